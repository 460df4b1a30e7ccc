"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licenses, linededup, packing, quality, resampling, sharding, simhash, toxicity, trie, urls
from .common import cut, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds plain turns; what stands for calls and results is said in ``chat.from_turns``."""
    turns = table(spark, sf_dir, "conversations")
    schemas = spark.createDataFrame(chat.TOOLS, "tool string, field string, type string, required boolean")
    return chat.format_chat(turns.select("conv_id", "turn", "role", "text"), *chat.from_turns(turns), schemas)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return done.select("doc_id", "lines_removed", F.char_length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "toxicity.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).select("doc_id", "bpe.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = trie.rebuilt(cut(trie.ordered(table(spark, sf_dir, "conversations"))))
    return trie.prefix_trie(rows, convs)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _spelled_sql(canon: str) -> str:
    for a, b in licenses.SPELLINGS:
        canon = f"replace({canon}, '{a}', '{b}')"
    return canon


def _canonical_sql(text: str) -> str:
    return _spelled_sql(f"regexp_replace(regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')")


def _licenses_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [(k, "text", t) for k, t in licenses.TEXTS.items()] + [(k, "notice", t) for k, own in licenses.NOTICES.items() for t in own]
    values = ", ".join(f"({quoted(k)}, {quoted(kind)}, {quoted(t)})" for k, kind, t in rows)
    whole = lambda c: _spelled_sql(f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))")
    return f"""
with known as (select license, kind, sha256({whole(_canonical_sql('body'))}) as digest from (values {values}) k(license, kind, body)),
canon as (select doc_id, {_canonical_sql('text')} as c from documents),
units as (select doc_id, 'text' as kind, {whole('c')} as u from canon union all select doc_id, 'notice', trim(unnest(string_split(c, chr(10)))) from canon),
hits as (select doc_id, min(case when kind = 'text' then license end) as whole, string_agg(distinct license, ',' order by license) filter (kind = 'notice') as notices
  from (select doc_id, kind, sha256(u) as digest from units where u <> '') join known using (kind, digest) group by doc_id)
select d.doc_id, h.whole, coalesce(h.notices, '') as notices from documents d left join hits h using (doc_id)"""


OPERATORS = (op1_url_filter, op2_chat, op3_decontamination, op4_line_dedup, op5_toxicity, op6_bpe, op7_quality, op8_simhash, op9_sharding, op10_licenses, op11_packing, op12_prefix_trie, op13_resampling)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {
    "op1_url_filter": r"""
with cut as (
  select page_id, case when contains(url, '://') then regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') else '' end as raw,
         case when contains(url, '://') then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path from pages),
u as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut),
rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
keys as (select distinct host, path from u),
best as (
  select k.host, k.path, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from keys k join rules r on (k.host = r.host or ends_with(k.host, '.' || r.host)) and starts_with(k.path, r.path) group by all)
select u.page_id, u.host, u.path, b.rule,
  coalesce(b.verdict, case when regexp_matches(u.host || u.path, '(?:^|\.)(?:ads-track|doubleclick|adserver)\.|/ads/|/banners?/|(?:^|[./-])(?:casino|porn)[./-]|\.exe$|/wp-login\.php$') then 'block' else 'allow' end) as verdict
from u left join best b on u.host = b.host and u.path = b.path""",
    "op10_licenses": _licenses_sql(),
    "op12_prefix_trie": """
with own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as d, coalesce(role, '') || chr(1) || coalesce(text, '') as k, length(coalesce(text, '')) as n from conversations where conv_id is not null),
heads as (select c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda acc, b:
  list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) % 6 as h from (select distinct c from own)),
turns as (select h.c, 0 as part, b.d, b.k, b.n from heads h join own b on b.c = h.c - h.c % 100 and b.d <= h.h union all select h.c, 1, o.d, o.k, o.n from heads h join own o on o.c = h.c and o.d > h.h),
paths as (select h.c, coalesce(list({'k': t.k, 'n': t.n} order by t.part, t.d) filter (t.c is not null), []) as p from heads h left join turns t on t.c = h.c group by h.c),
prefixes as (select c, p, unnest(range(len(p) + 1)) as d from paths),
nodes as (select p[:d] as path, d, min(c) as conv_id, count(*) as n_convs, string_agg(c::varchar, ',' order by c) filter (len(p) = d) as ids from prefixes group by p[:d], d),
kids as (select path[:d - 1] as path, count(*) as n from nodes where d > 0 group by 1),
tree as (select n.*, coalesce(k.n, 0) as n_children, case when n.d > 0 then n.path[n.d].n * (n.n_convs - 1) else 0 end as own from nodes n left join kids k on k.path = n.path),
below as (select a.path, sum(b.own)::bigint as saved_tokens, count(*) filter (b.n_children = 0) as n_leaves from tree a join tree b on b.d >= a.d and b.path[:a.d] = a.path group by a.path)
select t.conv_id, t.d as depth, u.conv_id as parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(t.ids, '')) as ends_sha256
from tree t join below b on b.path = t.path left join tree u on t.d > 0 and u.d = t.d - 1 and u.path = t.path[:t.d - 1]""",
}
