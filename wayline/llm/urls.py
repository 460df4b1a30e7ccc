"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a regular expression over host and path with literal tokens (runs of letters and digits, bounded on both sides)
that any URL it fits must hold. Each rule is filed under the one that fewest URLs have. A URL's tokens fetch
candidate rules, and only these run. The longest matching rule decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Up to so many rules sit in the plan as literals; more are a table that is joined.
INLINE = 256


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str  # over host and path
    tokens: tuple[str, ...]
    rank: int  # the highest matching rule decides; ties go to the first


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits a host with all of its subdomains where the path starts so. Tokens at the path's open end don't count."""
    closed = path if not path[-1:].isalnum() else path[: re.search(r"[A-Za-z0-9]*$", path).start()]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens_of(host + closed)), 1_000_000 + len(host + path))


def pattern_rule(verdict: str, name: str, pattern: str, tokens: tuple[str, ...]) -> Rule:
    return Rule(name, verdict, pattern, tokens, 0)


def tokens_of(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


HOST_RULES = [
    host_rule("allow", "com"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"),
]
#: For URLs that no host rule fits: advertising, trackers, adult sites, downloads. Without any of these a URL is allowed.
PATTERN_RULES = [
    pattern_rule("block", "ads-track", r"(?:^|\.)ads-track\.", ("ads", "track")),
    pattern_rule("block", "doubleclick", r"(?:^|\.)doubleclick\.", ("doubleclick",)),
    pattern_rule("block", "adserver", r"(?:^|\.)adserver\.", ("adserver",)),
    pattern_rule("block", "/ads/", r"/ads/", ("ads",)),
    pattern_rule("block", "/banner/", r"/banner/", ("banner",)),
    pattern_rule("block", "/banners/", r"/banners/", ("banners",)),
    pattern_rule("block", "casino", r"(?:^|[./-])casino[./-]", ("casino",)),
    pattern_rule("block", "porn", r"(?:^|[./-])porn[./-]", ("porn",)),
    pattern_rule("block", ".exe", r"\.exe$", ("exe",)),
    pattern_rule("block", "wp-login", r"/wp-login\.php$", ("wp", "login", "php")),
]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit("([a-z0-9]+)"), 1))


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs: as many numbers as there are tokens in rules."""
    own = sorted({t for r in rules for t in r.tokens})
    found = pages.select(F.explode(F.array_intersect(_tokens(host_of(F.col(url_col)), path_of(F.col(url_col))), F.array(*map(F.lit, own)))).alias("t"))
    return {r["t"]: r["count"] for r in found.groupBy("t").count().collect()}


def file_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers under each rule's rarest token; rules without tokens under ''."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", []).append(i)
    return index


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", counts: dict[str, int] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict in a struct ``judged``.

    ``rules``: the host rules and patterns above by default. A null url and one without :// have empty host and path, fit
    no rule and are allowed; urls of any length are read whole. A column ``judged`` is replaced, all others pass through, whatever their names. Each row is judged by itself: repeated rows agree, nothing is grouped, an empty
    table gives none. A rule list beyond INLINE is joined on tokens instead, with equal results.
    """
    rules = HOST_RULES + PATTERN_RULES if rules is None else rules
    index = file_rules(rules, token_counts(pages, rules, url_col) if counts is None else counts)
    host, path, best = fresh(pages, "host"), fresh(pages, "path"), fresh(pages, "best")
    base = pages.withColumn(host, host_of(F.col(url_col))).withColumn(path, path_of(F.col(url_col)))
    held = _inline(base, rules, index, host, path, best) if len(rules) <= INLINE else _joined(base, rules, index, host, path, best)
    name = F.when(F.col(f"{best}.rank") > 0, F.col(f"{best}.name"))
    judged = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), name.alias("rule"), F.coalesce(f"{best}.verdict", F.lit("allow")).alias("verdict"), F.col(f"{best}.name").alias("matched"))
    return held.withColumn("judged", judged).drop(host, path, best)


def _as_struct(rule: Rule, at: int) -> Column:
    return F.struct(F.lit(rule.rank).alias("rank"), F.lit(-at).alias("first"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))


def _inline(base: DataFrame, rules: list[Rule], index: dict[str, list[int]], host: str, path: str, best: str) -> DataFrame:
    shelf = F.create_map(*[x for t, own in index.items() for x in (F.lit(t), F.array(*[_as_struct(rules[i], i) for i in own]))])
    tokens = F.array_intersect(F.concat(_tokens(F.col(host), F.col(path)), F.array(F.lit(""))), F.array(*map(F.lit, index)))
    fetched = F.flatten(F.transform(tokens, lambda t: F.element_at(shelf, t)))
    fitting = F.filter(fetched, lambda r: F.regexp_like(F.concat(host, path), r["pattern"]))
    return base.withColumn(best, F.array_max(fitting))


def _joined(base: DataFrame, rules: list[Rule], index: dict[str, list[int]], host: str, path: str, best: str) -> DataFrame:
    """The same by a join of URL tokens with the rule table; URLs are grouped by host and path, partly before the shuffle."""
    spark = base.sparkSession
    rows = [(t, rules[i].rank, -i, rules[i].name, rules[i].verdict, rules[i].pattern) for t, own in index.items() for i in own]
    shelf = spark.createDataFrame(rows, "token string, rank int, first int, name string, verdict string, pattern string")
    urls = base.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    fetched = urls.withColumn("token", F.explode(F.concat(_tokens(F.col("h"), F.col("p")), F.array(F.lit(""))))).join(shelf, "token")
    fitting = fetched.where(F.regexp_like(F.concat("h", "p"), F.col("pattern")))
    found = fitting.groupBy(F.col("h").alias(host), F.col("p").alias(path)).agg(F.max(F.struct("rank", "first", "name", "verdict", "pattern")).alias(best))
    return base.join(found, [host, path], "left").select(*[f"`{c}`" for c in base.columns], best)
