"""Operators in DataFrame form against brute force, and their edge cases."""

import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wayline.llm import chat, licenses, linededup, sharding, toxicity, urls
from wayline.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 30)]
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(300, 330)} == {300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def edited(s, k):
    s = list(s)
    for _ in range(k):
        p, o = random.randrange(len(s)), random.random()
        if o < 0.4:
            s[p] = random.choice("xyz ")
        elif o < 0.7:
            s.insert(p, random.choice("xyz "))
        elif len(s) > 26:
            s.pop(p)
    return "".join(s)


@pytest.mark.parametrize("crowd, huge", [(32, 4000), (2, 8)])
def test_line_links_against_all_pairs(spark, crowd, huge, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "HUGE", huge)
    random.seed(5)
    base = ["".join(random.choice("abcdé ") for _ in range(random.randrange(25, 110))) for _ in range(20)]
    lines = set(base) | {edited(b, k) for b in base for k in (1, 2, 3)} | {"the same beginning of a line, then " + "".join(random.choice("ab") for _ in range(8)) for _ in range(30)}
    lines = sorted(x for x in lines if len(x) >= linededup.MIN_CHARS)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("length"))
    text = {r["h"]: r["line"] for r in df.collect()}
    got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in linededup.line_links(df).collect()}
    assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2}


def test_line_dedup(spark):
    long1, long2 = "a line that is long enough to take part", "another line that is long enough as well"
    near = long1.replace("enough", "enaugh")
    rows = [f"{long1}\nshort\n{long1}", f"first\n{near}\nshort", long2, f"{long2}\nrest", None, "", "short\nshort", long1]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {0: (f"{long1}\nshort", 1), 1: ("first\nshort", 1), 2: (long2, 0), 3: ("rest", 1), 4: (None, 0), 5: ("", 0), 6: ("short\nshort", 0), 7: ("", 1)}
    twice = docs(spark, rows).union(docs(spark, rows))
    assert linededup.dedup_lines(twice).count() == 2 * len(rows)
    assert sorted(r["doc_id"] for r in linededup.drop_repeats(docs(spark, rows)).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_short_lines_take_part(spark, tmp_path):
    foot = "All rights reserved."
    rows = [f"Menu\n{foot}\nhome page, first visit\n\nok", f"Menu\n \nhome page, first visits\n{foot}\n\nno", "Menu\n\n\nMenu", "home page, fixed visit\nMen", None, "", "home page, first visitxy"]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in linededup.dedup_lines(docs(spark, rows), short=True).collect()}
    assert got == {0: (rows[0], 0), 1: (" \n\nno", 3), 2: ("\n", 2), 3: (rows[3], 0), 4: (None, 0), 5: ("", 0), 6: (rows[6], 0)}
    assert sorted(r["doc_id"] for r in linededup.drop_repeats(docs(spark, rows), short=True).collect()) == [0, 1, 3, 4, 5, 6]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    from wayline.llm.queries import op4_line_dedup

    assert {r["doc_id"]: r["lines_removed"] for r in op4_line_dedup(spark, str(tmp_path)).collect()} == {i: n for i, (_, n) in got.items()}


@pytest.mark.parametrize("crowd, huge", [(32, 4000), (2, 8)])
def test_short_links_against_all_pairs(spark, crowd, huge, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "HUGE", huge)
    random.seed(8)
    base = ["".join(random.choice("abcdé ") for _ in range(random.randrange(12, 26))) for _ in range(40)]
    lines = {edited(b, k)[:25].ljust(12, "z") for b in base for k in (0, 1, 1, 2)} | {"beginning, " + "".join(random.choice("ab") for _ in range(6)) for _ in range(40)}
    lines = sorted(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("length"))
    text = {r["h"]: r["line"] for r in df.collect()}
    got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in linededup.line_links(df, 1, linededup.NEAR_CHARS).collect()}
    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if levenshtein(a, b) <= 1}
    assert want and got == want


def test_line_dedup_columns_and_brute_force(spark):
    """Removal against all pairs of lines; columns named like ours pass through; long lines, nulls, repeated rows."""
    random.seed(17)
    line = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n)).strip() or "x"
    base = [line(random.choice((8, 14, 30, 60, 120))) for _ in range(30)] + [line(9000)]
    texts = ["\n".join(edited(random.choice(base), random.choice((0, 0, 1, 2))) if random.random() < 0.7 else line(40) for _ in range(random.randrange(1, 7))) for _ in range(40)] + [None, "", "\n\n"]
    places = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    kinds = sorted({x for _, _, x in places})
    root = {x: x for x in kinds}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            most = 2 if min(len(x), len(y)) >= 25 else 1 if min(len(x), len(y)) >= 12 else 0
            if abs(len(x) - len(y)) <= most and (most and max(len(x), len(y)) < 5000 or x == y) and levenshtein(x, y) <= most:
                root[find(x)] = find(y)
    stay, want = set(), {}
    for d, p, x in places:
        if find(x) not in stay:
            stay.add(find(x))
            want.setdefault(d, set()).add(p)
    frame = docs(spark, texts).withColumn("lines_removed", F.lit(-1)).withColumn("_id", F.lit("i")).withColumn("_row", F.lit("r")).withColumn("gone", F.lit("g")).withColumn("h1", F.lit(1))
    out = linededup.dedup_lines(frame.union(frame.where("doc_id = 3")), short=True)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns.count("lines_removed") == 1 and out.count() == len(texts) + 1 and set(out.columns) == set(frame.columns)
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for p, x in enumerate(lines) if not x.strip() or p in want.get(d, set())]
        assert rows[d]["text"] == (None if t is None else "\n".join(left)) and rows[d]["lines_removed"] == len(lines) - len(left), (d, t)
    dropped = linededup.drop_repeats(frame, short=True)
    assert dropped.columns == frame.columns and dropped.where("lines_removed = -1").count() == dropped.count() and linededup.drop_repeats(frame.limit(0)).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    random.seed(4)
    texts = ["x" * int(random.expovariate(1 / 300)) + str(i) for i in range(3000)] + ["a copy of this"] * 200 + [None, ""]
    rows = sharding.shard(docs(spark, texts), 16).collect()
    total, by, slots, where = 0, {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        total += r["size"]
        by[r["shard"]] = by.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(t, set()).add(r["shard"])
    assert len(rows) == len(texts) and set(by) == set(range(16))
    assert max(by.values()) <= 1.05 * total / 16 and min(by.values()) >= 0.95 * total / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())


def test_cuts_follow_metadata(spark):
    """The tree against its rule: each node is cut along the dimension whose middle ninety percent are widest, near its weighted median."""
    random.seed(6)
    made = [("word " * random.randrange(1, 400), "é" * random.randrange(10, 900), "a b\n" * random.randrange(1, 300), "".join(random.choice("0123456789abc") for _ in range(random.randrange(5, 2000))))[i % 4] + str(i) for i in range(800)]
    docs_ = docs(spark, made)
    digest = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    dims = sharding.text_dimensions(F.col("text"))
    points = docs_.select((F.octet_length("text") + 1).cast("long").alias("size"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("tie"), *[F.shiftleft(d.cast("long"), 32).bitwiseOR(digest).alias(f"c{i}") for i, d in enumerate(dims)])
    splits, leaves = sharding.kd_tree(points, 16, len(dims))
    rows = [r.asDict() for r in points.collect()]
    quantile = lambda own, d, p: sorted(r[f"c{d}"] >> 32 for r in own)[max(0, -(-len(own) * p // 100) - 1)]
    whole = {d: max(1, quantile(rows, d, 95) - quantile(rows, d, 5)) for d in range(len(dims))}
    nodes, total = {1: rows}, sum(r["size"] for r in rows)
    assert len(splits) == 15 and sorted(leaves.values()) == list(range(16)) and len({s.dim for s in splits}) >= 3
    for s in sorted(splits, key=lambda s: s.node):
        own = nodes.pop(s.node)
        widths = [(quantile(own, d, 95) - quantile(own, d, 5)) / whole[d] for d in range(len(dims))]
        assert widths[s.dim] >= 0.95 * max(widths)
        at = lambda r, s=s: (r[f"c{s.dim}"], r["tie"] if s.tie is not None and r[f"c{s.dim}"] == s.value else 0) <= (s.value, s.tie or 0)
        left = [r for r in own if at(r)]
        nodes[2 * s.node], nodes[2 * s.node + 1] = left, [r for r in own if not at(r)]
        assert abs(sum(r["size"] for r in left) - sum(r["size"] for r in own) / 2) <= max(r["size"] for r in own) + 0.002 * total / 16


def test_a_huge_group_is_cut(spark):
    rows = sharding.shard(docs(spark, ["same text"] * 1000 + ["t%d" % i for i in range(50)]), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in rows]
    assert len(sizes) == 8 and max(sizes) <= 1.1 * sum(sizes) / 8


def test_shards_of_few_rows(spark):
    assert sharding.shard(docs(spark, []), 16).count() == 0
    assert sharding.shard(docs(spark, ["a", "b"]), 16).count() == 2
    clash = docs(spark, ["a", "b"]).withColumn("shard", F.lit(9)).withColumn("size", F.lit("x"))
    assert sharding.shard(clash, 2).count() == 2


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://m.example.com/EN/", "x://b.net/es/1#f", "http://b.net", "no scheme", None, "http://ads-track.example.org/a", "http://c.org/setup.exe", "http://h.org?p=/en/", "a://b://c.com/"]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: r["judged"] for r in urls.judge_urls(pages).collect()}
    assert [got[i]["rule"] for i in range(8)] == ["com/", "example.com/en/", "www.example.com/en/", "com/", "net/es/", None, None, None]
    assert [got[i]["verdict"] for i in range(8)] == ["allow", "block", "allow", "allow", "block", "allow", "allow", "allow"]
    assert (got[1]["host"], got[1]["path"]) == ("example.com", "/en/1") and (got[6]["host"], got[7]["path"]) == ("", "")
    assert [got[i]["verdict"] for i in (8, 9)] == ["block", "block"] and (got[10]["host"], got[10]["path"]) == ("h.org", "")
    assert (got[11]["host"], got[11]["path"]) == ("b:", "//c.com/")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_many_rules_are_joined_with_equal_results(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string")
    few = {r["page_id"]: r["judged"] for r in urls.judge_urls(pages).collect()}
    monkeypatch.setattr(urls, "INLINE", 1)
    assert {r["page_id"]: r["judged"] for r in urls.judge_urls(pages).collect()} == few


def test_rules_are_filed_under_their_rarest_token():
    index = urls.file_rules([urls.host_rule("block", "example.com", "/en/")], {"example": 9, "com": 20, "en": 3})
    assert index == {"en": [0]} and urls.host_rule("allow", "a.b", "/open").tokens == ("a", "b")


#: URLs without a host rule, for every alternative of each pattern rule, with near misses.
PATTERN_URLS = {
    "ads-track": ["http://ads-track.org/", "http://x.ads-track.org/", "http://xads-track.org/"],
    "doubleclick": ["http://doubleclick.org/", "http://x.doubleclick.org/a", "http://doubleclicks.org/"],
    "adserver": ["http://adserver.org/", "http://x.adserver.org/a", "http://adservers.org/"],
    "/ads/": ["http://h.org/ads/a", "http://h.org/x/ads/", "http://h.org/ads"],
    "/banner/": ["http://h.org/banner/a", "http://h.org/x/banner/", "http://h.org/banner"],
    "/banners/": ["http://h.org/banners/a", "http://h.org/x/banners/", "http://h.org/bannerss/"],
    "casino": [f"http://{a}casino{b}org/" for a in ("", "x.", "x-") for b in (".", "-")] + ["http://h.org/casino/", "http://h.org/a-casino.b", "http://h.org/casinos/"],
    "porn": [f"http://{a}porn{b}org/" for a in ("", "x.", "x-") for b in (".", "-")] + ["http://h.org/porn/", "http://h.org/a-porn.b", "http://h.org/porns/"],
    ".exe": ["http://h.org/a.exe", "http://h.org/.exe", "http://h.org/a.exe/b"],
    "wp-login": ["http://h.org/wp-login.php", "http://h.org/a/wp-login.php", "http://h.org/wp-login.php5"],
}


@pytest.mark.parametrize("inline", [256, 1])
def test_pattern_rules_agree_with_and_without_the_index(spark, monkeypatch, inline):
    import re

    monkeypatch.setattr(urls, "INLINE", inline)
    assert set(PATTERN_URLS) == {r.name for r in urls.PATTERN_RULES}
    made = [u for own in PATTERN_URLS.values() for u in own]
    got = {r["url"]: r["judged"] for r in urls.judge_urls(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()}
    for name, own in PATTERN_URLS.items():
        for at, u in enumerate(own):
            fits = [r.name for r in urls.PATTERN_RULES if re.search(r.pattern, u.split("://", 1)[1])]
            assert got[u]["matched"] == (fits[0] if fits else None) and got[u]["verdict"] == ("block" if fits else "allow")
            assert (fits == [name]) == (at < len(own) - 1)


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    other = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace("\n\n", "\n \n  ")
    rows = licenses.scan(docs(spark, [mit, other, mit + " more", None, "", "Text.\nreleased UNDER the MIT Licence\nLicensed under the Apache License, Version 2.0"])).collect()
    got = {r["doc_id"]: (r["whole"], r["notices"]) for r in rows}
    assert got[0][0] == got[1][0] == "MIT" and got[2][0] is None and got[3] == got[4] == (None, "") and got[5] == (None, "Apache-2.0,MIT")
    assert licenses.scan(docs(spark, [])).count() == 0 and licenses.scan(docs(spark, [mit, mit])).count() == 2


def test_wrapped_licenses_are_recognised(spark):
    """Texts wrapped at any width, behind a copyright line, in other case; bodies that differ in a word are not recognised."""
    import textwrap

    rows, want = [], []
    for name, body in licenses.TEXTS.items():
        for width in (*range(50, 84, 3), 400):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in body.split("\n\n"))
            rows.append(random.choice(("Copyright (c) 2020 A. Person\n\n", "copyright 2019-2021, Some Company Ltd.\n", "© A Person\n", "")) + wrapped)
            want.append(name)
        rows.append(body + " extra")
        want.append(None)
    got = [r["whole"] for r in licenses.scan(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == want and len(licenses.TEXTS) >= 15
    plain = spark.range(1).select(*[licenses.canonical(F.lit(t)) for t in ("Copyright holders may do this.", "copyright notice, this list", "Copyright: 2001 X", "(c) X")]).first()
    assert tuple(plain) == ("copyright holders may do this", "copyright notice this list", "", "")



def test_toxicity(spark):
    random.seed(6)
    vocab = ["w%s" % "".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(1200):
        words = [random.choice(vocab) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                words[random.randrange(60)] = "zqrux" + random.choice(["an", "or", "il"])
        texts.append(" ".join(words) + ".")
        labels.append((i, 1, int(i % 5 == 0)))
    model = toxicity.learn(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = toxicity.score(docs(spark, texts + [None, ""]), model).select("doc_id", "toxicity.*").collect()
    held = [r for r in rows if r["doc_id"] < 1200 and toxicity.held_out(r["doc_id"])]
    assert held and sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows) and not rows[-1]["predicted"]
    assert toxicity.learn(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))[0] == {}


def test_clauses_weigh_what_is_said():
    g = toxicity.Grammar({})
    one = lambda t: sum(g.clauses(t))
    assert one("a fine day.") == 0 and one("I will kill time.") == 0
    assert one("You are an idiot.") > one("What an idiot.") > one("He is not an idiot") * 0.99 > 0
    assert one("She said you idiot.") < one("you idiot.") and one("to you I will kill") > 0
    assert len(g.clauses("You idiot. You moron!")) == 2


def test_clauses_against_a_plain_reading():
    """The composed table against the rule, mark by mark."""
    random.seed(12)
    for _ in range(3000):
        said = [(random.choice(toxicity.MARKS), random.choice((0.5, 1.0, 2.0))) for _ in range(random.randrange(1, 7))]
        target, total, hit = any(m == "target" for m, _ in said), 0.0, False
        for i, (mark, weight) in enumerate(said):
            if mark == "insult" or mark == "threat" and target:
                spoken = [m for m, _ in said[:i]]
                last = max([k for k, m in enumerate(spoken) if m in ("insult", "threat")], default=-1)
                total += weight * (toxicity.NEGATED if "negation" in spoken[last + 1 :] else 1) * (toxicity.REPORTED if "report" in spoken else 1)
                hit = True
        got = toxicity._weigh(said)
        assert len(got) == hit and (not hit or abs(got[0] - total * (toxicity.WITH_TARGET if target else 1)) < 1e-9), said


def test_threats_count_on_either_side_of_their_target():
    g = toxicity.Grammar({})
    one = lambda t: sum(g.clauses(t))
    assert one("I will kill you.") == one("you I will kill.") > 0 and one("kill them") > 0
    assert 0 < one("I will not kill you.") < one("I will kill you.")
    assert one("I will kill time. You wait.") == 0 and len(g.clauses("I will kill you. Kill them!")) == 2


def run_chat(spark, messages, calls, results, schemas):
    m = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, arguments string, waits_for array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    s = spark.createDataFrame(schemas, "tool string, field string, type string, required boolean")
    return chat.format_chat(m, c, r, s).collect()


def test_chat_links_orders_and_validates(spark):
    schemas = [("f", "b", "BIGINT", True), ("f", "a", "STRING", False)]
    calls = [(1, 2, "c1", "f", '{"b": 1,  "a":"x"}', []), (1, 1, "c2", "f", '{"a": 2}', ["c1"]), (1, 5, "c3", "g", "{}", []), (1, 6, "c1", "f", '{"b":1}', []), (2, 1, "x", "f", "not json", ["y"]), (2, 2, "y", "f", '{"b":1,"z":0}', ["x"])]
    results = [(1, 3, "c1", "ok"), (1, 0, "c2", "early"), (1, 9, "lost", None), (2, 3, "x", "r"), (2, 4, "y", "r")]
    rows = run_chat(spark, [(1, 0, "user", "hi\n"), (1, 1, None, None)], calls, results, schemas)
    at = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in rows}
    assert len(rows) == 13
    key = lambda *k: (at[k]["key_turn"], at[k]["key_step"])
    assert key(1, "call", "c1", 2) < key(1, "result", "c1", 3) < key(1, "call", "c2", 1) < key(1, "result", "c2", 0)
    assert at[1, "call", "c1", 2]["json"] == '{"arguments":{"a":"x","b":1},"id":"c1","name":"f","role":"assistant"}' and at[1, "call", "c1", 2]["problems"] == ""
    assert at[1, "call", "c2", 1]["problems"] == "missing b,type a" and at[1, "call", "c3", 5]["problems"] == "unknown tool" and at[2, "call", "x", 1]["problems"] == "not an object"
    assert at[2, "call", "y", 2]["status"] == "circular" and at[1, "call", "c1", 6]["status"] == "duplicate" and at[1, "call", "c3", 5]["status"] == "unanswered" and at[1, "result", "lost", 9]["status"] == "orphan"
    assert at[1, "message", None, 0]["json"] == '{"content":"hi\\n","role":"user"}' and json.loads(at[1, "message", None, 1]["json"]) == {}


def test_chat_of_empty_tables(spark):
    assert run_chat(spark, [], [], [], []) == []


def test_columns_of_all_names_pass(spark):
    """Tables with columns named like the operators' own."""
    chats = spark.createDataFrame([(1, 0, "user", "hi", "x", 9, "c", "late")], "conv_id long, turn long, role string, text string, call_id string, key_turn int, kind string, status string")
    calls = spark.createDataFrame([(1, 1, "a", "note", '{"query":"' + "long " * 5000 + '"}', [], "mine")], "conv_id long, turn long, call_id string, tool string, arguments string, waits_for array<string>, status string")
    results = spark.createDataFrame([(1, 2, "a", "done", "mine")], "conv_id long, turn long, call_id string, content string, problems string")
    schemas = spark.createDataFrame(chat.TOOLS, "tool string, field string, type string, required boolean")
    got = chat.format_chat(chats, calls, results, schemas).orderBy("key_turn", "key_step").collect()
    assert [(r["kind"], r["status"], r["call_id"], r["key_turn"]) for r in got] == [("message", "ok", None, 0), ("call", "ok", "a", 1), ("result", "ok", "a", 2)] and len(got[1]["json"]) > 25_000
    pages = spark.createDataFrame([("http://www.example.com/en/x", "mine", "p", "b"), (None, "h", "p", "b"), ("http://e.net/" + "x/" * 40_000, "h", "p", "b")], "url string, host string, path string, best string")
    for rules in (None, urls.HOST_RULES * 60):
        out = urls.judge_urls(pages, rules)
        assert out.columns == [*pages.columns, "judged"] and {r["judged"]["verdict"] for r in out.collect()} == {"allow"} and out.where("host = 'mine'").count() == 1
    frame = docs(spark, ["you idiot", None, "a " * 200_000]).withColumn("toxicity", F.lit("mine"))
    scored = toxicity.score(frame, ({}, 1.0, -1.5)).orderBy("doc_id").collect()
    assert scored[0]["toxicity"]["clauses"] == 1 and scored[1]["toxicity"]["score"] == scored[2]["toxicity"]["score"]
    odd = docs(spark, ["a b", None]).withColumn("shard", F.lit("mine")).withColumn("id", F.lit("mine"))
    assert sharding.shard(odd, 2).count() == 2 and licenses.scan(odd.withColumn("whole", F.lit("mine"))).count() == 2


def test_lines_of_replaced_words_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Many long lines that share a third and differ by whole words of the same letters: few pairs are left to verify, and no link is lost."""
    random.seed(9)
    words = ["the", "that", "enth", "on", "reth", "ing", "oneth", "hean", "and", "thish", "ates", "ined"]
    base = [random.choice(words) for _ in range(60)]
    lines = {" ".join(base)}
    while len(lines) < 100:
        new = list(base)
        for _ in range(random.choice((1, 1, 2))):
            new[random.randrange(20, 60)] = random.choice(words)
        lines.add(" ".join(new))
    lines = sorted(lines)
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("length"))
    text = {r["h"]: r["line"] for r in df.collect()}
    verified = []
    between = linededup._between
    monkeypatch.setattr(linededup, "_between", lambda pairs: verified.append(pairs.count()) or between(pairs))
    got = {tuple(sorted((text[r["a"]], text[r["b"]]))) for r in linededup.line_links(df).collect()}
    head = lambda a, b: len(os.path.commonprefix([a, b]))

    def apart(a, b):  # between the common beginning and the common end
        n = head(a, b)
        a, b = a[n:], b[n:]
        n = head(a[::-1], b[::-1])
        return levenshtein(a[: len(a) - n], b[: len(b) - n])

    want = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and apart(a, b) <= 2}
    assert want and got == want
    assert verified[0] < 0.3 * len(lines) ** 2 / 2, verified
