"""Packing, the prefix trie and importance resampling against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import packing, resampling, trie
from wayline.llm.common import cut
from wayline.llm.queries import op11_packing, op12_prefix_trie, op13_resampling, vocabulary

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, RANK string, tokens string, _at long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)


# --- packing ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def check_packing(rows, texts, library, most_padding):
    """Every id of every row in one piece, sequences without gaps and overlaps; returns what is padded."""
    want = Counter()
    for i, t in texts:
        want[i] += 1
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == want.keys()
    for i, own in by_doc.items():
        if want[i] > 1:  # rows that share an id: their pieces can't be told apart, but add up
            assert sum(r["length"] for r in own) == sum(map(len, ids[i]))
            continue
        own, x, at = sorted(own, key=lambda r: r["start"]), ids[i][0], 0
        for r in own:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(x)
            assert r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(len(x) for v in ids.values() for x in v)
    assert padded <= most_padding * total
    return padded


def test_packing_query(spark, library):
    rows = op11_packing(spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packing(rows, texts, library, 0.02) >= 0


def test_packing_edges(spark, library):
    texts = [(0, None), (1, ""), (2, "a <|endoftext|> b"), (3, "\u0085 x  y dé​ 日本 I'LL don't"), (4, "word " * 6000), (5, "x" * 5000), (6, "same"), (6, "same"), (None, "nothing"), *[(10 + i, "one two three " * 300) for i in range(40)]]
    got = packing.pack(docs(spark, texts), vocabulary())
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and {t for _, t in got.dtypes} == {"bigint"}
    check_packing(got.collect(), texts, library, 0.05)  # forty copies of one awkward length are cut
    assert packing.pack(docs(spark, []), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.encoder(open(vocabulary(), encoding="utf-8").read().replace('"merges": [', '"merges": ["t h", ', 1).replace('"merges":[', '"merges":["t h",', 1))


def test_patterns_meet_the_demand_and_the_bound():
    random.seed(4)
    lengths = Counter(min(2047, int(random.lognormvariate(6.3, 1.0)) + 1) for _ in range(3000))
    of = packing.classes(lengths, 60)
    demand = Counter()
    for n, c in of.items():
        assert c >= n
        demand[c] += lengths[n]
    made = packing.patterns(dict(demand))
    filled = Counter()
    for p in made:
        assert sum(c * n for c, n in p.counts.items()) <= 2048
        for c, n in p.counts.items():
            filled[c] += n * p.times
    assert filled == demand and sum(p.times for p in made) <= 1.02 * sum(c * n for c, n in demand.items()) / 2048 + 1
    # the linear program of two sizes by hand: 1100 goes alone or with one 900, two 900s fit together
    lp = packing.relax([1100, 900], np.array([3.0, 5.0]), 2048)
    assert abs(sum(x for _, x in lp) - 4.0) < 1e-6


def test_knapsack_against_all_choices():
    random.seed(6)
    for _ in range(30):
        sizes, worth, most, room = [random.randrange(1, 12) for _ in range(4)], np.array([random.random() for _ in range(4)]), [random.randrange(0, 4) for _ in range(4)], random.randrange(1, 30)
        best = max(sum(n * w for n, w in zip(ns, worth)) for ns in np.ndindex(*[m + 1 for m in most]) if sum(n * s for n, s in zip(ns, sizes)) <= room)
        value, counts = packing.knapsack(sizes, worth, most, room)
        assert abs(value - best) < 1e-9 and abs(sum(worth[k] * n for k, n in counts.items()) - best) < 1e-9 and sum(sizes[k] * n for k, n in counts.items()) <= room


# --- the trie ---------------------------------------------------------------------------------------------------


def test_find_close():
    random.seed(3)
    for n in (1, 2, 50, 3000):
        bits, depth = [], 0
        while len(bits) < n:
            up = depth == 0 or random.random() < 0.5
            bits.append(up)
            depth += 1 if up else -1
        bits += [False] * depth
        stack, want = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert [want[i] for i in opens.tolist()] == trie.Parentheses(np.array(bits)).find_close(opens).tolist()


def plain_trie(turns):
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    conv = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        conv[c] = own.get(c - c % 100, [])[:h] + v[h:]
    nodes, kids, out = {}, {}, []
    for c, v in conv.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        under = [below(c) for c in kids.get(k, [])]
        leaves, saved = sum(a for a, _ in under) or 1, sum(b for _, b in under) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(conv[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids.get(k, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    sys.setrecursionlimit(10_000)
    if nodes:
        below(())
    return sorted(out, key=lambda r: (r[1], r[0]))


def ask(spark, turns):
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, d int, P string")
    got = trie.prefix_trie(*trie.rebuilt(cut(trie.ordered(df)))).collect()
    return sorted(map(tuple, got), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("places, block, ids", [(200_000, 1024, 65_536), (5, 3, 3)])
def test_trie_against_brute_force(spark, places, block, ids, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(trie, "BLOCK_IDS", ids)
    random.seed(places)
    turns = []
    for c in [0, 100, *random.sample(range(1, 400), 60)]:
        for t in range(random.choice([1, 3, 8, 40])):
            turns.append((c, None if t == 0 else t, random.choice(["user", None, ""]), random.choice(["a", "bb", None, "c"])))
    turns += [(c, t, "u", "same") for c in range(500, 540) for t in range(7)] + [(None, 1, "u", "x")]
    made = trie._shards
    monkeypatch.setattr(trie, "_shards", lambda batches: (setattr(trie, "SHARD_PLACES", places), made(batches))[1])
    assert ask(spark, turns) == plain_trie(turns)


def test_trie_edges(spark):
    assert ask(spark, []) == []
    only = [(7, 1, "u", "x"), (7, 1, "u", "x"), (7, None, None, None)]
    assert ask(spark, only) == plain_trie(only)
    gone = [(c, 1, "u", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]  # no conversation 0: nothing is left of them
    assert ask(spark, gone) == plain_trie(gone) and len(plain_trie(gone)) == 1
    long = [(c, t, "u", f"{t % 7}{'!' * (c == 3 and t == 2900)}") for c in (1, 2, 3) for t in range(3000)]
    assert ask(spark, long) == plain_trie(long)


def test_trie_query(spark):
    got = sorted(map(tuple, op12_prefix_trie(spark, SF).collect()), key=lambda r: (r[1], r[0]))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == plain_trie(list(map(tuple, turns))) and len(got) > 200


# --- resampling -------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_importance(rows, target):
    s, t, found = Counter(), Counter(), []
    for i, text in rows:
        n, crcs = plain_features(text)
        found.append((i, n, crcs))
        s.update(c % 10_000 for c in crcs)
    for text in target:
        t.update(c % 10_000 for c in plain_features(text)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)}
    out = []
    for i, n, crcs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % 10_000] for c in crcs)
        out.append((i, n, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = Counter()
    rank = {}
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        rank.setdefault(r[0], []).append(k + 1)
    rows = []
    for r in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = rank.get(r[0], [])
        rows.append((r[0], r[2], r[3], r[4], own[drawn[r[0]]] if drawn[r[0]] < len(own) and r[1] >= 20 else None))
        drawn[r[0]] += 1
    return rows


def key(r):
    return r[0] is not None, r[0] or 0, r[4] is None, r[4] or 0


@pytest.mark.parametrize("block", [1 << 20, 1000, 64])
def test_features_against_plain_hashing(block, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", block)
    random.seed(block)
    texts = ["".join(random.choice("abC éß,.日 \n1") for _ in range(random.randrange(300))) for _ in range(100)] + ["", "a", "x" * 700 + " y " + "z" * 5000, " , "]
    words, crcs = [0] * len(texts), [[] for _ in texts]
    for of_word, of_feature, found in resampling.features([t.encode() for t in texts]):
        for i in of_word.tolist():
            words[i] += 1
        for i, c in zip(of_feature.tolist(), found.tolist()):
            crcs[i].append(c)
    for i, t in enumerate(texts):
        n, want = plain_features(t)
        assert words[i] == n and sorted(crcs[i]) == sorted(want)


def test_resampling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = op13_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_importance(rows, target), key=key)


def test_resampling_edges(spark):
    random.seed(9)
    rows = [(i, " ".join(random.choice(["alpha", "beta", "Gamma", "délta"]) for _ in range(random.randrange(60)))) for i in range(300)]
    rows += [(1000, "tie " * 30)] * 25 + [(None, "nobody " * 40), (2000, None), (2001, ""), (2002, "!?"), (2003, "y" * 300_000)]
    target = ["tie tie alpha", None]
    df, goal = docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance(df, goal)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_importance(rows, target), key=key)
    drawn = resampling.resample(df, goal)
    assert drawn.columns == [*df.columns, "_rank"] and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in plain_importance(rows, target) if r[4]}
    assert resampling.importance(docs(spark, []), goal).count() == 0
    assert sorted(map(tuple, resampling.importance(df, goal.limit(0)).collect()), key=key) == sorted(plain_importance(rows, []), key=key)
    assert df.select(F.max("doc_id")).first()[0] == 2003
