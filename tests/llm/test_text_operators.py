"""Word-level operators against brute force, round trips and edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayline.llm import bpe, decontam, quality, simhash
from wayline.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.load(open(vocabulary(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("abcu \n\t'sthe<|>é漢🙂0123==--"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_the_library(codec, reference, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_on_special_tokens_and_long_runs(codec, reference):
    for text in ("", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "a" * 500, "uuuu" * 40, "=" * 301, " " * 99, "don't we'll"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_bpe_query_columns(spark):
    got = {r["doc_id"]: r["bpe"] for r in bpe.round_trip(docs(spark, ["hi there", None, ""]).withColumn("bpe_", F.lit(1)), vocabulary()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0]["n_tokens"] == 2 and got[0]["decoded_sha256"] == hashlib.sha256(b"hi there").hexdigest()
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == empty
    assert bpe.round_trip(docs(spark, []), vocabulary()).count() == 0
    both = bpe.decode(bpe.encode(docs(spark, ["a b\nc", None]), vocabulary()), vocabulary()).orderBy("doc_id").collect()
    assert [r["decoded"] for r in both] == ["a b\nc", ""]


def plain_counts(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines, dup = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("ab c\n\t\x1c\x85é#*|\x0b"), max_size=60))
def test_quality_counts(text):
    assert quality.base_counts(text) == plain_counts(text)


def test_quality_verdicts(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(2, 9)))
    vocab = [word() for _ in range(400)]
    fine = " ".join(random.choice(vocab) for _ in range(300))
    rows = quality.quality(docs(spark, [fine, "only a few words", None, "", "spam " * 200, " ".join(w + "***" for w in ["ab", "cd"] * 200), fine])).orderBy("doc_id").collect()
    assert [r["quality"]["kept"] for r in rows] == [True, False, False, False, False, False, True]
    assert rows[2]["quality"]["n_words"] == 0 and rows[2]["quality"]["base_failed"]
    kept = quality.keep_good(docs(spark, [fine, "short", None]))
    assert kept.columns == docs(spark, []).columns and [r["doc_id"] for r in kept.collect()] == [0]
    assert quality.keep_good(docs(spark, [])).count() == 0


def plain_fingerprint(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(text=st.text(st.sampled_from("abAZÀ \n\t"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_golay_indices_meet_within_two_errors():
    x = np.arange(1 << 11, dtype=np.int64)
    own = [set(r) for r in simhash.codeword_indices(x).tolist()]
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    for e in errors:
        assert all(a & set(b) for a, b in zip(own, simhash.codeword_indices(x ^ e).tolist()))


def components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(fps))]


def test_near_duplicates_against_all_pairs(spark):
    random.seed(7)
    vocab = ["w%d" % i for i in range(50)]
    base = [[random.choice(vocab) for _ in range(80)] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [None, "", " \n", "one", "one", "two words"]
    for b in base[:12]:
        for _ in range(4):
            c = list(b)
            c[random.randrange(80)] = "x"
            texts.append(" ".join(c))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in range(len(texts))] == components(fps, list(range(len(texts))))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_crowded_fingerprints_are_linked(spark):
    random.seed(2)
    center = random.getrandbits(64)
    fps = {center} | {center ^ 1 << i for i in range(40)} | {center ^ 1 << i ^ 1 << j for i in range(8) for j in range(i)} | {random.getrandbits(64) for _ in range(30)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    from wayline.llm.common import components as cc

    got = {r["node"]: r["root"] for r in cc(edges).collect()}
    want = components([f & (1 << 64) - 1 for f in signed], signed)
    assert [got.get(f, f) for f in signed] == want


def test_one_of_each_group_stays(spark):
    d = docs(spark, ["a b c d", "a b c d", "x y z q r"])
    assert sorted(r["doc_id"] for r in simhash.keep_one_each(d.union(d)).collect()) == [0, 2]


def test_leaks(spark):
    random.seed(3)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    items = [text(random.choice([13, 20, 30, 60])) for _ in range(40)] + ["tiny item", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    planted, rows = set(), []
    for i in range(120):
        body = text(random.randrange(300))
        if i % 3 == 0:
            k = random.randrange(40)
            words = items[k].split()
            for _ in range(len(words) // 10 if i % 2 else 0):
                words[random.randrange(len(words))] = "edited"
            body = f"{text(random.randrange(50))} {' '.join(words).upper()}, {body}"
            planted.add((i, k))
        rows.append(body)
    rows += [None, "", "Here is a tiny item!"]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    assert len(planted & got) >= 0.95 * len(planted)
    assert (122, 40) in got and got - planted == {(122, 40)}
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0
    assert decontam.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontam.drop_leaky(docs(spark, rows), bench).count() == len(rows) - len({d for d, _ in got})


def test_leaks_against_brute_force(spark):
    """Every item against every stretch of every document, by a plain edit distance."""
    random.seed(14)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (3, 8, 10, 12, 15, 21)]
    rows = [text(25) for _ in range(12)]
    for k, x in enumerate(items):
        for e in (0, 1, 2):
            copy = list(x)
            for _ in range(e):
                copy[random.randrange(len(copy))] = "new"
            rows.append(text(k) + copy + text(4))
    want = {(d, i) for d, r in enumerate(rows) for i, x in enumerate(items) if min(edit_distance(x, r[a:b]) for a in range(len(r)) for b in range(a, min(len(r), a + len(x) + 3) + 1)) <= len(x) // 10}
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in enumerate(items)], "item_id long, text string, doc_id long")
    frame = docs(spark, [" ".join(r) for r in rows])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 12
    odd = frame.withColumn("leaky", F.lit("x")).withColumn("_Leaky", F.lit(1)).withColumn("leaky_", F.lit(2))
    kept = decontam.drop_leaky(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(rows))) - {d for d, _ in got}
    gaps = spark.createDataFrame([(None, " ".join(items[3])), (None, "clean"), (2**60 + 1, " ".join(items[3])), (5, None), (6, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.find_leaks(gaps, bench).orderBy("doc_id").collect()] == [None, 2**60 + 1] and sorted(r["doc_id"] for r in decontam.drop_leaky(gaps, bench).collect()) == [5, 6]


@pytest.mark.parametrize("place", ["start", "end", "even", "any"])
def test_edited_copies_are_found_by_length_and_place(place):
    random.seed(9)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    caught = total = 0
    for n in (1, 2, 5, 9, 10, 11, 12, 19, 20, 23, 47, 95, 190, 400):
        items = [text(n) for _ in range(12)] if n > 2 else [[f"w{n}x{i}"] * n for i in range(12)]
        index, e = decontam.build([(i, " ".join(x)) for i, x in enumerate(items)]), n // 10
        rows = []
        for x in items:
            at = {"start": range(e), "end": range(n - e, n), "even": [(k + 1) * n // (e + 1) for k in range(e)], "any": sorted(random.sample(range(n), e))}[place]
            words = list(x)
            for p in reversed(at):
                words[p : p + 1] = random.choice([["edited"], [], ["edited", words[p]]])
            rows.append([w.encode() for w in text(random.randrange(30)) + words + text(random.randrange(30))])
        found = decontam.leaks(index, rows)
        caught, total = caught + sum(i in [r[0] for r in f] for i, f in enumerate(found)), total + 12
        assert all(r[0] == i and r[1] <= e for i, f in enumerate(found) for r in f), n
        assert n >= 10 or all(len(f) == 1 for f in found)
    assert caught >= 0.97 * total


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_distance_in():
    words = lambda s: [c.encode() for c in s]
    for item, region, want in (("abc", "xxabcxx", 0), ("abc", "xxacxx", 1), ("abcd", "zabxdz", 1), ("abc", "", 3), ("abcdef", "badcfe", 3)):
        plain = min(edit_distance(item, region[a:b]) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        assert decontam.distance_in(words(item), words(region))[0] == plain <= want
    assert decontam.distance_in(words("abc"), words("xxabcxx")) == (0, 5)


def test_quality_bands_against_brute_force(spark):
    """Verdicts from the bands as they are described, for chunks at every place: ends of texts too."""
    import zstandard

    random.seed(8)
    vocab = ["".join(random.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(random.randrange(2, 9))) for _ in range(2500)]
    prose = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(n))
    junk = "buy now cheap pills " * 60
    rows = [prose(n) for n in (49, 50, 80, 300, 900, 5000)] + [prose(300) + " " + noise(70), noise(70), noise(40) + prose(2000), prose(600) + "\n" + junk, prose(450) + prose(30) * 4, junk, None, "", "x" * 70_000]
    size = lambda b: len(b) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(b))
    want = []
    for text in rows:
        data, words = (text or "").encode(), (text or "").split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 6000 else set()
        good = len(words) >= 50 and 100 * len(again) <= 50 * len(words)
        if good:
            low, high = quality.band_limits(len(data))
            ends = [*range(quality.CHUNK, len(data) + 1, quality.CHUNK)] + ([len(data)] if len(data) > quality.CHUNK else [])
            own = sorted(size(data[e - quality.CHUNK : e]) for e in sorted(set(ends)))
            good = low <= size(data) <= high and (not own or ((own[len(own) // 2] + own[(len(own) - 1) // 2]) / 2 <= quality.CHUNK_MEDIAN_MAX and own[-1] <= quality.CHUNK_MAX and own[0] >= quality.CHUNK_MIN))
        want.append(good)
    frame = docs(spark, rows).withColumn("kept", F.lit("mine")).withColumn("_kept", F.lit(1))
    got = [r["kept"] for r in quality.quality(docs(spark, rows)).orderBy("doc_id").select("quality.kept").collect()]
    assert got == want and want.count(True) >= 4 and not want[9]
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [i for i, g in enumerate(want) if g]
    assert quality.keep_good(frame.limit(0)).count() == 0


def test_copies_against_brute_force(spark):
    """Groups of texts with 0.8 of their five-word shingles in common, by comparing all pairs."""
    random.seed(21)
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    passage, rows = text(40), []
    for k in range(25):
        own = text(random.randrange(60, 200)) + (passage if k % 2 else [])
        rows.append(" ".join(own))
        for edits in (1, 2, 3, 5):
            copy = list(own)
            for _ in range(edits):
                copy[random.randrange(len(copy))] = random.choice(vocab)
            rows.append(" ".join(copy))
    hot = text(150)
    for _ in range(40):  # one large group of near copies
        copy = list(hot)
        copy[random.randrange(len(copy))] = random.choice(vocab)
        rows.append(" ".join(copy))
    rows += [rows[0], rows[3].upper(), None, "", "", "a b", "a b", "a c", "  "]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r or "").lower().split()) else set() for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            alike = (len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8) if grams[i] and grams[j] else (rows[i] or "") == (rows[j] or "")
            if alike:
                near += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(rows)) if find(i) == i}
    frame = docs(spark, rows).withColumn("node", F.lit("mine")).withColumn("_First_id", F.lit(1)).withColumn("first", F.lit(2))
    kept = simhash.keep_one_each(frame)
    got = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert near > 500 and kept.columns == frame.columns and len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 0.02 * (len(rows) - len(want))
    assert simhash.keep_one_each(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (7, "x y"), (7, "x y"), (7, "other words"), (None, "lonely")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one_each(odd).collect()), key=str) == [(7, "other words"), (7, "x y"), (None, "lonely")]


def test_parities_never_drop_a_copy(spark):
    """Sizes and parities against the shingles themselves, for texts of 1 to 6,000 words with edits around the threshold."""
    random.seed(9)
    pairs = []
    for n in (1, 4, 5, 9, 30, 100, 100, 100, 400, 6000):
        own = [f"w{random.randrange(5000)}" for _ in range(n)]
        for share in (0.0, 0.005, 0.015, 0.02, 0.025, 0.03, 0.1):
            copy = [f"v{random.randrange(5000)}" if random.random() < share else w for w in own]
            pairs += [(own, copy), (own, copy + copy[: int(0.2 * n)]), (own, own[: max(1, int(0.8 * n) + 1)])]
    rows = [(k, " ".join(x), " ".join(y)) for k, (x, y) in enumerate(pairs)]
    met = spark.createDataFrame(rows, "k long, x string, y string").select("k", simhash.sketch_column("x").alias("sx"), simhash.sketch_column("y").alias("sy"))
    near = simhash._may_be_copies("sx", "sy")
    got = {r["k"]: r for r in met.select("k", near.alias("near"), (simhash._apart("sx", "sy") <= simhash.COPY_BITS).alias("close")).collect()}
    alike = [simhash.similarity(simhash.shingles(x), simhash.shingles(y)) for _, x, y in rows]
    assert all(got[k]["near"] == got[k]["close"] for k, s in enumerate(alike) if s >= simhash.COPY_SIMILARITY)
    dropped = [k for k, s in enumerate(alike) if s < 0.7 and got[k]["close"] and not got[k]["near"]]
    assert dropped and sum(s >= simhash.COPY_SIMILARITY for s in alike) > 50


def test_copy_segments_cover_the_fingerprint():
    import numpy as np

    limbs = [np.array([random.getrandbits(63)], np.int64) for _ in range(4)]
    whole = sum((int(x[0]) & (1 << 64) - 1) << (64 * i) for i, x in enumerate(limbs))
    assert [int(s[0]) for s in simhash.copy_segments(limbs)] == [whole >> (23 * i) & (1 << 23) - 1 for i in range(simhash.COPY_SEGMENTS)]


def test_bpe_batches_against_the_library():
    """Many texts at once: blanks, contractions, texts that are empty, longer than a batch, or hold special tokens."""
    from tokenizers import Tokenizer

    random.seed(4)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "Z", "é", "7", "٣", "!", "..", "’", "日本", "<|endoftext|>", "é", "😀"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(30))) for _ in range(3000)] + ["", "word " * 90_000, "x" * 2000, " " * 500]
    codec, library = bpe.load(open(vocabulary(), encoding="utf-8").read()), Tokenizer.from_file(vocabulary())
    got, want = codec.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(got, want))
    assert all(codec.decode(a) == library.decode(b.ids, skip_special_tokens=False) for a, b in zip(got, want))
