"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments A and B of 23 bits and C of 18. If two fingerprints differ in at
most two bits, then in some pair of segments they differ in at most one bit, so one segment of the pair is equal
and the other has at most one error. The equal one is taken as it is; the other is decoded with the binary
Golay code (23, 12) to the indices of all codewords within distance four (one or six of them), and
segments at distance two or less always share one of these indices. Fingerprints that share a key are verified.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from .common import components, cut, fresh

SEED = 42
DISTANCE = 2
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Up to so many fingerprints of one key are compared with each other; larger keys go through ``_crowded``.
CROWD = 16
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of three-word shingles, repeats included; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def _remainder(x: int) -> int:
    for i in range(22, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and for each remainder six error patterns of weight up to four (one alone is repeated)."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    unit = [_remainder(1 << i) for i in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= unit[i]
            found[s].append(sum(1 << i for i in bits))
    return low, high, np.array([(p * 6)[:6] for p in found], np.int64)


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """Six columns of 12-bit codeword indices for an array of 23-bit segments."""
    low, high, patterns = _golay()
    rest = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment[:, None] ^ patterns[rest]) >> 11


@F.pandas_udf(ArrayType(LongType()))
def fuzzy_keys(fingerprints: pd.Series) -> pd.Series:
    x = fingerprints.to_numpy(np.int64)
    parts = [(x >> at) & ((1 << size) - 1) for at, size in SEGMENTS]
    near = [codeword_indices(p) for p in parts]
    keys = [(np.int64(6 * p + q) << 40) | (parts[p][:, None] << 12) | near[q] for p in range(3) for q in range(3) if p != q]
    return pd.Series([np.unique(row) for row in np.concatenate(keys, axis=1)])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp``: every pair at distance two or less is joined by a path of them."""
    keys = cut(fps.select("fp", F.explode(fuzzy_keys("fp")).alias("key")))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    twos = sizes.where("n = 2").select("a", "b").where(close)
    few = keys.join(sizes.where(f"n > 2 and n <= {CROWD}").select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    few = few.select(F.explode(near).alias("e")).select("e.a", "e.b")
    many = keys.join(sizes.where(f"n > {CROWD}").select("key"), "key", "left_semi").select("fp").distinct()
    return twos.union(few).union(_crowded(many)).distinct()


def _crowded(fps: DataFrame) -> DataFrame:
    """Links within keys that many share, without comparing all pairs: fingerprints at distance two or less are
    those that reach a common value by changing at most one bit each. A value has at most 65 of them, and all of these
    are linked, so a star to the least one is enough."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    at = fps.select("fp", F.explode(F.concat(F.array("fp"), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))).alias("value"))
    least = at.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return at.join(least, "value").where("fp != b").select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: fingerprints at distance two or less are linked, and the
    component is named by its smallest id.

    A null or empty text has fingerprint zero and is linked like any other. Rows that repeat an id give a row each.
    A null id never names a component. An empty table gives no rows; other columns are ignored.
    """
    fps = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    member = components(fingerprint_links(nodes.select("fp")))
    linked = nodes.join(member, nodes.fp == member.node)
    names = linked.groupBy("root").agg(F.min("first").alias("name"))
    linked = linked.join(names, "root").select(F.col("node"), "name")
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    named = cut(named)  # a plain table on either side lets Spark split a hot fingerprint's rows
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by the similarity of their shingles -----------------------------------------------------------------

#: Copies have so many words in a shingle and at least this share of their shingles in common.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Segments of 23 bits in a copy's fingerprint; fingerprints of copies differ in at most so many bits. At a similarity of 0.8 they differ in 33 on average, with a
#: deviation of 6 (so 0.99 of pairs just at the threshold pass, and more above it), those of unrelated texts in 127. MERGE_ROUNDS: see ``copy_classes``.
MERGE_ROUNDS = 2
COPY_SEGMENTS, COPY_BITS = 11, 48
#: A text's anchors: its least shingles in so many orders. Each is looked up along with Golay indices of so many segments. At a similarity of 0.8 an anchor is shared
#: with probability 0.8 and one of its segments decodes to a common codeword with 0.95, so 0.99 and more of all copies meet.
ANCHORS, ANCHOR_SEGMENTS = 4, 3
_LIMBS = [f"b{i}" for i in range(4)]
#: Bits of a text's parities: whether an odd number of its distinct shingles falls on each of 256 places. Two texts that differ in k shingles differ in k parities at most.
_PARITIES = [f"p{i}" for i in range(4)]
_SKETCH = StructType([*[StructField(b, LongType()) for b in (*_LIMBS, *_PARITIES, "n")], StructField("anchors", ArrayType(LongType()))])


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = COPY_WORDS) -> np.ndarray:
    """Distinct shingles of lower-case words as 64-bit hashes; fewer words than ``size`` make one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(own) - size + 1)
    out = np.full(n, len(own[:size]), np.uint64)
    for i in range(min(size, len(own))):
        out = _mix(out ^ own[i : i + n], i)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def sketch(text: str | None) -> tuple[list[int], list[int]]:
    """256 bits of SimHash over the distinct shingles in four numbers, their 256 parities in four, how many they are; and the anchors."""
    own = shingles(text)
    if not len(own):
        return [0] * 9, []
    limbs = []
    for k in range(4):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(own), _BLOCK):
            ones += np.unpackbits(_mix(own[i : i + _BLOCK], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        limbs.append(int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0]))
    odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    parities = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()
    return [*limbs, *parities, len(own)], [int(_mix(own, 100 + r).min().view(np.int64)) for r in range(ANCHORS)]


@F.pandas_udf(_SKETCH)
def sketch_column(texts: pd.Series) -> pd.DataFrame:
    found = [sketch(t) for t in texts]
    return pd.DataFrame({**{b: pd.Series([f[0][i] for f in found], dtype="int64") for i, b in enumerate((*_LIMBS, *_PARITIES, "n"))}, "anchors": [f[1] for f in found]})


def copy_segments(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """The segments of fingerprints given as four arrays."""
    wide = [x.view(np.uint64) for x in limbs]
    out = []
    for s in range(COPY_SEGMENTS):
        at, shift = divmod(23 * s, 64)
        x = wide[at] >> np.uint64(shift)
        if shift > 41:
            x = x | (wide[at + 1] << np.uint64(64 - shift))
        out.append((x & np.uint64((1 << 23) - 1)).astype(np.int64))
    return out


@F.pandas_udf(ArrayType(LongType()))
def copy_keys(b0: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, order: pd.Series) -> pd.Series:
    """Golay indices of the segments that go with the anchor of an ``order``."""
    parts = copy_segments([np.ascontiguousarray(b.to_numpy(np.int64)) for b in (b0, b1, b2, b3)])
    near = np.stack([codeword_indices(p) for p in parts], axis=1)
    own = (order.to_numpy(np.int64)[:, None] * ANCHOR_SEGMENTS + np.arange(ANCHOR_SEGMENTS)) % COPY_SEGMENTS
    found = near[np.arange(len(own))[:, None], own] | (own[:, :, None] << 12)
    return pd.Series([np.unique(row) for row in found.reshape(len(own), -1)])


@F.pandas_udf(BooleanType())
def _copies(xs: pd.Series, ys: pd.Series) -> pd.Series:
    known = {t: shingles(t) for t in {*xs, *ys}}
    return pd.Series([similarity(known[x], known[y]) >= COPY_SIMILARITY for x, y in zip(xs, ys)], dtype=bool)


def _apart(a: str, b: str, names: list[str] = _LIMBS):
    return reduce(add, (F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in names))


def _may_be_copies(a: str, b: str):
    """Fingerprints near enough, and what parities and sizes leave possible: of n and m shingles, (n + m) / 9 at most may stand in one text alone at a similarity of 0.8,
    and neither number be under 0.8 of the other. The last two never drop a pair that reaches the threshold; in texts beyond a thousand words parities say little."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = (1 + COPY_SIMILARITY) * _apart(a, b, _PARITIES) <= (1 - COPY_SIMILARITY) * (n + m) + 1e-6
    return (_apart(a, b) <= COPY_BITS) & (F.least(n, m) >= COPY_SIMILARITY * F.greatest(n, m) - 1e-6) & differ


def copy_classes(texts: DataFrame) -> DataFrame:
    """(node, root): the group of every distinct text (node, text and what ``sketch_column`` gives). Links are all verified by their shingles; texts that meet in a key are in one group
    wherever their similarity reaches the threshold.

    A key is an anchor with a Golay index of one segment. Its least text is compared with all others; then only texts that these links leave in
    different classes are compared with each other, the nearest by fingerprint first, so a group of copies costs about as many verifications as it has members.
    """
    known = ["node", *_LIMBS, *_PARITIES, "n"]
    anchored = texts.select(*known, F.posexplode("anchors").alias("r", "anchor"))
    shared = anchored.groupBy("r", "anchor").agg(F.count("*").alias("of")).where("of > 1").select("r", "anchor")
    rows = anchored.join(shared, ["r", "anchor"])
    rows = rows.select(F.struct(*known).alias("x"), "r", "anchor", F.explode(copy_keys(*_LIMBS, "r")).alias("code"))
    rows = cut(rows.select("x", F.xxhash64("r", "anchor", "code").alias("key")))
    least = rows.groupBy("key").agg(F.min("x.node").alias("node"), F.count("*").alias("of")).where("of > 1").select("key", "node")
    least = cut(least.join(texts.select(*known), "node").select("key", F.struct(*known).alias("y")))  # numbers alone are grouped, sketches follow
    stars = cut(rows.join(least, "key").where("x.node != y.node").where(_may_be_copies("x", "y")).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct())
    member = cut(components(_verified(stars, texts)))
    label = F.coalesce("root", "x.node").alias("class")
    named = rows.join(member, F.col("x.node") == member["node"], "left").select("key", "x", label)
    mixed = named.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
    named = cut(named.join(mixed, "key"))
    left, right = named.select("key", F.col("x").alias("x1"), F.col("class").alias("ca")), named.select(F.col("key").alias("_key"), F.col("x").alias("x2"), F.col("class").alias("cb"))
    pairs = left.join(right, (F.col("key") == F.col("_key")) & (F.col("x1.node") < F.col("x2.node")) & (F.col("ca") != F.col("cb")) & _may_be_copies("x1", "x2"))
    pairs = pairs.select(F.col("x1.node").alias("a"), F.col("x2.node").alias("b"), _apart("x1", "x2").alias("d"), "ca", "cb").distinct()
    pairs = cut(pairs.join(stars, ["a", "b"], "left_anti"))
    grouped = texts.select("node").join(member, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    # at first the nearest text of each other class: most classes merge, and their other pairs need no verification
    for last in [False] * MERGE_ROUNDS + [True]:
        if pairs.isEmpty():
            break
        wanted = pairs if last else cut(pairs.groupBy("a", "cb").agg(F.min(F.struct("d", "b", "ca")).alias("n")).select("a", "n.b", "n.ca", "cb"))
        merged = cut(components(_verified(wanted, texts, "ca", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        grouped = _renamed(grouped, "root", merged)
        if not last:
            rest = pairs.join(wanted, ["a", "b"], "left_anti")
            pairs = cut(_renamed(_renamed(rest, "ca", merged), "cb", merged).where("ca != cb"))
    return grouped


def _renamed(df: DataFrame, name: str, merged: DataFrame) -> DataFrame:
    """``df`` with the classes in the column ``name`` replaced by what they merged to."""
    new = merged.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    return df.join(new, F.col(name) == F.col("_old"), "left").withColumn(name, F.coalesce("_new", name)).drop("_old", "_new")


def _verified(pairs: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = cut(texts.select("node", "text").join(wanted, "node"))
    x, y = own.select(F.col("node").alias("a"), F.col("text").alias("x")), own.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_copies("x", "y")).select("a", "b", *more)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, first): for each distinct text (node: its MD5) of ``docs`` the least (id, node) of its group, a group being texts that links of similarity join.

    A null text is like an empty one; texts without words are copies of equal texts only. A null id comes after all others. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.md5(text.cast("binary")).alias("node"), F.col(id_col).alias("id"), text.alias("text"))
    texts = base.groupBy("node").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    # numbered as they are written: each distinct text has a number of its own, and pairs and classes go by these
    texts = cut(texts.select(F.monotonically_increasing_id().alias("at"), "node", "id", "text", sketch_column("text").alias("s")).select("at", "node", "id", "text", "s.*"))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "node")
    classes = copy_classes(texts.drop("node", "id").withColumnRenamed("at", "node")).select(F.col("node").alias("at"), "root")
    grouped = cut(classes.join(texts.select("at", "node", "id"), "at"))
    first = grouped.groupBy("root").agg(F.min(order).alias("first"))
    return grouped.select("node", "root").join(first, "root").select("node", "first")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies, and of each group of copies one, the one with the least id; columns stay as they came, whatever their names.

    Of rows that repeat id and text one stays. A row without an id stays only if no copy of it has one. Groups are as in ``copies``; an empty table gives none.
    """
    node, id_, mark = fresh(docs, "node"), fresh(docs, "first_id"), fresh(docs, "first_node")
    kept = cut(copies(docs).where(F.col("node") == F.col("first.node")).select(F.col("node").alias(mark), F.col("first.id").alias(id_)))
    own = docs.withColumn(node, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    held = own.join(kept, (F.col(node) == F.col(mark)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
    return held.dropDuplicates(["doc_id", node]).drop(node)
