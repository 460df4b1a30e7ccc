"""Importance resampling: documents drawn by how much likelier a target distribution makes them than the corpus.

Features are runs of one to three words, hashed to buckets by CRC-32. No run is hashed on its own: a document, its separators
normalised to one blank, is scanned once and the running CRCs are kept; the CRC of any run follows from the two prefixes that end
where it begins and where it ends. A CRC is linear over GF(2), so shifting the first prefix by the run's length and adding it to the second cancels all that lies before the run.

The corpus' and the target's features are counted in buckets over all rows. A bucket's gain is the logarithm of the ratio of its two
smoothed shares; a document's weight is the sum of its features' gains. Gumbel noise from the document's id turns the greatest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

BUCKETS, ORDERS = 10_000, 3
MIN_WORDS, SHARE, SEED = 20, 5, 42
#: Bytes that are scanned at once; a longer text goes in pieces that end between words and carry the last words over.
BLOCK = 1 << 20
#: Bytes that one lane of a scan steps through; the lanes of a block go side by side.
LANE = 512
#: How much further than the drawn share the sort of the best goes, as a share of all: ten times the error of the percentile that bounds it.
MARGIN = 0.001
_ONES = np.uint32(0xFFFFFFFF)


def _byte_steps() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


STEP = _byte_steps()


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as its values for each of four bytes."""
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps of 0 to 63 zero bytes, and those of 64, 128, ... zero bytes."""
    short = np.empty((64, 4, 256), np.uint32)
    short[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 64):
        short[n] = STEP[short[n - 1] & 255] ^ short[n - 1] >> 8
    long = [_lookup(short[32], short[32])]
    while len(long) < 26:
        long.append(_lookup(long[-1], long[-1]))
    return short, long


SHORT, LONG = _shifts()


def shift(registers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each register after as many zero bytes as ``sizes`` says."""
    low, out = sizes & 63, registers
    out = SHORT[low, 0, out & 255] ^ SHORT[low, 1, out >> 8 & 255] ^ SHORT[low, 2, out >> 16 & 255] ^ SHORT[low, 3, out >> 24]
    high, k = sizes >> 6, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _lookup(LONG[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The CRC register before every byte, from 0 on, as (place in lane, lane). Lanes step side by side; each begins with the register that the lanes before it leave."""
    lanes = len(data) // LANE + 1
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[: len(data)] = data
    view, seeds, crc = memoryview(padded), np.empty(lanes, np.uint32), 0xFFFFFFFF
    for k in range(lanes):
        seeds[k] = crc ^ 0xFFFFFFFF
        crc = zlib.crc32(view[k * LANE : (k + 1) * LANE], crc)
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    out = np.empty((LANE, lanes), np.uint32)
    out[0] = seeds
    for i in range(1, LANE):
        out[i] = STEP[(out[i - 1] ^ columns[i - 1]) & 255] ^ out[i - 1] >> 8
    return out


def _plain() -> bytes:
    """Letters A-Z to lower case, all that is no digit, letter or byte of a longer character to a blank."""
    keep = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
    return bytes(b if b in keep else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


PLAIN = _plain()


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
    """(text's number, piece, how many words it repeats from the piece before)."""
    for i, t in enumerate(texts):
        if len(t) <= BLOCK:
            yield i, t, 0
            continue
        at, carried = 0, []
        while at < len(t):
            end = t.find(b" ", min(at + BLOCK, len(t)))
            end = len(t) if end < 0 else end
            yield i, b" ".join([*carried, t[at:end]]), len(carried)
            carried = [*carried, *t[at:end].rsplit(None, ORDERS - 1)[-(ORDERS - 1) :]]
            carried = b" ".join(carried).split()[-(ORDERS - 1) :]
            at = end


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: the number of the text of each word, that of each feature, and the features' CRCs."""
    block, size = [], 0
    for piece in _pieces([t.translate(PLAIN) for t in texts]):
        if block and size + len(piece[1]) > BLOCK:
            yield _features(block)
            block, size = [], 0
        block.append(piece)
        size += len(piece[1]) + 1
    if block:
        yield _features(block)


def _features(block: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number, data, carried = zip(*block)
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    borders = np.cumsum([len(d) + 1 for d in data])
    word = raw != 32
    before = np.concatenate([[False], word[:-1]])
    text = raw[word | before]  # every word and one blank behind it
    ends = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    piece = np.searchsorted(borders, np.flatnonzero(word & ~before), side="right")
    first = np.searchsorted(piece, np.arange(len(block)))
    new = np.arange(len(ends)) - first[piece] >= np.array(carried)[piece]
    number = np.array(number)
    registers = running_crcs(text)
    at = lambda p: registers[p % LANE, p // LANE]
    opened, closed = at(starts), at(ends)
    owners, crcs = [], []
    for n in range(ORDERS):
        i = np.flatnonzero((piece[: len(piece) - n] == piece[n:]) & new[n:])
        crcs.append(closed[i + n] ^ shift(opened[i] ^ _ONES, ends[i + n] - starts[i]) ^ _ONES)
        owners.append(number[piece[i]])
    return number[piece[new]], np.concatenate(owners), np.concatenate(crcs)


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8") if t else b"" for t in texts]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all rows; each task adds up its own before anything is shuffled."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, crcs in features(_bytes(b["text"])):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": own, "n": total[own]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A bucket's gain in thousandths, from both tables of counts (as many rows as there are buckets at most)."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * float(all_s) / (float(s.get(b, 0) + 1) * float(all_t)))) for b in range(buckets)]


def weigh(docs: DataFrame, of_bucket: list[int], text_col: str = "text", name: str = "weighed") -> DataFrame:
    """``docs`` with a struct ``name``: n_words, n_features and weight (the sum of the features' gains)."""
    spark, buckets = docs.sparkSession, np.uint32(len(of_bucket))
    shared = spark.sparkContext.broadcast(np.array(of_bucket, np.float64))

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for of_word, of_feature, crcs in features(_bytes(texts)):
                words += np.bincount(of_word, minlength=n)
                count += np.bincount(of_feature, minlength=n)
                weight += np.bincount(of_feature, shared.value[crcs % buckets], minlength=n)
            yield pd.DataFrame({"n_words": words, "n_features": count, "weight": weight.astype(np.int64)})

    return docs.withColumn(name, run(F.col(text_col)))


def noise(id_: F.Column, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from an id alone; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def rank_best(scored: DataFrame, id_col: str, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (id, n_words, score, ...) with ``rank``: 1, 2, 3 ... by score, then by smaller id, for the best floor(share * N / 100) of the N rows with ``min_words`` words; else null.

    Only the rows over a percentile that bounds the drawn ones are sorted, by ranges, and numbered where they lie; the driver sees a count for each partition.
    """
    fits = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    goal = max(0.0, 1 - share / 100 - MARGIN)
    n, least = scored.where(fits).agg(F.count("*"), F.percentile_approx("score", F.lit(goal), int(10 / MARGIN))).first()
    draw = share * n // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = fits & (F.col("score") >= F.lit(least))
    order = [F.desc("score"), F.asc(id_col)]
    best = cut(scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = best.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = best.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= draw, rank))
    return ranked.select(*scored.columns, "rank").union(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank is null for rows that aren't drawn.

    Texts count whole, whatever their length; a null text has no words. Rows that repeat stand for themselves each and have neighbouring ranks; a null id
    draws noise like an empty one and comes first among ties. Empty tables give no rows, an empty target shares of equal size. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    of_bucket = gains(bucket_counts(texts, "_text"), bucket_counts(target, target_col))
    rows = weigh(texts, of_bucket, "_text", "_w").select(id_col, "_w.*").withColumn("score", F.col("weight") + noise(F.col(id_col)))
    return rank_best(cut(rows), id_col).select(id_col, "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns and ``rank`` (under another name if there is one). Rows that share an id are drawn together, with the best rank among them."""
    drawn = importance(docs, target, id_col, text_col, target_col).where("rank is not null").groupBy(F.col(id_col).alias("_drawn_id")).agg(F.min("rank").alias("_rank"))
    name = fresh(docs, "rank")
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("_drawn_id"))).select(docs["*"], F.col("_rank").alias(name))
