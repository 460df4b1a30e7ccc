"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document is its tokens and an end token. Whole sequences are cut off its front; what is left, shorter than a sequence, is a piece to be packed. The histogram of
these lengths is a cutting-stock problem: which patterns of lengths fill a sequence, and how often each is used. Its linear program is solved by column
generation: a revised simplex keeps as many patterns as there are length classes, and a knapsack by dynamic programming over the dual prices finds the pattern worth entering.
The patterns' numbers are rounded, and the pieces of each class, numbered over all partitions, take the places that the patterns give to their class.
Pieces that no pattern fills well (many of one awkward length, or the last few) are cut into powers of two, which fill sequences without a gap.

Only the histogram (a row for each length under a sequence) and the patterns (a bounded number) pass through the driver.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPLIT, byte_alphabet
from .common import cut

LENGTH, END = 2048, 1
#: Length classes of the linear program at most, and pieces for each class at least on average; a class counts with its longest length.
CLASSES, CLASS_PIECES = 256, 8
#: The linear program is done when its value is this close to a lower bound.
GAP = 1e-3
#: Classes, drawn anew each time, among which a pattern is priced first; if none is worth entering, all classes are priced.
PRICED = 32
#: Sequences that would be emptier than this share are not made; their pieces are cut.
FILLED = 0.95
_EPS = 1e-9
PIECES = "array<struct<start:long,length:long,ids_crc32:long>>"


# --- tokens -----------------------------------------------------------------------------------------------------


def encoder(spec_json: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file; its merges must be ranked as their ids are (else ValueError). Strings of added tokens in a text are those tokens, as that library has it."""
    spec = json.loads(spec_json)
    letters = byte_alphabet()
    if spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only plain byte-level BPE files are read")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("merges aren't in the order of their ids")
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


_READY: dict[int, tiktoken.Encoding] = {}


def _encoder(shared) -> tiktoken.Encoding:
    """One in each Python worker."""
    key = zlib.crc32(shared.value.encode())
    if key not in _READY:
        _READY.clear()
        _READY[key] = encoder(shared.value)
    return _READY[key]


def measured(docs: DataFrame, vocabulary: str, text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """``docs`` with a struct ``_m``: how many tokens (the end token included), the pieces (whole sequences, then what is left), and what is left as powers of two, the greatest first.

    The ids themselves go no further than a CRC for each of these.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of one or two MB

    @F.pandas_udf(f"tokens long, pieces {PIECES}, powers {PIECES}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared)
        for texts in batches:
            rows = []
            for t in texts:
                ids = np.append(enc.encode_to_numpy(t or "", allowed_special="all"), np.uint32(end)).astype("<u4")
                starts, rest = list(range(0, len(ids), length)), len(ids) % length
                sizes = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
                inner = [len(ids) - rest + sum(sizes[:i]) for i in range(len(sizes))]
                piece = lambda a, n: {"start": a, "length": n, "ids_crc32": zlib.crc32(ids[a : a + n].tobytes())}
                rows.append((len(ids), [piece(a, min(length, len(ids) - a)) for a in starts], [piece(a, n) for a, n in zip(inner, sizes)]))
            yield pd.DataFrame(rows, columns=["tokens", "pieces", "powers"])

    return docs.withColumn("_m", run(F.col(text_col)))


# --- the linear program -----------------------------------------------------------------------------------------


@dataclass
class Pattern:
    """How many pieces of each class a sequence holds, and how many sequences are filled so."""

    counts: dict[int, int]
    times: int


def classes(histogram: dict[int, int], most: int = CLASSES) -> dict[int, int]:
    """Length to class (named by its longest length): every length its own if they are few, else borders at equal steps of the summed square roots of the counts, which keeps what rounding up wastes least."""
    lengths = sorted(n for n, k in histogram.items() if k)
    most = min(most, max(16, sum(histogram.values()) // CLASS_PIECES))
    if len(lengths) <= most:
        return {n: n for n in lengths}
    steps = np.cumsum(np.sqrt([histogram[n] for n in lengths]))
    bins = np.minimum((steps / steps[-1] * most).astype(int), most - 1)
    top = {b: n for b, n in zip(bins.tolist(), lengths)}
    return {n: top[b] for b, n in zip(bins.tolist(), lengths)}


def knapsack(sizes: list[int], worth: np.ndarray, most: list[int], room: int) -> tuple[float, dict[int, int]]:
    """The most valuable pieces that fit: (worth, number of each), by dynamic programming over the room; numbers are bounded by ``most``, split into powers of two."""
    best, taken = np.zeros(room + 1), []
    for k, size in enumerate(sizes):
        left, n = min(most[k], room // size), 1
        while left > 0 and worth[k] > 0:
            n = min(n, left)
            w = n * size
            offer = best[: room + 1 - w] + n * worth[k]
            take = np.zeros(room + 1, bool)
            take[w:] = offer > best[w:] + _EPS
            best[w:] = np.where(take[w:], offer, best[w:])
            taken.append((k, n, w, take))
            left, n = left - n, 2 * n
    at, out = room, {}
    for k, n, w, take in reversed(taken):
        if take[at]:
            out[k] = out.get(k, 0) + n
            at -= w
    return float(best[room]), out


def _inverse(a: np.ndarray) -> np.ndarray:
    """By elimination with the greatest pivot, in plain array arithmetic (the threads of a linear algebra library can hang in a process that runs a JVM beside them)."""
    m = len(a)
    work = np.concatenate([a, np.eye(m)], axis=1)
    for k in range(m):
        best = k + int(np.argmax(np.abs(work[k:, k])))
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        others = np.delete(np.arange(m), k)
        work[others] -= work[others, k, None] * work[k]
    return work[:, m:]


def relax(sizes: list[int], demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """The linear program: patterns and how often each is used, for as few sequences as possible. Starts with patterns of one class each; prices are the duals."""
    m, draw = len(sizes), np.random.default_rng(0)
    bound = float(sum(s * d for s, d in zip(sizes, demand))) / room
    basis = [{k: max(1, min(room // s, int(demand[k])))} for k, s in enumerate(sizes)]
    inverse = np.diag([1.0 / b[k] for k, b in enumerate(basis)])
    most = [int(d) for d in demand]
    for turn in range(30 * m):
        used = (inverse * demand).sum(axis=1)
        prices = inverse.sum(axis=0)
        if used.sum() <= (1 + gap) * bound:
            break
        some = np.sort(draw.choice(m, min(PRICED, m), replace=False)).tolist()
        value, counts = knapsack([sizes[k] for k in some], prices[some], [most[k] for k in some], room)
        counts = {some[k]: n for k, n in counts.items()}
        if value <= 1 + gap:
            value, counts = knapsack(sizes, prices, most, room)
            bound = max(bound, float((prices * demand).sum()) / value)
            if value <= 1 + _EPS:
                break
        column = np.zeros(m)
        column[list(counts)] = list(counts.values())
        way = (inverse[:, list(counts)] * column[list(counts)]).sum(axis=1)
        up = way > 1e-7
        ratio = np.where(up, np.maximum(used, 0) / np.where(up, way, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[out] = counts
        if turn % 1024 == 1023:  # against rounding errors
            whole = np.zeros((m, m))
            for j, b in enumerate(basis):
                whole[list(b), j] = list(b.values())
            inverse = _inverse(whole)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    return list(zip(basis, np.maximum((inverse * demand).sum(axis=1), 0).tolist()))


def patterns(demand: dict[int, int], room: int = LENGTH) -> list[Pattern]:
    """Patterns that hold exactly ``demand`` (size to number): the linear program's, rounded down, then once more each where the pieces suffice, greatest fraction first; what is
    left, about a sequence for each class at most, goes into sequences that begin with the largest piece and are filled by a knapsack of lengths."""
    sizes = sorted(demand, reverse=True)
    if not sizes:
        return []
    left = np.array([demand[s] for s in sizes], np.int64)
    made: list[Pattern] = []

    def use(counts: dict[int, int], times: int) -> None:
        if times and counts:
            made.append(Pattern({sizes[k]: n for k, n in counts.items()}, times))
            for k, n in counts.items():
                left[k] -= n * times

    found = relax(sizes, left.astype(float), room)
    for counts, x in found:
        use(counts, min(int(x + 1e-6), *(int(left[k]) // n for k, n in counts.items())))
    for counts, x in sorted(found, key=lambda f: -(f[1] % 1)):
        if x % 1 > 1e-6 and all(left[k] >= n for k, n in counts.items()):
            use(counts, 1)
    while left.any():
        k = int(np.flatnonzero(left)[0])
        rest = left.copy()
        rest[k] -= 1
        _, counts = knapsack(sizes, np.array(sizes, float), rest.tolist(), room - sizes[k])
        counts[k] = counts.get(k, 0) + 1
        use(counts, min(int(left[j]) // n for j, n in counts.items()))
    return made


def places(made: list[Pattern], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, rank after the last, first sequence, pieces a sequence, pieces before them in the sequence): where the pieces of a class go, by their rank in it; those to be cut have no sequence (-1)."""
    rows, ranks, sequence = [], {}, 0
    for p in made:
        slot = 0
        if sum(c * n for c, n in p.counts.items()) < FILLED * length:
            for c, n in p.counts.items():
                a = ranks.get(c, 0)
                ranks[c] = a + n * p.times
                rows.append((c, a, ranks[c], -1, n, 0))
            continue
        for c, n in sorted(p.counts.items(), reverse=True):
            a = ranks.get(c, 0)
            ranks[c] = a + n * p.times
            rows.append((c, a, ranks[c], sequence, n, slot))
            slot += n
        sequence += p.times
    return rows


# --- on tables --------------------------------------------------------------------------------------------------


def _before(rows: DataFrame, amount: F.Column, *keys: str) -> DataFrame:
    """(part, keys, before): what ``amount`` sums up to in the partitions before, for each key."""
    sums = rows.groupBy("_part", *keys).agg(F.sum(amount).alias("_n"))
    return sums.select("_part", *keys, (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before"))


def _cut_up(pieces: DataFrame, first: int, length: int) -> tuple[DataFrame, int]:
    """Pieces whose lengths are powers of two in sequences from ``first`` on, and how many these are: side by side from the greatest on, so none crosses a sequence's border; the last sequence falls into powers of two itself."""
    amount = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    total, begins = 0, {}
    for size in sorted(amount, reverse=True):
        begins[size] = total
        total += size * amount[size]
    inner = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_at")) - 1
    ranked = pieces.withColumn("_inner", inner).join(_before(pieces, F.lit(1), "length"), ["_part", "length"])
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), F.col("length")) if begins else F.lit(0)
    line = ranked.withColumn("_line", begin + (F.col("_before") + F.col("_inner")) * F.col("length"))
    whole, rest = divmod(total, length)
    sequence, offset, n, at = F.expr(f"_line div {length}"), F.col("_line") % length, whole, whole * length
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            sequence, offset = F.when(F.col("_line") >= at, n).otherwise(sequence), F.when(F.col("_line") >= at, F.col("_line") - at).otherwise(offset)
            n, at = n + 1, at + (1 << k)
    return line.withColumn("sequence_id", (F.lit(first) + sequence).cast("long")).withColumn("offset", offset.cast("long")), n


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row; sequences are numbered from 0 without gaps.

    A null text is empty and has the end token alone. Rows that repeat, null ids among them, are packed each for itself; texts of any length are cut at every ``length`` tokens.
    An empty table gives no rows; other columns are not read. Ranks come from where rows lie in a table that is written first, so a lost executor changes nothing.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = cut(measured(texts, vocabulary, "_text", length, end).select("_id", "_m.*").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_rest", (F.col("tokens") % length).cast("int"))
    own = ["_id", "start", "length", "ids_crc32", "tokens", "sequence_id"]
    # what is left of each document
    histogram = {r["_rest"]: r["n"] for r in rows.where("_rest > 0").groupBy("_rest").agg(F.count("*").alias("n")).collect()}
    of = classes(histogram)
    demand: dict[int, int] = {}
    for n, c in of.items():
        demand[c] = demand.get(c, 0) + histogram[n]
    made = patterns(demand, length)
    where = places(made, length)
    n_packed = max([0, *(first + (z - a) // each for _, a, z, first, each, _ in where if first >= 0)])
    sizes = spark.createDataFrame(list(of.items()), "_rest int, _class int")
    slots = spark.createDataFrame(where, "_c int, _a long, _z long, _first long, _each long, _slot long")
    rest = rows.where("_rest > 0").join(F.broadcast(sizes), "_rest").select("_id", "tokens", "_at", "_part", "_class", F.element_at("pieces", -1).alias("_p"), "powers")
    inner = F.row_number().over(Window.partitionBy("_part", "_class").orderBy("_at")) - 1
    ranked = rest.withColumn("_inner", inner).join(_before(rest, F.lit(1), "_class"), ["_part", "_class"]).withColumn("_rank", F.col("_before") + F.col("_inner"))
    ranked = ranked.join(F.broadcast(slots), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_z")))
    turn = F.col("_rank") - F.col("_a")
    placed = ranked.where("_first >= 0").select("_id", "_p.*", "tokens", F.expr("_first + (_rank - _a) div _each").alias("sequence_id"), (F.col("_slot") + turn % F.col("_each")).alias("_turn"))
    upto = Window.partitionBy("sequence_id").orderBy("_turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select(*own, (F.sum("length").over(upto) - F.col("length")).alias("offset"))
    powers = _cut_up(cut(ranked.where("_first < 0").select("_id", "tokens", "_at", "_part", F.explode("powers").alias("_p")).select("_id", "_p.*", "tokens", "_at", "_part")), n_packed, length)
    n_packed += powers[1]
    # whole sequences
    fulls = rows.where(F.col("tokens") >= length).withColumn("_full", F.expr(f"tokens div {length}"))
    within = F.sum("_full").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_full")
    numbered = fulls.withColumn("_inner", within).join(_before(fulls, F.col("_full")), "_part")
    whole = numbered.select("_id", "tokens", F.posexplode(F.slice("pieces", 1, F.col("_full").cast("int"))).alias("_i", "_p"), (F.lit(n_packed) + F.col("_before") + F.col("_inner")).alias("_base"))
    whole = whole.select("_id", "_p.*", "tokens", (F.col("_base") + F.col("_i")).alias("sequence_id")).select(*own, F.lit(0).cast("long").alias("offset"))
    return placed.union(powers[0].select(*own, "offset")).union(whole).select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
