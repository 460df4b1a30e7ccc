"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

Words are the symbols. The CGK random walk reads a window: step t emits the word under its pointer, and a random bit of that word and step moves the pointer
on or not. Two windows a few edits apart emit strings a small Hamming distance apart, as their pointers run in step again and again. A
repetition samples SAMPLES of the walk's STEPS places; windows that agree in all of them are candidates. Windows start at every word of every item
and document and reach to the item's end at most, so each stretch of an item is a chance of its own; REPEATS draws bring recall for
copies within a tenth of edits to 0.99 and more at all lengths from 10 words on (tested). Candidates are verified by
the edit distance in words between the whole item and the best stretch of the document. Shorter items allow no edit and are looked up whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: An item is found where at most this share of its words is edited.
EDIT_SHARE = 0.1
#: Items are taken in blocks of at most so many characters, so what is broadcast stays bounded.
BLOCK_CHARS = 8_000_000
#: Steps of a walk, places of it that a repetition samples, repetitions.
STEPS, SAMPLES, REPEATS = 16, 4, 8
#: Words that are looked up at once.
CHUNK_WORDS = 400_000
SCHEMA = "doc_id string, item_id string, edits int, first_word int"
_SPACE = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()


def symbols(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def edits_allowed(n: int) -> int:
    return int(EDIT_SHARE * n)


def draws() -> list[list[int]]:
    """The sampled places of each repetition: the same in every task."""
    rng = np.random.default_rng(20)
    return [sorted(rng.choice(STEPS, SAMPLES, replace=False).tolist()) for _ in range(REPEATS)]


def _absorb(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    keys = (keys ^ seen) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(31))


def walk(syms: np.ndarray, repeat: int, places: list[int], ends: np.ndarray | None = None, sieves: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the walks from every start that emit a word at all sampled ``places``, another one each time (samples of one word would say little).

    ``ends``: where each start's text ends (a walk that leaves it is dropped). ``sieves``: after each sample, only walks whose key's top bits are marked go on.
    """
    n = len(syms)
    own = np.append(_mix(syms, repeat), np.zeros(STEPS + 1, np.uint64))
    starts, at, keys, k = np.arange(n), np.arange(n), np.full(n, repeat, np.uint64), 0
    before = np.full(n, -1)
    for t in range(places[-1] + 1):
        word = own[at]
        if t == places[k]:
            keys = _absorb(keys, word)
            stay = (at < (n if ends is None else ends[starts])) & (at > before)
            if sieves is not None:
                stay &= sieves[k][(keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
            starts, at, keys, word, before, k = starts[stay], at[stay], keys[stay], word[stay], at[stay], k + 1
        at = at + ((word >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return starts, keys


def window_keys(syms: np.ndarray, width: int) -> np.ndarray:
    """The key of each window of ``width`` symbols as they stand, one at every start."""
    n = max(0, len(syms) - width + 1)
    mixed, keys = _mix(syms, 1000), np.full(n, width, np.uint64)
    for i in range(width):
        keys = _absorb(keys, mixed[i : i + n])
    return keys


SIEVE_BITS = 20


def _sieve(keys: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << SIEVE_BITS, bool)
    mask[(keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    return mask


def distance_in(item: list[bytes], region: list[bytes]) -> tuple[int, int]:
    """Least edit distance in words between ``item`` and any stretch of ``region`` (Myers' bit vectors), and where the best one ends."""
    n = len(item)
    masks: dict[bytes, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(region):
        eq = masks.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(cross | up)), up & cross
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        eq |= down
        up, down = minus | (full & ~(eq | plus)), plus & eq
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Index:
    """Keys of one block of items; small, as the block is. For each repetition: sieves, sorted keys, the items and offsets behind them."""

    ids: list
    items: list[list[bytes]]
    sets: list[frozenset[bytes]]
    tables: list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build(rows: list[tuple]) -> Index:
    ids, items = [r[0] for r in rows], [words_of(r[1]) for r in rows]
    long = [k for k, words in enumerate(items) if edits_allowed(len(words))]
    sizes = [len(items[k]) for k in long]
    begins = np.cumsum([0, *sizes])
    syms = symbols([w for k in long for w in items[k]])
    ends, owner = np.repeat(begins[1:], sizes), np.repeat(np.array(long, np.int64), sizes)
    offset = np.arange(len(syms)) - np.repeat(begins[:-1], sizes)
    tables = []
    for r, places in enumerate(draws()):
        sieves = [_sieve(walk(syms, r, places[: i + 1], ends)[1]) for i in range(SAMPLES)]
        starts, keys = walk(syms, r, places, ends)
        order = np.argsort(keys, kind="stable")
        tables.append((sieves, keys[order], owner[starts[order]], offset[starts[order]]))
    short = {}
    for n in sorted({len(words) for words in items if words and not edits_allowed(len(words))}):
        own = [k for k, words in enumerate(items) if len(words) == n]
        keys = np.array([window_keys(symbols(items[k]), n)[0] for k in own], np.uint64)
        order = np.argsort(keys, kind="stable")
        short[n] = (_sieve(keys), keys[order], np.array(own, np.int64)[order])
    return Index(ids, items, list(map(frozenset, items)), tables, short)


def leaks(index: Index, docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each of a few documents (lists of words) its (item_id, edits, first word), one for each item that it holds; the first of the places with the fewest edits."""
    begins = np.cumsum([0, *map(len, docs)])
    syms = symbols([w for d in docs for w in d])
    best: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
    seen: set[tuple[int, int, int]] = set()

    def meet(starts: np.ndarray, found: np.ndarray, keys: np.ndarray, owners: np.ndarray, offsets: np.ndarray | None) -> None:
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        for h in np.flatnonzero(hi > lo).tolist():
            start = int(starts[h])
            d = int(np.searchsorted(begins, start, "right")) - 1
            for j in range(lo[h], hi[h]):
                k, place = int(owners[j]), start - (int(offsets[j]) if offsets is not None else 0)
                if (d, k, place) not in seen:
                    seen.add((d, k, place))
                    _verify(index, docs[d], k, place - int(begins[d]), best[d])

    if any(len(t[1]) for t in index.tables):
        for r, (places, (sieves, keys, owners, offsets)) in enumerate(zip(draws(), index.tables)):
            meet(*walk(syms, r, places, None, sieves), keys, owners, offsets)
    for n, (sieve, keys, owners) in index.short.items():
        found = window_keys(syms, n)
        hits = np.flatnonzero(sieve[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        meet(hits, found[hits], keys, owners, None)
    return [[(index.ids[k], e, at) for k, (e, at) in sorted(b.items())] for b in best]


def _verify(index: Index, words: list[bytes], k: int, place: int, best: dict) -> None:
    item = index.items[k]
    allowed, at = edits_allowed(len(item)), max(0, place)
    if not allowed:
        edits = 0 if words[at : at + len(item)] == item else 1
    elif k in best and best[k] <= (0, at):
        return
    else:
        region = words[max(0, place - allowed) : place + len(item) + allowed]
        if len(index.sets[k].difference(region)) > allowed:  # an edit takes away one word at most
            return
        edits, _ = distance_in(item, region)
    if edits <= allowed and (k not in best or (edits, at) < best[k]):
        best[k] = (edits, at)


def _chunks(ids, texts) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Documents with words, some CHUNK_WORDS words at a time (a longer document alone)."""
    own, docs, size = [], [], 0
    for d, text in zip(ids, texts):
        if text and (words := words_of(text)):
            own.append(d)
            docs.append(words)
            size += len(words)
            if size >= CHUNK_WORDS:
                yield own, docs
                own, docs, size = [], [], 0
    if docs:
        yield own, docs


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters, one partition of them at the driver at a time."""
    block, size = [], 0
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).dropDuplicates()
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


_BUILT: dict[str, Index] = {}


def _index(name: str, shared) -> Index:
    """A block's index: built once in each Python worker, which keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(shared.value)
    return _BUILT[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word): one row for each document and item of ``benchmark`` (item_id, text) that it
    holds with at most a tenth of the item's words edited; ``first_word`` is about where, the first place among equals.

    Items are a stated query set: they go over all documents in blocks of bounded size (BLOCK_CHARS), each a broadcast whose index the tasks build.
    Null or empty texts and items hold nothing; a row that repeats a document repeats its leaks, rows that repeat an item count once, either table may be empty. Texts of any
    length are read whole, a very long one by itself. Other columns of either table are ignored.
    """
    spark, out = docs.sparkSession, None
    for rows in _blocks(benchmark, "item_id", "text"):
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            index = _index(name, shared)
            for b in batches:
                for own, words in _chunks(b["doc_id"], b["text"]):
                    found = [(d, str(i), *rest) for d, some in zip(own, leaks(index, words)) for i, *rest in some]
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "edits", "first_word"])

        part = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(scan, SCHEMA)  # as strings, nulls don't make numbers of ids
        out = part if out is None else out.union(part)
    out = out if out is not None else spark.createDataFrame([], SCHEMA)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("item_id").cast(benchmark.schema["item_id"].dataType), "edits", "first_word")


def drop_leaky(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with the columns that came in, whatever their names.

    A null or empty text holds none and stays. A row without an id is judged with the other rows without one: all of them go if one of them leaks. Rows that repeat stay or go together.
    """
    leaky = fresh(docs, "leaky")
    found = find_leaks(docs, benchmark).select(F.col("doc_id").alias(leaky), F.lit(True).alias(leaky + "_")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(leaky)), "left_anti")
