"""Selections and folds in time: what comes out of a row depends on what came out of earlier ones.

Rows are shuffled and sorted by their key, then pass as Arrow batches; what is carried from batch to batch is the small state of
one key, so memory is a batch whatever the key's length. Long keys are cut at pauses where state ends by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the blocks in which pauses are looked for, in pauses.
BLOCK_PAUSES = 64
#: Partitions in which a track's or a frame's rows are sorted, in times of ``spark.sql.shuffle.partitions``: rows of few bytes on the wire are wide in a sort, and adaptive execution would join them.
SPREAD = 8


def with_runs(rows: DataFrame, keys: list[str], time: str, pause: float, name: str = "_run") -> DataFrame:
    """``rows`` with a number that grows where a key pauses for at least ``pause`` at the border of two blocks of time.

    Only a row for each key and block is sorted, so a key that holds most rows is found in many tasks at once.
    """
    block = F.floor(F.col(time) / (BLOCK_PAUSES * pause)).cast("long")
    marked = rows.withColumn("_block", block)
    spans = marked.groupBy(*keys, "_block").agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    order = Window.partitionBy(*keys).orderBy("_block")
    spans = spans.withColumn("_new", F.coalesce((F.col("_from") - F.lag("_to").over(order) >= pause).cast("int"), F.lit(0)))
    spans = spans.withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), name)
    same = F.col("_block").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return marked.join(own, same, "left").drop("_block", "_kb", *[f"_k{i}" for i in range(len(keys))])


def in_order(rows: DataFrame, keys: list[str], order: list[str], schema, scan: Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray]]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``scan`` over all rows, each key's in order: it gets batches with a mask of the rows that begin a new key, and returns batches of ``schema``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan(_marked(batches, keys))

    return by_key(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_key(rows: DataFrame, keys: list[str], spread: int = 1) -> DataFrame:
    """``rows`` shuffled by key into a fixed number of partitions: the work is in Python, so adaptive execution must not join partitions for being few bytes. ``spread`` times as many
    partitions as usual even out a few heavy keys."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread * n, *keys)


def by_few_keys(rows: DataFrame, keys: list[str], sizes: DataFrame, spread: int = 1) -> DataFrame:
    """As ``by_key`` where keys are few and heavy, so that hashes would put several into one partition: the keys of ``sizes`` (rows with the keys, as many as a key is heavy) are dealt in turn, the heaviest first.

    What is sorted in one place is a row for each key.
    """
    n = spread * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = (F.row_number().over(Window.orderBy(F.desc("_n"), *keys)) - 1) % n
    dealt = sizes.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], turn.cast("int").alias("_part"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    placed = rows.join(F.broadcast(dealt), same, "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    return placed.repartitionById(n, F.col("_part")).drop("_part", *[f"_k{i}" for i in range(len(keys))])


def _marked(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k)
            x, y = v.slice(1), v.slice(0, b.num_rows - 1)
            differ = pc.if_else(pc.and_(pc.is_valid(x), pc.is_valid(y)), pc.fill_null(pc.not_equal(x, y), False), pc.not_equal(pc.is_valid(x), pc.is_valid(y)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        first = [b.column(k)[0].as_py() for k in keys]
        new[0] = first != last
        last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
        yield b, new


def numbers(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def spaced(rows: DataFrame, keys: list[str], time: str, ties: list[str], gap: float | Column) -> DataFrame:
    """Rows that come ``gap`` or more after the last kept row of their key, the first one always.

    Ties in time go by ``ties``; null keys are a key; a row with a null time is kept only as a key's first. One shuffle by key, one number kept in memory.
    """
    gap = F.lit(float(gap)) if not isinstance(gap, Column) else gap
    marked = rows.withColumn("_gap", gap.cast("double")).withColumn("_at", F.col(time).cast("double"))

    def scan(batches):
        last = None
        for b, new in batches:
            kept = np.zeros(b.num_rows, bool)
            for i, (first, t, g) in enumerate(zip(new.tolist(), numbers(b, "_at"), numbers(b, "_gap"))):
                if first or last is None or (t is not None and g is not None and t - last >= g):
                    kept[i], last = True, t
            yield b.filter(pa.array(kept))

    return in_order(marked, keys, ["_at", *ties], marked.schema, scan).drop("_gap", "_at")


def limited(rows: DataFrame, keys: list[str], time: str, ties: list[str], most: int, window: float) -> DataFrame:
    """Rows of which at most ``most`` are kept in any ``window`` before and with them; greedily in order of time.

    Keys are cut at pauses of a window, after which nothing is remembered; the times of at most ``most`` rows are kept in memory.
    """
    marked = with_runs(rows.withColumn("_at", F.col(time).cast("double")), keys, "_at", window)

    def scan(batches):
        recent: list[float] = []
        for b, new in batches:
            kept = np.zeros(b.num_rows, bool)
            for i, (first, t) in enumerate(zip(new.tolist(), numbers(b, "_at"))):
                recent = [] if first else [x for x in recent if t - x < window]
                if len(recent) < most:
                    kept[i] = True
                    recent.append(t)
            yield b.filter(pa.array(kept))

    return in_order(marked, [*keys, "_run"], ["_at", *ties], marked.schema, scan).drop("_at", "_run")
