"""Directed line counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .folds import SPREAD, by_key

TRACK = ["stream_id", "run_id", "track_id"]
COUNTABLE = ["active", "lost"]
#: Rows on the side being left before a further crossing counts.
SETTLED = 2


def attach(track_frames: DataFrame, dim: DataFrame) -> DataFrame:
    """Each countable row with every geometry of its stream (a dimension: broadcast by size), where the class at that frame is listed.

    Rows of other classes are left out before any state is looked at.
    """
    rows = track_frames.where(F.col("state").isin(COUNTABLE)).withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", F.col("y2"))
    return rows.join(dim, "stream_id").where(F.col("classes").isNull() | F.array_contains("classes", F.col("vehicle_class")))


def crossings(track_frames: DataFrame, lines: DataFrame) -> DataFrame:
    """Accepted crossings with direction label, canonical direction and the running count.

    A track's first crossing of a line counts; a later one only if at least two rows were spent on the side being left.
    Rows on the line itself keep the side. One shuffle and one sort by (track, line), and one of the kept rows by (line, direction) for the count.
    """
    rows = by_key(attach(track_frames, lines), ["stream_id", "track_id", "line_id"], SPREAD)  # without the run: where it is a constant, windows forget it, and other partitions would not do for them
    line = {k: F.col(k) for k in ("ax", "ay", "bx", "by")}
    per = Window.partitionBy(*TRACK, "line_id").orderBy("frame_index")
    past = per.rowsBetween(Window.unboundedPreceding, -1)
    so_far = per.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sign", F.signum(G.side(line, F.col("x"), F.col("y"))).cast("int"))
    rows = rows.withColumn("held", F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(past))
    rows = rows.withColumn("px", F.lag("x").over(per)).withColumn("py", F.lag("y").over(per))
    rows = rows.withColumn("way", G.crossing(line, F.col("px"), F.col("py"), F.col("x"), F.col("y")))
    changed = (F.col("sign") != 0) & F.col("held").isNotNull() & (F.col("sign") != F.col("held"))
    # rows on a side since the last change of it
    rows = rows.withColumn("settled", F.count_if(F.col("sign") != 0).over(so_far))
    rows = rows.withColumn("spent", F.col("settled") - F.coalesce(F.last(F.when(changed, F.col("settled") - 1), ignorenulls=True).over(so_far), F.lit(0)))
    rows = rows.withColumn("left", F.lag("spent").over(per)).withColumn("before", F.coalesce(F.max((F.col("way") != 0).cast("int")).over(past), F.lit(0)))
    kept = rows.where((F.col("way") != 0) & ((F.col("before") == 0) | (F.col("left") >= SETTLED)))
    forward = F.col("way") > 0
    kept = kept.withColumn("direction", F.when(forward, F.col("forward_label")).otherwise(F.col("backward_label"))).withColumn("direction_canonical", F.when(forward, "forward").otherwise("backward"))
    running = Window.partitionBy("stream_id", "run_id", "line_id", "direction_canonical").orderBy("frame_index", "track_id").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select("stream_id", "run_id", "track_id", "frame_index", "timestamp", "vehicle_class", "line_id", "name", "ord", "direction", "direction_canonical", F.count("*").over(running).alias("count"))


def counts(crossed: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Crossings by line, direction and class; with ``lines`` also directions that nobody took (class null, 0)."""
    out = crossed.groupBy("stream_id", "line_id", "direction", "vehicle_class").agg(F.count("*").alias("n"))
    if lines is None:
        return out
    ways = lines.select("stream_id", "line_id", F.explode(F.array("forward_label", "backward_label")).alias("direction"))
    return ways.join(out, ["stream_id", "line_id", "direction"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def totals(crossed: DataFrame) -> DataFrame:
    """Counts with totals: class null for a direction, direction null for a line."""
    out = crossed.rollup("line_id", "direction", "vehicle_class").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.where("level < 7")

