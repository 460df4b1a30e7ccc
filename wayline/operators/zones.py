"""Zone visits, dwell alerts and occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .folds import SPREAD, by_key
from .lines import TRACK, attach


def inside(track_frames: DataFrame, zones: DataFrame) -> DataFrame:
    """Countable rows with every zone of their stream and whether the anchor is inside; bounds are tested before the polygon."""
    x, y = F.col("x"), F.col("y")
    test = F.when(G.in_bounds(F.col("points"), x, y), G.in_polygon(F.col("points"), x, y)).otherwise(False)
    return attach(track_frames, zones).withColumn("inside", test)


def visits(track_frames: DataFrame, zones: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """One row per visit: entered and exited (frame, timestamp), dwell_s, whether it is open, and alert_timestamp.

    A visit is a run of rows inside. It ends with the first row outside; else with the track's end in ``finished``
    (its dwell is not negative), else it is open. The alert is the first row after the entry with a dwell of
    dwell_alert_s, once a visit.
    """
    rows = by_key(inside(track_frames, zones).drop("points"), ["stream_id", "track_id", "zone_id"], SPREAD)  # without the run, as in ``lines.crossings``
    per = Window.partitionBy(*TRACK, "zone_id").orderBy("frame_index")
    so_far = per.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("was", F.coalesce(F.lag("inside").over(per), F.lit(False))).withColumn("enters", F.col("inside") & ~F.col("was"))
    rows = rows.withColumn("visit", F.sum(F.col("enters").cast("int")).over(so_far)).withColumn("entered", F.last(F.when(F.col("enters"), F.struct("timestamp")), ignorenulls=True).over(so_far)["timestamp"])
    late = F.col("inside") & ~F.col("enters") & (F.col("timestamp") - F.col("entered") >= F.col("dwell_alert_s"))
    rows = rows.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("leaves", ~F.col("inside") & F.col("was"))
    rows = rows.where("visit > 0 and (enters or late or leaves)")  # the others say nothing of a visit
    alert = F.when(F.col("late"), F.struct("timestamp", "frame_index"))
    out = F.when(F.col("leaves"), F.struct("timestamp", "frame_index", "vehicle_class"))
    found = rows.groupBy(*TRACK, "zone_id", "name", "ord", "visit").agg(
        F.min("frame_index").alias("entered_frame"), F.min("entered").alias("entered"), F.min_by("vehicle_class", "frame_index").alias("vehicle_class"),
        F.min(alert).alias("alert"), F.min(out).alias("out"),
    )
    if finished is not None:
        ends = finished.select(*TRACK, F.col("timestamp").alias("end_t"), F.col("frame_index").alias("end_f"), F.col("vehicle_class").alias("end_c"))
        found = found.join(ends, TRACK, "left")
    else:
        found = found.withColumns({"end_t": F.lit(None).cast("double"), "end_f": F.lit(None).cast("long"), "end_c": F.lit(None).cast("string")})
    exited = F.coalesce("out.timestamp", "end_t")
    return found.select(
        *TRACK, "zone_id", "name", "ord", "visit", "vehicle_class", "entered_frame", "entered", F.coalesce("out.frame_index", "end_f").alias("exited_frame"), exited.alias("exited"),
        F.when(exited.isNotNull(), F.greatest(F.lit(0.0), exited - F.col("entered"))).alias("dwell_s"), F.coalesce("out.vehicle_class", "end_c").alias("exit_class"), F.col("out").isNull().alias("by_finish"),
        F.col("alert.timestamp").alias("alert_timestamp"), F.col("alert.frame_index").alias("alert_frame"),
    )


def occupancy(found: DataFrame, at: float | None = None) -> DataFrame:
    """Tracks in each zone at a time (the entry counts, the exit does not), or those never seen to leave."""
    open_ = F.col("exited").isNull() if at is None else (F.col("entered") <= at) & (F.col("exited").isNull() | (F.col("exited") > at))
    return found.groupBy("stream_id", "zone_id").agg(F.count_if(open_).alias("occupancy"), F.count("*").alias("visits"))


def overlay_occupancy(track_frames: DataFrame, zones: DataFrame) -> DataFrame:
    """Active tracks with their anchor in each zone, frame by frame, whatever the zone's classes."""
    rows = inside(track_frames.where("state = 'active'"), zones.withColumn("classes", F.lit(None).cast("array<string>")))
    return rows.groupBy("stream_id", "run_id", "zone_id", "frame_index").agg(F.count_if("inside").alias("occupancy"))
