"""Calibrated speed, heading, distance and speeding."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import geometry as G
from .folds import in_order, numbers, spaced, with_columns
from .lines import TRACK

WINDOW_S, MIN_TRACK_S, ALPHA = 1.0, 0.7, 0.35
MOVED_M, ANCHOR_M, REPEAT_S = 0.05, 0.15, 30.0


def ground(track_frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Rows of calibrated streams with their anchor on the ground (gx, gy in metres)."""
    rows = track_frames.join(calibrations.select("stream_id", "h"), "stream_id")
    gx, gy = G.project(F.col("h"), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return rows.withColumn("gx", gx).withColumn("gy", gy).drop("h")


def velocity(grounded: DataFrame, window_s: float = WINDOW_S, min_track_s: float = MIN_TRACK_S, max_history: int = 600) -> DataFrame:
    """Raw speed (km/h) and displacement against the earlier point nearest to ``window_s`` ago; the earlier one on ties.

    Null until a track is ``min_track_s`` old, and where it has no other point in the window. Everything is a
    window over the track's own rows: one shuffle and one sort.
    """
    t = F.col("timestamp")
    rows = Window.partitionBy(*TRACK).orderBy("frame_index")
    near = lambda f, a, b: F.expr(f"{f}(struct(timestamp, gx, gy)) over (partition by {', '.join(TRACK)} order by timestamp range between {a} and {b})")
    before = near("last", "unbounded preceding", f"{float(window_s)}D preceding")
    after = near("first", f"{float(window_s)}D preceding", "current row")
    out = grounded.withColumn("born", F.min("timestamp").over(Window.partitionBy(*TRACK)))
    out = out.withColumn("_b", before).withColumn("_a", after).withColumn("_oldest", F.lag(F.struct("timestamp", "gx", "gy"), max_history - 1).over(rows))
    oldest = F.col("_oldest")  # null while the whole track is held
    gone = lambda p: F.coalesce(p["timestamp"] < oldest["timestamp"], F.lit(False))
    ok = lambda p: p.isNotNull() & (p["timestamp"] < t) & ~gone(p)
    goal = t - window_s
    b, a = F.col("_b"), F.when(gone(F.col("_a")), oldest).otherwise(F.col("_a"))
    ref = F.when(ok(b) & ok(a), F.when(goal - b["timestamp"] <= a["timestamp"] - goal, b).otherwise(a)).when(ok(a), a).when(ok(b), b)
    recent = F.lag("timestamp").over(rows) >= goal
    out = out.withColumn("ref", F.when((t - F.col("born") >= min_track_s) & recent, ref))
    dx, dy, dt = F.col("gx") - F.col("ref.gx"), F.col("gy") - F.col("ref.gy"), t - F.col("ref.timestamp")
    moved = F.hypot(dx, dy)
    out = out.withColumn("moved_m", F.when(dt > 1e-6, moved)).withColumn("raw_kmh", F.when(dt > 1e-6, moved / dt * 3.6))
    return out.withColumn("turn", F.when((dt > 1e-6) & (moved >= MOVED_M), F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))).drop("_b", "_a", "_oldest", "born", "ref")


def smooth(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds speed_kmh (exponential mean; the first value raw, rows without one hold the last), max_speed_kmh so far and direction_deg (held while standing).

    One pass over each track's rows in order; three numbers are carried, whatever the track's length.
    """
    schema = StructType([*rows.schema.fields])
    for name in ("speed_kmh", "max_speed_kmh", "direction_deg"):
        schema.add(name, DoubleType())

    def scan(batches):
        speed = top = way = None
        for b, new in batches:
            out = []
            for first, raw, turn in zip(new.tolist(), numbers(b, "raw_kmh"), numbers(b, "turn")):
                if first:
                    speed = top = way = None
                if raw is not None:
                    speed = raw if speed is None else alpha * raw + (1 - alpha) * speed
                    top = speed if top is None else max(top, speed)
                way = way if turn is None else turn
                out.append((speed, top, way))
            columns = zip(*out)
            yield with_columns(b, **{name: pa.array(v, pa.float64()) for name, v in zip(("speed_kmh", "max_speed_kmh", "direction_deg"), columns)})

    return in_order(rows, TRACK, ["frame_index"], schema, scan)


def distance(grounded: DataFrame, step_m: float = ANCHOR_M) -> DataFrame:
    """distance_m of each track: steps count from the last anchor once they reach ``step_m``, and move it. A pass in order, as above."""
    rows = grounded.select(*TRACK, "frame_index", "gx", "gy")

    def scan(batches):
        key, x, y, total = None, 0.0, 0.0, 0.0
        for b, new in batches:
            done, tracks = [], list(zip(*[numbers(b, k) for k in TRACK]))
            for i, (first, gx, gy) in enumerate(zip(new.tolist(), numbers(b, "gx"), numbers(b, "gy"))):
                if first:
                    if key is not None:
                        done.append((*key, total))
                    key, x, y, total = tracks[i], gx, gy, 0.0
                elif (d := math.hypot(gx - x, gy - y)) >= step_m:
                    x, y, total = gx, gy, total + d
            yield _batch(done)
        if key is not None:
            yield _batch([(*key, total)])

    return in_order(rows, TRACK, ["frame_index"], "stream_id string, run_id string, track_id long, distance_m double", scan)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[*TRACK, "distance_m"])


def speeding(moving: DataFrame, limits: DataFrame) -> DataFrame:
    """Speeding events: above the stream's limit_kmh, then again after 30 s at the earliest."""
    over = moving.join(limits, "stream_id").where("speed_kmh > limit_kmh")
    kept = spaced(over, TRACK, "timestamp", ["frame_index"], REPEAT_S)
    return kept.withColumn("speed_kmh", F.bround("speed_kmh", 1))
