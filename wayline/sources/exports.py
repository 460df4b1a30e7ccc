"""What leaves the engine: result bundles, the live feed and snapshot manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utc_day
from ..operators.folds import limited
from ..schemas import EVENT_TYPES
from .store import scrub


def bundle(frames: DataFrame, events: DataFrame, tracks: DataFrame) -> dict[str, DataFrame]:
    """The tables of a finished job: totals (duration_s, frames_processed), tracks, events and event_counts by type."""
    totals = frames.agg((F.max("timestamp") - F.min("timestamp")).alias("duration_s"), F.count("*").alias("frames_processed"))
    return {"totals": totals, "tracks": tracks, "events": events, "event_counts": events.groupBy("type").agg(F.count("*").alias("n")).orderBy("type")}


def feed(events: DataFrame, types: str | None = None, redact: bool = True) -> DataFrame:
    """Events of the listed types (unknown names are dropped; none left means all); with ``redact`` every text under a plate key, in any column and at any depth, is blanked. Works on streams."""
    wanted = [t for t in (x.strip() for x in (types or "").split(",")) if t in EVENT_TYPES]
    rows = events.where(F.col("type").isin(wanted)) if wanted else events
    blank = lambda v: F.when(v.isNotNull(), F.lit("***"))
    return rows.withColumns({f.name: scrub(F.col(f"`{f.name}`"), f.dataType, "", f.name, blank) for f in rows.schema.fields}) if redact else rows


def snapshot_path(stream_id: Column, wall_ts: Column, id_: Column) -> Column:
    return F.concat_ws("/", stream_id, utc_day(wall_ts), F.concat(id_, F.lit(".jpg")))


def snapshots(events: DataFrame, on_events: list[str], max_per_minute: int) -> DataFrame:
    """(id, stream_id, wall_ts, path) of events that get a snapshot: wanted by type or by an action, and at most so many in any 60 s of a stream."""
    asked = F.coalesce(F.col("snapshot_requested"), F.lit(False)) if "snapshot_requested" in events.columns else F.lit(False)
    wanted = events.where(F.col("type").isin(on_events) | asked)
    kept = limited(wanted, ["stream_id"], "wall_ts", ["id"], max_per_minute, 60.0)
    return kept.select("id", "stream_id", "wall_ts", snapshot_path(F.col("stream_id"), F.col("wall_ts"), F.col("id")).alias("path"))


def old_snapshots(manifest: DataFrame, now: float, days: float) -> DataFrame:
    """Paths of the manifest to delete."""
    return manifest.where(F.col("wall_ts") < now - days * 86400).select("path")
