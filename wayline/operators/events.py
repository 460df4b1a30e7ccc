"""Primitive events as one table, in the order in which a frame makes them, and track summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DATA
from .lines import TRACK

#: Phase of each event type within a frame.
PHASES = {"speeding": 0, "plate_read": 1, "watchlist_hit": 2, "track_started": 3, "line_crossed": 4, "zone_entered": 5, "zone_exited": 5, "zone_dwell": 5, "track_finished": 7, "rule_triggered": 8}
FIELDS = [f.split(" ", 1) for f in DATA.split(", ")]


def payload(**values: Column) -> Column:
    """The typed payload with these fields set and the others null."""
    return F.struct(*[(values[k].cast(t) if k in values else F.lit(None).cast(t)).alias(k) for k, t in FIELDS])


def event_id(*parts: str | Column) -> Column:
    """The same for the same event, whoever computes it: 32 hex digits."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce((p if isinstance(p, Column) else F.col(p)).cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def event(rows: DataFrame, type_: str | Column, data: Column, geometry: Column | None = None, geom_ord: Column | None = None, phase: int | Column | None = None, rule_id: Column | None = None) -> DataFrame:
    """Events from rows with stream, run, track, frame_index, timestamp, vehicle_class: all of one type, or of the type and phase that columns give."""
    kind = type_ if isinstance(type_, Column) else F.lit(type_)
    none = F.lit(None).cast("string")
    at = geometry if geometry is not None else F.lit("")
    return rows.select(
        event_id(kind, "stream_id", "run_id", "track_id", "frame_index", at, rule_id if rule_id is not None else F.lit("")).alias("id"),
        kind.alias("type"), "stream_id", "run_id", F.col("timestamp").cast("double").alias("timestamp"), (F.col("wall_ts") if "wall_ts" in rows.columns else F.lit(None).cast("double")).alias("wall_ts"),
        F.col("track_id").cast("long").alias("track_id"), (rule_id if rule_id is not None else none).alias("rule_id"), "vehicle_class", data.alias("data"), none.alias("snapshot_path"),
        F.col("frame_index").cast("long").alias("frame_index"), (phase if isinstance(phase, Column) else F.lit(PHASES[type_] if phase is None else phase)).alias("phase"), (geom_ord if geom_ord is not None else F.lit(0)).cast("int").alias("geom_ord"),
    )


def from_crossings(crossed: DataFrame) -> DataFrame:
    d = payload(line=F.col("line_id"), line_name=F.col("name"), direction=F.col("direction"), direction_canonical=F.col("direction_canonical"), count=F.col("count"))
    return event(crossed, "line_crossed", d, F.col("line_id"), F.col("ord"))


def from_visits(found: DataFrame) -> DataFrame:
    """Entries, dwell alerts and exits; an exit by the track's end comes in the phase of that. One pass over the visits: each becomes its events."""
    none = F.lit(None).cast("double")

    def moment(when: Column, type_: str, phase: Column, frame: str, time: str, cls: Column, d: Column) -> Column:
        parts = {"type": F.lit(type_), "phase": phase, "frame_index": F.col(frame).cast("long"), "timestamp": F.col(time).cast("double"), "vehicle_class": cls, "d": d}
        return F.when(when, F.struct(*[v.alias(k) for k, v in parts.items()]))

    moments = F.array(
        moment(F.lit(True), "zone_entered", F.lit(PHASES["zone_entered"]), "entered_frame", "entered", F.col("vehicle_class"), none),
        moment(F.col("alert_timestamp").isNotNull(), "zone_dwell", F.lit(PHASES["zone_dwell"]), "alert_frame", "alert_timestamp", F.col("vehicle_class"), F.expr("alert_timestamp - entered")),
        moment(F.col("exited").isNotNull(), "zone_exited", F.when(F.col("by_finish"), 6).otherwise(PHASES["zone_exited"]), "exited_frame", "exited", F.col("exit_class"), F.col("dwell_s")),
    )
    rows = found.select(*TRACK, "zone_id", "name", "ord", F.explode(F.array_compact(moments)).alias("m")).select(*TRACK, "zone_id", "name", "ord", "m.*")
    return event(rows, F.col("type"), payload(zone=F.col("zone_id"), zone_name=F.col("name"), dwell_s=F.bround("d", 3)), F.col("zone_id"), F.col("ord"), phase=F.col("phase"))


def from_speeding(rows: DataFrame) -> DataFrame:
    return event(rows, "speeding", payload(speed_kmh=F.col("speed_kmh"), limit_kmh=F.col("limit_kmh")))


def from_plates(rows: DataFrame) -> DataFrame:
    d = payload(plate=F.col("plate"), confidence=F.bround("confidence", 3), corrected=F.col("corrected"), country=F.col("country"), valid=F.col("valid"))
    return event(rows, "plate_read", d)


def from_hits(rows: DataFrame) -> DataFrame:
    d = payload(watchlist=F.col("watchlist_id"), watchlist_name=F.col("watchlist_name"), plate=F.col("plate"))
    return event(rows, "watchlist_hit", d, F.col("watchlist_id"))


def started(track_frames: DataFrame) -> DataFrame:
    """One event per track at its first active row."""
    first = track_frames.where("state = 'active'").groupBy(*TRACK).agg(F.min(F.struct("frame_index", "timestamp", "vehicle_class")).alias("f")).select(*TRACK, "f.*")
    return event(first, "track_started", payload(**{"class": F.col("vehicle_class")}))


def from_summaries(rows: DataFrame) -> DataFrame:
    keys = ("duration_s", "distance_m", "avg_speed_kmh", "max_speed_kmh", "plate", "plate_confidence", "color", "n_points", "first_wall_ts", "last_wall_ts")
    return event(rows, "track_finished", payload(**{"class": F.col("vehicle_class")}, **{k: F.col(k) for k in keys}))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def summaries(finished: DataFrame, points: DataFrame, moving: DataFrame | None = None, distances: DataFrame | None = None, plates: DataFrame | None = None, attributes: DataFrame | None = None, offset: DataFrame | None = None, max_history: int = 600) -> DataFrame:
    """One row per finished track: duration, distance, speeds, plate, colour, attributes, points and wall times.

    ``offset`` (stream_id, run_id, frame_index, wall_ts): the wall clock at the finishing frame, if ``finished`` has no wall_ts itself; the average speed is null unless duration
    and distance are positive. All parts are grouped by track, so their joins share one partitioning.
    """
    seen = points.groupBy(*TRACK).agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count("*").alias("hits"))
    out = finished.drop("hits").join(seen, TRACK)
    none = F.lit(None)
    out = out.join(distances, TRACK, "left") if distances is not None else out.withColumn("distance_m", none.cast("double"))
    out = out.join(moving.groupBy(*TRACK).agg(F.max("speed_kmh").alias("max_speed_kmh")), TRACK, "left") if moving is not None else out.withColumn("max_speed_kmh", none.cast("double"))
    out = out.join(plates.select(*TRACK, "plate", F.col("confidence").alias("plate_confidence")), TRACK, "left") if plates is not None else out.withColumns({"plate": none.cast("string"), "plate_confidence": none.cast("double")})
    out = out.join(attributes, TRACK, "left") if attributes is not None else out.withColumn("attributes", none.cast("map<string,struct<value:string,confidence:double,n_observations:bigint>>"))
    out = out.drop("wall_ts").join(offset.groupBy("stream_id", "run_id", "frame_index").agg(F.min("wall_ts").alias("wall_ts")), ["stream_id", "run_id", "frame_index"], "left") if offset is not None else out if "wall_ts" in out.columns else out.withColumn("wall_ts", F.col("timestamp"))
    d = F.col("t1") - F.col("t0")
    drift = F.col("wall_ts") - F.col("timestamp")
    return out.select(
        *TRACK, "frame_index", "timestamp", "wall_ts", "vehicle_class", F.bround(d, 6).alias("duration_s"), "distance_m", F.when((d > 0) & (F.col("distance_m") > 0), F.col("distance_m") / d * 3.6).alias("avg_speed_kmh"), "max_speed_kmh",
        "plate", "plate_confidence", F.element_at("attributes", "color")["value"].alias("color"), "attributes", F.least("hits", F.lit(max_history)).cast("long").alias("n_points"),
        (F.col("t0") + drift).alias("first_wall_ts"), (F.col("t1") + drift).alias("last_wall_ts"),
    )
