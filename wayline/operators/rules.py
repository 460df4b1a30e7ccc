"""The rules: condition trees over events, compiled to boolean columns; cooldown and the outbox of actions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import event_id, payload
from .folds import spaced
from .lines import TRACK

E = F.col
TYPE = "type"


def _class_ok(classes: list[str] | None) -> Column:
    if classes is None:
        return F.lit(True)
    return F.coalesce(F.coalesce(E("track_class"), E("vehicle_class")).isin(classes), F.lit(False)) if classes else F.lit(False)


def canonical_direction() -> Column:
    d = E("data.direction")
    return F.coalesce(E("data.direction_canonical"), F.when(d.isin("forward", "backward"), d))


def trigger(c: dict) -> Column:
    """Whether an event by itself makes the condition fire."""
    kind, ok = c["type"], _class_ok(c.get("classes"))
    if kind == "line_cross":
        way = c.get("direction", "any")
        return (E(TYPE) == "line_crossed") & (E("data.line") == c["line"]) & ok & (F.lit(True) if way == "any" else canonical_direction() == way)
    if kind == "wrong_way":
        return (E(TYPE) == "line_crossed") & (E("data.line") == c["line"]) & ok & (canonical_direction() != c["allowed"])
    if kind == "zone_enter":
        return (E(TYPE) == "zone_entered") & (E("data.zone") == c["zone"]) & ok
    if kind == "zone_dwell":
        return (E(TYPE) == "zone_dwell") & (E("data.zone") == c["zone"]) & ok & (E("data.dwell_s") >= c.get("min_seconds", 30))
    if kind == "speed":
        return (E(TYPE) == "speeding") & ok & (F.coalesce(E("data.speed_kmh"), E("track_speed")) >= c["min_kmh"])
    if kind == "plate_watchlist":
        return (E(TYPE) == "watchlist_hit") & (F.coalesce(E("data.watchlist"), E("data.watchlist_id")) == c["watchlist"])
    if kind == "any_of":
        return reduce(Column.__or__, [_sure(trigger(m)) for m in c["conditions"]], F.lit(False))
    if kind == "all_of":
        parts = [(_sure(trigger(m)), _sure(state(m))) for m in c["conditions"]]
        if not parts:
            return F.lit(False)
        return reduce(Column.__or__, [t for t, _ in parts]) & reduce(Column.__and__, [t | s for t, s in parts])
    if kind == "class_is":
        return F.lit(False)
    raise ValueError(f"unknown condition {kind!r}")


def state(c: dict) -> Column:
    """Whether the condition holds of the event's track at that frame."""
    kind = c["type"]
    if kind == "zone_dwell":
        return _class_ok(c.get("classes")) & (F.element_at("dwell", c["zone"]) >= c.get("min_seconds", 30))
    if kind == "speed":
        return _class_ok(c.get("classes")) & (E("track_speed") >= c["min_kmh"])
    if kind == "class_is":
        return E("track_class").isin(c["classes"]) if c["classes"] else F.lit(False)
    if kind == "all_of":
        return reduce(Column.__and__, [_sure(state(m)) for m in c["conditions"]], F.lit(True))
    if kind == "any_of":
        return reduce(Column.__or__, [_sure(state(m)) for m in c["conditions"]], F.lit(False))
    return F.lit(False)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def references(c: dict) -> list[tuple[str, str]]:
    """(line, zone or watchlist, id) that a tree names."""
    own = [(k, c[k]) for k in ("line", "zone", "watchlist") if k in c]
    return own + [r for m in c.get("conditions", []) for r in references(m)]


def relevant(rules: list[dict], lines: DataFrame, zones: DataFrame, streams: DataFrame) -> DataFrame:
    """(rule_id, stream_id) of enabled rules on streams that they list (or all) and that have all of the lines and zones they name."""
    spark = lines.sparkSession
    rows = [(r["rule_id"], r.get("streams")) for r in rules if r.get("enabled", True)]
    named = [(r["rule_id"], k, i) for r in rules for k, i in references(r["when"]) if k != "watchlist"]
    every = spark.createDataFrame(rows, "rule_id string, streams array<string>").join(streams.select("stream_id").distinct(), F.expr("streams is null or array_contains(streams, stream_id)"))
    there = lines.select("stream_id", F.lit("line").alias("kind"), F.col("line_id").alias("geom")).union(zones.select("stream_id", F.lit("zone"), "zone_id"))
    needs = every.join(spark.createDataFrame(named, "rule_id string, kind string, geom string"), "rule_id")
    missing = needs.join(there, ["stream_id", "kind", "geom"], "left_anti").select("rule_id", "stream_id").distinct()
    return every.join(missing, ["rule_id", "stream_id"], "left_anti").select("rule_id", "stream_id")


def with_state(events: DataFrame, track_frames: DataFrame | None = None, visits: DataFrame | None = None) -> DataFrame:
    """Events with track_class and track_speed at their frame, and dwell (zone to seconds) of visits that hold them; equi-joins by track."""
    if track_frames is not None:
        speed = F.col("speed_kmh") if "speed_kmh" in track_frames.columns else F.lit(None).cast("double")
        state = track_frames.select(*TRACK, "frame_index", F.col("vehicle_class").alias("track_class"), speed.alias("track_speed"))
        events = events.join(state, [*TRACK, "frame_index"], "left")
    else:
        events = events.withColumn("track_class", F.when(F.col("track_id").isNotNull(), F.col("vehicle_class"))).withColumn("track_speed", F.lit(None).cast("double"))
    if visits is None:
        return events.withColumn("dwell", F.create_map().cast("map<string,double>"))
    v = visits.select(*TRACK, "zone_id", "entered", "exited")
    live = events.select("id", *TRACK, "timestamp").join(v, TRACK).where("entered <= timestamp and (exited is null or timestamp < exited)")
    live = live.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("zone_id", F.col("timestamp") - F.col("entered")))).alias("dwell"))
    return events.join(live, "id", "left")


def hits(events: DataFrame, rules: list[dict], allowed: DataFrame | None = None) -> DataFrame:
    """``events`` (from ``with_state``; may be a stream) with rule_id, rule_name, cooldown_s and rule_ord for each rule that they set off: one column per rule, exploded where it fires.

    Rules are dicts (rule_id, name, when, cooldown_s, enabled, streams, ord). Rule events never trigger rules.
    """
    live = [r for r in rules if r.get("enabled", True)]
    found = []
    for i, r in enumerate(live):
        here = F.lit(True) if r.get("streams") is None else E("stream_id").isin(r["streams"])
        rule = F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r.get("name", r["rule_id"])).alias("rule_name"), F.lit(float(r.get("cooldown_s", 0))).alias("cooldown_s"), F.lit(r.get("ord", i)).alias("rule_ord"))
        found.append(F.when(here & _sure(trigger(r["when"])), rule))
    if not found:
        found = [F.lit(None).cast("struct<rule_id:string,rule_name:string,cooldown_s:double,rule_ord:int>")]
    rows = events.where("type != 'rule_triggered'").withColumn("_r", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())))
    rows = rows.drop("rule_id").select("*", "_r.*").drop("_r")
    if allowed is not None:
        rows = rows.join(allowed, ["rule_id", "stream_id"], "left_semi")
    return rows


def fire(events: DataFrame, rules: list[dict], allowed: DataFrame | None = None) -> DataFrame:
    """Rule events: ``hits`` after the cooldown by (stream, run, rule, track)."""
    rows = hits(events, rules, allowed)
    return rule_events(spaced(rows, ["stream_id", "run_id", "rule_id", "track_id"], "timestamp", ["frame_index", "phase", "geom_ord", "id"], F.col("cooldown_s")))


def rule_events(fired: DataFrame) -> DataFrame:
    return fired.select(
        event_id(F.lit("rule_triggered"), "rule_id", "id").alias("id"), F.lit("rule_triggered").alias("type"), "stream_id", "run_id", "timestamp", "wall_ts", "track_id", "rule_id",
        F.coalesce("track_class", "vehicle_class").alias("vehicle_class"), payload(rule_name=F.col("rule_name"), trigger=F.col("type")).alias("data"), F.lit(None).cast("string").alias("snapshot_path"),
        "frame_index", F.lit(8).alias("phase"), F.col("rule_ord").cast("int").alias("geom_ord"), F.col("data").alias("trigger_data"),
    )


def outbox(fired: DataFrame, actions: DataFrame, redact: bool = True) -> DataFrame:
    """A row for each fired rule and action (rule_id, kind, url, headers, timeout_s, level): snapshots first, then webhooks and logs with the event as JSON.

    Plates are blanked in payloads unless ``redact`` is off; delivery is left to whoever reads the table.
    """
    body = F.struct("id", "type", "stream_id", "timestamp", "wall_ts", "track_id", "rule_id", "vehicle_class", (F.col("trigger_data").withField("plate", F.lit(None).cast("string")) if redact else F.col("trigger_data")).alias("trigger_data"))
    rows = fired.join(actions, "rule_id")
    order = F.when(F.col("kind") == "snapshot", 0).otherwise(1)
    return rows.select("id", "rule_id", "kind", order.alias("step"), (F.col("kind") == "snapshot").alias("snapshot_requested"), "url", "headers", "timeout_s", "level", F.when(F.col("kind") != "snapshot", F.to_json(body)).alias("payload"))


def parse(rules: DataFrame) -> list[dict]:
    """Rules from their table (a dimension that people write, so it is small)."""
    out = []
    for r in rules.orderBy("ord").collect():
        out.append({"rule_id": r["rule_id"], "name": r["name"], "enabled": r["enabled"], "when": json.loads(r["when_json"]), "cooldown_s": r["cooldown_s"], "streams": r["streams"], "ord": r["ord"]})
    return out
