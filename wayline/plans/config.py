"""Configuration from its file: streams with their geometry, watchlists and rules, as the tables that the jobs take.

The file is JSON, one document that people write, so it is small and is read by the driver; its tables are joined like any others. What it leaves out takes defaults.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import calibration, config_checks, rules, tracking
from ..sources.readers import dimension
from .batch import Dimensions

STREAMS = "stream_id string, name string, source string, enabled boolean, fps_cap double, resize_width int, limit_kmh double, window_s double, min_track_s double, ema_alpha double, governor boolean, idle_fps double, active_fps double, settle_s double"
ACTIONS = "rule_id string, kind string, url string, headers map<string,string>, timeout_s double, level string"
REFS = "rule_id string, stream_id string, kind string, geom string"
#: Defaults of the sections.
SPEED = {"enabled": True, "window_s": 1.0, "min_track_s": 0.7, "ema_alpha": 0.35, "limit_kmh": None}
GOVERNOR = {"enabled": True, "idle_fps": 2.0, "active_fps": 15.0, "settle_s": 3.0}
SNAPSHOTS = {"enabled": True, "on_events": ["watchlist_hit", "speeding", "wrong_way", "rule_triggered"], "max_per_minute": 60}
ALPR = {"enabled": True, "min_detection_score": 0.4, "min_ocr_confidence": 0.45, "country": "TR", "every_n_frames": 3, "vote_min_reads": 2, "min_plate_height_px": 14}
TRACKER = {"activation_score": "activation", "min_score": "min_score", "match_iou": "match_iou", "min_hits": "min_hits", "lost_ttl": "lost_ttl", "max_history": "max_history"}
WEBHOOK_S, LOG_LEVEL = 5.0, "warning"


@dataclass
class Config:
    streams: DataFrame
    dims: Dimensions
    tracker: tracking.Config
    actions: DataFrame
    snapshots: dict
    violations: DataFrame


def load_config(spark: SparkSession, path: str) -> Config:
    """The configuration at ``path``. Malformed geometry and classes that don't exist raise ValueError; ids that are found twice or point nowhere are rows of ``violations``.

    Streams whose speed section is off have no limit. A watchlist's plates are a row each.
    """
    texts = spark.read.format("text").options(wholetext=True).load(path).limit(1).collect()
    return from_document(spark, json.loads(texts[0][0]))


def from_document(spark: SparkSession, doc: dict) -> Config:
    streams = doc.get("streams", [])
    lines, zones, points, rows, limits = [], [], [], [], []
    for s in streams:
        speed, governor = {**SPEED, **s.get("speed", {})}, {**GOVERNOR, **s.get("governor", {})}
        limit = speed["limit_kmh"] if speed["enabled"] else None
        rows.append((s["id"], s.get("name", ""), s["source"], s.get("enabled", True), _number(s.get("fps_cap")), s.get("resize_width"), _number(limit), float(speed["window_s"]), float(speed["min_track_s"]), float(speed["ema_alpha"]), governor["enabled"], float(governor["idle_fps"]), float(governor["active_fps"]), float(governor["settle_s"])))
        if limit is not None:
            limits.append((s["id"], float(limit)))
        for line in s.get("lines", []):
            (ax, ay), (bx, by) = _points(line, 2, 2)
            lines.append({"stream_id": s["id"], "line_id": line["id"], "name": line.get("name", ""), "ax": ax, "ay": ay, "bx": bx, "by": by, "classes": _classes(line), **{k: line[k] for k in ("forward_label", "backward_label") if k in line}})
        for zone in s.get("zones", []):
            zones.append({"stream_id": s["id"], "zone_id": zone["id"], "name": zone.get("name", ""), "points": _points(zone, 3), "classes": _classes(zone), "dwell_alert_s": _number(zone.get("dwell_alert_s"))})
        if s.get("calibration"):
            image, ground = (s["calibration"][k] for k in ("image_points", "ground_points"))
            if len(image) < 4 or len(image) != len(ground):
                raise ValueError(f"stream {s['id']}: a calibration needs four pairs of points or more, as many on the image as on the ground")
            points += [(s["id"], *map(float, (*a, *b))) for a, b in zip(image, ground)]
    known = [_rule(r, i) for i, r in enumerate(doc.get("rules", []))]
    lists = [(w["id"], w.get("name", ""), p) for w in doc.get("watchlists", []) for p in w.get("plates", [])]
    names = [(w["id"], None, None) for w in doc.get("watchlists", [])]
    refs = [(r["rule_id"], s, k, i) for r in known for k, i in rules.references(r["when"]) for s in (r["streams"] if r["streams"] is not None else [None])]
    refs += [(r["rule_id"], s, "stream", None) for r in known for s in r["streams"] or []]
    actions = [(r["rule_id"], a["type"], a.get("url"), a.get("headers"), float(a.get("timeout_s", WEBHOOK_S)) if a["type"] == "webhook" else None, a.get("level", LOG_LEVEL) if a["type"] == "log" else None) for r in known for a in r["actions"]]
    table, line_dim, zone_dim = spark.createDataFrame(rows, STREAMS), dimension(spark, lines, schemas.LINES, "lines"), dimension(spark, zones, schemas.ZONES, "zones")
    watchlists = spark.createDataFrame(lists, schemas.WATCHLISTS)
    alpr = {**ALPR, **doc.get("alpr", {})}
    gates = {"every_n": alpr["every_n_frames"], "min_score": alpr["min_detection_score"], "min_height": alpr["min_plate_height_px"], "min_conf": alpr["min_ocr_confidence"]}
    dims = Dimensions(
        line_dim, zone_dim, calibration.fit(spark.createDataFrame(points, schemas.CALIBRATION_POINTS)), spark.createDataFrame(limits, "stream_id string, limit_kmh double"),
        known, watchlists if lists else None, alpr["country"], alpr["vote_min_reads"], gates,
    )
    wrong = config_checks.violations(table, line_dim, zone_dim, spark.createDataFrame([(r["rule_id"],) for r in known], "rule_id string"), spark.createDataFrame(names, schemas.WATCHLISTS), spark.createDataFrame(refs, REFS))
    tracker = tracking.Config(**{TRACKER[k]: v for k, v in doc.get("tracker", {}).items() if k in TRACKER})
    return Config(table, dims, tracker, spark.createDataFrame(actions, ACTIONS), {**SNAPSHOTS, **doc.get("snapshots", {})}, wrong)


def _number(v) -> float | None:
    return None if v is None else float(v)


def _points(shape: dict, least: int, most: int | None = None) -> list[tuple[float, float]]:
    found = [(float(x), float(y)) for x, y in shape["points"]]
    if len(found) < least or most is not None and len(found) > most:
        raise ValueError(f"{shape['id']}: a line has two points, a zone three or more")
    return found


def _classes(shape: dict) -> list[str] | None:
    found = shape.get("classes")
    if unknown := set(found or ()) - set(schemas.VEHICLE_CLASSES):
        raise ValueError(f"{shape.get('id', shape.get('type'))}: no such classes: {sorted(unknown)}")
    return found


def _rule(r: dict, i: int) -> dict:
    def check(c: dict) -> None:
        _classes(c)
        rules.trigger(c)  # raises on conditions of no known type
        for m in c.get("conditions", []):
            check(m)

    check(r["when"])
    return {"rule_id": r["id"], "name": r.get("name", ""), "enabled": r.get("enabled", True), "when": r["when"], "actions": r.get("actions", []), "cooldown_s": float(r.get("cooldown_s", 10.0)), "streams": r.get("streams"), "ord": i}
