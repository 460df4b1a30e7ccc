"""Configuration from its file: tables, defaults, what is refused."""

import json

import pytest

from wayline.plans.config import from_document, load_config

DOC = {
    "tracker": {"lost_ttl": 3.0, "type": "bytetrack"},
    "streams": [
        {"id": "007", "source": "a.mp4", "speed": {"limit_kmh": 50}, "lines": [{"id": "l", "points": [[1, 2], [3, 4]]}], "zones": [{"id": "z", "points": [[0, 0], [9, 0], [9, 9]], "classes": ["car"], "dwell_alert_s": 4}],
         "calibration": {"image_points": [[0, 0], [10, 0], [10, 10], [0, 10]], "ground_points": [[0, 0], [1, 0], [1, 1], [0, 1]]}},
        {"id": "b", "source": "b.mp4", "speed": {"limit_kmh": 30, "enabled": False}, "zones": [{"id": "z2", "points": [[0, 0], [9, 0], [9, 9]]}], "governor": {"idle_fps": 1}},
    ],
    "watchlists": [{"id": "w", "name": "Stolen", "plates": ["34 abc 123", "06xy99"]}, {"id": "empty"}],
    "rules": [
        {"id": "r1", "when": {"type": "line_cross", "line": "l"}, "actions": [{"type": "webhook", "url": "https://example.org"}, {"type": "log"}, {"type": "snapshot"}]},
        {"id": "r2", "when": {"type": "all_of", "conditions": [{"type": "zone_enter", "zone": "z"}, {"type": "class_is", "classes": ["bus"]}]}, "streams": ["b", "gone"], "cooldown_s": 0},
        {"id": "r1", "when": {"type": "plate_watchlist", "watchlist": "nowhere"}, "enabled": False},
    ],
}


def test_a_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(DOC, indent=1))
    c = load_config(spark, f"{tmp_path}/c.json")
    s = {r["stream_id"]: r for r in c.streams.collect()}
    assert (s["007"]["limit_kmh"], s["007"]["ema_alpha"], s["007"]["active_fps"], s["b"]["limit_kmh"], s["b"]["idle_fps"], s["b"]["enabled"]) == (50.0, 0.35, 15.0, None, 1.0, True)
    line = c.dims.lines.first()
    assert (line["ax"], line["by"], line["forward_label"], line["classes"]) == (1.0, 4.0, "forward", None)
    zones = {r["zone_id"]: r for r in c.dims.zones.collect()}
    assert zones["z"]["dwell_alert_s"] == 4.0 and zones["z2"]["dwell_alert_s"] is None and zones["z"]["classes"] == ["car"] and len(zones["z"]["points"]) == 3
    h = c.dims.calibrations.collect()
    assert [r["stream_id"] for r in h] == ["007"] and abs(h[0]["h"][0] - 0.1) < 1e-9 and c.dims.limits.collect() == [("007", 50.0)]
    assert c.tracker.lost_ttl == 3.0 and c.tracker.min_hits == 3 and c.snapshots["max_per_minute"] == 60 and c.dims.plate_gates["every_n"] == 3
    assert [(r["rule_id"], r["cooldown_s"], r["enabled"], r["streams"]) for r in c.dims.rule_list] == [("r1", 10.0, True, None), ("r2", 0.0, True, ["b", "gone"]), ("r1", 10.0, False, None)]
    assert sorted((a["kind"], a["timeout_s"], a["level"]) for a in c.actions.collect()) == [("log", None, "warning"), ("snapshot", None, None), ("webhook", 5.0, None)]
    assert c.dims.watchlists.count() == 2
    assert {tuple(r) for r in c.violations.collect()} == {("duplicate", "rule", "r1"), ("unknown", "stream", "gone"), ("unknown", "zone", "b/z"), ("unknown", "zone", "gone/z"), ("unknown", "watchlist", "nowhere")}


def test_what_is_refused(spark):
    bad = lambda **s: {"streams": [{"id": "s", "source": "x", **s}]}
    for doc in (bad(lines=[{"id": "l", "points": [[1, 2]]}]), bad(zones=[{"id": "z", "points": [[1, 2], [3, 4]]}]), bad(zones=[{"id": "z", "points": [[0, 0], [1, 0], [1, 1]], "classes": ["boat"]}]),
                bad(calibration={"image_points": [[0, 0]] * 4, "ground_points": [[0, 0]] * 3}), {"rules": [{"id": "r", "when": {"type": "moon"}}]}):
        with pytest.raises(ValueError):
            from_document(spark, doc)
    empty = from_document(spark, {})
    assert empty.streams.count() == 0 and empty.dims.lines.count() == 0 and empty.violations.count() == 0 and empty.dims.watchlists is None
