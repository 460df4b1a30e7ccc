"""Golden trajectories: lines, zones, motion, votes, rules."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from wayline import schemas
from wayline.operators import attributes, events, lines, motion, rules, zones
from wayline.operators.folds import SPREAD
from wayline.plans import derived
from wayline.sources.readers import dimension

ROW = "stream_id string, run_id string, track_id long, frame_index long, timestamp double, state string, vehicle_class string, x1 double, y1 double, x2 double, y2 double, score double"


def path(spark, tracks):
    """tracks: (track, class, state, [(t, x, y)])"""
    rows = [("s", "r", k, i, float(t), state, cls, x - 2.0, y - 4.0, x + 2.0, float(y), 0.9) for k, cls, state, pts in tracks for i, (t, x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, ROW)


def line(spark, classes=None):
    return dimension(spark, [{"stream_id": "s", "line_id": "l", "name": "L", "ax": 100.0, "ay": 200.0, "bx": 100.0, "by": 0.0, "forward_label": "eastbound", "backward_label": "westbound", "classes": classes}], schemas.LINES, "lines")


def step(xs, y=100.0):
    return [(i * 0.1, x, y) for i, x in enumerate(xs)]


def test_crossings(spark):
    tracks = [(1, "car", "active", step([60, 80, 90, 110, 130, 150])), (2, "car", "active", step([80, 90, 95, 110, 115, 120, 90, 80])), (3, "car", "active", step([80, 90, 95, 105, 95, 105, 110, 120])), (4, "car", "tentative", step([80, 90, 110, 130]))]
    got = {}
    for r in lines.crossings(path(spark, tracks), line(spark)).orderBy("frame_index").collect():
        got.setdefault(r["track_id"], []).append(r["direction"])
    assert got == {1: ["eastbound"], 2: ["eastbound", "westbound"], 3: ["eastbound"]}
    two = path(spark, [(1, "car", "active", step([80, 90, 110, 130])), (2, "truck", "active", step([80, 90, 110, 130], 120.0))])
    out = lines.crossings(two, line(spark, ["truck"]))
    assert [(r["track_id"], r["count"]) for r in out.collect()] == [(2, 1)]
    assert {(r["direction"], r["n"]) for r in lines.counts(out, line(spark)).collect()} == {("eastbound", 1), ("westbound", 0)}


def zone(spark):
    points = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]
    return dimension(spark, [{"stream_id": "s", "zone_id": "z1", "name": "Z", "points": points, "dwell_alert_s": 2.0}], schemas.ZONES, "zones")


def test_visits(spark):
    seen = [(0, 300, 100), (0.5, 100, 100), (1, 100, 100), (1.5, 110, 100), (2, 120, 100), (2.5, 120, 100), (3, 130, 100), (3.5, 300, 100)]
    stays = [(1, 100, 100)]
    rows = path(spark, [(1, "car", "active", seen), (2, "car", "active", stays)])
    ends = spark.createDataFrame([("s", "r", 2, 9, 4.0, "car", True, 1)], schemas.FINISHED)
    got = {r["track_id"]: r for r in zones.visits(rows, zone(spark), ends).collect()}
    assert (got[1]["entered"], got[1]["exited"], got[1]["dwell_s"], got[1]["alert_timestamp"]) == (0.5, 3.5, 3.0, 2.5)
    assert got[2]["dwell_s"] == 3.0 and got[2]["by_finish"] and got[2]["alert_timestamp"] is None


def test_motion(spark):
    cal = spark.createDataFrame([("s", [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0], [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 1.0])], schemas.CALIBRATIONS)
    east = step([20.0 * i for i in range(31)], 50.0)
    long = [(i * 0.1, 20.0 * i, 50.0) for i in range(351)]
    gap = [(0, 0, 50), (0.1, 20, 50), (0.2, 40, 50), (0.3, 60, 50), (6.0, 1200, 50)]
    north = [(i * 0.1, 0.0, 500.0 - 20 * i) for i in range(20)]
    rows = path(spark, [(1, "car", "active", east), (2, "car", "active", long), (3, "car", "active", gap), (4, "car", "active", north)])
    grounded = motion.ground(rows, cal)
    moving = motion.smooth(motion.velocity(grounded)).cache()
    last = {r["track_id"]: r for r in moving.groupBy("track_id").agg(F.max_by("speed_kmh", "frame_index").alias("v"), F.max_by("direction_deg", "frame_index").alias("d"), F.min(F.when(F.col("speed_kmh").isNotNull(), F.col("timestamp"))).alias("t")).collect()}
    assert abs(last[1]["v"] - 72) < 0.02 * 72 and abs(last[1]["t"] - 0.7) < 1e-6 and last[1]["d"] == 0 and last[3]["v"] is None and abs(last[4]["d"] - 270) < 1e-6
    d = {r["track_id"]: r["distance_m"] for r in motion.distance(grounded).collect()}
    assert abs(d[1] - 60) < 0.6
    limits = spark.createDataFrame([("s", 60.0)], "stream_id string, limit_kmh double")
    n = {r["track_id"]: r["n"] for r in motion.speeding(moving, limits).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 2, 4: 1}


def test_class_votes(spark):
    cls = ["car", "car", "truck", "car", "truck", "truck", "truck"]
    rows = spark.createDataFrame([("s", "r", 1, i, i * 0.1, c, 0.9) for i, c in enumerate(cls)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, vehicle_class string, score double")
    assert attributes.class_vote(rows).first()["vehicle_class"] == "truck"
    assert [r["class_now"] for r in attributes.running_class(rows).orderBy("frame_index").collect()] == ["car"] * 6 + ["truck"]


def test_fusion(spark):
    schema = "stream_id string, run_id string, track_id long, key string, value string, confidence double, seq long"
    obs = [("s", "r", 1, "color", "blue", 0.6, 1), ("s", "r", 1, "color", "red", 0.5, 2), ("s", "r", 1, "color", "red", 0.5, 3), ("s", "r", 1, "color", "green", 0.0, 4), ("s", "r", 2, "color", "white", 5.0, 1)]
    got = {r["track_id"]: r for r in attributes.fuse(spark.createDataFrame(obs, schema)).collect()}
    assert got[1]["value"] == "red" and abs(got[1]["confidence"] - 1.0 / 1.6) < 1e-12 and got[1]["n_observations"] == 3 and got[2]["confidence"] == 1.0


@pytest.mark.parametrize("bgr, name", [((255, 255, 255), "white"), ((15, 15, 15), "black"), ((128, 128, 128), "gray"), ((190, 190, 190), "silver"), ((30, 30, 200), "red"), ((200, 60, 30), "blue"), ((40, 200, 40), "green"), ((0, 220, 220), "yellow"), ((0, 140, 255), "orange"), ((19, 69, 139), "brown")])
def test_colors(spark, bgr, name):
    rows = spark.createDataFrame([("c", *bgr)] * 9, "crop_id string, b int, g int, r int")
    got = attributes.name_colors(rows).first()
    assert (got["color"], got["confidence"]) == (name, 1.0)


def dwell_events(spark):
    rows = spark.createDataFrame([("s", "r", 1, 5, 2.5, "truck"), ("s", "r", 2, 5, 2.5, "car"), ("s", "r", None, 6, 3.0, "car")], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, vehicle_class string")
    return events.event(rows, "zone_dwell", events.payload(zone=F.lit("z1"), dwell_s=F.lit(2.5)))


@pytest.mark.parametrize("least, want", [(2.0, [1]), (5.0, [])])
def test_all_of(spark, least, want):
    rule = {"rule_id": "r", "when": {"type": "all_of", "conditions": [{"type": "zone_dwell", "zone": "z1", "min_seconds": least}, {"type": "class_is", "classes": ["truck"]}]}, "cooldown_s": 0}
    fired = rules.fire(rules.with_state(dwell_events(spark)), [rule])
    assert [r["track_id"] for r in fired.collect()] == want


def test_cooldown_and_geometry(spark):
    rows = spark.createDataFrame([("s", "r", None, i, float(i), None) for i in range(10)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, vehicle_class string")
    e = events.event(rows, "zone_entered", events.payload(zone=F.lit("z1")))
    rule = {"rule_id": "a", "when": {"type": "zone_enter", "zone": "z1"}, "cooldown_s": 4.0}
    fired = rules.fire(rules.with_state(e), [rule, {**rule, "rule_id": "off", "enabled": False}, {**rule, "rule_id": "other", "streams": ["t"]}])
    assert sorted(r["timestamp"] for r in fired.collect()) == [0.0, 4.0, 8.0]
    lost = {"rule_id": "lost", "when": {"type": "zone_enter", "zone": "nowhere"}}
    allowed = rules.relevant([rule, lost], line(spark), zone(spark), rows)
    assert [tuple(r) for r in allowed.collect()] == [("a", "s")]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def track_sorts(df):
    return len(re.findall(r"\bSort \[stream_id#\d+ ASC NULLS FIRST, run_id#\d+ ASC NULLS FIRST, track_id", plan(df)))


def exchanges(df):
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]


def test_crossings_sort_tracks_once(spark):
    """Rows of tracks are sorted once, in partitions that adaptive execution leaves alone."""
    df = lines.crossings(path(spark, [(1, "car", "active", step([60, 80, 90, 110, 130]))]), line(spark))
    assert track_sorts(df) == 1 and exchanges(df) == [4 * SPREAD]


def test_changes_of_side(spark):
    """Rows on a side are counted anew after each change, rows on the line count for none."""
    xs = [90, 110, 110, 90, 110, 110, 100, 90, 90, 110]
    got = lines.crossings(path(spark, [(1, "car", "active", step(xs))]), line(spark)).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["direction_canonical"], r["count"]) for r in got] == [(1, "forward", 1), (3, "backward", 1), (6, "backward", 2), (9, "forward", 2)]


def test_visits_sort_tracks_once(spark):
    """The rows of a track are sorted once; what is grouped by visit after that are entries, alerts and exits."""
    area = dimension(spark, [{"stream_id": "s", "zone_id": "z", "name": "Z", "points": [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)], "dwell_alert_s": 0.2}], schemas.ZONES, "zones")
    df = zones.visits(path(spark, [(1, "car", "active", step([300, 100, 100, 100, 300, 300, 100]))]), area)
    assert exchanges(df) == [4 * SPREAD] and "visit" not in "".join(re.findall(r"windowspecdefinition\(([^)]*)\)", plan(df)))
    got = [(r["visit"], r["entered_frame"], r["exited_frame"], r["alert_frame"]) for r in df.orderBy("visit").collect()]
    assert got == [(1, 1, 4, 3), (2, 6, None, None)]


def test_visits_become_events_in_one_pass(spark):
    area = dimension(spark, [{"stream_id": "s", "zone_id": "z", "name": "Z", "points": [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)], "dwell_alert_s": 0.2}], schemas.ZONES, "zones")
    rows = path(spark, [(1, "car", "active", step([300, 100, 100, 100, 300, 100]))])
    done = spark.createDataFrame([("s", "r", 1, 0.9, 9, "car")], "stream_id string, run_id string, track_id long, timestamp double, frame_index long, vehicle_class string")
    df = events.from_visits(zones.visits(rows, area, done))
    assert exchanges(df) == [4 * SPREAD] and "Union" not in plan(df)
    got = [(r["type"], r["frame_index"], r["phase"], r["data"]["dwell_s"]) for r in df.orderBy("frame_index").collect()]
    assert got == [("zone_entered", 1, 5, None), ("zone_dwell", 3, 5, 0.2), ("zone_exited", 4, 5, 0.3), ("zone_entered", 5, 5, None), ("zone_exited", 9, 6, 0.4)]


def test_boxes_and_trajectories_are_sorted_in_even_parts(spark):
    """A frame's or track's rows are sorted in a fixed number of partitions, however few bytes they are on the wire."""
    for made in (derived.boxes, derived.trajectories):
        assert exchanges(made(spark, "/root/testdata/sf0.001")) == [4 * SPREAD]
    t = derived.trajectories(spark, "/root/testdata/sf0.001")  # with a constant run
    for df in (lines.crossings(t, derived.lines(spark)).drop("count"), zones.visits(t, derived.zones(spark))):
        assert exchanges(df) == [4 * SPREAD] * 2 and "track_id#" not in "".join(re.findall(r"Exchange hashpartitioning\(.*ENSURE_REQUIREMENTS", plan(df)))
