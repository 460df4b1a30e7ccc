"""Column functions against plain arithmetic."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayline.functions import geometry as G
from wayline.functions import plates as P
from wayline.functions import text as T
from wayline import schemas
from wayline.functions.registry import register_functions
from wayline.operators import calibration
from wayline.operators import plates


def test_boxes_and_letterbox(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0, 5.0, 5.0, 105.0, 105.0), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double, bx1 double, by1 double, bx2 double, by2 double")
    b = {k: F.col(f"b{k}") for k in ("x1", "y1", "x2", "y2")}
    got = rows.select(G.iou(G.box(), b).alias("iou"), G.area(G.box()).alias("a")).collect()
    assert abs(got[0]["iou"] - 9025 / 10975) < 1e-12 and got[1]["iou"] == 0 and got[0]["a"] == 10_000
    meta = G.letterbox(F.lit(1920), F.lit(1080), 640, 640)
    back = G.from_letterbox(G.to_letterbox(b, meta), meta)
    one = rows.select(meta[3].alias("pad"), back["x2"].alias("x2")).first()
    assert one["pad"] == 140 and abs(one["x2"] - 105) < 1e-9
    clipped = rows.select(G.clip(b, 100, 50)["x2"].alias("x"), G.clip(b, 100, 50)["y2"].alias("y")).first()
    assert tuple(clipped) == (100, 50)


def plain_inside(points, x, y):
    hit, j = False, len(points) - 1
    for i, (px, py) in enumerate(points):
        qx, qy = points[j]
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            hit = not hit
        j = i
    return hit


def test_polygon(spark):
    random.seed(3)
    shape = [(0.0, 0.0), (10.0, 0.0), (4.0, 5.0), (10.0, 10.0), (0.0, 10.0)]
    spots = [(float(random.randrange(-2, 13)), float(random.randrange(-2, 13))) for _ in range(150)]
    poly = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shape])
    got = [r["i"] for r in spark.createDataFrame(spots, "x double, y double").select(G.in_polygon(poly, F.col("x"), F.col("y")).alias("i")).collect()]
    assert got == [plain_inside(shape, x, y) for x, y in spots]


def test_homography_round_trip(spark):
    pairs = [("a", 0, 60, 0, 0), ("a", 640, 60, 64, 0), ("a", 640, 320, 64, 26), ("a", 0, 320, 0, 26), ("few", 0, 0, 0, 0), *[("flat", i, i, i, i) for i in range(6)]]
    pairs += [("tilted", x, y, (2 * x + y + 3) / (0.001 * x + 1), (x - y) / (0.001 * x + 1)) for x in (0, 100, 300) for y in (0, 50, 200)]
    fitted = {r["stream_id"]: r for r in calibration.fit(spark.createDataFrame([(s, *map(float, p)) for s, *p in pairs], schemas.CALIBRATION_POINTS)).collect()}
    assert set(fitted) == {"a", "tilted"} and abs(np.array(fitted["tilted"]["h"]) - [2, 1, 3, 1, -1, 0, 0.001, 0, 1]).max() < 1e-6
    assert abs(np.array(fitted["tilted"]["h"]).reshape(3, 3) @ np.array(fitted["tilted"]["inverse"]).reshape(3, 3) - np.eye(3)).max() < 1e-6
    h = fitted["a"]["h"]
    x, y = G.project(F.array(*map(F.lit, h)), F.lit(320.0), F.lit(190.0))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got["x"] - 32) < 1e-6 and abs(got["y"] - 13) < 1e-6


def test_plates(spark):
    cases = {"34 abc 123": ("34ABC123", True, False), "34A8C123": ("34ABC123", True, True), "O1AB1234": ("01A81234", True, True), "99AB1234": ("99AB1234", False, False), "": ("", False, False), "34şğ12": ("34SG12", False, False)}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", P.correct(F.col("text")).alias("c")).collect()
    for r in rows:
        want = cases[r["text"]]
        assert (r["c"]["valid"], r["c"]["corrected"]) == want[1:] and (not want[1] or r["c"]["text"] == want[0]), r
    a, b = spark.range(1).select(P.hashed(F.lit("34 abc 123"), "s"), P.hashed(F.lit("34ABC123"), "s")).first()
    assert a == b and len(a) == 64


def test_votes():
    v = plates.Vote(2)
    assert v.add("34ABC123", 0.9) is None and v.add("34A8C123", 0.6) is None
    plate, conf, n = v.add("34ABC123", 0.8)
    assert (plate, n) == ("34ABC123", 2) and abs(conf - (7 + 1.7 / 2.3) / 8) < 1e-12
    v, got = plates.Vote(2), []
    for t, c in (("34AB123", 0.5), ("34AB123", 0.5), ("34AB124", 0.9), ("34AB124", 0.9)):
        got.append(v.add(t, c))
    assert [g and g[0] for g in got] == [None, "34AB123", None, "34AB124"]


def test_votes_of_equal_weight(spark):
    """Sums that only the order of adding tells apart are equal: the longer length leads, then the character seen first."""
    short, long = [0.83, 0.64, 0.98, 0.78, 0.81], [0.98, 0.83, 0.78, 0.64, 0.81]
    reads = [("s", "r", 1, i, text, c) for i, (text, c) in enumerate([("51VZ50", c) for c in short] + [("51VZ505", c) for c in long])]
    df = spark.createDataFrame(reads, "stream_id string, run_id string, track_id long, seq long, text string, conf double")
    assert [(r["seq"], r["plate"]) for r in plates.emissions(df).orderBy("seq").collect()] == [(1, "51VZ50"), (9, "51VZ505")]
    assert [(r["seq"], r["plate"], r["valid"]) for r in plates.settled(plates.with_correction(df)).orderBy("seq").collect()] == [(1, "51VZ50", False), (9, "51VZ505", True)]


def test_consensus_agrees_with_votes(spark):
    reads = [("s", "r", 1, 1, "34ABC123", 0.9), ("s", "r", 1, 2, "34A8C123", 0.6), ("s", "r", 1, 3, "34ABC123", 0.8), ("s", "r", 2, 1, "34ABC12", 0.9), ("s", "r", 2, 2, "34ABC123", 0.9), ("s", "r", 2, 3, "34ABC123", 0.9)]
    df = spark.createDataFrame(reads, "stream_id string, run_id string, track_id long, seq long, text string, conf double")
    got = {r["track_id"]: r for r in plates.consensus(df).collect()}
    assert got[1]["plate"] == got[2]["plate"] == "34ABC123" and got[1]["n_reads"] == 2 and abs(got[1]["confidence"] - (7 + 1.7 / 2.3) / 8) < 1e-12
    out = [(r["track_id"], r["seq"], r["plate"]) for r in plates.emissions(df).orderBy("track_id", "seq").collect()]
    assert out == [(1, 3, "34ABC123"), (2, 3, "34ABC123")]


def test_text(spark):
    got = spark.range(1).select(
        T.vehicle_class(F.lit(" Fire Truck ")), T.vehicle_class(F.lit("dog")), T.scrub_credentials(F.lit("rtsp://u:p@h/x api_key=1&b")), T.utc_day(F.lit(86400.0)), T.remap_annotation(F.lit("2 .5 .5 .2 .2 0.9"), {2: 0}), T.remap_annotation(F.lit("not a label"), {2: 0}),
    ).first()
    assert tuple(got) == ("emergency", None, "rtsp://***@h/x api_key=***&b", "19700102", "0 .5 .5 .2 .2 0.9", None)


def test_sql_functions(spark):
    assert "normalize_plate" in register_functions(spark)
    got = spark.sql("select line_crossing(100, 200, 100, 0, 101, 50, 100, 50) a, line_crossing(100, 200, 100, 0, 100, 50, 99, 50) b, line_crossing(100, 200, 100, 0, 99, 50, 100, 50) c, box_iou(0, 0, 2, 2, 1, 0, 3, 2) d, in_polygon(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 4D)), 1, 1) e, plate_at_rest('34 a', 'plain', '') f, vehicle_class(' Pickup Truck') g, scrub_credentials('rtsp://u:p@h/x?api_key=1&b') h, polygon_centroid(array(named_struct('x', 0D, 'y', 2D), named_struct('x', 4D, 'y', 0D))).x i, project(array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 2D), 4, 2).x j").first()
    assert tuple(got)[:3] == (-1, 0, 1) and abs(got["d"] - 1 / 3) < 1e-12 and tuple(got)[4:] == (True, "34A", "truck", "rtsp://***@h/x?api_key=***&b", 2.0, 2.0)


def test_points_on_the_line(spark):
    """A point on the line belongs to the side it came from: a touch counts once, and leaving the line again doesn't count."""
    line = {"ax": F.lit(100.0), "ay": F.lit(200.0), "bx": F.lit(100.0), "by": F.lit(0.0)}
    steps = {(99, 100): 1, (100, 101): 0, (101, 100): -1, (100, 99): 0, (99, 101): 1, (101, 99): -1, (100, 100): 0}
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in steps], "a double, b double").select("a", "b", G.crossing(line, F.col("a"), F.lit(50.0), F.col("b"), F.lit(60.0)).alias("way"))
    assert {(r["a"], r["b"]): r["way"] for r in rows.collect()} == steps
    r = spark.sql("select normalize_plate('34 şb-1') a, tr_plate_valid('34ABC123') b, box_area(0, 0, 2, 3) c, heading_deg(0, -1) d").first()
    assert tuple(r) == ("34SB1", True, 6.0, 270.0)
