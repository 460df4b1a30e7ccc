"""Streams against tables: several micro-batches, a restart from the checkpoint, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from wayline import schemas
from wayline.operators import lines, motion, tracking, zones
from wayline.sources.readers import dimension
from wayline.streaming import trajectories as S
from wayline.streaming.processors import sink

ROWS = tracking.ROWS


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    """Six tracks that wander over two lines and two zones, in three files of frames; two of them never finish."""
    path = str(tmp_path_factory.mktemp("tracked"))
    random.seed(8)
    rows = []
    for k in range(6):
        x, y, last = 100.0 + random.random(), 120.0, 60 + 20 * (k % 3)
        for f in range(last):
            x, y = x + random.choice([-17.0, -3.0, 0.0, 4.0, 18.0]), y + random.choice([-6.0, 0.0, 6.0])
            if f % 10 == 5:
                x = 100.0  # on the line
            lost = random.random() < 0.1
            rows.append((f"cam{k % 2}", "r", k, f, f * 0.1, "lost" if lost else "active", not lost, x - 2, y - 4, x + 2, y, random.choice(["car", "truck"]) if k == 5 else "car", 0.9, f + 1, 0.9, False, None))
        if k > 1:
            rows.append((f"cam{k % 2}", "r", k, last + 9, (last + 9) * 0.1, "finished", False, None, None, None, None, "car", None, last, None, True, True))
    df = spark.createDataFrame(rows, ROWS)
    for lo, hi in ((0, 25), (25, 50), (50, 1000)):
        df.where(F.col("frame_index").between(lo, hi - 1)).coalesce(1).write.parquet(f"{path}/all/{lo:04d}")
    line = [{"stream_id": s, "line_id": n, "name": n, "ax": x, "ay": 300.0, "bx": x, "by": -100.0, "classes": c} for s in ("cam0", "cam1") for n, x, c in (("mid", 100.0, None), ("goods", 110.0, ["truck"]))]
    zone = [{"stream_id": s, "zone_id": n, "name": n, "points": [(a, 60.0), (b, 60.0), (b, 170.0), (a, 170.0)], "dwell_alert_s": 0.3} for s in ("cam0", "cam1") for n, a, b in (("left", 40.0, 101.0), ("wide", 60.0, 150.0))]
    cal = spark.createDataFrame([("cam0", [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0], None), ("cam1", [0.2, 0.0, 1.0, 0.0, 0.2, 0.0, 0.0, 0.001, 1.0], None)], schemas.CALIBRATIONS)
    limits = spark.createDataFrame([("cam0", 20.0)], "stream_id string, limit_kmh double")
    return {"path": path, "rows": df, "lines": dimension(spark, line, schemas.LINES, "lines"), "zones": dimension(spark, zone, schemas.ZONES, "zones"), "cal": cal, "limits": limits}


def stream(spark, job, name, build, steps=((0,), (25, 50))):
    """Runs ``build`` over files that arrive in ``steps``, with a new start from the checkpoint in between, a file a batch."""
    base = f"{job['path']}/{name}"
    for step in steps:
        for lo in step:
            spark.read.parquet(f"{job['path']}/all/{lo:04d}").coalesce(1).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        q = build(src).writeStream.foreachBatch(sink(f"{base}/out")).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_crossings(spark, job):
    live = tracking.live_rows(job["rows"])
    cols = ["stream_id", "run_id", "track_id", "frame_index", "timestamp", "vehicle_class", "line_id", "name", "ord", "direction", "direction_canonical", "count"]
    want = sorted(map(tuple, lines.crossings(live, job["lines"]).select(cols).collect()))
    out = stream(spark, job, "lines", lambda s: S.crossings(s, job["lines"]))
    assert sorted(map(tuple, out.where("late = 0").select(cols).collect())) == want and len(want) > 20 and out.where("late > 0").count() == 0


def test_visits_and_late_rows(spark, job):
    want = zones.visits(tracking.live_rows(job["rows"]), job["zones"], tracking.finished(job["rows"]))
    cols = ["stream_id", "track_id", "zone_id", "visit", "vehicle_class", "entered_frame", "entered", "exited_frame", "exited", "dwell_s", "exit_class", "by_finish", "alert_timestamp", "alert_frame"]
    order = lambda df: sorted((tuple(r) for r in df.select(cols).collect()), key=str)
    out = stream(spark, job, "zones", lambda s: S.visits(s, job["zones"]), ((0,), (25, 25, 50)))  # a file comes twice: all its rows are late
    assert order(S.visit_rows(out)) == order(want) and want.where("by_finish and exited is not null").count() > 0
    again = spark.read.parquet(f"{job['path']}/all/0025").where("not done")
    late = out.agg(F.sum("late")).first()[0]
    assert late == 2 * again.count() and out.where("kind = 'dwell'").groupBy("track_id", "zone_id", "visit").count().where("count > 1").count() == 0


def test_motion(spark, job):
    points = tracking.live_rows(job["rows"]).where("matched")
    ground = motion.ground(points, job["cal"])
    moving = motion.smooth(motion.velocity(ground, max_history=8))
    want = {(r["track_id"], r["frame_index"]): r for r in moving.collect()}
    got = {(r["track_id"], r["frame_index"]): r for r in stream(spark, job, "motion", lambda s: S.motion(s, job["cal"], job["limits"], max_history=8)).where("late = 0").collect()}
    assert got.keys() == want.keys()
    close = lambda a, b: a is b is None or abs(a - b) < 1e-9
    assert all(close(got[k][c], want[k][c]) for k in got for c in ("speed_kmh", "max_speed_kmh", "direction_deg"))
    far = {r["track_id"]: r["distance_m"] for r in motion.distance(ground).collect()}
    assert all(close(max(g["distance_m"] for k, g in got.items() if k[0] == i), d) for i, d in far.items())
    over = {(r["track_id"], r["frame_index"]) for r in motion.speeding(moving, job["limits"]).collect()}
    assert {k for k, g in got.items() if g["speeding"]} == over and len(over) >= 2


def test_the_whole_job(spark, tmp_path):
    from test_tracking_store import scene

    from wayline.operators import calibration
    from wayline.plans.batch import Dimensions, run_batch
    from wayline.plans.stream import run_stream
    from wayline.sources import store

    dets, frames = scene(spark)
    line = dimension(spark, [{"stream_id": "cam", "line_id": "count", "name": "Count", "ax": 320.0, "ay": 320.0, "bx": 320.0, "by": 60.0}], schemas.LINES, "lines")
    zone = dimension(spark, [{"stream_id": "cam", "zone_id": "mid", "name": "Mid", "points": [(200.0, 60.0), (440.0, 60.0), (440.0, 320.0), (200.0, 320.0)], "dwell_alert_s": 0.2}], schemas.ZONES, "zones")
    cal = calibration.fit(spark.createDataFrame([("cam", *map(float, p)) for p in [(0, 60, 0, 0), (640, 60, 64, 0), (640, 320, 64, 26), (0, 320, 0, 26)]], schemas.CALIBRATION_POINTS))
    rule = [{"rule_id": "cross", "name": "Cross", "when": {"type": "line_cross", "line": "count", "classes": ["car"]}, "cooldown_s": 0}, {"rule_id": "in", "name": "In", "when": {"type": "zone_enter", "zone": "mid"}, "cooldown_s": 0}]
    dims = Dimensions(line, zone, cal, spark.createDataFrame([("cam", 60.0)], "stream_id string, limit_kmh double"), rule)
    batch = run_batch(dets, frames, dims)["events"]
    cols = ["stream_id", "run_id", "frame_index", "timestamp", "det_idx", "x1", "y1", "x2", "y2", "score", "vehicle_class"]
    every = dets.select(cols).unionByName(frames.join(dets, "frame_index", "left_anti").select(cols[:4]), allowMissingColumns=True)
    late = frames.agg(F.max("frame_index").alias("f")).select(F.lit("cam").alias("stream_id"), F.lit("r").alias("run_id"), (F.col("f") + 1).alias("frame_index"), F.lit(20.0).alias("timestamp"))
    every = every.unionByName(late, allowMissingColumns=True)  # a frame long after the last one ends all tracks
    for lo, hi in ((0, 40), (40, 500)):
        every.where(F.col("frame_index").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    root = f"{tmp_path}/store"
    run_stream(spark, src, dims, root, frames=frames)
    got = store.load(spark, f"{root}/events")
    tell = lambda df: sorted((r["type"], r["track_id"], r["frame_index"], r["rule_id"] or "", r["data"]["direction"] or "", r["data"]["count"] or 0, r["data"]["zone"] or "", round(r["data"]["dwell_s"] or 0, 3), round(r["data"]["speed_kmh"] or 0, 3)) for r in df.where("type != 'track_finished'").collect())
    assert tell(got) == tell(batch) and {"rule_triggered", "speeding", "line_crossed", "zone_dwell", "zone_exited", "track_started"} <= {t[0] for t in tell(got)}
    ends = lambda df: sorted((r["track_id"], r["data"]["duration_s"], r["data"]["n_points"]) for r in df.where("type = 'track_finished'").collect())
    assert ends(got) == ends(batch) and store.load(spark, f"{root}/tracks").count() == len(ends(batch))


def test_a_track_costs_two_calls_for_state(spark, job):
    """One value holds all that a track carries, rows come packed, and the configuration is broadcast, so that few streams don't make few tasks."""
    import pickle

    live = tracking.live_rows(job["rows"]).withColumn("done", F.lit(False))
    packed = S._packed(live.select(*S.TRACK, "frame_index", "done").coalesce(1)).collect()
    assert len(packed) == live.select(*S.TRACK).distinct().count() and sum(len(pickle.loads(p["blob"])) for p in packed) == live.count()

    class Held:
        calls: list = []

        def __getattr__(self, name):
            return lambda *a: self.calls.append(name)

    class Handle:
        getValueState = lambda self, *a: Held()

    processor = S.CrossingProcessor()
    processor.fields = ["frame_index", "done", "part", "line_id", "ax", "ay", "bx", "by", "x", "y", "side"]
    processor.init(Handle())
    rows = [S.Row(blob=pickle.dumps([(f, False, line, line, 0.0, 2.0, 0.0, 0.0, 1.0, 1.0, 1.0) for f in range(5) for line in ("a", "b", None)]))]
    assert list(processor.handleInputRows(("s", "r", 1), iter(rows), None)) == [] and Held.calls == ["exists", "update"]
    out = S.crossings(job["rows"], job["lines"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in out
