"""Golden tracks, the end-to-end job, batch and stream parity, the store."""

import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from wayline import schemas
from wayline.operators import calibration, detections, folds, sampling, tracking
from wayline.plans.batch import Dimensions, run_batch
from wayline.sources import exports, store
from wayline.sources.readers import dimension, frame_clock
from wayline.streaming import processors

EMPTY = (np.zeros((0, 4)), np.zeros(0), [])


def box(cx, cy, w=40, h=30):
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def follow(frames, config=tracking.Config()):
    """frames: a list of [(box, score, class)]; rows by frame and finished tracks."""
    t, rows, done = tracking.Tracker(config), [], []
    for f, dets in enumerate(frames):
        args = (np.array([d[0] for d in dets]), np.array([d[1] for d in dets]), [d[2] for d in dets]) if dets else EMPTY
        live, end = t.step(f, f / 30, *args)
        rows.append(live)
        done += end
    return rows, done, t


def test_a_straight_track():
    rows, _, _ = follow([[(box(100 + 5 * f, 100), 0.9, "car")] for f in range(30)])
    assert {r[0] for live in rows for r in live} == {1} and [live[0][3] for live in rows[:4]] == ["tentative", "tentative", "active", "active"] and rows[-1][0][-2] == 30


def test_occlusion_keeps_the_id():
    rows, _, _ = follow([[] if 10 <= f < 15 else [(box(100 + 10 * f, 100), 0.9, "car")] for f in range(30)])
    assert {r[0] for live in rows for r in live} == {1} and rows[12][0][3] == "lost" and rows[15][0][3] == "active"


def test_crossing_tracks_keep_their_ids():
    rows, _, _ = follow([[(box(80 + 8 * f, 150, 40, 28), 0.9, "car"), (box(200, 30 + 8 * f, 28, 40), 0.9, "car")] for f in range(30)])
    ids = [{r[0]: r[5] for r in live} for live in rows]
    assert all(set(i) == {1, 2} for i in ids) and all(abs(i[1] - (80 + 8 * f - 20)) < 1e-6 for f, i in enumerate(ids))


def test_low_scores_keep_but_never_start():
    rows, _, t = follow([[(box(100 + 5 * f, 100), 0.9 if f < 5 else 0.2, "car"), (box(500, 300), 0.2, "car")] for f in range(20)])
    assert {r[0] for live in rows for r in live} == {1} and abs(rows[-1][0][-1] - (5 * 0.9 + 15 * 0.2) / 20) < 1e-12


def test_ttl_and_votes():
    _, done, t = follow([[(box(100, 100), 0.9, "car")]] * 4 + [[]] * 20, tracking.Config(lost_ttl=0.3))
    assert [d[0] for d in done] == [1] and t.live == 0 and t.finish() == []
    rows, _, _ = follow([[(box(100, 100), 0.9, c)] for c in ("car", "car", "truck", "car", "truck", "truck", "truck")], tracking.Config(min_hits=1))
    assert rows[5][0][9] == "car" and rows[6][0][9] == "truck"


def scene(spark):
    """Two cars eastwards, as in the scenario: 10 px a frame at 30 fps."""
    rows = []
    for first, last, y, score in ((0, 70, 100, 0.90), (10, 80, 180, 0.88)):
        for f in range(first, last):
            x = 15 + 10 * (f - first)
            x1, x2 = min(x, 640), min(x + 60, 640)
            if x2 > x1:
                rows.append(("cam", "r", f, f / 30, len(rows), float(x1), float(y), float(x2), float(y + 40), score, 2, "car", "car"))
    frames = [("cam", "r", f, f / 30, 1000.0 + f / 30, 640, 360) for f in range(120)]
    return spark.createDataFrame(rows, schemas.DETECTIONS), spark.createDataFrame(frames, schemas.FRAMES)


def test_end_to_end(spark, tmp_path):
    dets, frames = scene(spark)
    line = dimension(spark, [{"stream_id": "cam", "line_id": "count", "name": "Count", "ax": 320.0, "ay": 320.0, "bx": 320.0, "by": 60.0}], schemas.LINES, "lines")
    zone = dimension(spark, [{"stream_id": "cam", "zone_id": "mid", "name": "Mid", "points": [(200.0, 60.0), (440.0, 60.0), (440.0, 320.0), (200.0, 320.0)]}], schemas.ZONES, "zones")
    points = [(0, 60, 0, 0), (640, 60, 64, 0), (640, 320, 64, 26), (0, 320, 0, 26)]
    cal = calibration.fit(spark.createDataFrame([("cam", *map(float, p)) for p in points], schemas.CALIBRATION_POINTS))
    limits = spark.createDataFrame([("cam", 60.0)], "stream_id string, limit_kmh double")
    rule = {"rule_id": "r-speeding", "name": "Speeding", "when": {"type": "speed", "min_kmh": 60}, "cooldown_s": 0}

    def save(df):
        path = f"{tmp_path}/{'tracked' if 'done' in df.columns else uuid.uuid4().hex}"  # one segment: the tracker's own numbers
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    wanted = {"rule_id": "r-wanted", "name": "Wanted", "when": {"type": "plate_watchlist", "watchlist": "w"}, "cooldown_s": 0}
    reads = spark.createDataFrame([("cam", "r", f, 0, 35.0 + 10 * f, 110.0, 60.0 + 10 * f, 130.0, 0.9, text, 0.9) for f, text in ((3, "34 abc 123"), (6, "34ABC12"), (9, "34A8C123"), (10, "34XYZ999"), (12, "34 ABC 123"), (15, "x"))], "stream_id string, run_id string, frame_index long, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, text string, conf double")
    lists = spark.createDataFrame([("w", "Stolen", "34-abc-123")], schemas.WATCHLISTS)
    out = run_batch(dets, frames, Dimensions(line, zone, cal, limits, [rule, wanted], lists), plate_reads=reads, save=save)
    given = out["events"].where("type in ('plate_read', 'watchlist_hit') or rule_id = 'r-wanted'").orderBy("phase").collect()
    assert [(e["type"], e["frame_index"], e["vehicle_class"]) for e in given] == [("plate_read", 9, "car"), ("watchlist_hit", 9, "car"), ("rule_triggered", 9, "car")]
    d = given[0]["data"]
    assert (d["plate"], d["corrected"], d["country"], d["valid"]) == ("34ABC123", True, "TR", True) and given[2]["trigger_data"]["plate"] == "34ABC123" and given[1]["data"]["watchlist_name"] == "Stolen"
    assert [(r["plate"], r["valid"]) for r in store.plate_rows(out["events"]).collect()] == [("34ABC123", True)] and out["tracks"].where("plate = '34ABC123'").count() == 1
    assert store.event_rows(out["events"], "hashed", "s").where("data.plate = '34ABC123' or trigger_data.plate = '34ABC123'").count() == 0
    rows = out["events"].select("type", "timestamp", "data.count", "data.direction_canonical", "rule_id", "id").collect()
    kinds = [r["type"] for r in rows]
    crossed = sorted((r["count"], r["direction_canonical"]) for r in rows if r["type"] == "line_crossed")
    assert crossed == [(1, "forward"), (2, "forward")] and kinds.count("track_started") == 2 and kinds.count("zone_entered") == 2 and kinds.count("zone_exited") == 2 and kinds.count("speeding") >= 1
    assert any(r["rule_id"] == "r-speeding" for r in rows) and len({r["id"] for r in rows}) == len(rows) and all(0 <= r["timestamp"] < 60 for r in rows)
    tracks = out["tracks"].where("n_points >= 3").collect()  # boxes cut by the edge may start tracks that are never confirmed
    assert len(tracks) == 2 and all(abs(t["avg_speed_kmh"] - 108) < 18 and t["vehicle_class"] == "car" for t in tracks)
    assert store.track_rows(out["events"]).count() >= 2 and out["totals"].first()["frames_processed"] == 120
    # the stream gives the rows of the batch
    cols = tracking.COLUMNS
    want = spark.read.parquet(f"{tmp_path}/tracked").where("not done").select("track_id", "frame_index", "state", "x1", "vehicle_class").collect()
    dets.select("stream_id", "run_id", "frame_index", "timestamp", "det_idx", "x1", "y1", "x2", "y2", "score", "vehicle_class").unionByName(
        frames.join(dets, "frame_index", "left_anti").select("stream_id", "run_id", "frame_index", "timestamp"), allowMissingColumns=True
    ).repartition(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = processors.track(src).writeStream.foreachBatch(processors.sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("not done and late = 0").select("track_id", "frame_index", "state", "x1", "vehicle_class").collect()
    assert cols[0] == "stream_id" and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_nms_and_decode(spark):
    rows = [(0.0, 0.0, 100.0, 100.0, 0.9, 0), (5.0, 5.0, 105.0, 105.0, 0.8, 1), (300.0, 300.0, 400.0, 400.0, 0.7, 2)]
    df = spark.createDataFrame([("s", "r", 1, i, 0, *b[:5]) for *b, i in rows], "stream_id string, run_id string, frame_index long, det_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r["det_idx"] for r in detections.nms(df, 0.5).collect()) == [0, 2]
    pred = spark.createDataFrame([("s", "r", 1, [[100.0, 100.0, 40.0, 20.0, 0.9, 0.1], [100.0, 100.0, 40.0, 20.0, 0.1, 0.3]])], "stream_id string, run_id string, frame_index long, rows array<array<double>>")
    got = detections.decode_classic(pred, 0.5).collect()
    assert len(got) == 1 and (got[0]["x1"], got[0]["y2"], got[0]["class_id"]) == (80.0, 110.0, 0)
    raw = spark.createDataFrame([(-50.0, -10.0, 60.0, 700.0, 0.9, "Truck"), (0.0, 0.0, 9.0, 9.0, 0.9, "person"), (0.0, 0.0, 9.0, 9.0, 0.1, "car"), (700.0, 0.0, 800.0, 9.0, 0.9, "car")], "x1 double, y1 double, x2 double, y2 double, score double, class_name string").withColumn("width", F.lit(640)).withColumn("height", F.lit(480))
    kept = detections.contract(raw, None, 0.3).collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"], r["vehicle_class"]) for r in kept] == [(0.0, 0.0, 60.0, 480.0, "truck")]


def plain_tracks(rows, config=tracking.Config()):
    """The tracker over one stream, its eight-number filter written out with full matrices and its tracks as a list."""
    live, done, last, step = [], [], None, np.eye(8) + np.eye(8, k=4)
    diag = lambda h, pos, aspect, vel, turn: np.diag(np.array([pos * h / 20, pos * h / 20, aspect, pos * h / 20, vel * h / 160, vel * h / 160, turn, vel * h / 160]) ** 2)
    measure = lambda b: np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, max(b[2] - b[0], 1e-3) / max(b[3] - b[1], 1e-3), max(b[3] - b[1], 1e-3)])

    def iou(x, d):
        h = max(x["m"][3], 1e-3)
        w = max(x["m"][2], 1e-3) * h
        a = [x["m"][0] - w / 2, x["m"][1] - h / 2, x["m"][0] + w / 2, x["m"][1] + h / 2]
        both = max(0, min(a[2], d[2]) - max(a[0], d[0])) * max(0, min(a[3], d[3]) - max(a[1], d[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (d[2] - d[0]) * (d[3] - d[1]) - both
        return np.float32(both / union if union > 0 else 0)

    def frame(f, t, dets):
        for x in live:
            if x["state"] == "lost":
                x["m"][6:8] = 0
            h = max(x["m"][3], 1e-3)
            x["m"], x["P"] = step @ x["m"], step @ x["P"] @ step.T + diag(h, 1, 1e-2, 1, 1e-5)
        hit, used = {}, set()
        high = [i for i, d in enumerate(dets) if d[4] >= config.activation]
        for states, pool in (({"active", "lost"}, high), ({"active"}, [i for i, d in enumerate(dets) if config.min_score <= d[4] < config.activation]), ({"tentative"}, high)):
            found = [(-iou(x, dets[i]), k, i) for k, x in enumerate(live) if x["state"] in states and k not in hit for i in pool if i not in used]
            for s, k, i in sorted(p for p in found if -p[0] >= config.match_iou):
                if k not in hit and i not in used:
                    hit[k] = i
                    used.add(i)
        for k, x in enumerate(live):
            if k in hit:
                d = dets[hit[k]]
                h = max(x["m"][3], 1e-3)
                s = x["P"][:4, :4] + np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
                gain = x["P"][:, :4] @ np.linalg.inv(s)
                x["m"], x["P"] = x["m"] + gain @ (measure(d) - x["m"][:4]), x["P"] - gain @ s @ gain.T
                x["hits"], x["t"], x["streak"] = x["hits"] + 1, t, x["streak"] + (not x["sure"])
                x["sure"] = x["sure"] or x["streak"] >= config.min_hits
                x["state"] = "active" if x["sure"] else "tentative"
            elif x["state"] != "lost":
                x["state"], x["streak"] = "lost", 0
        for x in [x for x in live if x["state"] == "lost" and t - x["t"] > config.lost_ttl]:
            done.append((x["id"], f, x["sure"], x["hits"]))
            live.remove(x)
        for i in high:
            if i not in used:
                z = measure(dets[i])
                frame.born += 1
                live.append({"id": frame.born, "m": np.concatenate([z, np.zeros(4)]), "P": diag(z[3], 2, 1e-2, 10, 1e-5), "state": "tentative", "hits": 1, "streak": 1, "sure": False, "t": t})

    frame.born = 0
    for f, t, dets in rows:
        frame(f, t, dets)
        last = (f, t)
    for k in (1, 2):
        frame(last[0], last[1] + (config.lost_ttl + 1) * k, [])
    return done


def test_tracking_query_against_a_plain_tracker(spark):
    from wayline.plans import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.t01_tracking(spark, sf).collect())
    frames = {}
    for r in queries._detections(spark, sf).orderBy("stream_id", "frame_index", "det_idx").collect():
        frames.setdefault(r["stream_id"], {}).setdefault((r["frame_index"], r["timestamp"]), []).append((r["x1"], r["y1"], r["x2"], r["y2"], r["score"]))
    want = sorted((s, *d) for s, own in frames.items() for d in plain_tracks([(*k, v) for k, v in own.items()]))
    assert got == want and len(got) > 500
    every = queries.t02_track_frames(spark, sf).agg(F.sum("matched").alias("m")).first()["m"]
    assert every == sum(h for *_, h in got)


def test_segments_give_the_rows_of_one_pass(spark):
    from wayline.sources.scratch import saved

    rng = np.random.default_rng(3)
    dets, frames, t = [], [], 0.0
    for part in range(11):
        for f in range(60):
            frames.append(("s0", "r", len(frames), t))
            if f < 40 and f % 13 != 5:  # twenty empty frames end each part, a few lie within
                for k in range(3):
                    x = 50.0 + 60 * k + 3 * f + float(rng.normal())
                    dets.append((*frames[-1], k, x, 10.0, x + 40, 50.0, float(rng.choice([0.9, 0.3, 0.05])), "car"))
            t += 0.1 if f < 45 else 0.8
        t += float(rng.choice([0.0, 9.0]))
    other = [("s1", "r", i, i * 0.1, 0, 5.0 * i, 10.0, 5.0 * i + 40, 50.0, 0.9, "car") for i in range(30)]
    d = spark.createDataFrame(dets + other, "stream_id string, run_id string, frame_index long, timestamp double, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, vehicle_class string")
    f = spark.createDataFrame(frames + [o[:4] for o in other], "stream_id string, run_id string, frame_index long, timestamp double")
    key = lambda df: sorted(map(str, df.collect()))
    parts = []
    got = tracking.track(d, f, save=lambda df: parts.append(saved(df)) or parts[-1])
    assert key(got) == key(tracking.track(d, f)) and got.columns == tracking.COLUMNS
    assert parts[0].where("stream_id = 's0'").select("_segment").distinct().count() == 11
    from wayline.plans import queries

    sf = "/root/testdata/sf0.001"
    whole = lambda rows, clock=None, save=None: real(rows, clock, every_frame=False)
    real, one = tracking.track, sorted(map(tuple, queries.t03_tracking_in_segments(spark, sf).collect()))
    tracking.track = lambda rows, clock, every_frame, save: whole(rows, clock)
    try:
        assert sorted(map(tuple, queries.t03_tracking_in_segments(spark, sf).collect())) == one and len(one) > 500
    finally:
        tracking.track = real


def test_carried_meets_few_frames(spark):
    points = spark.createDataFrame([("s", "r", k, k * 50 + f, 0.1, "active", 1.0 * f, 0.0, 1.0 * f, 1.0, "car") for k in range(60) for f in (0, 3, 40)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, state string, x1 double, y1 double, x2 double, y2 double, vehicle_class string")
    frames = spark.createDataFrame([("s", "r", f, f * 0.1) for f in range(3100)], "stream_id string, run_id string, frame_index long, timestamp double")
    for block in (None, 1, 7, 4000):
        out = tracking.carried(points, frames, block).collect()
        assert len(out) == 60 * 41 and {(r["frame_index"] % 50, r["x1"], r["state"], r["matched"]) for r in out} == {(f, 0.0 if f < 3 else 3.0 if f < 40 else 40.0, "active" if f in (0, 3, 40) else "lost", f in (0, 3, 40)) for f in range(41)}


def admitted(**config):
    s = sampling.Sampler(**{k: v for k, v in config.items() if k != "busy"})
    return sum(s.admit(i * 0.01, config.get("busy", False)) for i in range(1000))


def test_sampler(spark):
    assert 18 <= admitted() <= 22 and 140 <= admitted(busy=True) <= 160 and 45 <= admitted(busy=True, fps_cap=5) <= 55 and admitted(enabled=False) == 1000 and 95 <= admitted(enabled=False, fps_cap=10) <= 105
    s = sampling.Sampler()
    assert s.admit(100, False) and s.admit(0, False)
    frames = spark.createDataFrame([("s", "r", i, i * 0.01, False) for i in range(300)], "stream_id string, run_id string, seq long, timestamp double, has_detection boolean")
    assert 5 <= sampling.sample(frames).where("admitted").count() <= 8


def test_store(spark, tmp_path):
    from wayline.operators import events

    rows = spark.createDataFrame([("s", "r", 1, i, float(i), 1000.0 + i * 86400, "car") for i in range(4)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, wall_ts double, vehicle_class string")
    ev = events.event(rows, "plate_read", events.payload(plate=F.lit("34 abc 123"), confidence=F.lit(0.9), valid=F.lit(True)))
    hidden = store.event_rows(ev, "hashed", "s")
    assert "34" not in {r["plate"][:2] for r in hidden.select("data.plate").collect()} or all(len(r["plate"]) == 64 for r in hidden.select("data.plate").collect())
    path = f"{tmp_path}/events"
    store.append(store.event_rows(ev), path)
    store.append(store.event_rows(ev), path)
    back = store.load(spark, path)
    assert back.count() == 8
    page = store.event_page(back, 5000, 0, since=1000.0 + 86400)
    assert [r["wall_ts"] for r in page.limit(2).collect()] == [1000.0 + 3 * 86400] * 2 and page.count() == 6
    assert store.purge_all(spark, {"events": (path, "wall_ts", 1.5), "tracks": (path, "wall_ts", None)}, 1000.0 + 3 * 86400) == {"events": 4, "tracks": 0} and store.load(spark, path).count() == 4
    early = events.event(rows.where("frame_index < 2").withColumn("wall_ts", F.expr("case when frame_index = 0 then 2 * 86400 + 10D else 2 * 86400 + 90D end")), "plate_read", events.payload(plate=F.lit("34 abc 123")))
    store.append(store.event_rows(early), path)
    assert store.purge(spark, path, "wall_ts", 3 * 86400 + 50.0, 1) == 1 and store.load(spark, path).count() == 5
    assert {f.name for f in tmp_path.joinpath("events").iterdir() if f.is_dir()} == {"wall_date=1970-01-03", "wall_date=1970-01-04"}
    reads = store.plate_rows(ev, "hashed", "s")
    assert store.plate_page(reads, "34ABC123", 10, "hashed", "s").count() == 4 and store.plate_page(reads, "34ABC", 10, "hashed", "s").count() == 0
    plate = hashlib.sha256(b"s34ABC123").hexdigest()
    cases = {
        '{"a":[{"text":"34 abc 123"}],"b":1}': '{"a":[{"text":"%s"}],"b":1}', '{"plate": ["34ABC123", {"k": "34ABC123"}]}': '{"plate":["%s",{"k":"34ABC123"}]}',
        '{"x":{"plate":"34abc123"},"class":"34abc123"}': '{"x":{"plate":"%s"},"class":"34abc123"}', '{"plate_text":"34\\u0041bc123","n":null}': '{"plate_text":"%s","n":null}', '{"text":34}': '{"text":34}', "no json 34ABC123": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", store.scrub_json(F.col("t"), "s").alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == {k: v and v.replace("%s", plate) for k, v in cases.items()}
    nested = spark.createDataFrame([("s", "r", 1, 5.0, "plate_read", "i", {"text": "34 abc 123", "deep": [{"raw_text": ["34 abc 123"]}], "more": {"plate": "34 abc 123", "k": "v"}}, {"plate": "34 abc 123", "class": "34 abc 123"})], "stream_id string, run_id string, track_id long, wall_ts double, type string, id string, data struct<text:string,deep:array<struct<raw_text:array<string>>>,more:map<string,string>>, trigger_data struct<plate:string,class:string>")
    r = store.event_rows(nested, "hashed", "s").first()
    assert r["data"]["text"] == r["data"]["deep"][0]["raw_text"][0] == r["data"]["more"]["plate"] == r["trigger_data"]["plate"] == plate and r["data"]["more"]["k"] == "v" and r["trigger_data"]["class"] == "34 abc 123"
    assert [(x["plate"], x["valid"], x["confidence"]) for x in store.plate_rows(nested, "hashed", "s").collect()] == [(plate, False, None)]
    assert exports.feed(ev, "plate_read, nonsense").select("data.plate").distinct().collect()[0][0] == "***" and exports.feed(ev, "nonsense").count() == 4


def test_frame_clock(spark):
    packets = spark.createDataFrame([("s", "r", i, i // 3, i % 3, 0.0, 10.0) for i in range(6)], "stream_id string, run_id string, seq long, part long, part_frame long, pts double, fps double")
    got = [round(r["timestamp"], 6) for r in frame_clock(packets).orderBy("seq").collect()]
    assert got == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]


def test_stream_votes(spark, tmp_path):
    schema = "stream_id string, run_id string, track_id long, seq long, text string, conf double"
    rows = [("s", "r", 1, 1, "34ABC123", 0.9), ("s", "r", 1, 2, "34A8C123", 0.6), ("s", "r", 1, 3, "34ABC123", 0.8)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    q = processors.plate_emissions(src).writeStream.foreachBatch(processors.sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["seq"], r["plate"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(3, "34ABC123")]


def test_overlaps_of_few_and_many_boxes():
    """Pairs worked out one by one are those of the matrix, in single precision at the gate, with boxes that touch, are empty or no numbers."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = (np.hstack([o, o + rng.integers(0, 6, o.shape) * 10.0]) for o in (rng.integers(0, 6, (8, 2)) * 10.0, rng.integers(0, 6, (9, 2)) * 10.0))
        b[0, 2] = np.nan
        for least in (0.2, 0.25, 1 / 3):
            iou = tracking.iou_matrix(a, b)
            want = [(float(-iou[i, j]), i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(iou >= least)))]
            assert len(a) * len(b) < tracking.MANY_PAIRS and sorted(tracking._overlaps(a.tolist(), b.tolist(), least)) == sorted(want)


def test_few_streams_lie_in_partitions_of_their_own(spark):
    """Seventeen streams in twenty partitions: none waits behind another, the one without a name neither."""
    rows = spark.range(170).selectExpr("case when id % 17 = 16 then null else concat('cam', id % 17) end as stream_id", "'r' as run_id", "id").where("stream_id is not null or id < 50")
    placed = folds.by_few_keys(rows, ["stream_id", "run_id"], rows, 5).withColumn("at", F.spark_partition_id())
    got = placed.groupBy("stream_id").agg(F.count_distinct("at").alias("parts"), F.min("at").alias("at"), F.count("*").alias("n")).collect()
    assert len(got) == 17 and {r["parts"] for r in got} == {1} and len({r["at"] for r in got}) == 17 and sum(r["n"] for r in got) == 162 and placed.columns == [*rows.columns, "at"]
