"""No plate leaves through nested payloads, and the store keeps stream ids as they are."""

import hashlib

from pyspark.sql import functions as F

from wayline.operators import events
from wayline.sources import exports, store

HASHED = hashlib.sha256(b"s34ABC123").hexdigest()


def test_maps_of_anything(spark):
    plate = "34 abc 123"
    row = ({"plate": [plate], "other": [plate]}, {"plate": {"k": plate}, "x": {"plate": plate, "k": plate}}, {"a": [(plate, plate)]}, [[plate]], {"plate": plate, "k": plate})
    df = spark.createDataFrame([row], "lists map<string,array<string>>, maps map<string,map<string,string>>, structs map<string,array<struct<text:string,k:string>>>, raw_text array<array<string>>, flat map<string,string>")
    cols = {f.name: store.scrub(F.col(f.name), f.dataType, "s", f.name) for f in df.schema.fields}
    r = df.select(*[c.alias(n) for n, c in cols.items()]).first()
    assert r["lists"] == {"plate": [HASHED], "other": [plate]} and r["flat"] == {"plate": HASHED, "k": plate} and r["raw_text"] == [[HASHED]]
    # as in JSON payloads, the keys of an object inside count for themselves
    assert r["maps"] == {"plate": {"k": plate}, "x": {"plate": HASHED, "k": plate}}
    assert r["structs"]["a"][0]["text"] == HASHED and r["structs"]["a"][0]["k"] == plate


def test_feed_shows_no_plate(spark):
    rows = spark.createDataFrame([("s", "r", 1, 1, 1.0, 2.0, "car")], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, wall_ts double, vehicle_class string")
    ev = events.event(rows, "rule_triggered", events.payload(plate=F.lit("34ABC123"), zone=F.lit("z")))
    ev = ev.withColumn("trigger_data", F.struct(F.lit("34ABC123").alias("plate"), F.array(F.struct(F.lit("34ABC123").alias("matched_plate"))).alias("deep"), F.lit("ok").alias("k"))).withColumn("raw_text", F.lit("34ABC123"))
    r = exports.feed(ev).first()
    assert "34ABC123" not in str(r) and r["trigger_data"]["k"] == "ok" and r["data"]["plate"] == r["trigger_data"]["deep"][0]["matched_plate"] == r["raw_text"] == "***" and r["data"]["zone"] == "z"
    assert exports.feed(ev, redact=False).first()["trigger_data"]["plate"] == "34ABC123" and exports.feed(ev).first()["data"]["plate_confidence"] is None


def test_stream_ids_in_the_store(spark, tmp_path):
    ids = ["007", "7", "1e3", "2020-01-01", None]
    rows = spark.createDataFrame([(s, "r", 1, k, 1.0, day * 86400.0 + k, "car") for day in (1, 2, 3) for k, s in enumerate(ids)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, wall_ts double, vehicle_class string")
    path = f"{tmp_path}/events"
    store.append(store.event_rows(events.event(rows, "speeding", events.payload(speed_kmh=F.lit(1.0)))), path)
    back = store.load(spark, path)
    assert dict(back.dtypes)["stream_id"] == "string" and sorted(r["stream_id"] or "" for r in back.select("stream_id").distinct().collect()) == sorted(s or "" for s in ids)
    assert [r["stream_id"] for r in store.event_filter(back, stream_id="007").collect()] == ["007"] * 3 and store.event_filter(back, stream_id="7", since=2 * 86400.0).count() == 2
    assert store.purge(spark, path, "wall_ts", 3 * 86400 + 2.5, 1) == len(ids) + 3
    left = store.load(spark, path)
    assert sorted((r["stream_id"] or "", r["wall_ts"]) for r in left.collect()) == sorted((s or "", day * 86400.0 + k) for day in (2, 3) for k, s in enumerate(ids) if day == 3 or k > 2)
    assert not [f for f in (tmp_path / "events").iterdir() if f.name.startswith("_border")]


def test_purge_takes_up_what_was_cut_off(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r", 1, k, 1.0, 86400.0 + k, "car") for k in range(4)], "stream_id string, run_id string, track_id long, frame_index long, timestamp double, wall_ts double, vehicle_class string")
    path = tmp_path / "events"
    store.append(store.event_rows(events.event(rows, "speeding", events.payload())), str(path))
    (path / "wall_date=1970-01-02").rename(path / "_border-1970-01-02-x-old")  # the crash: moved away, nothing in its place yet
    store.append(store.event_rows(events.event(rows.withColumn("wall_ts", F.lit(5 * 86400.0)), "speeding", events.payload())), str(path))
    assert store.purge(spark, str(path), "wall_ts", 2 * 86400 + 1.5, 1) == 2 and store.load(spark, str(path)).count() == 6
