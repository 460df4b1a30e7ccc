"""Label and picture folders, pixels of crops, table functions, fusion on streams."""

import contextlib
import io
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from wayline.functions import plates as P
from wayline.functions.registry import register_functions
from wayline.operators import annotations, attributes, plates, tracking
from wayline.sources import pictures, readers
from wayline.streaming import processors


def png(path, pixels):
    """Writes rows of (red, green, blue)."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_plate_crops(spark, tmp_path):
    rng = np.random.default_rng(2)
    images, want = {}, []
    for k, at in enumerate(("a/images/one", "a/images/sub dir/two", "images/labels/images/three")):
        images[at] = rng.integers(0, 256, (50 + 10 * k, 80, 3), dtype=np.uint8)
        png(tmp_path / f"{at}.png", images[at])
    lines = ["3 0.5 0.5 0.5 0.5", "", "not a label", "1 0.95 0.1 0.2 0.4 extra", "  ", "2.7 0.5 0.5 0.1 0.02", "0 0.5 0.5 1.2 0.5", "4 0.02 0.98 0.3 0.6"]
    for at, folder in (("a/images/one", "a/labels/one"), ("a/images/sub dir/two", "a/labels/sub dir/two"), ("images/labels/images/three", "images/labels/labels/three"), (None, "a/labels/alone"), (None, "nowhere/four")):
        path = tmp_path / f"{folder}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes("\r\n".join(lines).encode())
        if at is None:
            continue
        img = images[at]
        for i, line in enumerate(x for x in lines if x.strip()):
            try:
                c, cx, cy, w, h = [float(t) for t in line.split()[:5]]
            except ValueError:
                continue
            if not (0 < w <= 1 and 0 < h <= 1):
                continue
            ih, iw = img.shape[:2]
            x1, y1 = int(max(0, cx * iw - w * iw / 2 - w * iw * 0.08)), int(max(0, cy * ih - h * ih / 2 - h * ih * 0.08))
            x2, y2 = int(min(iw, cx * iw + w * iw / 2 + w * iw * 0.08)), int(min(ih, cy * ih + h * ih / 2 + h * ih * 0.08))
            if x2 > x1 and y2 - y1 >= 12:
                want.append((at.rpartition("/")[2], i, int(c), x1, y1, x2, y2, img[y1:y2, x1:x2, ::-1].tobytes()))
    (tmp_path / "a/images/alone.png").write_bytes(b"no picture")
    got = pictures.plate_crops(spark, str(tmp_path)).collect()
    assert sorted((r["image_path"].rpartition("/")[2][:-4], r["line"], r["class_id"], r["x1"], r["y1"], r["x2"], r["y2"], bytes(r["data"])) for r in got) == sorted(want) and len(want) == 9


def test_pixels_of(spark, tmp_path):
    pixels = np.zeros((20, 30, 3), np.uint8)
    pixels[:, :15], pixels[:, 15:] = (200, 10, 20), (10, 20, 220)
    png(tmp_path / "x.png", pixels)
    img = readers.read_images(spark, str(tmp_path))
    origin = img.select("image.origin").first()[0]
    crops = spark.createDataFrame([(1, origin, 0, 0, 15, 20), (2, origin, 15, 5, 30, 20), (3, origin, 4, 4, 4, 9)], "crop_id int, origin string, x1 int, y1 int, x2 int, y2 int")
    rows = attributes.pixels_of(img, crops)
    assert sorted(map(tuple, rows.distinct().collect())) == [(1, 20, 10, 200), (2, 220, 20, 10)] and rows.groupBy("crop_id").count().orderBy("crop_id").collect() == [(1, 300), (2, 225)]


def test_table_functions(spark):
    names = register_functions(spark)
    assert {"track_detections", "plate_votes", "scrub_payload", "correct_plate"} <= set(names)
    random.seed(1)
    rows = [(s, "r", f, f * 0.1, k, 60.0 * k + 4 * f, 10.0, 60.0 * k + 4 * f + 40, 50.0, random.choice([0.9, 0.3]), "car") if k or f % 7 else (s, "r", f, f * 0.1, 0, None, None, None, None, None, None) for s in "ab" for f in range(40) for k in range(random.choice([1, 3]))]
    d = spark.createDataFrame(rows, "stream_id string, run_id string, frame_index long, timestamp double, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, vehicle_class string")
    d.createOrReplaceTempView("det")
    got = spark.sql("select * from track_detections(table(det) partition by (stream_id, run_id) order by (frame_index, det_idx))")
    assert sorted(map(str, got.collect())) == sorted(map(str, tracking.track(d).collect())) and got.columns == tracking.COLUMNS
    reads = spark.createDataFrame([("s", "r", k, i, random.choice(["34ABC123", "34A8C123", "06XY99", ""]), random.random()) for k in range(8) for i in range(9)], "stream_id string, run_id string, track_id long, seq long, text string, conf double")
    reads.createOrReplaceTempView("reads")
    votes = spark.sql("select * from plate_votes(table(reads) partition by (stream_id, run_id, track_id) order by (seq), 3)")
    assert sorted(map(str, votes.collect())) == sorted(map(str, plates.emissions(reads, 3).collect())) and votes.count() > 3
    texts = ["34 abc 123", "34 A8C I23", "3A ABC 123", "O6 XY 99B", "", "x", None, "99ABC123", "34ABC12345678"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    pairs = t.select(F.expr("correct_plate(t)").alias("a"), P.correct(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in pairs) and sum(bool(r["a"] and r["a"]["corrected"]) for r in pairs) >= 2
    assert spark.sql("""select scrub_payload('{"plate":"34 abc 123","n":1}', 's') = concat('{"plate":"', hash_plate('34ABC123', 's'), '","n":1}')""").first()[0]
    box = spark.sql("select to_letterbox(10D, 20D, 110D, 70D, 1280D, 720D, 640D, 640D) as b").first()["b"]
    assert tuple(box) == (5.0, 150.0, 55.0, 175.0)
    assert tuple(spark.sql("select from_letterbox(5D, 150D, 55D, 175D, 1280D, 720D, 640D, 640D) as b").first()["b"]) == (10.0, 20.0, 110.0, 70.0)


def test_fusion_on_a_stream(spark, tmp_path):
    random.seed(5)
    schema = "stream_id string, run_id string, track_id long, seq long, key string, value string, confidence double"
    rows = [("s", "r", k, i, random.choice(["color", "type"]), random.choice(["red", "blue", "", None]), random.choice([0.5, 0.25, 0.0, 2.0])) for k in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    for lo in (0, 10, 20):
        df.where(F.col("seq").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.createDataFrame([("s", "r", 99)], "stream_id string, run_id string, track_id long").write.parquet(f"{tmp_path}/done")
    ends = spark.readStream.schema("stream_id string, run_id string, track_id long").parquet(f"{tmp_path}/done")
    q = processors.fuse(src, ends).writeStream.foreachBatch(processors.sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("track_id", "key").agg(F.max_by(F.struct("value", "confidence", "n_observations"), "seq").alias("v")).select("track_id", "key", "v.*")
    want = attributes.fuse(df).select("track_id", "key", "value", "confidence", "n_observations")
    tidy = lambda x: sorted((*r[:3], round(r[3], 9), r[4]) for r in x.collect())
    assert tidy(got) == tidy(want) and len(tidy(want)) == 10
    t = df.select("stream_id", "run_id", "track_id")
    assert [r["track_id"] for r in attributes.expired(t, t.where("track_id < 4")).collect()] == [4]


def test_windowed_counts(spark, tmp_path):
    schema = "event_time timestamp, type string"
    for i, minutes in enumerate(([0, 0, 1], [1, 30], [2, 60])):  # the row of minute 2 comes after the watermark has passed it
        spark.createDataFrame([(m * 60 + 5, "x") for m in minutes], "s long, type string").select(F.timestamp_seconds("s").alias("event_time"), "type").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    out = []
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = processors.windowed_counts(src, "1 minute", "10 minutes", "type").writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r["start"].minute, r["n"]) for r in out) == [(0, 2), (1, 2), (30, 1)]


def test_label_lines_are_split_once(spark):
    lines = spark.createDataFrame([("2 .5 .5 .2 .2 0.9",), ("  0 .5 .5 1 1 ",), ("not a label",), ("1 .5 .5 .2",), ("1 .5 .5 0 .2",), ("1 x .5 .2 .2",), (None,)], "value string")
    df = annotations.parse(lines)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        annotations.crops(df.withColumns({"width": F.lit(400), "height": F.lit(200)})).explain()
    assert text.getvalue().count("split(") == 1
    assert sorted((r["class_id"], r["w"], r["h"]) for r in df.collect()) == [(0, 1.0, 1.0), (2, 0.2, 0.2)]
