"""Readers of detections, frames and configuration, and the normal form of clocks and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", streaming: bool = False, **options) -> DataFrame:
    """A table with a fixed schema, as a batch or a stream (``maxFilesPerTrigger`` bounds what one trigger takes)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).options(**options).format(fmt).load(path)


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, **options) -> DataFrame:
    return read(spark, path, schemas.DETECTIONS, fmt, streaming, **options)


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, **options) -> DataFrame:
    return read(spark, path, schemas.FRAMES, fmt, streaming, **options)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Spark's image source; three-channel bytes are in the order blue, green, red."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def with_empty_frames(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame, with its detections or nulls: trackers must tick on empty frames too."""
    keys = ["stream_id", "run_id", "frame_index"]
    return frames.join(detections.drop("timestamp", "wall_ts"), keys, "left")


def stamp(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections with the clocks of their frame."""
    return detections.join(frames.select("stream_id", "run_id", "frame_index", "timestamp", "wall_ts"), ["stream_id", "run_id", "frame_index"])


def frame_clock(packets: DataFrame) -> DataFrame:
    """``packets`` (stream_id, run_id, seq, part, part_frame, pts, fps) with a timestamp that grows across loops and reconnects.

    Within a part it is the packet's pts if above 0, else frame / fps (30 if unknown); a part starts one frame after the last
    packet of the one before. Parts are summed up as offsets, so it is two windows and no recursion.
    """
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    rows = packets.withColumn("_t", F.when(F.col("pts") > 0, F.col("pts")).otherwise(F.col("part_frame") / rate)).withColumn("_step", 1 / rate)
    keys = ["stream_id", "run_id"]
    ends = rows.groupBy(*keys, "part").agg(F.max_by(F.col("_t") + F.col("_step"), "seq").alias("_span"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "part", F.coalesce(F.sum("_span").over(before), F.lit(0.0)).alias("_base"))
    return rows.join(ends, [*keys, "part"]).withColumn("timestamp", F.col("_base") + F.col("_t")).drop("_t", "_step", "_base")


def to_processed(detections: DataFrame, resize_width: int | None) -> DataFrame:
    """Boxes in the coordinates of frames reduced to ``resize_width``; never enlarged. Needs the frame's width and height."""
    if resize_width is None:
        return detections
    k = F.when(F.col("width") > resize_width, F.lit(float(resize_width)) / F.col("width")).otherwise(1.0)
    return detections.withColumns(G.scale(G.box(), k, k))


#: Defaults of configuration rows.
DEFAULTS = {
    "lines": {"forward_label": "forward", "backward_label": "backward"},
    "rules": {"enabled": True, "cooldown_s": 10.0},
    "streams": {"min_hits": 3, "lost_ttl": 1.0, "every_n": 3, "limit_kmh": None},
}


def dimension(spark: SparkSession, rows: list[dict], schema: str, kind: str) -> DataFrame:
    """A configuration section as a table: defaults filled in, ``ord`` its place."""
    names = [f.strip().split(" ")[0] for f in _fields(schema)]
    filled = [{**DEFAULTS.get(kind, {}), **{k: v for k, v in r.items() if v is not None}, "ord": i} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], schema)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]
