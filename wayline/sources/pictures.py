"""Annotated pictures as tables: label files, the pictures they belong to, and plate crops as pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations

CROPS = "image_path string, label_path string, line int, class_id int, x1 int, y1 int, x2 int, y2 int, channels int, data binary"


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(label_path, line, value): the lines of all .txt files under ``folder`` that aren't blank, numbered from 0 within their file."""
    files = spark.read.format("text").options(wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").load(folder)
    lines = F.filter(F.split("value", r"\r\n|\n|\r"), lambda v: F.trim(F.regexp_replace(v, r"\s", " ")) != "")
    return files.select(F.col("_metadata.file_path").alias("label_path"), F.posexplode(lines).alias("line", "value"))


def image_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path) of pictures under ``folder``; their bytes are not read."""
    endings = ",".join(annotations.EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").load(folder)
    return files.select(F.col("_metadata.file_path").alias("image_path"))


def plate_crops(spark: SparkSession, folder: str, margin: float = 0.08, min_height: int = 12) -> DataFrame:
    """Every labelled plate under ``folder`` cut out of its picture: rows of ``CROPS``, ``data`` holding the crop's pixels row by row (blue, green, red for three channels).

    A label belongs to the picture of its stem in the mirrored ``images`` folder; label files without one, pictures that can't be decoded, malformed lines and crops under ``min_height`` pixels give no rows.
    Labels find their picture by its path, so a picture is decoded once, whatever number of plates it shows, and its pixels go no further than the task that cuts them.
    """
    boxes = annotations.parse(read_labels(spark, folder))
    pairs = annotations.pair(boxes.select("label_path").distinct(), image_paths(spark, folder))
    wanted = boxes.join(pairs, "label_path").groupBy("image_path").agg(F.array_sort(F.collect_list(F.struct("label_path", "line", "class_id", "cx", "cy", "w", "h"))).alias("boxes"))
    pictures = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    pictures = pictures.select(F.col("_metadata.file_path").alias("image_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    found = pictures.join(wanted, "image_path").withColumn("b", F.explode("boxes")).select("image_path", "width", "height", "channels", "b.*", "data")
    return annotations.crops(found, margin, min_height).select("image_path", "label_path", "line", "class_id", "x1", "y1", "x2", "y2", "width", "height", "channels", "data").mapInArrow(_cut_out, CROPS)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        place = [b.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2", "width", "height", "channels")]
        out = []
        for i, (x1, y1, x2, y2, width, height, channels) in enumerate(zip(*place)):
            pixels = np.frombuffer(b.column("data")[i].as_buffer(), np.uint8).reshape(height, width, channels)
            out.append(pixels[y1:y2, x1:x2].tobytes())
        kept = ("image_path", "label_path", "line", "class_id", "x1", "y1", "x2", "y2", "channels")
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.binary())], names=[*kept, "data"])
