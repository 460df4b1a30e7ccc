"""Training annotations: label lines, their images, and plate crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remap_annotation

#: Image endings in order of preference.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def parse(lines: DataFrame) -> DataFrame:
    """Rows (.., class_id, cx, cy, w, h) of well-formed label lines: five tokens or more, numeric, 0 < w, h <= 1."""
    def numbers(t: Column) -> Column:
        num = lambda i: F.get(t, F.lit(i)).try_cast("double")
        return F.struct(F.size(t).alias("_n"), num(0).cast("int").alias("class_id"), *[num(i).alias(k) for i, k in enumerate(("cx", "cy", "w", "h"), 1)])

    # a line is split once: a generator's rows are not worked out again in each condition
    rows = lines.select("*", F.inline(F.transform(F.array(F.split(F.trim(F.col("value")), r"\s+")), numbers)))
    return rows.where("_n >= 5 and class_id is not null and cx is not null and cy is not null and w > 0 and w <= 1 and h > 0 and h <= 1").drop("_n")


def crop_box(width: Column, height: Column, margin: float = 0.08) -> dict[str, Column]:
    """Whole pixels of a normalised box with a margin of its size, held inside the image."""
    w, h = F.col("w") * width, F.col("h") * height
    x1, y1 = F.col("cx") * width - w / 2 - w * margin, F.col("cy") * height - h / 2 - h * margin
    x2, y2 = F.col("cx") * width + w / 2 + w * margin, F.col("cy") * height + h / 2 + h * margin
    hold = lambda v, top: F.least(F.greatest(v.cast("int"), F.lit(0)), top)
    return {"x1": hold(x1, width), "y1": hold(y1, height), "x2": hold(x2, width), "y2": hold(y2, height)}


def crops(boxes: DataFrame, margin: float = 0.08, min_height: int = 12) -> DataFrame:
    """Boxes (from ``parse``, with width and height of the image) as pixel crops; empty and too low ones go."""
    rows = boxes.withColumns(crop_box(F.col("width"), F.col("height"), margin))
    return rows.where(F.expr("x2 > x1 and y2 > y1") & (F.expr("y2 - y1") >= min_height))


def pair(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Label files (label_path) with their image: the last ``labels`` folder of the path read as ``images``, the same stem, the preferred ending. An equi-join."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    own = labels.select("label_path", F.regexp_replace(stem(F.col("label_path")), r"^(.*/)?labels/", "$1images/").alias("stem"))
    ext = F.lower(F.regexp_extract("image_path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext)
    there = images.select("image_path", stem(F.col("image_path")).alias("stem"), rank.alias("rank")).where("rank > 0").groupBy("stem").agg(F.min_by("image_path", "rank").alias("image_path"))
    return own.join(there, "stem").select("label_path", "image_path")


def remap(lines: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """``lines`` (value) with ``mapped``, null where dropped."""
    return lines.withColumn("mapped", remap_annotation(F.col("value"), mapping))


def remap_stats(lines: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Kept and dropped lines; blank ones are neither."""
    rows = remap(lines.where("trim(value) != ''"), mapping)
    return rows.agg(F.count_if(F.col("mapped").isNotNull()).alias("kept"), F.count_if(F.col("mapped").isNull()).alias("dropped"))
