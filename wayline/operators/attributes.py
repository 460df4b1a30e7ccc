"""Votes on class, colour and other attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .folds import spaced
from .lines import TRACK


def class_vote(points: DataFrame) -> DataFrame:
    """A track's class: most rows; among equals the one that got there first. Also the mean score of its rows.

    Counts are summed before the shuffle.
    """
    votes = points.groupBy(*TRACK, "vehicle_class").agg(F.count("*").alias("n"), F.max("frame_index").alias("last"), F.sum("score").alias("s"))
    return votes.groupBy(*TRACK).agg(F.max_by("vehicle_class", F.struct("n", -F.col("last"))).alias("vehicle_class"), (F.sum("s") / F.sum("n")).alias("class_confidence"), F.sum("n").alias("hits"))


def running_class(points: DataFrame) -> DataFrame:
    """``points`` with ``class_now``: the vote as it stands at each row; ties keep the class that held before."""
    own = Window.partitionBy(*TRACK, "vehicle_class").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(*TRACK).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.withColumn("_n", F.count("*").over(own))
    # a class takes the lead at the row where its count first reaches the maximum so far
    return counted.withColumn("class_now", F.max_by("vehicle_class", F.struct("_n", -F.col("frame_index"))).over(so_far)).drop("_n")


def fuse(observations: DataFrame) -> DataFrame:
    """Attributes of (track, key) from observations (seq, value, confidence): the value of the greatest summed confidence, the first seen among equals.

    Confidences are clamped to 1; those of 0 or less and empty values don't count. confidence is the winner's share of the sum. Sums are
    rounded to nine places, so the order of summing decides no tie.
    """
    ok = observations.where("confidence > 0 and value is not null and value != ''")
    mass = ok.groupBy(*TRACK, "key", "value").agg(F.round(F.sum(F.least(F.col("confidence"), F.lit(1.0))), 9).alias("mass"), F.min("seq").alias("first"), F.count("*").alias("n"))
    return mass.groupBy(*TRACK, "key").agg(F.max_by("value", F.struct("mass", -F.col("first"))).alias("value"), (F.max("mass") / F.sum("mass")).alias("confidence"), F.sum("n").alias("n_observations"))


def expired(known: DataFrame, live: DataFrame) -> DataFrame:
    """Tracks of ``known`` that aren't among ``live``, whose state can go; each once."""
    return known.select(*TRACK).distinct().join(live.select(*TRACK), TRACK, "left_anti")


def as_map(fused: DataFrame) -> DataFrame:
    return fused.groupBy(*TRACK).agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("value", "confidence", "n_observations")))).alias("attributes"))


def cadence(frames: DataFrame, every: int) -> DataFrame:
    """Frames on which attributes are read: at or after the next due frame and only with an active track (``n_active`` > 0); a rewind starts again.

    ``frames`` (stream_id, run_id, seq, frame_index, n_active), seq being the order of arrival.
    """
    per = Window.partitionBy("stream_id", "run_id").orderBy("seq")
    all_ = frames.withColumn("_back", (F.col("frame_index") < F.lag("frame_index").over(per)).cast("int"))
    all_ = all_.withColumn("part", F.coalesce(F.sum("_back").over(per.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_back")
    busy = all_.where("n_active > 0").withColumn("_t", F.col("frame_index").cast("double"))
    return spaced(busy, ["stream_id", "run_id", "part"], "_t", ["seq"], float(every)).drop("_t", "part")


def central_crop(b: dict[str, Column], w: Column, h: Column, share: float = 0.6, least: int = 24) -> dict[str, Column]:
    """The middle of a clipped box in whole pixels, null where it is under ``least`` pixels."""
    c = G.clip(b, w, h)
    m = (1 - share) / 2
    x1, x2 = (c["x1"] + G.width(c) * m).cast("int"), (c["x2"] - G.width(c) * m).cast("int")
    y1, y2 = (c["y1"] + G.height(c) * m).cast("int"), (c["y2"] - G.height(c) * m).cast("int")
    ok = (x2 - x1 >= least) & (y2 - y1 >= least)
    return {k: F.when(ok, v) for k, v in {"x1": x1, "y1": y1, "x2": x2, "y2": y2}.items()}


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 180), saturation and value in [0, 255] of byte channels."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = top - low
    deg = F.when(d == 0, 0.0).when(top == r, 60.0 * (g - b) / d).when(top == g, 120 + 60.0 * (b - r) / d).otherwise(240 + 60.0 * (r - g) / d)
    hue = F.bround(F.when(deg < 0, deg + 360).otherwise(deg) / 2).cast("int")
    return F.when(hue >= 180, hue - 180).otherwise(hue), F.when(top == 0, 0).otherwise(F.bround(255.0 * d / top).cast("int")), top


def name_colors(pixels: DataFrame, key: str = "crop_id") -> DataFrame:
    """(crop, color, confidence) from pixel rows (crop, b, g, r): the heaviest of six hues and one achromatic name, by its share of pixels.

    Sums and an exact median per crop; equal masses go by the order red, orange, brown, yellow, green, blue, achromatic.
    """
    h, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    rows = pixels.select(key, h.alias("h"), s.alias("s"), v.alias("v"))
    grey = F.expr("s < 60 or v < 46 or (v > 232 and s < 90)")
    hue = F.col("h")
    masks = {
        "red": (hue < 8) | (hue >= 150), "orange": hue.between(8, 29) & (F.col("v") > 150), "brown": hue.between(8, 29) & (F.col("v") <= 150),
        "yellow": hue.between(30, 44), "green": hue.between(45, 89), "blue": hue.between(90, 149),
    }
    sums = [F.count_if(~grey & m).alias(k) for k, m in masks.items()]
    found = rows.groupBy(key).agg(*sums, F.count_if(grey).alias("grey"), F.percentile(F.when(grey, F.col("v")), F.lit(0.5)).alias("mid"), F.count("*").alias("total"))
    name = F.when(F.col("mid") >= 205, "white").when(F.col("mid") >= 160, "silver").when(F.col("mid") >= 60, "gray").otherwise("black")
    best = F.greatest(*masks, "grey")
    pick = None
    for k in masks:
        pick = F.when(F.col(k) == best, k) if pick is None else pick.when(F.col(k) == best, k)
    return found.where(best > 0).select(key, pick.otherwise(name).alias("color"), (best / F.col("total")).alias("confidence"))


def pixels_of(images: DataFrame, crops: DataFrame, stride_px: int = 64) -> DataFrame:
    """Pixel rows (crop_id, b, g, r) of crops (crop_id, origin, x1, y1, x2, y2) from Spark's image source, sampled to some ``stride_px`` a side.

    Rows and columns are exploded from the byte array by position, so only sampled pixels become rows.
    """
    img = images.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("ch"), F.col("image.data").alias("data"))
    rows = crops.join(img, "origin").withColumn("step", F.greatest(F.lit(1), F.floor(F.greatest(F.expr("x2 - x1"), F.expr("y2 - y1")) / stride_px).cast("int")))
    rows = rows.where("x2 > x1 and y2 > y1")
    rows = rows.withColumn("y", F.explode(F.sequence("y1", F.col("y2") - 1, F.col("step")))).withColumn("x", F.explode(F.sequence("x1", F.col("x2") - 1, F.col("step"))))
    at = lambda i: F.conv(F.hex(F.substr("data", ((F.col("y") * F.col("w") + F.col("x")) * F.col("ch") + F.lit(i + 1)).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.select("crop_id", at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))
