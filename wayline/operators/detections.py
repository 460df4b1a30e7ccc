"""Raw predictions to clean detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import DEFAULT_CLASSES, vehicle_class

FRAME = ["stream_id", "run_id", "frame_index"]


def decode_end_to_end(predictions: DataFrame, conf: float) -> DataFrame:
    """``rows`` (array of x1, y1, x2, y2, score, class) to a row for each box with score >= conf."""
    rows = predictions.select(*[c for c in predictions.columns if c != "rows"], F.posexplode("rows").alias("det_idx", "r"))
    at = lambda i: F.get("r", F.lit(i)).cast("double")
    return rows.select(*[c for c in rows.columns if c != "r"], *[at(i).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2", "score"))], at(5).cast("int").alias("class_id")).where(F.col("score") >= conf)


def decode_classic(predictions: DataFrame, conf: float) -> DataFrame:
    """``rows`` (array of cx, cy, w, h, then class scores) to boxes of the best class (the first on ties) with score >= conf."""
    rows = predictions.select(*[c for c in predictions.columns if c != "rows"], F.posexplode("rows").alias("det_idx", "r"))
    scores = F.slice("r", F.lit(5), F.size("r") - 4)
    cx, cy, w, h = (F.get("r", F.lit(i)).cast("double") for i in range(4))
    best = F.array_max(scores)
    out = {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2, "score": best.cast("double"), "class_id": (F.array_position(scores, best) - 1).cast("int")}
    return rows.select(*[c for c in rows.columns if c != "r"], *[v.alias(k) for k, v in out.items()]).where(F.col("score") >= conf)


def contract(detections: DataFrame, labels: DataFrame | None, conf: float, classes: list[str] | None = None) -> DataFrame:
    """Score, label, class and clipping rules; drops ids without label, labels of no road user, classes not allowed and empty boxes.

    ``labels`` (class_id, class_name) is a small dimension; without it the table has class_name. An empty or missing ``classes`` means vehicles.
    """
    rows = detections.where(F.col("score") >= conf)
    if labels is not None:
        rows = rows.drop("class_name").join(labels, "class_id")
    rows = rows.withColumn("vehicle_class", vehicle_class(F.col("class_name"))).where(F.col("vehicle_class").isin(classes or DEFAULT_CLASSES))
    clipped = G.clip(G.box(), F.col("width").cast("double"), F.col("height").cast("double"))
    return rows.withColumns(clipped).where("x2 > x1 and y2 > y1")


def nms(detections: DataFrame, threshold: float, keys: list[str] | None = None, label: str = "class_id") -> DataFrame:
    """Per-class non-maximum suppression: in order of score (then det_idx), a box goes if it overlaps a kept one by more than ``threshold``.

    A fold over the boxes of one frame and class.
    """
    keys = keys or FRAME
    fields = ("score", "det_idx", "x1", "y1", "x2", "y2")
    box = F.struct((-F.col("score")).alias("o"), *fields)

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: G.iou({n: k[n] for n in ("x1", "y1", "x2", "y2")}, {n: b[n] for n in ("x1", "y1", "x2", "y2")}) > threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(b)))

    boxes = detections.groupBy(*keys, label).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    start = F.slice("boxes", 1, 1)
    return boxes.select(*keys, label, F.inline(F.aggregate(F.slice(F.col("boxes"), F.lit(2), F.greatest(F.size("boxes") - 1, F.lit(0))), start, step))).drop("o")


def overlaps(detections: DataFrame, min_iou: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs of boxes of one frame with IoU of ``min_iou`` or more: an equi-join on the frame with a residual test."""
    keys = keys or FRAME
    a = detections.select(*keys, F.col("det_idx").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])
    b = detections.select(*keys, F.col("det_idx").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    value = G.iou({k: F.col(f"a{k}") for k in ("x1", "y1", "x2", "y2")}, {k: F.col(f"b{k}") for k in ("x1", "y1", "x2", "y2")})
    return a.join(b, keys).where("a < b").withColumn("iou", value).where(F.col("iou") >= min_iou).select(*keys, "a", "b", "iou")


#: Label indices of the 80-class set; in the 91-number set ten numbers are unused.
UNUSED_91 = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)


def contiguous_id(number: Column) -> Column:
    """Index from 0 in the 80-class set of a number from 1 in the 91-number set; null for an unused one."""
    below = sum((F.when(number > g, 1).otherwise(0) for g in UNUSED_91), F.lit(0))
    return F.when(number.between(1, 90) & ~number.isin(*UNUSED_91), number - 1 - below)
