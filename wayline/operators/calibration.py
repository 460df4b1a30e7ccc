"""Homographies of a fleet of cameras, and how well they fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

LIMIT_PX = 2.0


#: Eigenvalues below this share of the greatest count as zero.
FLAT = 1e-11
_SIDES = (("image", "image_x", "image_y"), ("ground", "ground_x", "ground_y"))


def fit(points: DataFrame) -> DataFrame:
    """A homography and its inverse for each stream of correspondences; streams with under four pairs or degenerate ones give none.

    With p = (x, y, 1) on the image and (u, v) on the ground, the least-squares matrix is made of four moment matrices, the sums of pp', u pp', v pp' and
    (u^2 + v^2) pp'; these are plain aggregates, so no stream's points are gathered. Both sides are first moved to their mean and scaled by their spread.
    """
    spread = points.groupBy("stream_id").agg(F.count("*").alias("n"), *[f for side, x, y in _SIDES for f in (
        F.avg(x).alias(f"{side}_mx"), F.avg(y).alias(f"{side}_my"), F.sqrt(F.var_pop(x) + F.var_pop(y)).alias(f"{side}_s"))])
    rows = points.join(spread.where("n >= 4 and image_s > 0 and ground_s > 0"), "stream_id")
    x, y, u, v = [(F.col(c) - F.col(f"{side}_m{axis}")) / F.col(f"{side}_s") for side, *own in _SIDES for c, axis in zip(own, "xy")]
    p = (x, y, F.lit(1.0))
    moments = [F.sum(w * p[i] * p[j]) for w in (F.lit(1.0), u, v, u * u + v * v) for i in range(3) for j in range(i, 3)]
    norms = [f"{side}_{k}" for side, *_ in _SIDES for k in ("mx", "my", "s")]
    sums = rows.groupBy("stream_id", *norms).agg(F.array(*moments).alias("m"))

    @F.pandas_udf("h array<double>, inverse array<double>")
    def solve(m: pd.Series, norm: pd.DataFrame) -> pd.DataFrame:
        found = [_homography(np.array(a), *n) for a, n in zip(m, norm[norms].itertuples(index=False))]
        return pd.DataFrame({"h": [f and f[0] for f in found], "inverse": [f and f[1] for f in found]})

    out = sums.withColumn("s", solve("m", F.struct(*norms))).where("s.h is not null")
    return out.select("stream_id", "s.h", "s.inverse")


def _homography(sums: np.ndarray, ix: float, iy: float, i_s: float, gx: float, gy: float, g_s: float) -> tuple[list[float], list[float]] | None:
    """The direction in which the moment matrix is least, taken back to pixels and metres; none if it isn't the only one."""
    a, b, c, d = (np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]) for m in sums.reshape(4, 6))
    values, vectors = np.linalg.eigh(np.block([[a, np.zeros((3, 3)), -b], [np.zeros((3, 3)), a, -c], [-b, -c, d]]))
    if values[1] <= FLAT * values[-1]:
        return None
    back = np.array([[g_s, 0, gx], [0, g_s, gy], [0, 0, 1]])
    there = np.array([[1 / i_s, 0, -ix / i_s], [0, 1 / i_s, -iy / i_s], [0, 0, 1]])
    h = back @ vectors[:, 0].reshape(3, 3) @ there
    if abs(h[2, 2]) < 1e-12 * abs(h).max() or abs(np.linalg.det(h / h[2, 2])) < 1e-15:
        return None
    h = h / h[2, 2]
    return h.reshape(-1).tolist(), np.linalg.inv(h).reshape(-1).tolist()


def errors(points: DataFrame, calibrations: DataFrame) -> DataFrame:
    """``points`` with error_px: how far the ground point, projected back, is from the image point."""
    rows = points.join(calibrations.select("stream_id", "inverse"), "stream_id")
    x, y = G.project(F.col("inverse"), F.col("ground_x"), F.col("ground_y"))
    return rows.withColumn("error_px", F.hypot(x - F.col("image_x"), y - F.col("image_y"))).drop("inverse")


def report(points: DataFrame, calibrations: DataFrame, limit: float = LIMIT_PX) -> DataFrame:
    out = errors(points, calibrations).groupBy("stream_id").agg(F.avg("error_px").alias("mean_error_px"), F.max("error_px").alias("max_error_px"), F.count("*").alias("points"))
    return out.withColumn("ok", F.col("mean_error_px") <= limit)
