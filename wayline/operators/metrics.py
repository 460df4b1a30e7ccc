"""Counts, rates, latency and other operational figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds in seconds, and of batch sizes.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
BATCH_BUCKETS = (1, 2, 4, 8, 16, 32)


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy("type", *by).agg(F.count("*").alias("n"))


def stream_counts(frames: DataFrame, track_frames: DataFrame) -> DataFrame:
    """Per stream: frames seen, frames dropped (``dropped``), and the most tracks active at once."""
    seen = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), F.count_if("dropped").alias("dropped"))
    at = track_frames.where("state = 'active'").groupBy("stream_id", "frame_index").agg(F.count_distinct("track_id").alias("n"))
    return seen.join(at.groupBy("stream_id").agg(F.max("n").alias("most_active")), "stream_id", "left")


def validity(reads: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Share of valid plate reads by window of event_time."""
    out = reads.groupBy(F.window("event_time", every)).agg(F.count_if("valid").alias("valid"), F.count("*").alias("reads"))
    return out.select(F.col("window.start").alias("start"), "valid", "reads", (F.col("valid") / F.col("reads")).alias("ratio"))


def rates(events: DataFrame, every: str, *by: str) -> DataFrame:
    """Events per window of event_time; ``events`` may be a stream with a watermark."""
    return events.groupBy(F.window("event_time", every), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


#: Width of the blocks of a rolling rate, in spans.
BLOCK_SPANS = 16


def rolling_fps(frames: DataFrame, span: float = 2.0) -> DataFrame:
    """``frames`` with fps: frames of the last ``span`` seconds by second.

    A stream is cut into blocks of time; the rows of a block's last span also stand, unseen, at the beginning of the next one, so one stream's rows spread over many tasks.
    """
    width = float(BLOCK_SPANS * span)
    own = F.floor(F.col("wall_ts") / width).cast("long")
    reach = F.floor((F.col("wall_ts") + span) / width).cast("long")  # its span may end in the next block
    blocks = F.when(reach > own, F.array(own, own + 1)).otherwise(F.array(own))
    rows = frames.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)
    n = F.expr(f"count(*) over (partition by stream_id, _block order by wall_ts range between {float(span)}D preceding and current row)")
    return rows.withColumn("fps", F.bround(n / span, 2)).where("_own").drop("_block", "_own")


def quantiles(samples: DataFrame, value: str, *by: str, exact: bool = True) -> DataFrame:
    """p50 and p95; the approximate form keeps a sketch of bounded size for each group."""
    q = (lambda p: F.percentile(value, F.lit(p))) if exact else (lambda p: F.percentile_approx(value, p, 10_000))
    return samples.groupBy(*by).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.count("*").alias("n"))


def histogram(samples: DataFrame, value: str, bounds: tuple = LATENCY_BUCKETS, *by: str) -> DataFrame:
    """Counts at or below each bound, and of all (bound null)."""
    sums = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds], F.struct(F.lit(None).cast("double").alias("le"), F.count("*").alias("n")))
    return samples.groupBy(*by).agg(sums.alias("b")).select(*by, F.inline("b"))


def live_status(streams: DataFrame, live: DataFrame) -> DataFrame:
    """All configured streams; those without a worker are stopped, with zeros."""
    rows = streams.select("stream_id").join(live, "stream_id", "left")
    return rows.select("stream_id", F.coalesce("state", F.lit("stopped")).alias("state"), *[F.coalesce(c, F.lit(0)).alias(c) for c in live.columns if c not in ("stream_id", "state")])
