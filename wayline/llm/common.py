"""Shared helpers: cutting lineage in the shared folder, reading tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``); in local mode one of our own if unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="wayline-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The write's own shuffle files, which nothing reads again, are removed at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayline-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b of one type that has an order): rows (node, root), root being the smallest node reachable.

    Alternating large-star and small-star rounds (each node points to the least node it knows), every round
    written to the shared folder, until all that is left are stars. The number of rounds grows with the logarithm of the longest chain; only
    a flag comes to the driver. Self links are left out; no edges give no rows.
    """
    now = cut(_down(edges))
    while not _stars(now):
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and that one to none."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = both.join(least, both.a == least.u).where("b > a")
    return hung.select(F.col("b").alias("a"), F.least("m", F.col("u")).alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = edges.join(least, edges.a == least.u).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("u", "m")).distinct()
