"""Streams into the store: micro-batches that land in the tables of history and retention, each row once.

A batch is staged beside the tables, its files listed in a manifest, and then renamed into their partitions. A batch that is run again after a crash either is
staged anew (no manifest yet) or has its renames finished (manifest there), so nothing is lost or written twice. Events whose id is stored already are left out.
If rows can't be written, the batch is tried again and then halved by a digest of the id, as often as needed: what can be written is, and events that fail alone
go to a quarantine table with the reason. Attempts are kept in a small file, so a restart goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Failures of a slice before it is halved.
FAILURES = 2


class Files:
    """A few calls of Spark's own file system, whatever store the path is in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, a: str, b: str) -> None:
        """Only if ``a`` is still there; a file that was moved before is not moved again."""
        if self.exists(a):
            self.fs.mkdirs(self.path(b).getParent())
            if not self.fs.rename(self.path(a), self.path(b)):
                raise OSError(f"{a} can't be moved to {b}")

    def under(self, name: str) -> list[str]:
        """Data files below a folder, as paths relative to it."""
        out, base = [], self.fs.makeQualified(self.path(name)).toString()
        if self.exists(name):
            found = self.fs.listFiles(self.path(name), True)
            while found.hasNext():
                at = found.next().getPath().toString()
                if at.endswith(".parquet"):
                    out.append(at[len(base) + 1 :])
        return sorted(out)

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Whole or not at all: written beside, then renamed."""
        stream = self.fs.create(self.path(f"{name}.new"), True)
        stream.write(json.dumps(value).encode())
        stream.close()
        self.remove(name)
        self.fs.rename(self.path(f"{name}.new"), self.path(name))


def builders(mode: str = "plain", salt: str = "") -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The tables that events make: events, finished tracks and plate reads."""
    return {"events": lambda e: store.event_rows(e, mode, salt), "tracks": lambda e: store.track_rows(e, mode, salt), "plates": lambda e: store.plate_rows(e, mode, salt)}


class StoreSink:
    """For ``foreachBatch``: batches of events go to ``root``/events, tracks and plates, in partitions by wall_date and stream_id; ``source`` tells several streams into one store apart.

    Rows with a null id can't be told from each other and are quarantined, as are events that no attempt could write. Events are found stored by their id within
    the days of the batch, so only those days are read.
    """

    def __init__(self, root: str, tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None, source: str = "stream"):
        self.root, self.tables, self.source = root.rstrip("/"), tables or builders(), source

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, stage = Files(spark, self.root), f"{self.root}/_stage/{self.source}-{batch_id}"
        if not files.exists(f"{stage}/manifest"):
            self._stage(spark, files, batch, stage, batch_id)
        self._publish(files, stage)

    # --- stage

    def _stage(self, spark: SparkSession, files: Files, batch: DataFrame, stage: str, batch_id: int) -> None:
        progress = files.read(f"{stage}/attempts")
        if progress is None:
            files.remove(stage)
            self._fresh(spark, files, batch).write.parquet(f"{stage}/raw")
            progress = {"open": [["", 0]], "done": [], "alone": []}
            files.write(f"{stage}/attempts", progress)
        raw = spark.read.schema(batch.schema).parquet(f"{stage}/raw")
        while progress["open"]:
            bits, failed = progress["open"].pop()
            rows = raw.where(_slice(bits))
            try:
                for name, build in self.tables.items():
                    build(rows).write.mode("overwrite").partitionBy("wall_date", "stream_id").parquet(f"{stage}/{name}/slice-{bits or 'all'}")
                progress["done"].append(bits)
            except PySparkException as e:
                failed += 1
                if failed < FAILURES:
                    progress["open"].append([bits, failed])
                elif rows.agg(F.count_distinct("id")).first()[0] <= 1:
                    progress["alone"].append([bits, str(e)[:500]])
                else:
                    progress["open"] += [[bits + "0", 0], [bits + "1", 0]]
            files.write(f"{stage}/attempts", progress)
        for bits, why in progress["alone"]:
            bad = raw.where(_slice(bits)).withColumn("reason", F.lit(why))
            bad.write.mode("overwrite").parquet(f"{stage}/quarantine/slice-{bits or 'all'}")
        raw.where("id is null").withColumn("reason", F.lit("no id")).write.mode("overwrite").parquet(f"{stage}/quarantine/slice-null")
        moves = {}
        for name in (*self.tables, "quarantine"):
            slices = [f"slice-{b or 'all'}" for b in (progress["done"] if name != "quarantine" else [b for b, _ in progress["alone"]])] + ["slice-null"] * (name == "quarantine")
            for s in slices:
                for k, at in enumerate(files.under(f"{stage}/{name}/{s}")):
                    folder = at.rpartition("/")[0]
                    moves[f"{name}/{s}/{at}"] = "/".join(x for x in (name if name != "quarantine" else "_quarantine", folder, f"{self.source}-{batch_id}-{s}-{k}.parquet") if x)
        files.write(f"{stage}/manifest", moves)

    def _fresh(self, spark: SparkSession, files: Files, batch: DataFrame) -> DataFrame:
        """Events that aren't stored yet, one of each id; those without one all stay."""
        there = f"{self.root}/events"
        named = batch.where("id is not null").dropDuplicates(["id"])
        if files.under(there):
            day = store.wall_date(F.col("wall_ts"))
            first, last = batch.agg(F.min(day), F.max(day)).first()
            known = store.load(spark, there).where(F.col("wall_date").between(first, last) | F.col("wall_date").isNull()) if first else store.load(spark, there).where("wall_date is null")
            named = named.join(known.select("id"), "id", "left_anti").select(*batch.columns)
        return named.unionByName(batch.where("id is null"))

    # --- publish

    def _publish(self, files: Files, stage: str) -> None:
        for a, b in files.read(f"{stage}/manifest").items():
            files.move(f"{stage}/{a}", f"{self.root}/{b}")
        for name in (*self.tables, "quarantine", "raw"):  # the manifest stays and tells a repeated batch that all is done
            files.remove(f"{stage}/{name}")


def _slice(bits: str) -> F.Column:
    """Events whose id's digest begins with these bits; none has a null id."""
    named = F.col("id").isNotNull()
    return named & (F.shiftrightunsigned(F.xxhash64("id"), 64 - len(bits)) == int(bits, 2)) if bits else named


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/_quarantine/*.parquet")
