"""Stateful operators on streams. Each wraps the same code as its table form, so both give equal rows.

State is kept in the RocksDB store, by stream and run for tracking and by track for plate votes. Rows that come late (a frame
at or before the last one seen) are dropped and counted. State of a stream that stays silent is finished by a timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tracking
from ..operators.plates import EMISSIONS, Vote

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACKED = tracking.ROWS + ", late int"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class TrackProcessor(StatefulProcessor):
    def __init__(self, config: tracking.Config, idle_ms: int):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "blob binary, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        tracker = pickle.loads(bytes(known[0])) if known else tracking.Tracker(self.config)
        pdf = pd.concat(list(rows))
        late = pdf["frame_index"] <= tracker.last_frame
        out = tracking.follow(tracker, key, pdf[~late]) if (~late).any() else []
        now = timerValues.getCurrentProcessingTimeInMs() if timerValues else -1
        timer = -1
        if now >= 0 and self.idle_ms:
            if known and known[1] >= 0:
                self.handle.deleteTimer(known[1])
            timer = now + self.idle_ms
            self.handle.registerTimer(timer)
        self.state.update((pickle.dumps(tracker), timer))
        yield self._frame(out, int(late.sum()), key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            out = tracking.finished_rows(key, pickle.loads(bytes(self.state.get()[0])).finish())
            self.state.clear()
        yield self._frame(out, 0, key)

    def _frame(self, out: list[tuple], late: int, key) -> pd.DataFrame:
        rows = [(*r, 0) for r in out]
        if late:
            rows.append((*key, *[None] * (len(tracking.COLUMNS) - 2), late))
        return pd.DataFrame(rows, columns=[*tracking.COLUMNS, "late"])

    def close(self) -> None:
        pass


def track(detections: DataFrame, config: tracking.Config = tracking.Config(), idle_ms: int = 0) -> DataFrame:
    """A stream of detections to the rows of ``tracking.track`` (finished ones when their time is over); a row with ``late`` > 0 counts dropped rows.

    Frames without detections come as rows with a null score. With ``idle_ms`` a stream silent for so long is finished.
    """
    cols = ["stream_id", "run_id", "frame_index", "timestamp", "det_idx", *tracking.BOX, "score", "vehicle_class"]
    mode = "processingTime" if idle_ms else "none"
    return detections.select(cols).groupBy("stream_id", "run_id").transformWithStateInPandas(TrackProcessor(config, idle_ms), TRACKED, "append", mode)


class VoteProcessor(StatefulProcessor):
    def __init__(self, min_reads: int, ttl_ms: int):
        self.min_reads, self.ttl_ms = min_reads, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vote", "blob binary, last long", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        vote, last = (pickle.loads(bytes(known[0])), known[1]) if known else (Vote(self.min_reads), -1)
        out = []
        for seq, text, conf in pd.concat(list(rows)).sort_values("seq")[["seq", "text", "conf"]].itertuples(index=False):
            if seq > last:
                last = int(seq)
                if (got := vote.add(text, conf)) is not None:
                    out.append((*key, seq, *got))
        self.state.update((pickle.dumps(vote), last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EMISSIONS.split(", ")])

    def close(self) -> None:
        pass


def plate_emissions(reads: DataFrame, min_reads: int = 2, ttl_ms: int = 0) -> DataFrame:
    """The stream form of ``plates.emissions``; a track's votes are forgotten after ``ttl_ms`` without a read."""
    rows = reads.select("stream_id", "run_id", "track_id", "seq", "text", "conf").groupBy("stream_id", "run_id", "track_id")
    return rows.transformWithStateInPandas(VoteProcessor(min_reads, ttl_ms), EMISSIONS, "append", "processingTime" if ttl_ms else "none")


FUSED = "stream_id string, run_id string, track_id long, seq long, key string, value string, confidence double, n_observations long"


class FusionProcessor(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.mass = handle.getMapState("mass", "key string, value string", "mass double, first long, n long", **ttl)
        self.last = handle.getValueState("last", "seq long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["done", "seq"], kind="stable")
        known: dict[str, dict[str, tuple[float, int, int]]] = {}
        for (k, v), m in self.mass.iterator() if self.mass.exists() else ():
            known.setdefault(k, {})[v] = tuple(m)
        last, out, changed = self.last.get()[0] if self.last.exists() else -1, [], set()
        seen = pdf[~pdf["done"]]
        for seq, k, v, c in seen[["seq", "key", "value", "confidence"]].itertuples(index=False):
            if seq <= last:
                continue
            last = int(seq)
            if not v or not c > 0:
                continue
            own = known.setdefault(k, {})
            m, first, n = own.get(v, (0.0, last, 0))
            own[v] = (m + min(float(c), 1.0), first, n + 1)
            changed.add((k, v))
            best = max(own, key=lambda x: (round(own[x][0], 9), -own[x][1]))
            out.append((*key, last, k, best, round(own[best][0], 9) / sum(round(m, 9) for m, _, _ in own.values()), sum(n for *_, n in own.values())))
        if pdf["done"].any():
            self.mass.clear()
            self.last.clear()
        elif last >= 0:
            for k, v in changed:
                self.mass.updateValue((k, v), known[k][v])
            self.last.update((last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FUSED.split(", ")])

    def close(self) -> None:
        pass


def fuse(observations: DataFrame, finished: DataFrame | None = None, ttl_ms: int = 0) -> DataFrame:
    """The stream form of ``attributes.fuse``: an attribute each time an observation counts, as it stands then; the last row of a (track, key) is what the table form gives.

    What was seen of a track is forgotten when it comes in ``finished`` (a stream too), and what was seen of a value after ``ttl_ms`` without it. Observations at or before the last ``seq`` of a track are late and dropped.
    """
    cols = ["stream_id", "run_id", "track_id", "seq", "key", "value", "confidence"]
    rows = observations.select(cols).withColumn("done", F.lit(False))
    if finished is not None:
        rows = rows.unionByName(finished.select("stream_id", "run_id", "track_id").withColumn("done", F.lit(True)), allowMissingColumns=True)
    return rows.groupBy("stream_id", "run_id", "track_id").transformWithStateInPandas(FusionProcessor(ttl_ms), FUSED, "append", "processingTime" if ttl_ms else "none")


def windowed_counts(events: DataFrame, every: str = "1 minute", late: str = "10 minutes", *by: str) -> DataFrame:
    """Event counts by window of event_time; rows later than ``late`` are dropped by the watermark."""
    out = events.withWatermark("event_time", late).groupBy(F.window("event_time", every), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sink(path: str, check=None, quarantine: str | None = None):
    """For foreachBatch: each batch goes to its own ``batch_id`` partition, overwritten on a retry, so nothing is written twice.

    Rows for which the boolean column ``check`` is not true go to ``quarantine`` instead.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.coalesce(check, F.lit(False)) if check is not None else F.lit(True)
        batch.where(ok).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if quarantine is not None:
            batch.where(~ok).write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")

    return write
