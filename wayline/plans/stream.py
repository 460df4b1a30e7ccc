"""The whole job as streams: detections to tracks, tracks to events in the store, events to rule events.

Tracks are one query; its rows go to a table that the others follow, so tracking runs once. Lines, zones, motion and lives are a query each, with a checkpoint and a
sink of their own, so one may be restarted or changed without the others. Rules follow the store's events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import events, rules, tracking
from ..sources import publish, store
from ..streaming import processors
from ..streaming import trajectories as S
from .batch import Dimensions


def _clock(rows: DataFrame, frames: DataFrame | None) -> DataFrame:
    """Rows with the wall clock of their frame; without ``frames`` the stream's own clock stands for it."""
    if frames is None:
        return rows.withColumn("wall_ts", F.col("timestamp"))
    return rows.join(frames.select("stream_id", "run_id", "frame_index", "wall_ts"), ["stream_id", "run_id", "frame_index"], "left")


def _visit_events(rows: DataFrame) -> DataFrame:
    kinds = {"entered": ("zone_entered", 5), "dwell": ("zone_dwell", 5), "exited": ("zone_exited", 5), "finished": ("zone_exited", 6)}
    zone = {"zone": F.col("zone_id"), "zone_name": F.col("name")}
    made = [events.event(rows.where(F.col("kind") == k), type_, events.payload(**zone, **({"dwell_s": F.bround("dwell_s", 3)} if k != "entered" else {})), F.col("zone_id"), F.col("ord"), phase=phase) for k, (type_, phase) in kinds.items()]
    return events.union(*made)


def _life_events(rows: DataFrame) -> DataFrame:
    start = events.event(rows.where("kind = 'started'"), "track_started", events.payload(**{"class": F.col("vehicle_class")}))
    d = events.payload(**{"class": F.col("vehicle_class"), "duration_s": F.bround("duration_s", 6), "n_points": F.col("n_points")})
    return events.union(start, events.event(rows.where("kind = 'finished'"), "track_finished", d))


def _parts(tracked: DataFrame, dims: Dimensions, config: tracking.Config, idle_ms: int) -> dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]:
    return {
        "lines": (S.crossings(tracked, dims.lines, idle_ms), lambda b: events.from_crossings(b.where("line_id is not null"))),
        "zones": (S.visits(tracked, dims.zones, idle_ms), _visit_events),
        "motion": (S.motion(tracked, dims.calibrations, dims.limits, max_history=config.max_history, idle_ms=idle_ms), lambda b: events.from_speeding(b.where("speeding").withColumn("speed_kmh", F.bround("speed_kmh", 1)))),
        "lives": (S.lives(tracked, config.max_history, idle_ms), _life_events),
    }


def _into(sink: publish.StoreSink, made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # several kinds of events come from one batch of state
        try:
            sink(made(held), batch_id)
        finally:
            held.unpersist()

    return write


def _start(rows: DataFrame, root: str, name: str, trigger: dict) -> Callable:
    return rows.writeStream.queryName(f"{name}-{abs(hash(root))}").option("checkpointLocation", f"{root}/_checkpoints/{name}").trigger(**trigger)


def run_stream(spark: SparkSession, detections: DataFrame, dims: Dimensions, root: str, config: tracking.Config = tracking.Config(), frames: DataFrame | None = None, idle_ms: int = 0, mode: str = "plain", salt: str = "", wait: bool = True) -> list[StreamingQuery]:
    """Starts the queries from a stream of detections (empty frames as rows with a null score) into the store at ``root``: events, tracks and plates as from ``publish.StoreSink``.

    ``frames`` gives wall clocks. With ``wait`` each query takes what is there and ends before the next one starts; else all run on. Events are those of ``run_batch`` for lines, zones,
    speeding and the start and end of tracks (the end with duration and points only). Rules fire on events by themselves and by the class of their track; conditions on a track's speed or a
    visit's dwell at another event's frame need the tables of ``run_batch``. Cooldowns hold across batches; hits of one rule from different queries come in the order of these.
    """
    trigger = {"availableNow": True} if wait else {"processingTime": "10 seconds"}
    running = []

    def go(writer) -> None:
        query = writer.start()
        running.append(query)
        if wait:
            query.awaitTermination()

    rows = processors.track(detections, config, idle_ms)
    go(_start(rows, root, "tracks", trigger).format("parquet").option("path", f"{root}/_tracked"))
    follow = lambda: spark.readStream.schema(processors.TRACKED).parquet(f"{root}/_tracked").where("late = 0")
    tables = publish.builders(mode, salt)
    for name, (part, made) in _parts(follow(), dims, config, idle_ms).items():
        go(_start(part, root, name, trigger).foreachBatch(_into(publish.StoreSink(root, tables, name), lambda b, made=made: made(_clock(b, frames)))))
    if dims.rule_list:
        stored = spark.readStream.schema(f"{schemas.EVENTS}, wall_date date").parquet(f"{root}/events")
        found = rules.hits(rules.with_state(stored), dims.rule_list)
        cooled = S.cooled(found.drop("wall_date", "dwell").withColumn("data", F.to_json("data")))  # the payload passes as text
        data = schemas.EVENTS.split("data ", 1)[1].split(", snapshot_path")[0]

        def fired(batch: DataFrame) -> DataFrame:
            return rules.rule_events(batch.withColumn("data", F.from_json("data", data))).drop("trigger_data")

        go(_start(cooled, root, "rules", trigger).foreachBatch(_into(publish.StoreSink(root, tables, "rules"), fired)))
    return running
