"""Table functions for SQL text: tracking and plate votes over ``TABLE(...) PARTITION BY ... ORDER BY ...``.

Spark brings the rows of a partition in order to one instance, which keeps the state that the DataFrame forms keep: the tracker, or the sums of a vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import tracking
from ..operators.plates import EMISSIONS, Vote


class TrackDetections:
    """Rows of one stream and run by frame_index and det_idx; a row with a null score stands for an empty frame."""

    def __init__(self):
        self.tracker, self.key, self.frame, self.rows = tracking.Tracker(), None, None, []

    def eval(self, row: Row) -> Iterator[tuple]:
        at = (row["frame_index"], row["timestamp"])
        if self.frame is not None and at != self.frame:
            yield from self._step()
        self.key, self.frame = (row["stream_id"], row["run_id"]), at
        if row["score"] is not None:
            self.rows.append(row)

    def _step(self) -> Iterator[tuple]:
        boxes = np.array([[r[c] for c in tracking.BOX] for r in self.rows], float).reshape(-1, 4)
        live, done = self.tracker.step(*self.frame, boxes, np.array([r["score"] for r in self.rows], float), [r["vehicle_class"] for r in self.rows])
        self.rows = []
        for r in live:
            yield (*self.key, *r, False, False)
        yield from tracking.finished_rows(self.key, done)

    def terminate(self) -> Iterator[tuple]:
        if self.frame is not None:
            yield from self._step()
            yield from tracking.finished_rows(self.key, self.tracker.finish())


class PlateVotes:
    """Reads of one track by seq: a row whenever ``min_reads`` of them agree on a plate that was not the last one given out."""

    def __init__(self):
        self.vote = None

    def eval(self, row: Row, min_reads: int = 2) -> Iterator[tuple]:
        self.vote = self.vote or Vote(min_reads)
        if (got := self.vote.add(row["text"], row["conf"] or 0.0)) is not None:
            yield (row["stream_id"], row["run_id"], row["track_id"], row["seq"], *got)


def register_tables(spark: SparkSession) -> list[str]:
    for name, made, schema in (("track_detections", TrackDetections, tracking.ROWS), ("plate_votes", PlateVotes, EMISSIONS)):
        spark.udtf.register(name, udtf(made, returnType=schema))
    return ["plate_votes", "track_detections"]
