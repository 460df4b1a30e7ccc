"""Adaptive frame sampling: which frames of a stream are processed."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructType

from .folds import in_order, numbers, with_columns


@dataclass
class Sampler:
    """A bucket of one token that fills at the active rate while something was seen in a kept frame within settle_s, else at the idle rate."""

    active_fps: float = 15.0
    idle_fps: float = 2.0
    settle_s: float = 3.0
    fps_cap: float | None = None
    enabled: bool = True
    last_t: float | None = None
    tokens: float = 0.0
    seen_t: float | None = None

    def rate(self, t: float) -> float | None:
        """Frames a second that are wanted now; null: all of them."""
        busy = self.seen_t is not None and 0 <= t - self.seen_t <= self.settle_s
        rates = [r for r in (((self.active_fps if busy else self.idle_fps) if self.enabled else None), self.fps_cap) if r is not None]
        return min(rates, default=None)

    def admit(self, t: float, has_detection: bool) -> bool:
        """The first frame and one that goes back in time are kept and start afresh; a rate of zero or less keeps none."""
        rate = self.rate(t)
        if rate is None:
            kept = True
        elif rate <= 0:
            return False
        elif self.last_t is None or t < self.last_t:
            kept, self.tokens, self.seen_t = True, 0.0, None
        else:
            self.tokens = min(1.0, self.tokens + (t - self.last_t) * rate)
            kept = self.tokens >= 1.0
            self.tokens -= kept
        self.last_t = t
        if kept and has_detection:
            self.seen_t = t
        return kept


def sample(frames: DataFrame, **config) -> DataFrame:
    """``frames`` (stream_id, run_id, seq, timestamp, has_detection) with ``admitted``: what is kept decides the rate, so each stream runs in order.

    A stream passes batch by batch; its sampler, a few numbers, is all that is kept.
    """
    schema = StructType([*frames.schema.fields]).add("admitted", BooleanType())

    def scan(batches):
        s = Sampler(**config)
        for b, new in batches:
            out = []
            for first, t, seen in zip(new.tolist(), numbers(b, "timestamp"), numbers(b, "has_detection")):
                s = Sampler(**config) if first else s
                out.append(s.admit(float(t), bool(seen)))
            yield with_columns(b, admitted=pa.array(out, pa.bool_()))

    return in_order(frames, ["stream_id", "run_id"], ["seq"], schema, scan)
