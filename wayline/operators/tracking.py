"""Multi-object tracking: detections of one stream and run to tracks.

The tracker's state depends on every earlier frame, so a stream is followed in order and streams run side by side. Where a stream pauses for so long that no track
outlives the pause, the tracker is as good as new: there a stream can be cut, its segments run side by side too, and only the numbers of their tracks hang together.
Tables pass as sorted batches through ``mapInPandas``, streams through a state processor, both through ``Tracker``: what stays in memory is the live tracks
and a batch, whatever a stream's length.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FINISHED, TRACK_FRAMES
from .folds import by_few_keys, by_key

LEAST = 1e-3
_POS, _VEL = 1 / 20, 1 / 160
BOX = ["x1", "y1", "x2", "y2"]
STATES = ("tentative", "active", "lost")
TENTATIVE, ACTIVE, LOST = range(3)


@dataclass(frozen=True)
class Config:
    activation: float = 0.5
    min_score: float = 0.1
    match_iou: float = 0.2
    min_hits: int = 3
    lost_ttl: float = 1.0
    max_history: int = 600


_SINGLE = struct.Struct("f")
#: Squares of the aspect's deviations: at birth and of its speed, per step and of its speed's, and of a measurement.
_ASPECT_BORN, _ASPECT_STEP, _ASPECT_SPEED, _ASPECT_SEEN = 1e-2 * 1e-2, 1e-2 * 1e-2, 1e-5 * 1e-5, 1e-1 * 1e-1
#: Pairs of tracks and boxes from which on overlaps are worked out as arrays.
MANY_PAIRS = 256


def _single(x: float) -> float:
    """In single precision, as the gate compares overlaps."""
    return _SINGLE.unpack(_SINGLE.pack(x))[0]


def _measure(box: list[float]) -> tuple[float, float, float, float]:
    """Centre, aspect and height."""
    x1, y1, x2, y2 = box
    w, h = max(x2 - x1, LEAST), max(y2 - y1, LEAST)
    return (x1 + x2) / 2, (y1 + y2) / 2, w / h, h


class Track:
    """A live track with its constant-velocity filter.

    All noise is independent by measure and each measure moves by its own speed alone, so the eight-number filter falls into four of two numbers: a place with
    its variance ``p``, a speed with its variance ``v``, and the covariance ``c`` of both. Noise grows with the height for all measures but the aspect, so three of
    the four share ``p``, ``c`` and ``v``; the aspect has its own (``ap``, ``ac``, ``av``). A frame has few tracks, for which plain numbers are several times faster than arrays.
    """

    __slots__ = ("id", "box", "score", "state", "seen", "hits", "streak", "confirmed", "total", "cls", "votes", "x", "y", "a", "h", "dx", "dy", "da", "dh", "p", "c", "v", "ap", "ac", "av")

    def __init__(self, id_: int, box: list[float], score: float, t: float, cls: str, sure: bool):
        self.id, self.box, self.score, self.seen, self.total, self.cls, self.votes = id_, box, score, t, score, cls, {cls: 1}
        self.state, self.hits, self.streak, self.confirmed = ACTIVE if sure else TENTATIVE, 1, 1, sure
        self.x, self.y, self.a, self.h = _measure(box)
        self.dx = self.dy = self.da = self.dh = 0.0
        place, speed = 2 * _POS * self.h, 10 * _VEL * self.h
        self.p, self.c, self.v = place * place, 0.0, speed * speed
        self.ap, self.ac, self.av = _ASPECT_BORN, 0.0, _ASPECT_SPEED

    def predict(self) -> tuple[float, float, float, float]:
        """One step on, and the box there; a lost track keeps its size."""
        if self.state == LOST:
            self.da = self.dh = 0.0
        h = max(self.h, LEAST)
        self.x += self.dx
        self.y += self.dy
        self.a += self.da
        self.h += self.dh
        place, speed = _POS * h, _VEL * h
        self.p = self.p + 2 * self.c + self.v + place * place
        self.c += self.v
        self.v += speed * speed
        self.ap = self.ap + 2 * self.ac + self.av + _ASPECT_STEP
        self.ac += self.av
        self.av += _ASPECT_SPEED
        h = max(self.h, LEAST)
        w = max(self.a, LEAST) * h
        return self.x - w / 2, self.y - h / 2, self.x + w / 2, self.y + h / 2

    def take(self, box: list[float], score: float, t: float, cls: str, min_hits: int) -> None:
        place = _POS * max(self.h, LEAST)
        x, y, a, h = _measure(box)
        p, c, ap, ac = self.p, self.c, self.ap, self.ac
        s, sa = p + place * place, ap + _ASPECT_SEEN
        x, y, a, h = x - self.x, y - self.y, a - self.a, h - self.h
        gain, gain_a = p / s, ap / sa
        self.x += gain * x
        self.y += gain * y
        self.a += gain_a * a
        self.h += gain * h
        gain, gain_a = c / s, ac / sa
        self.dx += gain * x
        self.dy += gain * y
        self.da += gain_a * a
        self.dh += gain * h
        self.p, self.c, self.v = p - p * p / s, c - p * c / s, self.v - c * c / s
        self.ap, self.ac, self.av = ap - ap * ap / sa, ac - ap * ac / sa, self.av - ac * ac / sa
        self.box, self.score, self.seen = box, score, t  # the raw box is kept, the filter's only matches
        self.hits += 1
        self.total += score
        if not self.confirmed:
            self.streak += 1
            self.confirmed = self.streak >= min_hits
        self.state = ACTIVE if self.confirmed else TENTATIVE
        n = self.votes[cls] = self.votes.get(cls, 0) + 1
        if n > self.votes[self.cls]:
            self.cls = cls


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In single precision, as the gate compares it."""
    side = lambda lo, hi: np.maximum(0, np.minimum(a[:, None, hi], b[None, :, hi]) - np.maximum(a[:, None, lo], b[None, :, lo]))
    both = side(0, 2) * side(1, 3)
    size = lambda x: np.maximum(0, x[:, 2] - x[:, 0]) * np.maximum(0, x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0).astype(np.float32)


def _overlaps(a: list, b: list, least: float) -> list[tuple[float, int, int]]:
    """(-IoU, i, j) of the pairs with ``least`` or more."""
    if len(a) * len(b) >= MANY_PAIRS or least <= 0:
        iou = iou_matrix(np.array(a, float), np.array(b, float))
        i, j = np.nonzero(iou >= least)
        return list(zip((-iou[i, j]).tolist(), i.tolist(), j.tolist()))
    out, gate = [], _single(least)
    for j, (bx1, by1, bx2, by2) in enumerate(b):
        size = max(0.0, bx2 - bx1) * max(0.0, by2 - by1)
        for i, (ax1, ay1, ax2, ay2) in enumerate(a):
            if not (bx1 < ax2 and ax1 < bx2 and by1 < ay2 and ay1 < by2):
                continue  # apart, or no number
            both = ((ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)) * ((ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1))
            union = max(0.0, ax2 - ax1) * max(0.0, ay2 - ay1) + size - both
            if both > 0 and union > 0 and (iou := _single(both / union)) >= gate:
                out.append((-iou, i, j))
    return out


def match(a: list, b: list, least: float) -> list[tuple[int, int]]:
    """Greedy pairs by IoU, then by track and detection order."""
    if not a or not b:
        return []
    used_i, used_j, out = set(), set(), []
    for _, x, y in sorted(_overlaps(a, b, least)):
        if x not in used_i and y not in used_j:
            used_i.add(x)
            used_j.add(y)
            out.append((x, y))
    return out


class Tracker:
    """State of one stream and run: live tracks in order of their birth. ``step`` must see every processed frame, the empty ones too."""

    def __init__(self, config: Config = Config()):
        self.config, self.next_id = config, 1
        self.tracks: list[Track] = []
        self.last_t, self.last_frame = 0.0, -1

    @property
    def live(self) -> int:
        return len(self.tracks)

    def step(self, frame: int, t: float, boxes, scores, classes: list[str]) -> tuple[list[tuple], list[tuple]]:
        """Rows of live tracks after this frame, and of tracks that it finished."""
        finished, matched = self.advance(frame, t, boxes, scores, classes)
        return [self.row(k, m, frame, t) for k, m in zip(self.tracks, matched)], finished

    @staticmethod
    def row(k: Track, matched: bool, frame: int, t: float) -> tuple:
        return k.id, frame, t, STATES[k.state], matched, *k.box, k.cls, k.score, k.hits, k.total / max(k.hits, 1)

    def advance(self, frame: int, t: float, boxes, scores, classes: list[str]) -> tuple[list[tuple], list[bool]]:
        """Takes in a frame: the tracks that it finished, and which of the live ones it matched or started."""
        c, finished, tracks = self.config, [], self.tracks
        boxes, scores = (v.tolist() if isinstance(v, np.ndarray) else v for v in (boxes, scores))
        high = [d for d, score in enumerate(scores) if score >= c.activation]
        pairs: dict[int, int] = {}
        matched: list[bool] = []
        if tracks:
            at = [k.predict() for k in tracks]
            if scores:
                pairs = self._pairs(at, boxes, scores, high)
            over = False
            for i, k in enumerate(tracks):
                if (d := pairs.get(i)) is not None:
                    k.take(boxes[d], scores[d], t, classes[d], c.min_hits)
                else:
                    if k.state != LOST:
                        k.state, k.streak = LOST, 0
                    over = over or t - k.seen > c.lost_ttl
            matched = [i in pairs for i in range(len(tracks))]
            if over:
                gone = [k.state == LOST and t - k.seen > c.lost_ttl for k in tracks]
                finished = [(k.id, frame, t, k.cls, k.confirmed, k.hits) for k, g in zip(tracks, gone) if g]
                matched = [m for m, g in zip(matched, gone) if not g]
                self.tracks = tracks = [k for k, g in zip(tracks, gone) if not g]
        taken = set(pairs.values())
        for d in high:
            if d not in taken:
                tracks.append(Track(self.next_id, boxes[d], scores[d], float(t), classes[d], c.min_hits <= 1))
                matched.append(True)
                self.next_id += 1
        self.last_t, self.last_frame = t, frame
        return finished, matched

    def _pairs(self, at: list, boxes: list, scores: list[float], high: list[int]) -> dict[int, int]:
        """Settled and lost tracks get strong detections first, settled ones then weak ones, new ones what is left of the strong."""
        c, pairs, states = self.config, {}, [k.state for k in self.tracks]

        def stage(tracks: list[int], dets: list[int]) -> None:
            for i, j in match([at[k] for k in tracks], [boxes[d] for d in dets], c.match_iou):
                pairs[tracks[i]] = dets[j]

        stage([k for k, s in enumerate(states) if s != TENTATIVE], high)
        stage([k for k, s in enumerate(states) if s == ACTIVE and k not in pairs], [d for d, score in enumerate(scores) if c.min_score <= score < c.activation])
        taken = set(pairs.values())
        stage([k for k, s in enumerate(states) if s == TENTATIVE], [d for d in high if d not in taken])
        return pairs

    def finish(self) -> list[tuple]:
        """Ends all tracks: two empty frames, each a TTL and a second on."""
        base, frame, out = self.last_t, self.last_frame, []
        for k in (1, 2):
            out += self.advance(frame, base + (self.config.lost_ttl + 1) * k, [], [], [])[0]
        return out


ROWS = TRACK_FRAMES + ", done boolean, confirmed boolean"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def frames_of(rows: pd.DataFrame) -> Iterator[tuple[int, float, list[list[float]], list[float], list[str]]]:
    """Frames of rows in order: (frame, time, boxes, scores, classes); a row with null score stands for an empty frame."""
    frame, t = rows["frame_index"].to_numpy(), rows["timestamp"].to_numpy(float)
    cuts = (np.flatnonzero((np.diff(frame) != 0) | (np.diff(t) != 0)) + 1).tolist()
    empty = np.isnan(rows["score"].to_numpy(float))
    some = empty.any()
    frame, t, boxes, scores, classes = frame.tolist(), t.tolist(), rows[BOX].to_numpy(float).tolist(), rows["score"].to_numpy(float).tolist(), rows["vehicle_class"].tolist()
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a < b:
            if some and empty[a:b].any():
                own = [i for i in range(a, b) if not empty[i]]
                yield int(frame[a]), t[a], [boxes[i] for i in own], [scores[i] for i in own], [classes[i] for i in own]
            else:
                yield int(frame[a]), t[a], boxes[a:b], scores[a:b], classes[a:b]


class Rows:
    """Collects output rows, a frame at a time."""

    def __init__(self):
        self.live: list[tuple] = []

    def add(self, key: tuple, tracker: Tracker, frame: int, t: float, matched: list[bool]) -> None:
        self.live += [(*key, *tracker.row(k, m, frame, t), False, False) for k, m in zip(tracker.tracks, matched)]

    def flush(self) -> pd.DataFrame | None:
        if not self.live:
            return None
        out = pd.DataFrame(dict(zip(COLUMNS, map(list, zip(*self.live)))))
        self.live = []
        return out


def follow(tracker: Tracker, key: tuple, rows: pd.DataFrame) -> list[tuple]:
    """Feeds rows of frames to a tracker; output rows in the ROWS schema."""
    out = []
    for frame, *dets in frames_of(rows.sort_values(["frame_index", "timestamp", "det_idx"])):
        live, done = tracker.step(frame, *dets)
        out += [(*key, *r, False, None) for r in live] + finished_rows(key, done)
    return out


def finished_rows(key: tuple, done: list[tuple]) -> list[tuple]:
    return [(*key, i, frame, t, "finished", False, None, None, None, None, cls, None, hits, None, True, confirmed) for i, frame, t, cls, confirmed, hits in done]


#: Rows of live tracks that are collected before they go out.
FLUSH_ROWS = 20_000


def _follow_all(config: Config, every_frame: bool, keys: list[str]):
    """Follows sorted rows, batch by batch; the last frame of a batch waits for the next one, as more of it may come. Keys beyond stream and run go out behind the other columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, key, rest, rows, size = Tracker(config), None, None, Rows(), 0

        def ended() -> pd.DataFrame:
            return marked(pd.DataFrame(finished_rows(key[:2], tracker.finish()), columns=COLUMNS))

        def marked(out: pd.DataFrame) -> pd.DataFrame:
            return out.assign(**dict(zip(keys[2:], key[2:])))

        def feed(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal size
            done = []
            for frame, t, *dets in frames_of(part):
                over, matched = tracker.advance(frame, t, *dets)
                done += finished_rows(key[:2], over)
                if every_frame and tracker.live:
                    rows.add(key[:2], tracker, frame, t, matched)
                    size += tracker.live
                    if size >= FLUSH_ROWS:
                        yield marked(rows.flush())
                        size = 0
            if done:
                yield marked(pd.DataFrame(done, columns=COLUMNS))

        def flushed() -> Iterator[pd.DataFrame]:
            nonlocal size
            if (left := rows.flush()) is not None:
                yield marked(left)
            size = 0

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            where = b.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(b)]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                own = tuple(b[k].iloc[lo] for k in keys) if lo < hi else key
                if key is not None and own != key:
                    if len(keys) > 2:
                        yield from flushed()
                    yield ended()
                    tracker = Tracker(config)
                key = own
                if hi == len(b):  # the last frame may go on in the next batch
                    f, t = b["frame_index"].to_numpy()[lo:hi], b["timestamp"].to_numpy()[lo:hi]
                    open_ = np.flatnonzero((f != f[-1]) | (t != t[-1]))
                    at = lo + (int(open_[-1]) + 1 if len(open_) else 0)
                    yield from feed(b.iloc[lo:at])
                    rest = b.iloc[at:]
                else:
                    yield from feed(b.iloc[lo:hi])
        if rest is not None and len(rest):
            yield from feed(rest)
        if key is not None:
            yield from flushed()
            yield ended()

    return lambda batches: run(b for b in batches if len(b))


#: Width of the blocks of time at whose borders streams are cut, in times to live.
BLOCK_TTLS = 4


def with_segments(rows: DataFrame, ttl: float) -> DataFrame:
    """Rows of frames with ``_segment``: a new one begins with the first detection behind a pause that no track outlives, that is, one with an empty frame more than ``ttl`` after the last detection.

    Pauses are looked for between blocks of time, so that a row for each block is sorted by stream, not one for each frame; a pause within a block is no cut.
    """
    block = F.floor(F.col("timestamp") / (BLOCK_TTLS * ttl)).cast("long")
    marked = rows.withColumn("_block", block)
    spans = marked.groupBy("stream_id", "run_id", "_block").agg(F.max("timestamp").alias("_frame"), F.max(F.when(F.col("score").isNotNull(), F.col("timestamp"))).alias("_seen"))
    order = Window.partitionBy("stream_id", "run_id").orderBy("_block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("_seen").isNotNull() & (F.max("_frame").over(past) - F.max("_seen").over(past) > ttl)
    spans = spans.withColumn("_new", F.coalesce(new, F.lit(False)).cast("long"))
    spans = spans.select(F.col("stream_id").alias("_s"), F.col("run_id").alias("_r"), F.col("_block").alias("_b"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_segment"))
    same = F.col("stream_id").eqNullSafe(F.col("_s")) & F.col("run_id").eqNullSafe(F.col("_r")) & F.col("_block").eqNullSafe(F.col("_b"))
    return marked.join(spans, same).drop("_s", "_r", "_b", "_block")


def renumbered(tracked: DataFrame) -> DataFrame:
    """Tracks of segments numbered as in one pass: each segment's go on behind those of the segments before. Every track ends with a row, so a segment's last number is how many it has."""
    keys = ["stream_id", "run_id"]
    births = tracked.where("done").groupBy(*keys, "_segment").agg(F.max("track_id").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_segment")) - F.col("_n")
    known = births.select(F.col("stream_id").alias("_s"), F.col("run_id").alias("_r"), F.col("_segment").alias("_g"), before.alias("_before")).where("_before > 0")
    same = F.col("stream_id").eqNullSafe(F.col("_s")) & F.col("run_id").eqNullSafe(F.col("_r")) & (F.col("_segment") == F.col("_g"))
    return tracked.join(known, same, "left").withColumn("track_id", F.col("track_id") + F.coalesce("_before", F.lit(0))).select(COLUMNS)


def track(detections: DataFrame, frames: DataFrame | None = None, config: Config = Config(), every_frame: bool = True, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of live tracks frame by frame (left out unless ``every_frame``), and a row with ``done`` when one finishes (all do, at the latest after the last frame).

    ``frames`` (stream_id, run_id, frame_index, timestamp) brings in frames without detections. One task follows a stream and run from its first frame
    to its last, as every frame's outcome hangs on the one before; it keeps the tracker and a batch, so a stream may be of any length.
    With ``save``, which writes a table and reads it back, streams are cut at pauses and their segments followed side by side, with the same rows and numbers; the
    tracker's rows are written before they are numbered, so that they are made once. Timestamps must grow with the frames then.
    """
    cols = ["stream_id", "run_id", "frame_index", "timestamp", "det_idx", *BOX, "score", "vehicle_class"]
    rows = detections.select(cols)
    if frames is not None:
        clock = frames.select("stream_id", "run_id", "frame_index", "timestamp")
        rows = clock.join(rows.drop("timestamp"), ["stream_id", "run_id", "frame_index"], "left").select(cols)
    keys = ["stream_id", "run_id"]
    if save is not None:
        rows, keys = with_segments(rows, config.lost_ttl), [*keys, "_segment"]
    dealt = by_key(rows, keys, 4) if save is not None else by_few_keys(rows, keys, rows if frames is None else clock, 4)
    ordered = dealt.sortWithinPartitions(*keys, "frame_index", "timestamp", "det_idx")
    tracked = ordered.mapInPandas(_follow_all(config, every_frame, keys), ROWS if save is None else f"{ROWS}, _segment long")
    return tracked if save is None else renumbered(save(tracked))


def live_rows(tracked: DataFrame) -> DataFrame:
    return tracked.where("not done").select(*[c.split()[0] for c in TRACK_FRAMES.split(", ")])


def finished(tracked: DataFrame) -> DataFrame:
    return tracked.where("done").select(*[c.split()[0] for c in FINISHED.split(", ")])


def carried(points: DataFrame, frames: DataFrame, block: int | None = None) -> DataFrame:
    """Matched points spread over their stream's frames from the first to the last: between matches a track stands where it was, lost (a backward as-of join by ``last``).

    Frames and tracks meet by blocks of frames, so a track meets the frames of its own span and at most a block more at either end, not all frames of its stream. ``block`` is a quarter of the
    mean span unless given, so that these are half of the rows at most.
    """
    key = ["stream_id", "run_id"]
    span = points.groupBy(*key, "track_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"))
    if block is None:
        mean = span.agg(F.avg(F.col("b") - F.col("a"))).first()[0]
        block = max(1, int((mean or 0) / 4))
    at = lambda c: F.floor(F.col(c) / block).cast("long")
    parts = span.withColumn("_block", F.explode(F.sequence(at("a"), at("b"))))
    clock = frames.select(*key, "frame_index", "timestamp").withColumn("_block", at("frame_index"))
    grid = parts.join(clock, [*key, "_block"]).where("frame_index between a and b").drop("a", "b", "_block")
    rows = grid.join(points.drop("timestamp").withColumn("_hit", F.lit(True)), [*key, "track_id", "frame_index"], "left")
    past = Window.partitionBy(*key, "track_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("matched", F.coalesce("_hit", F.lit(False))).withColumn("state", F.when(F.col("_hit"), F.coalesce("state", F.lit("active"))).otherwise("lost"))
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in (*BOX, "vehicle_class")}).drop("_hit")
