"""Line crossings, zone visits and motion on streams of track rows (those of ``tracking.track`` or of the tracking stream).

Geometry is worked out by the same columns as in tables, in joins of the stream with the configuration (broadcast: adaptive execution, which would see its size, is off here, and a shuffle by stream has few keys); what a track carries from row to row is one value of state in the
RocksDB store, keyed by (stream, run, track): the anchor and side for each line, the open visit of each zone, a ring of grounded points. A track's last row
(``done``) ends its visits and clears all its state. Rows at or before the last frame that a track has seen are late: they are dropped and counted in ``late``.
With ``idle_ms`` a track that stays silent for so long is forgotten, and the last frame of a finished one is remembered for so long, so rows that come after its end are late too;
without it they would begin a new track. The running count of a line is a second stateful operator behind the first.
"""

from __future__ import annotations

import math
import pickle
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import PARALLEL
from ..operators import lines as L
from ..operators import motion as M
from ..operators import zones as Z

KEY = "stream_id string, run_id string, track_id long"
TRACK = L.TRACK


class TrackState(StatefulProcessor):
    """What the three have in common: order within a batch, late rows, the end of a track and silence. A subclass takes rows in and says what its columns are."""

    COLUMNS: list[str] = []

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms
        self.fields: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each call for state is a round trip: (last frame, timer, what the track carries)
        self.held = handle.getValueState("held", "blob binary")
        self.row, self.result = namedtuple("Row_", self.fields), Row(*TRACK, *self.COLUMNS, "late")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = [self.row._make(r) for packed in rows for r in pickle.loads(packed.blob)]
        rows.sort(key=lambda r: (r.frame_index, r.done, r.part is None, 0 if r.part is None else r.part))
        last, timer, carried = pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else (-1, -1, {})
        fresh = [r for r in rows if r.done or r.frame_index > last]
        late = len(rows) - len(fresh)
        out = self.follow(carried, [r for r in fresh if not r.done])
        ends = [r for r in fresh if r.done]
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if ends:
            out += self.finish(carried, ends[-1])
            carried = {}
        if ends and not self.idle_ms:
            self.held.clear()
        elif fresh or timer >= 0:
            timer = -1
            if self.idle_ms:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(timer)
            self.held.update((pickle.dumps((max(last, fresh[-1].frame_index) if fresh else last, timer, carried)),))
        table = [self.result(*key, *r, 0) for r in out]
        if late:
            table.append(self.result(*key, *[None] * len(self.COLUMNS), late))
        return iter(table)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass

    def follow(self, carried: dict, rows: list) -> list[tuple]:
        """What live rows, in order, make; ``carried`` is what the track brought along, and takes what it carries on."""
        raise NotImplementedError

    def finish(self, carried: dict, row) -> list[tuple]:
        return []


def _ends(tracked: DataFrame, like: DataFrame) -> DataFrame:
    """``like`` with the last rows of tracks, which are attached to nothing."""
    ends = tracked.where("done").select(*TRACK, "frame_index", "timestamp", "vehicle_class")
    return like.withColumn("done", F.lit(False)).unionByName(ends.withColumn("done", F.lit(True)), allowMissingColumns=True)


def _packed(rows: DataFrame) -> DataFrame:
    """A row (TRACK, blob) for the rows that a track has in an Arrow batch; what is behind the shuffle then reads one value for them all."""
    keys = len(TRACK)

    def pack(batches):
        for b in batches:
            tracks: dict[tuple, list[tuple]] = {}
            for r in zip(*[c.to_pylist() for c in b.columns]):
                tracks.setdefault(r[:keys], []).append(r[keys:])
            made = [[k[i] for k in tracks] for i in range(keys)]
            blobs = [pickle.dumps(own) for own in tracks.values()]
            yield pa.RecordBatch.from_arrays([*[pa.array(m, b.schema.field(i).type) for i, m in enumerate(made)], pa.array(blobs, pa.binary())], names=[*TRACK, "blob"])

    return rows.select(*TRACK, *[c for c in rows.columns if c not in TRACK]).mapInArrow(pack, f"{KEY}, blob binary")


def _run(rows: DataFrame, processor: TrackState, columns: str) -> DataFrame:
    """Numbers that are not there are NaN in the processor."""
    mode = "processingTime" if processor.idle_ms else "none"
    doubles = lambda df, f: df.select(*[f(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])
    rows = doubles(rows.withColumn("track_id", F.col("track_id").cast("long")), lambda c: F.coalesce(c, F.lit(math.nan)))
    processor.fields = [c for c in rows.columns if c not in TRACK]
    out = _packed(rows).groupBy(*TRACK).transformWithState(processor, f"{KEY}, {columns}, late int", "append", mode)
    return doubles(out, lambda c: F.nanvl(c, F.lit(None).cast("double")))


# --- lines ------------------------------------------------------------------------------------------------------

CROSSED = "frame_index long, timestamp double, vehicle_class string, line_id string, name string, ord int, direction string, direction_canonical string"


class CrossingProcessor(TrackState):
    COLUMNS = [c.split()[0] for c in CROSSED.split(", ")]

    def follow(self, carried: dict, rows: list) -> list[tuple]:
        out = []
        for r in rows:
            here = _sign(r.side)
            if r.line_id not in carried:
                carried[r.line_id] = (r.x, r.y, here, int(here != 0), False)
                continue
            px, py, side, spent, crossed = carried[r.line_id]
            way = _way(r, px, py)
            if way and (not crossed or spent >= L.SETTLED):
                crossed = True
                out.append((r.frame_index, r.timestamp, r.vehicle_class, r.line_id, r.name, r.ord, r.forward_label if way > 0 else r.backward_label, "forward" if way > 0 else "backward"))
            if here:  # a row on the line keeps the side
                side, spent = here, spent + 1 if here == side else 1
            carried[r.line_id] = (r.x, r.y, side, spent, crossed)
        return out


def _sign(v: float) -> int:
    return (v > 0) - (v < 0)


def _way(r, px: float, py: float) -> int:
    """As ``geometry.crossing``, from the side of the point before."""
    sx, sy = r.bx - r.ax, r.by - r.ay
    before = sx * (py - r.ay) - sy * (px - r.ax)
    way = 1 if before < 0 <= r.side else -1 if before > 0 >= r.side else 0
    rx, ry = r.x - px, r.y - py
    cross = rx * sy - ry * sx
    if not way or abs(cross) < PARALLEL:
        return 0
    qx, qy = r.ax - px, r.ay - py
    return way if 0 <= (qx * sy - qy * sx) / cross <= 1 and 0 <= (qx * ry - qy * rx) / cross <= 1 else 0


class CountProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["frame_index", "track_id"], kind="stable")
        n = self.total.get()[0] if self.total.exists() else 0
        pdf["count"] = range(n + 1, n + 1 + len(pdf))
        self.total.update((n + len(pdf),))
        yield pdf[[*TRACK, *CrossingProcessor.COLUMNS, "late", "count"]]

    def close(self) -> None:
        pass


def crossings(tracked: DataFrame, lines: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The stream form of ``lines.crossings``, with the running count of each line and direction; rows that only count late ones have no line.

    Counts follow the frames if batches do; within a batch they go by frame and track.
    """
    live = L.attach(tracked.where("not done"), F.broadcast(lines))
    line = {k: F.col(k) for k in ("ax", "ay", "bx", "by")}
    cols = [*TRACK, "frame_index", "timestamp", "vehicle_class", F.col("line_id"), "name", "ord", "forward_label", "backward_label", *line, "x", "y", L.G.side(line, F.col("x"), F.col("y")).alias("side")]
    rows = _ends(tracked, live.select(cols)).withColumn("part", F.col("line_id"))
    found = _run(rows, CrossingProcessor(idle_ms), CROSSED)
    return found.groupBy("stream_id", "run_id", "line_id", "direction_canonical").transformWithStateInPandas(CountProcessor(), f"{KEY}, {CROSSED}, late int, count long", "append", "processingTime" if idle_ms else "none")


# --- zones ------------------------------------------------------------------------------------------------------

VISITED = "kind string, zone_id string, name string, ord int, visit long, frame_index long, timestamp double, vehicle_class string, entered_frame long, entered double, dwell_s double"


class ZoneProcessor(TrackState):
    COLUMNS = [c.split()[0] for c in VISITED.split(", ")]

    def follow(self, carried: dict, rows: list) -> list[tuple]:
        out = []
        for r in rows:
            _, _, visit, inside, frame, entered, alerted = carried.get(r.zone_id, (None, None, 0, False, 0, 0.0, False))
            event = None
            if r.inside and not inside:
                visit, frame, entered, alerted = visit + 1, r.frame_index, r.timestamp, False
                event, dwell = "entered", None
            elif r.inside and not alerted and r.timestamp - entered >= r.dwell_alert_s:
                event, dwell, alerted = "dwell", r.timestamp - entered, True
            elif inside and not r.inside:
                event, dwell = "exited", max(0.0, r.timestamp - entered)
            if event:
                out.append((event, r.zone_id, r.name, r.ord, visit, r.frame_index, r.timestamp, r.vehicle_class, frame, entered, dwell))
            carried[r.zone_id] = (r.name, r.ord, visit, bool(r.inside), frame, entered, alerted)
        return out

    def finish(self, carried: dict, row) -> list[tuple]:
        out = []
        for zone, (name, ord_, visit, inside, frame, entered, _) in carried.items():
            if inside:
                out.append(("finished", zone, name, ord_, visit, row.frame_index, row.timestamp, row.vehicle_class, frame, entered, max(0.0, row.timestamp - entered)))
        return out


def visits(tracked: DataFrame, zones: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The stream form of ``zones.visits``, as the events of a visit: ``kind`` is entered, dwell (once a visit), exited, or finished for one that the track's end closes."""
    live = Z.inside(tracked.where("not done"), F.broadcast(zones))
    cols = [*TRACK, "frame_index", "timestamp", "vehicle_class", "zone_id", "name", "ord", "dwell_alert_s", "inside"]
    rows = _ends(tracked, live.select(cols)).withColumn("part", F.col("zone_id"))
    return _run(rows, ZoneProcessor(idle_ms), VISITED)


def visit_rows(events: DataFrame) -> DataFrame:
    """A row for each visit of a table of such events, as ``zones.visits`` has it."""
    at = lambda kinds, c: F.max(F.when(F.col("kind").isin(kinds), F.col(c)))
    over = ["exited", "finished"]
    return events.where("kind is not null").groupBy(*TRACK, "zone_id", "name", "ord", "visit").agg(
        at(["entered"], "vehicle_class").alias("vehicle_class"), F.min("entered_frame").alias("entered_frame"), F.min("entered").alias("entered"), at(over, "frame_index").alias("exited_frame"),
        at(over, "timestamp").alias("exited"), at(over, "dwell_s").alias("dwell_s"), at(over, "vehicle_class").alias("exit_class"), (F.count_if(F.col("kind") == "exited") == 0).alias("by_finish"),
        at(["dwell"], "timestamp").alias("alert_timestamp"), at(["dwell"], "frame_index").alias("alert_frame"),
    )


# --- motion -----------------------------------------------------------------------------------------------------

MOVED = "frame_index long, timestamp double, vehicle_class string, speed_kmh double, max_speed_kmh double, direction_deg double, distance_m double, limit_kmh double, speeding boolean"


class MotionProcessor(TrackState):
    COLUMNS = [c.split()[0] for c in MOVED.split(", ")]

    def __init__(self, window_s: float, min_track_s: float, max_history: int, alpha: float, idle_ms: int = 0):
        super().__init__(idle_ms)
        self.window_s, self.min_track_s, self.max_history, self.alpha = window_s, min_track_s, max_history, alpha

    def follow(self, carried: dict, rows: list) -> list[tuple]:
        ring, state = carried.get("ring", []), carried.get("state")
        out = []
        for r in rows:
            if state is None:
                state = (r.timestamp, 0, None, None, None, r.gx, r.gy, 0.0, None)
            born, n, speed, top, way, ax, ay, distance, fired = state
            if (step := math.hypot(r.gx - ax, r.gy - ay)) >= M.ANCHOR_M:
                ax, ay, distance = r.gx, r.gy, distance + step
            ring = [p for p in ring if p[3] > n - self.max_history]
            goal = r.timestamp - self.window_s
            if r.timestamp - born >= self.min_track_s and ring and ring[-1][0] >= goal:
                t, x, y, _ = min(ring, key=lambda p: abs(p[0] - goal))
                dt, dx, dy = r.timestamp - t, r.gx - x, r.gy - y
                if dt > 1e-6:
                    moved = math.hypot(dx, dy)
                    raw = moved / dt * 3.6
                    speed = raw if speed is None else self.alpha * raw + (1 - self.alpha) * speed
                    top = speed if top is None else max(top, speed)
                    way = math.degrees(math.atan2(dy, dx)) % 360.0 if moved >= M.MOVED_M else way
            limit = None if math.isnan(r.limit_kmh) else r.limit_kmh
            speeding = limit is not None and speed is not None and speed > limit and (fired is None or r.timestamp - fired >= M.REPEAT_S)
            fired = r.timestamp if speeding else fired
            out.append((r.frame_index, r.timestamp, r.vehicle_class, speed, top, way, distance, limit, speeding))
            # behind the window only its nearest point can still be a reference
            ring.append((r.timestamp, r.gx, r.gy, n))
            old = [i for i, p in enumerate(ring) if p[0] <= goal]
            ring = ring[old[-1] :] if old else ring
            state = (born, n + 1, speed, top, way, ax, ay, distance, fired)
        carried["ring"], carried["state"] = ring, state
        return out


def motion(tracked: DataFrame, calibrations: DataFrame, limits: DataFrame, window_s: float = M.WINDOW_S, min_track_s: float = M.MIN_TRACK_S, max_history: int = 600, alpha: float = M.ALPHA, idle_ms: int = 0) -> DataFrame:
    """The stream form of ``motion.velocity``, ``smooth``, ``distance`` and ``speeding``: a row for each grounded point with speed, greatest speed, heading and distance so far, and whether it is a speeding event.

    The ring keeps the window and one point behind it, ``max_history`` points at most. Streams without a limit are never speeding.
    """
    live = M.ground(tracked.where("not done and matched"), F.broadcast(calibrations)).join(F.broadcast(limits.select("stream_id", "limit_kmh")), "stream_id", "left")
    rows = _ends(tracked, live.select(*TRACK, "frame_index", "timestamp", "vehicle_class", "gx", "gy", "limit_kmh")).withColumn("part", F.lit(0))
    return _run(rows, MotionProcessor(window_s, min_track_s, max_history, alpha, idle_ms), MOVED)


# --- lives ------------------------------------------------------------------------------------------------------

LIVED = "kind string, frame_index long, timestamp double, vehicle_class string, duration_s double, n_points long"


class LifeProcessor(TrackState):
    COLUMNS = [c.split()[0] for c in LIVED.split(", ")]

    def __init__(self, max_history: int, idle_ms: int = 0):
        super().__init__(idle_ms)
        self.max_history = max_history

    def follow(self, carried: dict, rows: list) -> list[tuple]:
        first, last, hits, started = carried.get("life", (0.0, 0.0, 0, False))
        out = []
        for r in rows:
            if r.matched:
                first, last, hits = r.timestamp if not hits else first, r.timestamp, hits + 1
            if r.state == "active" and not started:
                started = True
                out.append(("started", r.frame_index, r.timestamp, r.vehicle_class, None, None))
        carried["life"] = (first, last, hits, started)
        return out

    def finish(self, carried: dict, row) -> list[tuple]:
        first, last, hits, _ = carried.get("life", (0.0, 0.0, 0, False))
        return [("finished", row.frame_index, row.timestamp, row.vehicle_class, last - first, min(hits, self.max_history))]


def lives(tracked: DataFrame, max_history: int = 600, idle_ms: int = 0) -> DataFrame:
    """When tracks start (their first active row) and finish, with their duration and number of points."""
    live = tracked.where("not done").select(*TRACK, "frame_index", "timestamp", "vehicle_class", "state", "matched")
    return _run(_ends(tracked, live).withColumn("part", F.lit(0)), LifeProcessor(max_history, idle_ms), LIVED)


# --- cooldown ---------------------------------------------------------------------------------------------------


class CooldownProcessor(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["timestamp", "frame_index", "phase", "geom_ord", "id"], kind="stable").reset_index(drop=True)
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for i, (t, gap) in enumerate(zip(pdf["timestamp"], pdf["cooldown_s"])):
            if last is None or t - last >= gap:
                last = float(t)
                kept.append(i)
        if last is not None:
            self.last.update((last,))
        yield pdf.loc[kept, self.columns]

    def close(self) -> None:
        pass


def cooled(hits: DataFrame) -> DataFrame:
    """Rule hits (from ``rules.hits``, flat columns) that come a cooldown or more after the last one kept of their stream, run, rule and track, across batches."""
    return hits.groupBy("stream_id", "run_id", "rule_id", "track_id").transformWithStateInPandas(CooldownProcessor(hits.columns), hits.schema, "append", "none")
