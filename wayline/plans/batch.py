"""The whole job over a table of detections: tracks, motion, lines, zones, plates, events and rules, lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import attributes, events, lines, motion, plates, rules, tracking, zones
from ..sources import exports


@dataclass
class Dimensions:
    """Configuration tables; all small. ``limits`` (stream_id, limit_kmh), ``rule_list`` as in ``rules.fire``."""

    lines: DataFrame
    zones: DataFrame
    calibrations: DataFrame
    limits: DataFrame
    rule_list: list[dict] = field(default_factory=list)
    watchlists: DataFrame | None = None
    country: str | None = "TR"
    plate_min_reads: int = 2
    plate_gates: dict = field(default_factory=dict)


def run_batch(detections: DataFrame, frames: DataFrame, dims: Dimensions, config: tracking.Config = tracking.Config(), plate_reads: DataFrame | None = None, observations: DataFrame | None = None, save=None) -> dict[str, DataFrame]:
    """The result bundle (totals, tracks, events, event_counts) and the tables on the way.

    Everything after tracking is keyed by (stream, run, track), so its shuffles spread over tracks. The tracker's rows, the gated plate reads and the primitive events feed
    several branches: pass a ``save`` that writes and rereads them (``sources.scratch.saved``), so that each is made once; tracking then is one task per segment of a stream between pauses, else one per stream and run.
    ``plate_reads``: plate boxes as read, (stream_id, run_id, frame_index, det_idx, x1, y1, x2, y2, score, text, conf); those with a track_id are taken as assigned.
    Rule events carry the payload that set them off in ``trigger_data``.
    """
    tracked = tracking.track(detections, frames, config, save=save)
    save = save or (lambda df: df)
    live, done = tracking.live_rows(tracked), tracking.finished(tracked)
    points = live.where("matched")
    grounded = motion.ground(points, dims.calibrations)
    moving = motion.smooth(motion.velocity(grounded, max_history=config.max_history))
    crossed = lines.crossings(live, dims.lines)
    visits = zones.visits(live, dims.zones, done)
    over = motion.speeding(moving, dims.limits)
    parts = [events.from_speeding(over), events.started(live), events.from_crossings(crossed), events.from_visits(visits)]
    best = None
    if plate_reads is not None:
        own = plate_reads if "track_id" in plate_reads.columns else plates.assign(plate_reads, live.where("state = 'active'"))
        state = live.select(*lines.TRACK, "frame_index", "timestamp", "state", "vehicle_class")
        own = own.drop("state", "timestamp", "vehicle_class").join(state, [*lines.TRACK, "frame_index"])
        if "width" not in own.columns:
            own = own.join(frames.select("stream_id", "run_id", "frame_index", "width", "height"), ["stream_id", "run_id", "frame_index"])
        reads = save(plates.gates(own, country=dims.country, **dims.plate_gates).withColumn("seq", F.struct("frame_index", "det_idx")).withColumn("seq", F.row_number().over(Window.partitionBy(*lines.TRACK).orderBy("seq")).cast("long")))
        moment = reads.select(*lines.TRACK, "seq", "frame_index", "timestamp", "vehicle_class")
        given = plates.settled(reads, dims.country, dims.plate_min_reads).join(moment, [*lines.TRACK, "seq"])
        parts.append(events.from_plates(given))
        best = plates.last_given(given)
        if dims.watchlists is not None:
            parts.append(events.from_hits(plates.watchlist_hits(given, dims.watchlists).join(moment, [*lines.TRACK, "seq"])))
    attrs = attributes.as_map(attributes.fuse(observations)) if observations is not None else None
    clock = frames.select("stream_id", "run_id", "frame_index", "wall_ts") if "wall_ts" in frames.columns else None
    summaries = events.summaries(done, points, moving, motion.distance(grounded), best, attrs, clock, config.max_history)
    primitive = save(events.union(*parts, events.from_summaries(summaries)))
    state = live.join(moving.select(*lines.TRACK, "frame_index", "speed_kmh"), [*lines.TRACK, "frame_index"], "left")
    allowed = rules.relevant(dims.rule_list, dims.lines, dims.zones, frames.select("stream_id"))
    fired = rules.fire(rules.with_state(primitive, state, visits), dims.rule_list, allowed) if dims.rule_list else None
    every = events.union(primitive, fired) if fired is not None else primitive
    return exports.bundle(frames, every, summaries) | {"track_frames": live, "moving": moving, "crossings": crossed, "visits": visits, "line_counts": lines.counts(crossed, dims.lines)}
