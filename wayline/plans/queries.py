"""The library's own queries and their SQL. Names begin with the operator's place in the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G
from ..functions import plates as P
from ..functions import text as T
from ..operators import annotations, attributes, calibration, config_checks, detections, events, lines, metrics, motion, plates, rules, sampling, tracking, zones
from ..operators.folds import spaced
from ..sources import exports, readers, store
from ..sources.scratch import fresh_path, saved
from ..streaming import processors
from ..streaming import trajectories as stream
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- line counting -----------------------------------------------------------------------------------------------

_CROSS = f"""with {D.trajectory_sql()}, {D.LINES_SQL},
sided as (select *, sign(0.0 * (y - 200.0) - (0.0 - 200.0) * (x - lx))::int as s, lag(x) over w as px, lag(y) over w as py from attached window w as (partition by track_id, line_id order by frame_index)),
held as (select *, last_value(nullif(s, 0) ignore nulls) over (partition by track_id, line_id order by frame_index rows between unbounded preceding and 1 preceding) as hold,
  case when px is null then 0 when px < lx and x >= lx and 200.0 - (py + (y - py) * (lx - px) / (x - px)) between 0 and 200 then 1 when px > lx and x <= lx and 200.0 - (py + (y - py) * (lx - px) / (x - px)) between 0 and 200 then -1 else 0 end as way from sided),
stays as (select *, sum((s <> 0 and hold is not null and s <> hold)::int) over (partition by track_id, line_id order by frame_index) as stay from held),
spent as (select *, sum((s <> 0)::int) over (partition by track_id, line_id, stay order by frame_index) as spent from stays),
gone as (select *, lag(spent) over (partition by track_id, line_id order by frame_index) as gone, coalesce(max((way <> 0)::int) over (partition by track_id, line_id order by frame_index rows between unbounded preceding and 1 preceding), 0) as before from spent),
crossed as (select *, case when way > 0 then forward_label else backward_label end as direction, case when way > 0 then 'forward' else 'backward' end as canonical from gone where way <> 0 and (before = 0 or gone >= 2))
"""


def _crossed(spark, sf):
    return lines.crossings(D.trajectories(spark, sf), D.lines(spark))


@query(_CROSS + "select stream_id, line_id, direction, vehicle_class, count(*) as n from crossed group by all")
def a01_line_counts(spark, sf):
    return lines.counts(_crossed(spark, sf))


@query(_CROSS + "select line_id, direction, vehicle_class, count(*) as n from crossed group by rollup(line_id, direction, vehicle_class) having line_id is not null")
def a01_line_totals(spark, sf):
    return lines.totals(_crossed(spark, sf)).drop("level")


@query(_CROSS + "select stream_id, track_id, frame_index, line_id, direction, canonical as direction_canonical, count(*) over (partition by stream_id, line_id, canonical order by frame_index, track_id rows unbounded preceding) as count from crossed")
def w01_line_crossings(spark, sf):
    return _crossed(spark, sf).select("stream_id", "track_id", "frame_index", "line_id", "direction", "direction_canonical", "count")


@query(f"""with {D.trajectory_sql()} select track_id, frame_index, round(0.0 * (y - 200.0) - (0.0 - 200.0) * (x - 100.0), 6) as side from traj""")
def p11_line_side(spark, sf):
    t = D.trajectories(spark, sf)
    line = {"ax": F.lit(100.0), "ay": F.lit(200.0), "bx": F.lit(100.0), "by": F.lit(0.0)}
    return t.select("track_id", "frame_index", r6(G.side(line, (F.col("x1") + F.col("x2")) / 2, F.col("y2"))).alias("side"))


# --- zones -------------------------------------------------------------------------------------------------------

_VISITS = f"with {D.trajectory_sql()}, {D.ZONES_SQL} "


def _visits(spark, sf):
    return zones.visits(D.trajectories(spark, sf), D.zones(spark))


@query(_VISITS + "select stream_id, track_id, zone_id, visit, entered_frame, round(entered, 6) as entered, round(exited, 6) as exited, case when exited is not null then round(greatest(0, exited - entered), 6) end as dwell_s from visits")
def w03_zone_visits(spark, sf):
    return _visits(spark, sf).select("stream_id", "track_id", "zone_id", "visit", "entered_frame", r6("entered").alias("entered"), r6("exited").alias("exited"), r6("dwell_s").alias("dwell_s"))


@query(_VISITS + "select track_id, zone_id, visit, round(alert, 6) as alert from visits where alert is not null")
def w04_dwell_alerts(spark, sf):
    return _visits(spark, sf).where("alert_timestamp is not null").select("track_id", "zone_id", "visit", r6("alert_timestamp").alias("alert"))


@query(_VISITS + "select stream_id, zone_id, count(*) filter (entered <= 2.05 and (exited is null or exited > 2.05)) as occupancy, count(*) as visits from visits group by all")
def a02_zone_occupancy(spark, sf):
    return zones.occupancy(_visits(spark, sf), 2.05)


@query(_VISITS + "select stream_id, zone_id, frame_index, count(*) filter (hit) as occupancy from inside group by all")
def a03_overlay_occupancy(spark, sf):
    return zones.overlay_occupancy(D.trajectories(spark, sf), D.zones(spark)).drop("run_id")


@query(f"with {D.trajectory_sql()}, {D.ZONES_SQL} select track_id, frame_index, zone_id, hit from inside")
def p13_point_in_polygon(spark, sf):
    return zones.inside(D.trajectories(spark, sf), D.zones(spark)).select("track_id", "frame_index", "zone_id", F.col("inside").alias("hit"))


@query("select 'box' as zone_id, 100.0::double as cx, 115.0::double as cy, count(distinct 'cam' || (user_id % 8)) as streams from events union all select 'wedge', 100.0, round(350.0 / 3, 6), count(distinct 'cam' || (user_id % 8)) from events")
def p14_centroid(spark, sf):
    cx, cy = G.centroid(F.col("points"))
    used = D.trajectories(spark, sf).select("stream_id").distinct()
    return D.zones(spark).join(used, "stream_id").groupBy("zone_id", r6(cx).alias("cx"), r6(cy).alias("cy")).agg(F.count("*").alias("streams"))


# --- motion ------------------------------------------------------------------------------------------------------

_GROUND = f"with {D.trajectory_sql('drift')}, ground as (select *, x * 0.1::double as gx, y * 0.1::double as gy from traj where stream_id not in ('cam6', 'cam7'))"
_SPEED = _GROUND + """,
refs as (select g.*, first_value(timestamp) over (partition by track_id order by frame_index) as born, lag(timestamp) over (partition by track_id order by frame_index) as prev from ground g),
cand as (select a.track_id, a.frame_index, min_by({'t': b.timestamp, 'gx': b.gx, 'gy': b.gy}, {'d': abs(b.timestamp - (a.timestamp - 1.0::double)), 't': b.timestamp}) as ref
  from refs a join ground b on a.track_id = b.track_id and b.timestamp < a.timestamp and b.frame_index between a.frame_index - 20 and a.frame_index group by all),
vel as (select r.*, c.ref, case when r.timestamp - born >= 0.7::double and prev >= r.timestamp - 1.0::double and r.timestamp - c.ref.t > 1e-6 then sqrt((r.gx - c.ref.gx) ** 2 + (r.gy - c.ref.gy) ** 2) / (r.timestamp - c.ref.t) * 3.6::double end as raw,
  case when r.timestamp - born >= 0.7::double and prev >= r.timestamp - 1.0::double then sqrt((r.gx - c.ref.gx) ** 2 + (r.gy - c.ref.gy) ** 2) end as moved from refs r left join cand c using (track_id, frame_index)),
ordered as (select *, row_number() over (partition by track_id order by frame_index) as n from vel)"""
_EMA = _SPEED.replace("with", "with recursive", 1) + """,
ema as (select track_id, frame_index, n, raw as v from ordered where n = 1
  union all select o.track_id, o.frame_index, o.n, case when o.raw is null then e.v when e.v is null then o.raw else 0.35::double * o.raw + 0.65::double * e.v end from ema e join ordered o on o.track_id = e.track_id and o.n = e.n + 1)"""


def _grounded(spark, sf):
    return motion.ground(D.trajectories(spark, sf, "drift"), D.calibrations(spark))


def _moving(spark, sf):
    return motion.smooth(motion.velocity(_grounded(spark, sf)))


@query(_GROUND + " select track_id, frame_index, round(gx, 6) as gx, round(gy, 6) as gy from ground")
def p15_ground(spark, sf):
    return _grounded(spark, sf).select("track_id", "frame_index", r6("gx").alias("gx"), r6("gy").alias("gy"))


@query(_GROUND + " select track_id, frame_index, round(gx * 10, 6) as ix, round(gy * 10, 6) as iy from ground")
def p16_back_projection(spark, sf):
    g = _grounded(spark, sf).join(D.calibrations(spark).select("stream_id", "inverse"), "stream_id")
    x, y = G.project(F.col("inverse"), F.col("gx"), F.col("gy"))
    return g.select("track_id", "frame_index", r6(x).alias("ix"), r6(y).alias("iy"))


@query(_SPEED + " select track_id, frame_index, round(raw, 4) as raw_kmh, round(moved, 4) as moved_m from vel")
def w05_velocity(spark, sf):
    return motion.velocity(_grounded(spark, sf)).select("track_id", "frame_index", F.round("raw_kmh", 4).alias("raw_kmh"), F.round("moved_m", 4).alias("moved_m"))


@query(_EMA + " select track_id, frame_index, round(v, 4) as speed_kmh, round(max(v) over (partition by track_id order by frame_index), 4) as max_speed_kmh from ema")
def w06_speed(spark, sf):
    return _moving(spark, sf).select("track_id", "frame_index", F.round("speed_kmh", 4).alias("speed_kmh"), F.round("max_speed_kmh", 4).alias("max_speed_kmh"))


@query(_SPEED + """ select track_id, frame_index, round(last_value(case when moved >= 0.05 then (degrees(atan2(gy - ref.gy, gx - ref.gx)) + 360) % 360 end ignore nulls) over (partition by track_id order by frame_index), 3) as direction_deg from vel""")
def w08_heading(spark, sf):
    return _moving(spark, sf).select("track_id", "frame_index", F.round("direction_deg", 3).alias("direction_deg"))


@query(_GROUND.replace("with", "with recursive", 1) + """, o as (select *, row_number() over (partition by track_id order by frame_index) as n from ground),
walk as (select track_id, n, gx as ax, gy as ay, 0.0::double as d from o where n = 1
  union all select o.track_id, o.n, case when h >= 0.15 then gx else ax end, case when h >= 0.15 then gy else ay end, case when h >= 0.15 then d + h else d end
  from (select o.*, w.ax, w.ay, w.d, sqrt((o.gx - w.ax) ** 2 + (o.gy - w.ay) ** 2) as h from walk w join o on o.track_id = w.track_id and o.n = w.n + 1) o)
select track_id, round(max(d), 4) as distance_m from walk group by all""")
def w09_distance(spark, sf):
    return motion.distance(_grounded(spark, sf)).select("track_id", F.round("distance_m", 4).alias("distance_m"))


@query(_EMA.replace("with recursive", "with recursive", 1) + """, over_ as (select e.track_id, o.timestamp, e.v, o.frame_index, row_number() over (partition by e.track_id order by o.frame_index) as k from ema e join ordered o on o.track_id = e.track_id and o.n = e.n where e.v > 70),
fire as (select track_id, k, timestamp as last, true as fired, v, frame_index from over_ where k = 1
  union all select o.track_id, o.k, case when o.timestamp - f.last >= 30 then o.timestamp else f.last end, o.timestamp - f.last >= 30, o.v, o.frame_index from fire f join over_ o on o.track_id = f.track_id and o.k = f.k + 1)
select track_id, frame_index, round_even(v, 1) as speed_kmh from fire where fired""")
def w10_speeding(spark, sf):
    limits = spark.createDataFrame([(s, 70.0) for s in D.STREAMS], "stream_id string, limit_kmh double")
    return motion.speeding(_moving(spark, sf), limits).select("track_id", "frame_index", "speed_kmh")


@query(f"with {D.trajectory_sql()}, n as (select *, row_number() over (partition by track_id order by frame_index desc) as back from traj) select track_id, count(*) as n_points, min(frame_index) as oldest from n where back <= 50 group by all")
def w17_history_trim(spark, sf):
    t = D.trajectories(spark, sf)
    w = F.row_number().over(lines.Window.partitionBy("track_id").orderBy(F.desc("frame_index")))
    return t.withColumn("back", w).where("back <= 50").groupBy("track_id").agg(F.count("*").alias("n_points"), F.min("frame_index").alias("oldest"))


@query("""with p as (select c_custkey as k, 'cam' || (c_custkey % 8) as stream_id, (c_custkey * 7 % 100)::double as gx, (c_custkey * 13 % 100)::double as gy, (c_custkey % 3)::double as e from customer where c_custkey % 8 < 6)
select stream_id, round(avg(sqrt(e * e)), 6) as mean_error_px, round(max(e), 6) as max_error_px, count(*) as points, avg(sqrt(e * e)) <= 2.0 as ok from p group by all""")
def a18_reprojection(spark, sf):
    return calibration.report(_points(spark, sf), D.calibrations(spark)).withColumn("mean_error_px", r6("mean_error_px")).withColumn("max_error_px", r6("max_error_px"))


def _points(spark, sf):
    c = D.table(spark, sf, "customer")
    gx, gy = F.expr("cast(c_custkey * 7 % 100 as double)"), F.expr("cast(c_custkey * 13 % 100 as double)")
    return c.select(F.concat(F.lit("cam"), (F.col("c_custkey") % 8).cast("string")).alias("stream_id"), (gx * 10 + F.col("c_custkey") % 3).alias("image_x"), (gy * 10).alias("image_y"), gx.alias("ground_x"), gy.alias("ground_y"))


_TRUE = (0.1, 0.02, 3.0, 0.01, 0.12, -2.0, 0.0001, 0.0002, 1.0)


@query("select 'cam' || s as stream_id, " + ", ".join(f"{v}::double as h{i}" for i, v in enumerate(_TRUE)) + " from (select distinct c_custkey % 8 as s from customer)")
def a19_homography_fit(spark, sf):
    """All nine numbers of a map with perspective, from points all over the picture."""
    c = D.table(spark, sf, "customer")
    x, y = F.expr("cast(c_custkey * 7 % 640 as double)"), F.expr("cast(c_custkey * 13 % 360 as double)")
    gx, gy = G.project(F.array(*map(F.lit, _TRUE)), x, y)
    points = c.select(F.concat(F.lit("cam"), (F.col("c_custkey") % 8).cast("string")).alias("stream_id"), x.alias("image_x"), y.alias("image_y"), gx.alias("ground_x"), gy.alias("ground_y"))
    return calibration.fit(points).select("stream_id", *[(F.round(F.get("h", F.lit(i)), 6) + 0.0).alias(f"h{i}") for i in range(9)])


# --- boxes and detections ----------------------------------------------------------------------------------------

@query(f"""with {D.BOXES_SQL} select frame_index, det_idx, round((x2 - x1) * (y2 - y1), 6) as area, round((x1 + x2) / 2, 6) as cx, round(y2, 6) as by, trunc(x2)::int as x2i,
  round(greatest(0, x1 - (x2 - x1) * 0.15::double), 6) as ex1, round(least(60.0, x2 + (x2 - x1) * 0.15::double), 6) as ex2, round(x1 * 0.5, 6) as sx1 from b""")
def p01_box_geometry(spark, sf):
    b = G.box()
    grown, half = G.clip(G.expand(b, 0.15), 60.0, 48.0), G.scale(b, 0.5, 0.5)
    cx, by = G.bottom_center(b)
    return D.boxes(spark, sf).select("frame_index", "det_idx", r6(G.area(b)).alias("area"), r6(cx).alias("cx"), r6(by).alias("by"), G.to_int(b)["x2"].alias("x2i"), r6(grown["x1"]).alias("ex1"), r6(grown["x2"]).alias("ex2"), r6(half["x1"]).alias("sx1"))


_IOU = "case when i > 0 then i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i) else 0 end"
_PAIRS = f"""pairs as (select a.frame_index, a.det_idx as a, b.det_idx as b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
  (a.x2 - a.x1) * (a.y2 - a.y1) as sa, (b.x2 - b.x1) * (b.y2 - b.y1) as sb from b a join b on a.frame_index = b.frame_index and a.det_idx < b.det_idx)"""


@query(f"with {D.BOXES_SQL}, {_PAIRS} select frame_index, a, b, round(i / (sa + sb - i), 6) as iou from pairs where i / (sa + sb - i) >= 0.3")
def j04_iou_pairs(spark, sf):
    return detections.overlaps(D.boxes(spark, sf), 0.3).select("frame_index", "a", "b", r6("iou").alias("iou"))


@query(f"""with {D.BOXES_SQL}, m as (select *, least(640 / 60.0::double, 640 / 48.0::double) as k from b), s as (select *, round_even(60 * k, 0) / 60 as sx, round_even(48 * k, 0) / 48 as sy, floor((640 - round_even(60 * k, 0)) / 2) as px, floor((640 - round_even(48 * k, 0)) / 2) as py from m)
select frame_index, det_idx, round(x1 * sx + px, 6) as lx1, round(y1 * sy + py, 6) as ly1, round(x1, 6) as back from s""")
def p04_letterbox(spark, sf):
    meta = G.letterbox("width", "height", 640, 640)
    there = G.to_letterbox(G.box(), meta)
    back = G.from_letterbox(there, meta)
    return D.boxes(spark, sf).select("frame_index", "det_idx", r6(there["x1"]).alias("lx1"), r6(there["y1"]).alias("ly1"), r6(back["x1"]).alias("back"))


@query("""select l_orderkey as frame_index, l_partkey as part, round(l_quantity - 2.5, 6) as x1, round(greatest(l_discount * 10, l_tax * 10), 6) as score, case when l_discount >= l_tax then 0 else 1 end as class_id from lineitem where greatest(l_discount * 10, l_tax * 10) >= 0.5""")
def p06_decode_classic(spark, sf):
    li = D.table(spark, sf, "lineitem")
    row = F.array(F.col("l_quantity"), F.lit(10.0), F.lit(5.0), F.lit(4.0), F.col("l_discount") * 10, F.col("l_tax") * 10)
    rows = li.select(F.col("l_orderkey").alias("frame_index"), F.col("l_partkey").alias("part"), F.array(row).alias("rows"))
    return detections.decode_classic(rows, 0.5).select("frame_index", "part", r6("x1").alias("x1"), r6("score").alias("score"), "class_id")


@query("""select l_orderkey as frame_index, l_partkey as part, round(l_quantity, 6) as x1, round(l_discount * 10, 6) as score, l_linenumber::int as class_id from lineitem where l_discount * 10 >= 0.5""")
def p05_decode_end_to_end(spark, sf):
    li = D.table(spark, sf, "lineitem")
    row = F.array(F.col("l_quantity"), F.lit(10.0), F.lit(60.0), F.lit(40.0), F.col("l_discount") * 10, F.col("l_linenumber").cast("double"))
    rows = li.select(F.col("l_orderkey").alias("frame_index"), F.col("l_partkey").alias("part"), F.array(row).alias("rows"))
    return detections.decode_end_to_end(rows, 0.5).select("frame_index", "part", r6("x1").alias("x1"), r6("score").alias("score"), "class_id")


@query(f"""with {D.BOXES_SQL} select frame_index, det_idx, case class_id when 2 then 'car' else 'truck' end as vehicle_class, round(least(60.0, x2), 6) as x2, round(least(48.0, y2), 6) as y2 from b
  where score >= 0.2 and class_id in (2, 7) and least(60.0, x2) > x1 and least(48.0, y2) > y1""")
def p07_detection_contract(spark, sf):
    labels = spark.createDataFrame([(2, "car"), (7, "truck"), (16, "dog")], "class_id int, class_name string")
    return detections.contract(D.boxes(spark, sf), labels, 0.2).select("frame_index", "det_idx", "vehicle_class", r6("x2").alias("x2"), r6("y2").alias("y2"))


@query(f"""with {D.BOXES_SQL} select frame_index, det_idx, case class_name when 'Car' then 'car' when 'dog' then null else 'truck' end as vehicle_class from b""")
def p09_label_map(spark, sf):
    return D.boxes(spark, sf).select("frame_index", "det_idx", T.vehicle_class(F.col("class_name")).alias("vehicle_class"))


@query("""select id as number, case when id in (12, 26, 29, 30, 45, 66, 68, 69, 71, 83) then null else id - 1 - len(list_filter([12, 26, 29, 30, 45, 66, 68, 69, 71, 83], lambda g: g < id)) end::int as idx, n from
  (select p_partkey % 90 + 1 as id, count(*) as n from part group by all)""")
def p10_class_ids(spark, sf):
    rows = D.table(spark, sf, "part").groupBy((F.col("p_partkey") % 90 + 1).alias("number")).agg(F.count("*").alias("n"))
    return rows.select("number", detections.contiguous_id(F.col("number")).cast("int").alias("idx"), "n")


@query(f"""with recursive {D.BOXES_SQL}, o as (select *, row_number() over (partition by frame_index, class_id order by score desc, det_idx) as k from b),
f as (select frame_index, class_id, k, [{{'d': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept from o where k = 1
 union all select o.frame_index, o.class_id, o.k, case when len(list_filter(f.kept, lambda q: (greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1))) >
   0.5::double * ((q.x2 - q.x1) * (q.y2 - q.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1))))) > 0 then f.kept else list_append(f.kept, {{'d': o.det_idx, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) end
 from f join o on o.frame_index = f.frame_index and o.class_id = f.class_id and o.k = f.k + 1),
l as (select frame_index, class_id, arg_max(kept, k) as kept from f group by all)
select frame_index, class_id, unnest(kept).d as det_idx from l""")
def a16_nms(spark, sf):
    return detections.nms(D.boxes(spark, sf), 0.5).select("frame_index", "class_id", "det_idx")


@query(f"with {D.BOXES_SQL} select frame_index, det_idx, round(x1 * 2.0 / 3, 6) as x1, round(y2 * 2.0 / 3, 6) as y2 from b")
def s05_scaling(spark, sf):
    return readers.to_processed(D.boxes(spark, sf), 40).select("frame_index", "det_idx", r6("x1").alias("x1"), r6("y2").alias("y2"))


@query(f"""with {D.BOXES_SQL}, c as (select *, least(60.0, x2) as cx2, least(48.0, y2) as cy2 from b), m as (select frame_index, det_idx, trunc(x1 + (cx2 - x1) * 0.2::double)::int as a, trunc(cx2 - (cx2 - x1) * 0.2::double)::int as b_, trunc(y1 + greatest(0, cy2 - y1) * 0.2::double)::int as c_, trunc(cy2 - greatest(0, cy2 - y1) * 0.2::double)::int as d_, y1 from c)
select frame_index, det_idx, case when b_ - a >= 24 and d_ - c_ >= 24 then a end as x1, case when b_ - a >= 24 and d_ - c_ >= 24 then d_ end as y2 from m""")
def p25_central_crop(spark, sf):
    c = attributes.central_crop(G.box(), F.lit(60.0), F.lit(48.0))
    return D.boxes(spark, sf).select("frame_index", "det_idx", c["x1"].alias("x1"), c["y2"].alias("y2"))


@query(f"""with {D.BOXES_SQL}, p as (select *, (x1 + x2) / 2 as px, (y1 + y2) / 2 as py from b where class_id = 16), t as (select * from b where class_id <> 16),
j as (select p.frame_index, p.det_idx, t.det_idx as track_id, (px between t.x1 and t.x2 and py between t.y1 and t.y2) as holds, (t.x2 - t.x1) * (t.y2 - t.y1) as area, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) as i, (p.x2 - p.x1) * (p.y2 - p.y1) as pa from p join t using (frame_index))
select frame_index, det_idx, arg_min(track_id, {{'a': not holds, 'b': case when holds then area else -i / (area + pa - i) end, 't': track_id}}) as track_id from j where holds or i > 0 group by all""")
def j05_plate_assignment(spark, sf):
    b = D.boxes(spark, sf)
    tracks = b.where("class_id <> 16").withColumn("track_id", F.col("det_idx").cast("long"))
    return plates.assign(b.where("class_id = 16"), tracks).select("frame_index", "det_idx", "track_id")


# --- votes and attributes ----------------------------------------------------------------------------------------

@query(f"""with {D.trajectory_sql()}, v as (select track_id, vehicle_class, count(*) as n, max(frame_index) as last from traj group by all), t as (select track_id, round(avg(score), 6) as class_confidence, count(*) as hits from traj group by all)
select track_id, arg_max(vehicle_class, {{'n': n, 'l': -last}}) as vehicle_class, any_value(class_confidence) as class_confidence, any_value(hits) as hits from v join t using (track_id) group by all""")
def a04_class_vote(spark, sf):
    out = attributes.class_vote(D.trajectories(spark, sf))
    return out.select("track_id", "vehicle_class", r6("class_confidence").alias("class_confidence"), "hits")


@query(f"""with {D.trajectory_sql()}, c as (select *, count(*) over (partition by track_id, vehicle_class order by frame_index) as n from traj)
select track_id, frame_index, arg_max(vehicle_class, {{'n': n, 'f': -frame_index}}) over (partition by track_id order by frame_index rows unbounded preceding) as class_now from c""")
def a05_running_class(spark, sf):
    return attributes.running_class(D.trajectories(spark, sf)).select("track_id", "frame_index", "class_now")


def _observations(spark, sf):
    t = D.trajectories(spark, sf)
    return t.select(*lines.TRACK, F.lit("color").alias("key"), F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("white")), (F.col("event_id") % 3 + 1).cast("int")).alias("value"), F.expr("cast(event_id % 13 as double) / 10.0D").alias("confidence"), F.col("frame_index").alias("seq"))


@query(f"""with {D.trajectory_sql()}, o as (select track_id, ['red', 'blue', 'white'][(event_id % 3 + 1)::int] as value, (event_id % 13)::double / 10.0::double as c, frame_index as seq from traj where event_id % 13 > 0),
m as (select track_id, value, round(sum(least(c, 1.0)), 6) as mass, min(seq) as first, count(*) as n from o group by all)
select track_id, arg_max(value, {{'m': mass, 'f': -first}}) as value, round(max(mass) / sum(mass), 5) as confidence, sum(n)::bigint as n_observations from m group by all""")
def a07_attribute_fusion(spark, sf):
    return attributes.fuse(_observations(spark, sf)).select("track_id", "value", F.round("confidence", 5).alias("confidence"), "n_observations")


@query(f"""with {D.PIXELS_SQL}, s as (select crop_id, count(*) filter (not grey and (h < 8 or h >= 150)) as red, count(*) filter (not grey and h between 8 and 29 and v > 150) as orange, count(*) filter (not grey and h between 8 and 29 and v <= 150) as brown,
  count(*) filter (not grey and h between 30 and 44) as yellow, count(*) filter (not grey and h between 45 and 89) as green, count(*) filter (not grey and h between 90 and 149) as blue, count(*) filter (grey) as g, quantile_cont(case when grey then v end, 0.5) as mid, count(*) as total from hsv group by all),
m as (select *, greatest(red, orange, brown, yellow, green, blue, g) as best from s)
select crop_id, case best when red then 'red' when orange then 'orange' when brown then 'brown' when yellow then 'yellow' when green then 'green' when blue then 'blue' else case when mid >= 205 then 'white' when mid >= 160 then 'silver' when mid >= 60 then 'gray' else 'black' end end as color, round(best / total, 6) as confidence from m where best > 0""")
def a15_color_naming(spark, sf):
    return attributes.name_colors(D.pixels(spark, sf)).select("crop_id", "color", r6("confidence").alias("confidence"))


@query("""with recursive f as (select user_id % 8 as s, event_id as seq, row_number() over (partition by user_id % 8 order by event_id) as n, (event_id % 3)::int as act from events), b as (select s, seq, n, row_number() over (partition by s order by seq) as k from f where act > 0),
w as (select s, k, seq, n as last, true as fired from b where k = 1 union all select b.s, b.k, b.seq, case when b.n - w.last >= 5 then b.n else w.last end, b.n - w.last >= 5 from w join b on b.s = w.s and b.k = w.k + 1)
select 'cam' || s as stream_id, seq from w where fired""")
def w15_attribute_cadence(spark, sf):
    e = D.table(spark, sf, "events")
    s = F.concat(F.lit("cam"), (F.col("user_id") % 8).cast("string"))
    n = F.row_number().over(lines.Window.partitionBy(F.col("user_id") % 8).orderBy("event_id"))
    frames = e.select(s.alias("stream_id"), F.lit("r0").alias("run_id"), F.col("event_id").alias("seq"), n.cast("long").alias("frame_index"), (F.col("event_id") % 3).alias("n_active"))
    return attributes.cadence(frames, 5).select("stream_id", "seq")


# --- plates ------------------------------------------------------------------------------------------------------

@query(r"select doc_id, regexp_replace(translate(upper(replace(text, 'ß', 'ss')), 'İŞĞÜÖÇ', 'ISGUOC'), '[^A-Z0-9]', '', 'g') as plate from documents where text is not null")
def f01_normalize_plate(spark, sf):
    return D.table(spark, sf, "documents").where("text is not null").select("doc_id", P.normalize(F.col("text")).alias("plate"))


_NORM = r"regexp_replace(upper(text), '[^A-Z0-9]', '', 'g')"
_LEGAL = r"'^(0[1-9]|[1-7][0-9]|8[01])([ABCDEFGHIJKLMNOPRSTUVYZ][0-9]{4,5}|[ABCDEFGHIJKLMNOPRSTUVYZ]{2}[0-9]{3,4}|[ABCDEFGHIJKLMNOPRSTUVYZ]{3}[0-9]{2,3})$'"


@query(f"with {D.READS_SQL} select o_orderkey, regexp_matches({_NORM}, {_LEGAL}) as tr, regexp_matches({_NORM}, '^[A-Z0-9]{{4,9}}$') as generic from reads")
def f02_plate_valid(spark, sf):
    n = P.normalize(F.col("text"))
    return D.plate_reads(spark, sf).select("o_orderkey", P.valid(n, F.lit("TR")).alias("tr"), P.valid(n, F.lit(None).cast("string")).alias("generic"))


def _candidate(digits, letters, n, least, most) -> str:
    put = f"translate(substr(t, 1, 2), '{digits[0]}', '{digits[1]}') || translate(substr(t, 3, {n}), '{letters[0]}', '{letters[1]}') || translate(substr(t, {3 + n}), '{digits[0]}', '{digits[1]}')"
    return f"case when length(t) between {2 + n + least} and {2 + n + most} and regexp_matches({put}, {_LEGAL}) then {put} end"


_TRIES = ", ".join(_candidate(d, le, n, a, b) for d, le in ((P.TO_DIGIT_SAFE, P.TO_LETTER_SAFE), (P.TO_DIGIT_ALL, P.TO_LETTER_ALL)) for n, a, b in P.SHAPES)
_FIXED = f"{D.READS_SQL}, n as (select *, {_NORM} as t from reads), fixed as (select *, coalesce(case when regexp_matches(t, {_LEGAL}) then t end, {_TRIES}) as found from n)"


@query(f"with {_FIXED} select o_orderkey, coalesce(found, t) as text, found is not null as valid, (found is not null and found <> t) as corrected from fixed")
def f04_correct_plate(spark, sf):
    return plates.with_correction(D.plate_reads(spark, sf)).select("o_orderkey", "text", "valid", "corrected")


@query(f"with {D.READS_SQL} select o_orderkey, sha256('pepper' || {_NORM}) as hash from reads")
def f05_hash_plate(spark, sf):
    return D.plate_reads(spark, sf).select("o_orderkey", P.hashed(F.col("text"), "pepper").alias("hash"))


@query(f"with {D.READS_SQL} select o_orderkey, {_NORM} as plate from reads where contains({_NORM}, '1C')")
def f08_plate_search(spark, sf):
    rows = D.plate_reads(spark, sf).withColumn("plate", P.at_rest(F.col("text"), "plain", ""))
    return rows.where(P.matches_search(F.col("plate"), F.lit("1 c"), "plain", "")).select("o_orderkey", "plate")


_VOTES = f"""with {_FIXED}, r as (select stream_id, track_id, seq, coalesce(found, t) as text, greatest(conf, 1e-6) as w, length(coalesce(found, t)) as len from fixed where coalesce(found, t) <> ''),
l0 as (select stream_id, track_id, len, count(*) as n, round(sum(w), 6) as s from r group by all), l as (select stream_id, track_id, arg_max(len, {{'n': n, 's': s, 'l': len}}) as len from l0 group by all), g as (select r.* from r join l using (stream_id, track_id, len)),
c as (select stream_id, track_id, slot, substr(text, slot::int, 1) as ch, sum(w) as w, min(seq) as first from g, range(1, len + 1) as z(slot) group by all),
b as (select stream_id, track_id, slot, arg_max(ch, {{'w': round(w, 6), 'f': -first}}) as ch, max(w) / sum(w) as share from c group by all),
p as (select stream_id, track_id, string_agg(ch, '' order by slot) as plate, avg(share) as confidence from b group by all)"""


def _corrected_reads(spark, sf):
    return plates.with_correction(D.plate_reads(spark, sf))


@query(_VOTES + " select p.track_id, p.plate, round(p.confidence, 5) as confidence, (select count(*) from g where g.track_id = p.track_id and g.stream_id = p.stream_id and g.text = p.plate) as n_reads from p")
def a08_plate_consensus(spark, sf):
    return plates.consensus(_corrected_reads(spark, sf)).select("track_id", "plate", F.round("confidence", 5).alias("confidence"), "n_reads")


_EMITTED = f"""with {_FIXED}, r as (select stream_id, track_id, seq, coalesce(found, t) as text, greatest(conf, 1e-6) as w, length(coalesce(found, t)) as len, (found is not null and found <> t) as mended from fixed where coalesce(found, t) <> ''),
pre as (select a.stream_id, a.track_id, a.seq as upto, b.seq, b.text, b.w, b.len from r a join r b on a.stream_id = b.stream_id and a.track_id = b.track_id and b.seq <= a.seq),
l0 as (select stream_id, track_id, upto, len, count(*) as n, round(sum(w), 6) as s from pre group by all), l as (select stream_id, track_id, upto, arg_max(len, {{'n': n, 's': s, 'l': len}}) as len from l0 group by all), g as (select p.* from pre p join l using (stream_id, track_id, upto, len)),
c as (select stream_id, track_id, upto, slot, substr(text, slot::int, 1) as ch, sum(w) as w, min(seq) as first from g, range(1, len + 1) as z(slot) group by all),
b as (select stream_id, track_id, upto, slot, arg_max(ch, {{'w': round(w, 6), 'f': -first}}) as ch, max(w) / sum(w) as share from c group by all),
p as (select stream_id, track_id, upto, string_agg(ch, '' order by slot) as plate, avg(share) as confidence from b group by all),
agreed as (select p.stream_id, p.track_id, p.upto, p.plate, any_value(p.confidence) as confidence, count(*)::int as n_reads from p join g on g.stream_id = p.stream_id and g.track_id = p.track_id and g.upto = p.upto and g.text = p.plate group by all having count(*) >= 2),
given as (select *, lag(plate) over (partition by stream_id, track_id order by upto) as prior from agreed qualify prior is null or prior <> plate)"""


@query(_EMITTED + " select track_id, upto as seq, plate, round(confidence, 5) as confidence, n_reads from given")
def w12_plate_emissions(spark, sf):
    return plates.emissions(_corrected_reads(spark, sf)).select("track_id", "seq", "plate", F.round("confidence", 5).alias("confidence"), "n_reads")


@query(_EMITTED + f""", n2 as (select g.*, plate as t, (select bool_or(r.mended) from r where r.stream_id = g.stream_id and r.track_id = g.track_id and r.seq <= g.upto) as before from given g),
again as (select *, coalesce(case when regexp_matches(t, {_LEGAL}) then t end, {_TRIES}) as found from n2)
select track_id, upto as seq, coalesce(found, t) as plate, found is not null as valid, case when found is not null then 'TR' end as country, (found is not null and found <> t) or before as corrected from again""")
def w12_settled_plates(spark, sf):
    return plates.settled(_corrected_reads(spark, sf)).select("track_id", "seq", "plate", "valid", "country", "corrected")


@query(f"with {_FIXED} select track_id, seq, bool_or(found is not null and found <> t) over (partition by stream_id, track_id order by seq rows unbounded preceding) as ever_corrected from fixed")
def w13_corrected_carry(spark, sf):
    return plates.corrected_so_far(_corrected_reads(spark, sf)).select("track_id", "seq", "ever_corrected")


def _watchlists(spark, sf):
    """A list for each market segment: every text read of customers in debt."""
    owing = D.plate_reads(spark, sf).where("c_acctbal < 0")
    return owing.select(F.col("c_mktsegment").alias("watchlist_id"), F.lit("Wanted").alias("name"), F.col("text").alias("plate")).distinct()


_LISTS = f"{_FIXED}, lists as (select distinct c_mktsegment as watchlist_id, {_NORM} as p from reads where c_acctbal < 0)"


@query(f"with {_LISTS} select f.track_id, watchlist_id, min(seq) as seq, arg_min(coalesce(found, t), seq) as plate from fixed f join lists on coalesce(found, t) = p group by all")
def j11_watchlist_hits(spark, sf):
    reads = _corrected_reads(spark, sf).withColumn("plate", F.col("text"))
    return plates.watchlist_hits(reads, _watchlists(spark, sf)).select("track_id", "watchlist_id", "seq", "plate")


@query(f"with {_LISTS} select o_orderkey, coalesce(found, t) as plate from fixed where coalesce(found, t) not in (select p from lists)")
def j11_clean_plates(spark, sf):
    reads = _corrected_reads(spark, sf).withColumn("plate", F.col("text"))
    return plates.listed(reads, _watchlists(spark, sf), on=False).select("o_orderkey", "plate")


@query(f"""with {D.BOXES_SQL}, g as (select frame_index, det_idx from b where frame_index % 3 = 0 and score >= 0.4 and least(48.0, y2) - y1 >= 14 and least(60.0, x2) - x1 > 0 and 0.45 + det_idx % 10 / 100.0 >= 0.5) select frame_index, det_idx from g""")
def p19_plate_gates(spark, sf):
    b = D.boxes(spark, sf).withColumn("state", F.lit("active")).withColumn("conf", F.expr("0.45D + det_idx % 10 / 100.0D")).withColumn("text", F.lit("34ABC123"))
    return plates.gates(b, min_conf=0.5).select("frame_index", "det_idx")


@query(f"with {D.READS_SQL} select o_orderkey, trim(replace(text || '__', '_', '')) as text, round((conf + 1.0 + 0.5) / 3, 6) as conf from reads")
def p20_ocr_text(spark, sf):
    slots = D.plate_reads(spark, sf).select("o_orderkey", F.concat("text", F.lit("__")).alias("text"), F.array(F.col("conf"), F.lit(1.0), F.lit(0.5)).alias("probs"))
    return plates.ocr_text(slots).select("o_orderkey", "text", r6("conf").alias("conf"))


# --- events, summaries, rules ------------------------------------------------------------------------------------

def _finished(spark, sf):
    return D.trajectories(spark, sf, "drift").groupBy(*lines.TRACK).agg(F.max("frame_index").alias("frame_index"), F.max("timestamp").alias("timestamp"), F.max_by("wall_ts", "frame_index").alias("wall_ts"))


def _summaries(spark, sf):
    t = D.trajectories(spark, sf, "drift")
    done = _finished(spark, sf).join(attributes.class_vote(t).select(*lines.TRACK, "vehicle_class"), lines.TRACK)
    g = _grounded(spark, sf)
    attrs = attributes.as_map(attributes.fuse(_observations(spark, sf)))
    return events.summaries(done, t, _moving(spark, sf), motion.distance(g), None, attrs)


@query(_EMA + """, t as (select track_id, min(timestamp) as t0, max(timestamp) as t1, count(*) as n, max(wall_ts) as w from traj group by all),
v as (select track_id, vehicle_class, count(*) as n, max(frame_index) as last from traj group by all), c as (select track_id, arg_max(vehicle_class, {'n': n, 'l': -last}) as class from v group by all),
steps as (select *, row_number() over (partition by track_id order by frame_index) as n from ground),
walk as (select track_id, n, gx as ax, gy as ay, 0.0::double as d from steps where n = 1
  union all select o.track_id, o.n, case when h >= 0.15 then gx else ax end, case when h >= 0.15 then gy else ay end, case when h >= 0.15 then d + h else d end
  from (select o.*, w.ax, w.ay, w.d, sqrt((o.gx - w.ax) ** 2 + (o.gy - w.ay) ** 2) as h from walk w join steps o on o.track_id = w.track_id and o.n = w.n + 1) o),
far as (select track_id, max(d) as d from walk group by all), top as (select track_id, max(v) as top from ema group by all),
seen as (select track_id, ['red', 'blue', 'white'][(event_id % 3 + 1)::int] as value, least((event_id % 13)::double / 10.0::double, 1.0) as conf, frame_index from traj where event_id % 13 > 0),
mass as (select track_id, value, round(sum(conf), 6) as m, min(frame_index) as f, count(*) as k from seen group by all),
hue as (select track_id, arg_max(value, {'m': m, 'f': -f}) as color, sum(k)::bigint as k from mass group by all)
select t.track_id, class as vehicle_class, round(t1 - t0, 5) as duration_s, least(n, 600) as n_points, round(w - t1 + t0, 3) as first_wall_ts, round(w, 3) as last_wall_ts, round(far.d, 4) as distance_m, round(top.top, 4) as max_speed_kmh,
  case when t1 > t0 and far.d > 0 then round(far.d / (t1 - t0) * 3.6, 4) end as avg_speed_kmh, hue.color, hue.k as n_observations, null::varchar as plate
from t join c using (track_id) left join far using (track_id) left join top using (track_id) left join hue using (track_id)""")
def a09_track_summary(spark, sf):
    rows = _summaries(spark, sf)
    rounded = [F.round(c, n).alias(c) for c, n in (("duration_s", 5), ("first_wall_ts", 3), ("last_wall_ts", 3), ("distance_m", 4), ("max_speed_kmh", 4), ("avg_speed_kmh", 4))]
    return rows.select("track_id", "vehicle_class", "n_points", *rounded, "color", F.element_at("attributes", "color")["n_observations"].alias("n_observations"), "plate")


def _primitive(spark, sf, save=lambda df: df):
    """Events, track rows and visits; ``save`` keeps the rows and visits that several of them are made of."""
    t = save(D.trajectories(spark, sf))
    visits = save(zones.visits(t, D.zones(spark)))
    return events.union(events.started(t), events.from_crossings(lines.crossings(t, D.lines(spark))), events.from_visits(visits)), t, visits


_PRIM = _CROSS + "," + D.ZONES_SQL.strip() + """,
prim as (select 'track_started' as type, stream_id, track_id, min(timestamp) as t, min(frame_index) as f, arg_min(vehicle_class, frame_index) as cls, null as geom, null as way, null::double as dwell, 3 as phase from traj group by all
 union all select 'line_crossed', stream_id, track_id, timestamp, frame_index, vehicle_class, line_id, canonical, null, 4 from crossed
 union all select 'zone_entered', stream_id, track_id, entered, entered_frame, null, zone_id, null, null, 5 from visits
 union all select 'zone_dwell', stream_id, track_id, alert, null, null, zone_id, null, alert - entered, 5 from visits where alert is not null
 union all select 'zone_exited', stream_id, track_id, exited, null, null, zone_id, null, exited - entered, 5 from visits where exited is not null)"""


@query(_PRIM + " select type, stream_id, track_id, round(t, 6) as timestamp, geom, round(dwell, 3) as dwell_s from prim")
def u01_event_union(spark, sf):
    rows, _, _ = _primitive(spark, sf)
    return rows.select("type", "stream_id", "track_id", r6("timestamp").alias("timestamp"), F.coalesce("data.line", "data.zone").alias("geom"), F.round("data.dwell_s", 3).alias("dwell_s"))


@query(_PRIM + " select type, count(*) as n from prim group by all")
def a10_event_counts(spark, sf):
    return metrics.event_counts(_primitive(spark, sf)[0])


RULES = [
    {"rule_id": "east", "name": "Eastbound goods", "when": {"type": "line_cross", "line": "mid", "direction": "forward", "classes": ["truck", "bus"]}, "cooldown_s": 1.0},
    {"rule_id": "wrong", "name": "Wrong way", "when": {"type": "wrong_way", "line": "mid", "allowed": "forward"}, "cooldown_s": 0.0},
    {"rule_id": "stay", "name": "Dwelling truck", "when": {"type": "all_of", "conditions": [{"type": "zone_dwell", "zone": "box", "min_seconds": 0.3}, {"type": "class_is", "classes": ["truck"]}]}, "cooldown_s": 0.0},
    {"rule_id": "any", "name": "Enter or goods", "when": {"type": "any_of", "conditions": [{"type": "zone_enter", "zone": "wedge"}, {"type": "line_cross", "line": "goods"}]}, "cooldown_s": 2.0},
    {"rule_id": "off", "name": "Off", "enabled": False, "when": {"type": "zone_enter", "zone": "box"}, "cooldown_s": 0.0},
]
_STATE = "cls_ as (select track_id, frame_index, timestamp, vehicle_class from traj)"


def _greedy(name: str, source: str, gap: float) -> str:
    return f"""{name}_o as (select *, row_number() over (partition by track_id order by t, phase, id) as k from ({source})),
{name}_w as (select track_id, k, t, t as last, true as fired from {name}_o where k = 1 union all select o.track_id, o.k, o.t, case when o.t - w.last >= {gap} then o.t else w.last end, o.t - w.last >= {gap} from {name}_w w join {name}_o o on o.track_id = w.track_id and o.k = w.k + 1)"""


_RULES_SQL = _PRIM.replace("with", "with recursive", 1) + f""", {_STATE}, ev as (select p.*, c.vehicle_class as tc, p.type || coalesce(p.geom, '') as id from prim p left join cls_ c on c.track_id = p.track_id and c.timestamp = p.t),
{_greedy('east', "select * from ev where type = 'line_crossed' and geom = 'mid' and way = 'forward' and tc in ('truck', 'bus')", 1.0)},
{_greedy('anyr', "select * from ev where (type = 'zone_entered' and geom = 'wedge') or (type = 'line_crossed' and geom = 'goods')", 2.0)},
fired as (select 'east' as rule_id, track_id, t from east_w where fired union all select 'any', track_id, t from anyr_w where fired union all select 'wrong', track_id, t from ev where type = 'line_crossed' and geom = 'mid' and way <> 'forward'
 union all select 'stay', track_id, t from ev where type = 'zone_dwell' and geom = 'box' and dwell >= 0.2995 and tc = 'truck')
"""


def _fired(spark, sf):
    rows, t, visits = _primitive(spark, sf, saved)
    streams = t.select("stream_id").distinct()
    allowed = rules.relevant(RULES, D.lines(spark), D.zones(spark), streams)
    return rules.fire(rules.with_state(rows, t, visits), [r for r in RULES if r["rule_id"] != "any"] + [r for r in RULES if r["rule_id"] == "any"], allowed)


@query(_RULES_SQL + """select f.rule_id, c.stream_id, f.track_id, round(f.t, 6) as timestamp, c.vehicle_class from fired f join traj c on c.track_id = f.track_id and c.timestamp = f.t
  where f.rule_id <> 'any' or c.stream_id in ('cam0', 'cam1', 'cam2', 'cam3')""")
def r01_rules(spark, sf):
    return _fired(spark, sf).select("rule_id", "stream_id", "track_id", r6("timestamp").alias("timestamp"), "vehicle_class")


@query(_RULES_SQL + "select rule_id, track_id, round(t, 6) as timestamp from fired where rule_id in ('wrong', 'east')")
def r02_direction_rules(spark, sf):
    return _fired(spark, sf).where("rule_id in ('wrong', 'east')").select("rule_id", "track_id", r6("timestamp").alias("timestamp"))


@query(_RULES_SQL + "select rule_id, track_id, round(t, 6) as timestamp from fired where rule_id = 'stay'")
def r08_all_of(spark, sf):
    return _fired(spark, sf).where("rule_id = 'stay'").select("rule_id", "track_id", r6("timestamp").alias("timestamp"))


STATE_RULES = [
    {"rule_id": "fast_in", "when": {"type": "all_of", "conditions": [{"type": "zone_enter", "zone": "wedge"}, {"type": "speed", "min_kmh": 60}]}},
    {"rule_id": "lingering", "when": {"type": "all_of", "conditions": [{"type": "line_cross", "line": "mid"}, {"type": "zone_dwell", "zone": "box", "min_seconds": 0.2}]}},
    {"rule_id": "goods_in", "when": {"type": "zone_enter", "zone": "box", "classes": ["truck", "bus"]}},
    {"rule_id": "nested", "when": {"type": "any_of", "conditions": [{"type": "all_of", "conditions": [{"type": "zone_enter", "zone": "box"}, {"type": "class_is", "classes": ["car"]}]}, {"type": "zone_dwell", "zone": "wedge", "min_seconds": 0.25}]}},
    {"rule_id": "fast", "when": {"type": "speed", "min_kmh": 100, "classes": ["van", "motorcycle"]}},
    {"rule_id": "stolen", "when": {"type": "plate_watchlist", "watchlist": "w"}},
]


@query(_RULES_SQL + """, now as (select e.type, e.track_id, e.t, e.geom, e.dwell, e.id, e.phase, r.vehicle_class as cls, r.value % 120 as speed from ev e join traj r on r.track_id = e.track_id and r.timestamp = e.t),
staying as (select n.track_id, n.t, n.id from now n join visits v on v.track_id = n.track_id and v.zone_id = 'box' and v.entered <= n.t and (v.exited is null or n.t < v.exited) where n.t - v.entered >= 0.2::double)
select 'fast_in' as rule_id, track_id, round(t, 6) as timestamp from now where type = 'zone_entered' and geom = 'wedge' and speed >= 60
union all select 'lingering', n.track_id, round(n.t, 6) from now n join staying h on h.track_id = n.track_id and h.t = n.t and h.id = n.id where n.type = 'line_crossed' and n.geom = 'mid'
union all select 'goods_in', track_id, round(t, 6) from now where type = 'zone_entered' and geom = 'box' and cls in ('truck', 'bus')
union all select 'nested', track_id, round(t, 6) from now where (type = 'zone_entered' and geom = 'box' and cls = 'car') or (type = 'zone_dwell' and geom = 'wedge' and round_even(dwell, 3) >= 0.25)
union all select 'fast', track_id, round(timestamp, 6) from traj where value % 120 > 90 and value % 120 >= 100 and vehicle_class in ('van', 'motorcycle')
union all select 'stolen', track_id, round(timestamp, 6) from traj where event_id % 50 = 7""")
def r03_state_rules(spark, sf):
    """Rules on entries, speeds (of events and of tracks), live visits, nested conditions and watchlists; each row's value is its speed, some plates are on a list."""
    rows, t, visits = _primitive(spark, sf, saved)
    moving = t.withColumn("speed_kmh", F.col("value") % 120)
    over = events.from_speeding(moving.where("speed_kmh > 90").withColumn("limit_kmh", F.lit(90.0)))
    hit = t.where("event_id % 50 = 7").select(*t.columns, F.lit("w").alias("watchlist_id"), F.lit("Stolen").alias("watchlist_name"), F.lit("34ABC123").alias("plate"))
    every = events.union(rows, over, events.from_hits(hit))
    fired = rules.fire(rules.with_state(every, moving, visits), [{**r, "cooldown_s": 0.0} for r in STATE_RULES])
    return fired.select("rule_id", "track_id", r6("timestamp").alias("timestamp"))


@query(_RULES_SQL + """select rule_id, track_id, round(t, 6) as timestamp, a.kind, a.step, a.kind = 'snapshot' as snapshot_requested, a.url, a.x, a.timeout_s, a.level, case when a.kind <> 'snapshot' then 'rule_triggered' end as told
from fired join (values ('wrong', 'snapshot', 0, null, null, null::double, null), ('wrong', 'webhook', 1, 'https://example.org/hook', 'y', 5.0::double, null), ('east', 'log', 1, null, null, null, 'info')) a(rule, kind, step, url, x, timeout_s, level) on a.rule = rule_id""")
def s13_action_outbox(spark, sf):
    none = None
    acts = spark.createDataFrame([("wrong", "snapshot", none, none, none, none), ("wrong", "webhook", "https://example.org/hook", {"x": "y"}, 5.0, none), ("east", "log", none, none, none, "info")], "rule_id string, kind string, url string, headers map<string,string>, timeout_s double, level string")
    fired = _fired(spark, sf)
    at = fired.select("id", "track_id", r6("timestamp").alias("timestamp"))
    out = rules.outbox(fired, acts).join(at, "id")
    told = F.get_json_object("payload", "$.type")
    # the payload tells of the same event
    same = F.col("payload").isNull() | ((F.get_json_object("payload", "$.id") == F.col("id")) & (F.get_json_object("payload", "$.track_id").cast("long") == F.col("track_id")))
    return out.where(same).select("rule_id", "track_id", "timestamp", "kind", "step", "snapshot_requested", "url", F.element_at("headers", "x").alias("x"), "timeout_s", "level", told.alias("told"))


@query(f"""with recursive {D.trajectory_sql()}, o as (select track_id, timestamp as t, row_number() over (partition by track_id order by frame_index) as k, frame_index from traj),
w as (select track_id, k, t as last, true as fired, frame_index from o where k = 1 union all select o.track_id, o.k, case when o.t - w.last >= 0.45 then o.t else w.last end, o.t - w.last >= 0.45, o.frame_index from w join o on o.track_id = w.track_id and o.k = w.k + 1)
select track_id, frame_index from w where fired""")
def w11_cooldown(spark, sf):
    rows = D.trajectories(spark, sf)
    return spaced(rows, lines.TRACK, "timestamp", ["frame_index"], 0.45).select("track_id", "frame_index")


@query(f"with {D.trajectory_sql()} select track_id, min(frame_index) as frame_index, arg_min(vehicle_class, frame_index) as vehicle_class from traj group by all")
def w14_track_started(spark, sf):
    return events.started(D.trajectories(spark, sf)).select("track_id", "frame_index", "vehicle_class")


# --- history, metrics, retention ---------------------------------------------------------------------------------

_NOW = 1_735_689_600.0


@query(f"with {D.LOG_SQL} select id, type, stream_id, round(wall_ts, 3) as wall_ts from log where stream_id = 'cam3' and type = 'speeding' order by log.wall_ts desc, id limit 50 offset 10")
def l01_event_page(spark, sf):
    return store.event_page(D.event_log(spark, sf), 50, 10, stream_id="cam3", type_="speeding").select("id", "type", "stream_id", F.round("wall_ts", 3).alias("wall_ts"))


def _stored(spark, sf):
    """The events as a table on disk, with stream ids that look like numbers."""
    path = fresh_path(spark)
    log = D.event_log(spark, sf).withColumn("stream_id", F.lpad(F.substr("stream_id", F.lit(4)), 3, "0"))
    store.append(store.event_rows(log), path)
    return path


_STORED = f"with {D.LOG_SQL}, stored as (select *, lpad(stream_id[4:], 3, '0') as number from log), ends as (select max(wall_ts) as top from log)"


@query(_STORED + " select id, number as stream_id, type, round(wall_ts, 3) as wall_ts from stored, ends where number = '007' and type = 'speeding' and wall_ts between top - 864000 and top - 86400.5")
def s07_store_history(spark, sf):
    """Events written to the store and read back by stream, type and time."""
    top = D.event_log(spark, sf).agg(F.max("wall_ts")).first()[0]
    back = store.load(spark, _stored(spark, sf))
    rows = store.event_filter(back, stream_id="007", type_="speeding", since=top - 864000, until=top - 86400.5)
    return rows.select("id", "stream_id", "type", F.round("wall_ts", 3).alias("wall_ts"))


@query(_STORED + " select id, number as stream_id from stored, ends where wall_ts >= top - 10.3::double * 86400")
def m01_purged_store(spark, sf):
    """What retention leaves of the stored table, the border's day rewritten."""
    top, path = D.event_log(spark, sf).agg(F.max("wall_ts")).first()[0], _stored(spark, sf)
    store.purge(spark, path, "wall_ts", top, 10.3)
    return store.load(spark, path).select("id", "stream_id")


@query(f"with {D.READS_SQL} select o_orderkey, stream_id, sha256('s' || {_NORM}) as plate, round(conf, 6) as confidence, conf >= 0.8 as valid, round(wall_ts, 3) as wall_ts from reads where {_NORM} <> ''")
def s09_plate_sink(spark, sf):
    """Plate reads as stored, hashed."""
    r = D.plate_reads(spark, sf).withColumn("frame_index", F.col("seq")).withColumn("timestamp", F.col("seq").cast("double")).withColumn("vehicle_class", F.lit("car"))
    ev = events.event(r, "plate_read", events.payload(plate=F.col("text"), confidence=F.col("conf"), valid=F.col("conf") >= 0.8, country=F.col("o_orderkey").cast("string")))
    rows = store.plate_rows(ev, "hashed", "s")
    return rows.select(F.col("country").cast("long").alias("o_orderkey"), "stream_id", "plate", r6("confidence").alias("confidence"), "valid", F.round("wall_ts", 3).alias("wall_ts"))


@query(f"""with {D.trajectory_sql('drift')}, t as (select stream_id, track_id, min(timestamp) as t0, max(timestamp) as t1, count(*) as n, max(wall_ts) as w from traj group by all)
select stream_id, track_id, round(t1 - t0, 5) as duration_s, least(n, 600) as n_points, round(w - t1 + t0, 3) as first_wall_ts, round(w, 3) as last_wall_ts, cast(floor(w / 86400) as int) as day from t""")
def s08_track_sink(spark, sf):
    """Summaries of finished tracks as stored, by the day of their end."""
    rows = store.track_rows(events.from_summaries(_summaries(spark, sf)))
    return rows.select("stream_id", "track_id", F.round("duration_s", 5).alias("duration_s"), "n_points", F.round("first_wall_ts", 3).alias("first_wall_ts"), F.round("last_wall_ts", 3).alias("last_wall_ts"), F.date_diff("wall_date", F.lit("1970-01-01").cast("date")).alias("day"))


@query(f"with {D.trajectory_sql()}, {D.LINES_SQL} select track_id, frame_index, line_id from attached where event_id % 4 in (1, 2)")
def p17_countable_states(spark, sf):
    """Only active and lost rows meet lines."""
    state = F.element_at(F.array(*map(F.lit, schemas.TRACK_STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    return lines.attach(D.trajectories(spark, sf).withColumn("state", state), D.lines(spark)).select("track_id", "frame_index", "line_id")


@query(f"""with {D.LOG_SQL}, t as (select stream_id, track_id, max(wall_ts) as last_wall_ts, min(vehicle_class) as class from log group by all) select stream_id, track_id, round(last_wall_ts, 3) as last_wall_ts from t order by t.last_wall_ts desc nulls last, track_id limit 40""")
def l02_track_page(spark, sf):
    t = D.event_log(spark, sf).groupBy("stream_id", "track_id").agg(F.max("wall_ts").alias("last_wall_ts"), F.min("vehicle_class").alias("class"))
    return store.track_page(t, 40).select("stream_id", "track_id", F.round("last_wall_ts", 3).alias("last_wall_ts"))


@query(f"with {D.READS_SQL} select o_orderkey, {_NORM} as plate from reads where contains({_NORM}, '12') order by wall_ts desc, lpad(o_orderkey::varchar, 12, '0') desc limit 30")
def l03_plate_page(spark, sf):
    rows = D.plate_reads(spark, sf).select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), "o_orderkey", P.normalize(F.col("text")).alias("plate"), "wall_ts")
    return store.plate_page(rows, "12", 30).select("o_orderkey", "plate")


@query(f"with {D.LOG_SQL} select stream_id, type, count(*) as n from log group by all")
def a10_event_counts_by_stream(spark, sf):
    return metrics.event_counts(D.event_log(spark, sf), "stream_id")


@query(f"with {D.trajectory_sql()} , f as (select stream_id, count(*) as frames, count(*) filter (event_id % 7 = 0) as dropped from traj group by all), m as (select stream_id, max(n) as most_active from (select stream_id, frame_index, count(distinct track_id) as n from traj group by all) group by all) select * from f join m using (stream_id)")
def a11_stream_counts(spark, sf):
    t = D.trajectories(spark, sf)
    return metrics.stream_counts(t.withColumn("dropped", F.col("event_id") % 7 == 0), t)


@query(f"with {_FIXED} select time_bucket(interval '1 day', event_time) as start, count(*) filter (found is not null) as valid, count(*) as reads, round(count(*) filter (found is not null) / count(*), 6) as ratio from fixed group by 1")
def a12_plate_validity(spark, sf):
    return metrics.validity(_corrected_reads(spark, sf), "1 day").withColumn("ratio", r6("ratio"))


@query(f"with {D.LOG_SQL} select time_bucket(interval '1 hour', event_time) as start, type, count(*) as n from log group by all")
def a13_event_rates(spark, sf):
    return metrics.rates(D.event_log(spark, sf), "1 hour", "type")


@query(f"with {D.LOG_SQL} select id, round_even(count(*) over (partition by stream_id order by wall_ts range between 600 preceding and current row) / 600.0, 2) as fps from log")
def a13_rolling_fps(spark, sf):
    return metrics.rolling_fps(D.event_log(spark, sf), 600.0).select("id", "fps")


@query(f"with {D.LOG_SQL} select type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(*) as n from log group by all")
def a14_latency_quantiles(spark, sf):
    return metrics.quantiles(D.event_log(spark, sf), "value", "type").withColumn("p50", r6("p50")).withColumn("p95", r6("p95"))


@query(f"with {D.LOG_SQL} select type, le, count(*) filter (le is null or value / 200 <= le) as n from log, (values (0.005::double), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), (null)) b(le) group by all")
def a14_latency_histogram(spark, sf):
    return metrics.histogram(D.event_log(spark, sf).withColumn("s", F.col("value") / 200), "s", metrics.LATENCY_BUCKETS, "type")


@query(f"with {D.LOG_SQL}, n as (select max(wall_ts) as now from log) select 'events' as \"table\", count(*) filter (wall_ts < now - 10 * 86400) as removed, count(*) filter (wall_ts >= now - 10 * 86400) as kept from log, n")
def m01_retention(spark, sf):
    log = D.event_log(spark, sf)
    now = log.agg(F.max("wall_ts")).first()[0] or 0.0
    return store.purge_counts({"events": (log, "wall_ts", 10)}, now)


@query("""with recursive e as (select event_id, 'cam' || (user_id % 8) as stream_id, floor(epoch_us(ts) / 1000000 / 300)::double as w from events where event_id % 5 = 2), o as (select *, row_number() over (partition by stream_id order by w, event_id) as k from e),
f as (select stream_id, k, event_id, [w] as recent, true as kept from o where k = 1 union all select o.stream_id, o.k, o.event_id, case when len(list_filter(f.recent, lambda q: o.w - q < 60)) < 3 then list_append(list_filter(f.recent, lambda q: o.w - q < 60), o.w) else list_filter(f.recent, lambda q: o.w - q < 60) end, len(list_filter(f.recent, lambda q: o.w - q < 60)) < 3 from f join o on o.stream_id = f.stream_id and o.k = f.k + 1)
select lpad(event_id::varchar, 8, '0') as id, stream_id from f where kept""")
def s12_snapshot_manifest(spark, sf):
    log = D.event_log(spark, sf).withColumn("wall_ts", F.floor(F.col("wall_ts") / 300).cast("double"))
    return exports.snapshots(log, ["speeding"], 3).select("id", "stream_id")


@query(f"with {D.LOG_SQL} select id, stream_id || '/' || strftime(event_time, '%Y%m%d') || '/' || id || '.jpg' as path from log")
def f11_snapshot_path(spark, sf):
    return D.event_log(spark, sf).select("id", exports.snapshot_path(F.col("stream_id"), F.col("wall_ts"), F.col("id")).alias("path"))


@query("""with live as (select s_nationkey as k, count(*) as n from supplier where s_acctbal < 0 group by all)
select n_nationkey as k, case when n is not null then 'running' else 'stopped' end as state, coalesce(n, 0) as frames from nation left join live on n_nationkey = k""")
def j15_live_status(spark, sf):
    """Nations with suppliers in debt stand for streams that run."""
    streams = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("stream_id"))
    live = D.table(spark, sf, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").cast("string").alias("stream_id")).agg(F.count("*").alias("frames")).withColumn("state", F.lit("running"))
    return metrics.live_status(streams, live).select(F.col("stream_id").cast("int").alias("k"), "state", "frames")


@query(f"with {D.trajectory_sql()} select track_id, max(frame_index) as last_frame from traj group by all having max(frame_index) < 60")
def u02_expired_tracks(spark, sf):
    """Tracks that are seen no more from frame 60 on."""
    t = D.trajectories(spark, sf)
    ends = t.groupBy("track_id").agg(F.max("frame_index").alias("last_frame"))
    return attributes.expired(t, t.where("frame_index >= 60").select(*lines.TRACK).distinct()).join(ends, "track_id").select("track_id", "last_frame")


# --- clocks, configuration, annotations, texts -------------------------------------------------------------------

@query("""with p as (select o_custkey % 4 as s, o_orderkey % 3 as part, o_orderkey, row_number() over (partition by o_custkey % 4, o_orderkey % 3 order by o_orderkey, o_totalprice) - 1 as f from orders),
t as (select *, f / 25.0::double as t from p), e as (select s, part, max(t) + 1 / 25.0::double as span from t group by all), b as (select s, part, coalesce(sum(span) over (partition by s order by part rows between unbounded preceding and 1 preceding), 0) as base from e)
select 'cam' || s as stream_id, part, f as part_frame, round(base + t, 5) as timestamp from t join b using (s, part)""")
def s04_frame_clock(spark, sf):
    o = D.table(spark, sf, "orders")
    f = F.row_number().over(lines.Window.partitionBy(F.col("o_custkey") % 4, F.col("o_orderkey") % 3).orderBy("o_orderkey", "o_totalprice")) - 1
    packets = o.select(F.concat(F.lit("cam"), (F.col("o_custkey") % 4).cast("string")).alias("stream_id"), F.lit("r0").alias("run_id"), f.cast("long").alias("part_frame"), (F.col("o_orderkey") % 3).alias("part"), F.lit(0.0).alias("pts"), F.lit(25.0).alias("fps"))
    return readers.frame_clock(packets.withColumn("seq", F.col("part_frame"))).select("stream_id", "part", "part_frame", F.round("timestamp", 5).alias("timestamp"))


@query("""with r as (select o_orderkey, 'cam' || (o_custkey % 10) as s from orders), d as (select distinct s from r where s not in ('cam0','cam1','cam2','cam3','cam4','cam5','cam6','cam7'))
select 'unknown' as problem, 'stream' as kind, s as id from d union all select 'duplicate', 'rule', k from (select (o_custkey)::varchar as k from orders group by 1 having count(*) > 1)""")
def j13_config_integrity(spark, sf):
    o = D.table(spark, sf, "orders")
    refs = o.select(F.col("o_custkey").cast("string").alias("rule_id"), F.concat(F.lit("cam"), (F.col("o_custkey") % 10).cast("string")).alias("stream_id"), F.lit("none").alias("kind"), F.lit(None).cast("string").alias("geom"))
    streams = spark.createDataFrame([(s,) for s in D.STREAMS], "stream_id string")
    lists = spark.createDataFrame([], schemas.WATCHLISTS)
    return config_checks.violations(streams, D.lines(spark), D.zones(spark), refs, lists, refs)


@query(f"with {D.trajectory_sql()}, u as (select distinct stream_id from traj) select rule_id, stream_id from (values ('east'), ('wrong'), ('stay'), ('any')) r(rule_id), u where rule_id <> 'any' or stream_id in ('cam0', 'cam1', 'cam2', 'cam3')")
def j12_rule_relevance(spark, sf):
    used = D.trajectories(spark, sf).select("stream_id").distinct()
    return rules.relevant(RULES, D.lines(spark), D.zones(spark), used)


_MAP = {2: 0, 7: 1, 5: 2}
_LINE = "case p_partkey % 5 when 0 then 'not a label' when 1 then (p_partkey % 9)::varchar || ' 0.4' else (p_partkey % 9)::varchar || ' 0.5 0.5 0.25 0.2' || case when p_partkey % 2 = 0 then ' 0.9' else '' end end"


def _labels(spark, sf):
    k = F.col("p_partkey")
    head = (k % 9).cast("string")
    full = F.concat(head, F.lit(" 0.5 0.5 0.25 0.2"), F.when(k % 2 == 0, " 0.9").otherwise(""))
    return D.table(spark, sf, "part").select("p_partkey", F.when(k % 5 == 0, "not a label").when(k % 5 == 1, F.concat(head, F.lit(" 0.4"))).otherwise(full).alias("value"))


@query(f"with l as (select p_partkey, {_LINE} as value from part), m as (select *, case when p_partkey % 5 >= 2 then case p_partkey % 9 when 2 then '0' when 7 then '1' when 5 then '2' end end as n from l) select p_partkey, case when n is not null then n || substr(value, 2) end as mapped from m")
def f12_class_remap(spark, sf):
    return annotations.remap(_labels(spark, sf), _MAP).select("p_partkey", "mapped")


@query("select count(*) filter (p_partkey % 5 >= 2 and p_partkey % 9 in (2, 7, 5)) as kept, count(*) filter (not (p_partkey % 5 >= 2 and p_partkey % 9 in (2, 7, 5))) as dropped from part")
def a17_remap_stats(spark, sf):
    return annotations.remap_stats(_labels(spark, sf), _MAP)


@query("""with b as (select p_partkey, (p_partkey % 9)::int as class_id, (p_partkey % 100) / 100.0::double as cx, (p_partkey % 89) / 100.0::double as cy, (1 + p_size % 40) / 100.0::double * 400 as w, (1 + p_partkey % 30) / 100.0::double * 200 as h from part),
e as (select p_partkey, class_id, least(greatest(trunc(cx * 400 - w / 2 - w * 0.08::double)::int, 0), 400) as x1, least(greatest(trunc(cy * 200 - h / 2 - h * 0.08::double)::int, 0), 200) as y1,
  least(greatest(trunc(cx * 400 + w / 2 + w * 0.08::double)::int, 0), 400) as x2, least(greatest(trunc(cy * 200 + h / 2 + h * 0.08::double)::int, 0), 200) as y2 from b)
select * from e where x2 > x1 and y2 > y1 and y2 - y1 >= 12""")
def p27_plate_crops(spark, sf):
    """Boxes of many sizes, some over the picture's edge, some too low."""
    hundredths = lambda c: F.format_string("%.2f", c / F.lit(100.0))
    k = F.col("p_partkey")
    value = F.concat_ws(" ", (k % 9).cast("string"), hundredths(k % 100), hundredths(k % 89), hundredths(1 + F.col("p_size") % 40), hundredths(1 + k % 30))
    boxes = annotations.parse(D.table(spark, sf, "part").select("p_partkey", value.alias("value"))).withColumn("width", F.lit(400)).withColumn("height", F.lit(200))
    return annotations.crops(boxes).select("p_partkey", "class_id", "x1", "y1", "x2", "y2")


@query("""with l as (select p_partkey as k, '/data/labels/a/labels/' || (p_partkey % 50) || '/' || p_partkey || '.txt' as p, p_size as s from part) select p as label_path, '/data/labels/a/images/' || (k % 50) || '/' || k || case when k % 3 = 0 then '.png' else '.jpg' end as image_path from l where s > 10""")
def s14_image_label_pairs(spark, sf):
    """Small parts have a label and no picture."""
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part")
    stem = lambda kind: F.concat(F.lit(f"/data/labels/a/{kind}/"), (k % 50).cast("string"), F.lit("/"), k.cast("string"))
    labels = p.select(F.concat(stem("labels"), F.lit(".txt")).alias("label_path"))
    images = p.where("p_size > 10").select(F.explode(F.when(k % 3 == 0, F.array(F.lit(".webp"), F.lit(".png"))).otherwise(F.array(F.lit(".png"), F.lit(".jpg")))).alias("e"), stem("images").alias("s")).select(F.concat("s", "e").alias("image_path"))
    return annotations.pair(labels, images)


@query(r"select page_id, regexp_replace(regexp_replace('rtsp://user:pw@' || url || '?api_key=abc&x=1', '([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@', '\1***@', 'g'), '(api_key=)[^&\s]+', '\1***', 'g') as text from pages")
def f09_credential_scrub(spark, sf):
    text = F.concat(F.lit("rtsp://user:pw@"), F.col("url"), F.lit("?api_key=abc&x=1"))
    return D.table(spark, sf, "pages").select("page_id", T.scrub_credentials(text).alias("text"))


_HASHED = f"sha256('s' || {_NORM})"


@query(f"""with {D.READS_SQL} select o_orderkey, '{{"plate":["' || {_HASHED} || '","' || {_HASHED} || '"],"class":"' || text || '","a":[{{"text":"' || {_HASHED} || '","n":1,"x":{{"raw_text":[["' || {_HASHED} || '"]],"say":"\\"plate\\": ' || text || '"}}}}]}}' as payload from reads""")
def f06_payload_scrub(spark, sf):
    """Lists, nesting, escapes, and equal values under other keys."""
    t = F.col("text")
    raw = F.concat(F.lit('{"plate": ["'), t, F.lit('", "'), t, F.lit('"], "class": "'), t, F.lit('", "a": [{"text": "'), t, F.lit('", "n": 1, "x": {"raw_text": [["'), t, F.lit('"]], "say": "\\"plate\\": '), t, F.lit('"}}]}'))
    return D.plate_reads(spark, sf).select("o_orderkey", store.scrub_json(raw, "s").alias("payload"))


@query(_CROSS + " select track_id, frame_index, '#' || track_id || ' · ' || vehicle_class || ' · ' || name || ' ' || direction as summary from crossed")
def f13_event_summary(spark, sf):
    e = events.from_crossings(_crossed(spark, sf))
    return e.select("track_id", "frame_index", T.summary(F.struct("type", "track_id", "vehicle_class"), F.col("data")).alias("summary"))


# --- state that SQL has no short form for ------------------------------------------------------------------------

@query(f"""with recursive {D.LOG_SQL}, o as (select id, stream_id, row_number() over (partition by stream_id order by wall_ts, id) as k, value > 450 as seen from log),
f as (select *, k * 0.01::double as t from o),
w as (select stream_id, k, id, t, 0.0::double as tokens, case when seen then t end as seen_t, true as kept from f where k = 1
  union all select stream_id, k, id, t, case when x >= 1.0 then x - 1.0 else x end, case when x >= 1.0 and seen then t else seen_t end, x >= 1.0 from
  (select f.*, w.seen_t, least(1.0::double, w.tokens + (f.t - w.t) * case when w.seen_t is not null and f.t - w.seen_t <= 3.0 then 15.0::double else 2.0::double end) as x from w join f on f.stream_id = w.stream_id and f.k = w.k + 1))
select id, kept as admitted from w""")
def w16_frame_sampling(spark, sf):
    e = D.event_log(spark, sf)
    order = lines.Window.partitionBy("stream_id").orderBy("wall_ts", "id")
    frames = e.select("id", "stream_id", F.lit("r0").alias("run_id"), F.row_number().over(order).alias("seq"), (F.row_number().over(order) * F.lit(0.01)).alias("timestamp"), (F.col("value") > 450).alias("has_detection"))
    return sampling.sample(frames).select("id", "admitted")


def _detections(spark, sf):
    b = D.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 16).alias("s"), F.col("l_orderkey").alias("frame_index"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_linenumber", "l_extendedprice")
    k = F.row_number().over(lines.Window.partitionBy("frame_index").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber")) - 1
    x, y = F.expr("cast(l_partkey % 20 as double) * 30"), F.expr("cast(l_suppkey % 10 as double) * 30")
    return b.select(F.concat(F.lit("cam"), F.col("s").cast("string")).alias("stream_id"), F.lit("r0").alias("run_id"), "frame_index", (F.col("frame_index") * F.lit(0.02)).alias("timestamp"), k.cast("int").alias("det_idx"), x.alias("x1"), y.alias("y1"), (x + 40.0).alias("x2"), (y + 30.0).alias("y2"), (F.col("l_discount") * 10).alias("score"), F.lit("car").alias("vehicle_class"))


@query()
def t01_tracking(spark, sf):
    return tracking.finished(tracking.track(_detections(spark, sf), every_frame=False)).select("stream_id", "track_id", "frame_index", "confirmed", "hits")


@query()
def t02_track_frames(spark, sf):
    """Live tracks at every frame, summed up by frame."""
    rows = tracking.live_rows(tracking.track(_detections(spark, sf)))
    return rows.groupBy("stream_id", "frame_index").agg(F.count("*").alias("live"), F.count_if("matched").alias("matched"), F.count_if(F.col("state") == "lost").alias("lost"), F.sum("hits").alias("hits"))


@query()
def t03_tracking_in_segments(spark, sf):
    """Tracks of streams that pause between orders of different days: segments side by side, numbered as in one pass."""
    d = _detections(spark, sf)
    late = F.floor(F.col("frame_index") / 5000)  # a pause of ten seconds after each 5000 frames
    paused = d.withColumn("timestamp", F.col("timestamp") + late * 10.0)
    clock = paused.select("stream_id", "run_id", "frame_index", "timestamp").distinct()
    gaps = clock.groupBy("stream_id", "run_id", F.floor(F.col("frame_index") / 5000).alias("part")).agg(F.max("frame_index").alias("frame_index"), F.max("timestamp").alias("timestamp"))
    empty = gaps.select("stream_id", "run_id", (F.col("frame_index") + 1).alias("frame_index"), (F.col("timestamp") + 2.5).alias("timestamp"))  # the camera ran on, nothing was seen
    tracked = tracking.track(paused, clock.union(empty), every_frame=False, save=saved)
    return tracking.finished(tracked).select("stream_id", "track_id", "frame_index", "confirmed", "hits")


@query(f"with {D.trajectory_sql()}, h as (select * from traj where vehicle_class <> 'bus'), span as (select track_id, min(frame_index) as a, max(frame_index) as b from h group by all), g as (select t.track_id, t.frame_index from traj t join span s on t.track_id = s.track_id and t.frame_index between a and b) select g.track_id, g.frame_index, h.event_id is not null as matched, round(last_value(h.x ignore nulls) over (partition by g.track_id order by g.frame_index), 6) as x from g left join h using (track_id, frame_index)")
def j06_carry_forward(spark, sf):
    t = D.trajectories(spark, sf)
    # every track is its own clock here, so that frames and rows agree
    own = t.withColumn("run_id", F.col("track_id").cast("string"))
    out = tracking.carried(own.where("vehicle_class <> 'bus'").drop("event_id", "value", "wall_ts", "score"), own.select("stream_id", "run_id", "frame_index", "timestamp"))
    return out.select("track_id", "frame_index", "matched", r6((F.col("x1") + F.col("x2")) / 2).alias("x"))


# --- streams -----------------------------------------------------------------------------------------------------

#: Where the rows of a stream are cut into arrivals, by frame.
_ARRIVALS = (0, 20, 40, 1 << 40)


def _streamed(spark, rows, build):
    """What ``build`` makes of ``rows`` as a stream that arrives in three parts, with a restart from the checkpoint before each."""
    processors.use_rocksdb(spark)
    base = fresh_path(spark)
    for lo, hi in zip(_ARRIVALS, _ARRIVALS[1:]):
        rows.where(F.col("frame_index").between(lo, hi - 1)).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        run = build(arriving).writeStream.foreachBatch(processors.sink(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{base}/out").where("late = 0")


def _arriving(spark, sf, kind="jitter"):
    return D.trajectories(spark, sf, kind).withColumn("matched", F.lit(True)).withColumn("done", F.lit(False))


@query(SQL["w01_line_crossings"])
def x02_stream_crossings(spark, sf):
    """Line crossings and their running counts, from a stream."""
    out = _streamed(spark, _arriving(spark, sf), lambda s: stream.crossings(s, D.lines(spark)))
    return out.select("stream_id", "track_id", "frame_index", "line_id", "direction", "direction_canonical", "count")


@query(SQL["w03_zone_visits"])
def x02_stream_visits(spark, sf):
    """Zone visits, from a stream."""
    out = stream.visit_rows(_streamed(spark, _arriving(spark, sf), lambda s: stream.visits(s, D.zones(spark))))
    return out.select("stream_id", "track_id", "zone_id", "visit", "entered_frame", r6("entered").alias("entered"), r6("exited").alias("exited"), r6("dwell_s").alias("dwell_s"))


@query(SQL["w06_speed"])
def x02_stream_speed(spark, sf):
    """Smoothed speeds, from a stream."""
    limits = spark.createDataFrame([(s, 70.0) for s in D.STREAMS], "stream_id string, limit_kmh double")
    out = _streamed(spark, _arriving(spark, sf, "drift"), lambda s: stream.motion(s, D.calibrations(spark), limits))
    return out.select("track_id", "frame_index", F.round("speed_kmh", 4).alias("speed_kmh"), F.round("max_speed_kmh", 4).alias("max_speed_kmh"))
