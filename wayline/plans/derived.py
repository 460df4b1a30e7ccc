"""Trajectories, boxes, plate reads and other inputs derived from the shared tables by arithmetic alone, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.folds import SPREAD, by_key
from ..sources.readers import dimension


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLASS_OF = {"click": "car", "view": "bus", "purchase": "truck", "signup": "van", "error": "motorcycle"}
#: Event types whose anchors lie on a grid.
STEPPED = ("view", "purchase")
STREAMS = [f"cam{i}" for i in range(8)]
_CASE = "case " + " ".join(f"when event_type = '{k}' then '{v}'" for k, v in CLASS_OF.items()) + " else 'car' end"


def trajectories(spark: SparkSession, sf_dir: str, kind: str = "jitter") -> DataFrame:
    """A row per event: one user is one track; anchors jitter about x = 100, some of them in steps of 20 so that they meet lines, or drift east."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = by_key(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], SPREAD).withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    x = F.expr(f"case when event_type in {STEPPED} then 20.0D * floor(value % 200 / 20) else value % 200 end") if kind == "jitter" else F.expr("20.0D * k + value % 3")
    y = F.expr("cast(100 + event_id % 50 as double)")
    return e.select(
        F.concat(F.lit("cam"), (F.col("user_id") % 8).cast("string")).alias("stream_id"), F.lit("r0").alias("run_id"), F.col("user_id").alias("track_id"), F.col("k").alias("frame_index"),
        (F.col("k") * F.lit(0.1)).alias("timestamp"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D").alias("wall_ts"), F.lit("active").alias("state"), F.expr(_CASE).alias("vehicle_class"),
        (x - 2.0).alias("x1"), (y - 4.0).alias("y1"), (x + 2.0).alias("x2"), y.alias("y2"), F.expr("0.5D + (event_id % 50) / 100.0D").alias("score"), "event_id", "value",
    )


def trajectory_sql(kind: str = "jitter") -> str:
    x = f"case when event_type in {STEPPED} then 20.0::double * floor(value % 200 / 20) else value % 200 end" if kind == "jitter" else "20.0 * k + value % 3"
    return f"""
base as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events),
traj0 as (select 'cam' || (user_id % 8) as stream_id, user_id as track_id, k as frame_index, k * 0.1::double as timestamp, epoch_us(ts) / 1000000.0::double as wall_ts, {_CASE} as vehicle_class,
  ({x})::double as cx, (100 + event_id % 50)::double as cy, 0.5::double + (event_id % 50) / 100.0::double as score, event_id, value from base),
traj as (select *, ((cx - 2.0::double) + (cx + 2.0::double)) / 2 as x, cy as y from traj0)"""


def lines(spark: SparkSession) -> DataFrame:
    rows = [{"stream_id": s, "line_id": "mid", "name": "Middle", "ax": 100.0, "ay": 200.0, "bx": 100.0, "by": 0.0, "forward_label": "eastbound", "backward_label": "westbound"} for s in STREAMS]
    rows += [{"stream_id": s, "line_id": "goods", "name": "Goods", "ax": 60.0, "ay": 200.0, "bx": 60.0, "by": 0.0, "classes": ["truck", "bus"]} for s in STREAMS[:4]]
    return dimension(spark, rows, schemas.LINES, "lines")


LINES_SQL = """
lines(line_id, name, lx, forward_label, backward_label, picky) as (values ('mid', 'Middle', 100.0::double, 'eastbound', 'westbound', false), ('goods', 'Goods', 60.0::double, 'forward', 'backward', true)),
attached as (select t.*, l.* from traj t join lines l on not l.picky or (t.vehicle_class in ('truck', 'bus') and t.stream_id in ('cam0', 'cam1', 'cam2', 'cam3')))"""

ZONE = [(50.0, 90.0), (150.0, 90.0), (150.0, 140.0), (50.0, 140.0)]
WEDGE = [(20.0, 100.0), (180.0, 100.0), (100.0, 150.0)]


def zones(spark: SparkSession) -> DataFrame:
    rows = [{"stream_id": s, "zone_id": "box", "name": "Box", "points": ZONE, "dwell_alert_s": 0.3} for s in STREAMS]
    rows += [{"stream_id": s, "zone_id": "wedge", "name": "Wedge", "points": WEDGE, "dwell_alert_s": 0.2} for s in STREAMS]
    return dimension(spark, rows, schemas.ZONES, "zones")


def _ray(points: list[tuple[float, float]]) -> str:
    """Ray casting as SQL: the parity of edges to the right."""
    edges = [(points[i], points[i - 1]) for i in range(len(points))]
    hits = [f"(({a[1]} > y) <> ({b[1]} > y) and x < ({b[0]} - {a[0]})::double * (y - {a[1]}) / nullif({b[1]} - {a[1]}, 0)::double + {a[0]})::int" for a, b in edges]
    return "((" + " + ".join(f"coalesce({h}, 0)" for h in hits) + ") % 2 = 1)"


ZONES_SQL = f"""
inside as (select t.*, 'box' as zone_id, 0.3::double as alert_s, {_ray(ZONE)} as hit from traj t union all select t.*, 'wedge', 0.2::double, {_ray(WEDGE)} from traj t),
edges as (select *, hit and not coalesce(lag(hit) over w, false) as enters from inside window w as (partition by track_id, zone_id order by frame_index)),
runs as (select *, sum(enters::int) over (partition by track_id, zone_id order by frame_index) as visit from edges),
timed as (select *, first_value(timestamp) over (partition by track_id, zone_id, visit order by frame_index) as entered from runs where visit > 0),
visits as (select stream_id, track_id, zone_id, visit, min(frame_index) as entered_frame, min(entered) as entered, min(case when not hit then timestamp end) as exited,
  min(case when hit and not enters and timestamp - entered >= alert_s then timestamp end) as alert from timed group by all)"""

#: Ten metres for a hundred pixels.
SCALE = [0.1, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0]
BACK = [10.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 1.0]


def calibrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, SCALE, BACK) for s in STREAMS[:6]], schemas.CALIBRATIONS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per order line; one order is one frame."""
    li = by_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], SPREAD)
    order = Window.partitionBy("l_orderkey").orderBy(*li.columns)
    x, y = F.expr("cast(l_partkey % 50 as double)"), F.expr("cast(l_suppkey % 50 as double)")
    label = F.expr("case l_returnflag when 'A' then 'Car' when 'N' then ' Pickup Truck' else 'dog' end")
    return li.withColumn("i", F.row_number().over(order) - 1).select(
        F.lit("cam0").alias("stream_id"), F.lit("r0").alias("run_id"), F.col("l_orderkey").alias("frame_index"), F.col("i").alias("det_idx"), x.alias("x1"), y.alias("y1"),
        (x + 10.0 + F.col("l_quantity")).alias("x2"), (y + 10.0 + F.col("l_quantity") / 2).alias("y2"), F.expr("round(l_discount * 8 + l_tax / 10, 4)").alias("score"),
        F.expr("case l_returnflag when 'A' then 2 when 'N' then 7 else 16 end").alias("class_id"), label.alias("class_name"), F.lit(60).alias("width"), F.lit(48).alias("height"),
    )


BOXES_SQL = """
b as (select l_orderkey as frame_index, row_number() over (partition by l_orderkey order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as det_idx,
  (l_partkey % 50)::double as x1, (l_suppkey % 50)::double as y1, (l_partkey % 50)::double + 10.0::double + l_quantity as x2, (l_suppkey % 50)::double + 10.0::double + l_quantity / 2 as y2,
  round(l_discount * 8 + l_tax / 10, 4) as score, case l_returnflag when 'A' then 2 when 'N' then 7 else 16 end as class_id,
  case l_returnflag when 'A' then 'Car' when 'N' then ' Pickup Truck' else 'dog' end as class_name from lineitem)"""


def plate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each customer's plate, one per order, some misread."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    key = F.col("o_custkey")
    letter = lambda d: F.substr(F.lit("ABCDEFGHIJKLMNOPRSTUVYZ"), (F.floor(key / d) % 23 + 1).cast("int"), F.lit(1))
    plate = F.concat(F.lpad((key % 81 + 1).cast("string"), 2, "0"), letter(1), letter(7), F.lpad((key % 1000).cast("string"), 3, "0"))
    noise = F.col("o_orderkey") % 5
    text = F.when(noise == 0, F.replace(plate, F.lit("8"), F.lit("B"))).when(noise == 1, F.concat(F.substr(plate, F.lit(1), F.lit(2)), F.lit(" "), F.lower(F.substr(plate, F.lit(3))))).when(noise == 2, F.substr(plate, F.lit(1), F.lit(6))).otherwise(plate)
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice", "o_orderdate")
    return o.select(
        F.concat(F.lit("cam"), (F.col("c_nationkey") % 8).cast("string")).alias("stream_id"), F.lit("r0").alias("run_id"), key.alias("track_id"), F.row_number().over(order).cast("long").alias("seq"),
        text.alias("text"), F.expr("0.5D + (o_orderkey % 50) / 100.0D").alias("conf"), F.col("o_orderkey"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) / 1000000.0D").alias("wall_ts"), F.col("o_orderdate").alias("event_time"), "c_acctbal", "c_mktsegment",
    )


def _letter(d: int) -> str:
    return f"substr('ABCDEFGHIJKLMNOPRSTUVYZ', ((o_custkey // {d}) % 23 + 1)::int, 1)"


READS_SQL = f"""
p0 as (select o.*, c_nationkey, c_acctbal, c_mktsegment, lpad((o_custkey % 81 + 1)::varchar, 2, '0') || {_letter(1)} || {_letter(7)} || lpad((o_custkey % 1000)::varchar, 3, '0') as plate from orders o join customer on c_custkey = o_custkey),
reads as (select 'cam' || (c_nationkey % 8) as stream_id, o_custkey as track_id, row_number() over (partition by o_custkey order by o_orderkey, o_totalprice, o_orderdate) as seq,
  case o_orderkey % 5 when 0 then replace(plate, '8', 'B') when 1 then substr(plate, 1, 2) || ' ' || lower(substr(plate, 3)) when 2 then substr(plate, 1, 6) else plate end as text,
  0.5::double + (o_orderkey % 50) / 100.0::double as conf, o_orderkey, epoch_us(o_orderdate) / 1000000.0::double as wall_ts, o_orderdate as event_time, c_acctbal, c_mktsegment from p0)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as stored history."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.format_string("%08d", "event_id").alias("id"), F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 5 + 1).cast("int")).alias("type"), F.concat(F.lit("cam"), (F.col("user_id") % 8).cast("string")).alias("stream_id"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1000000.0D").alias("wall_ts"), F.col("user_id").alias("track_id"), F.expr(_CASE).alias("vehicle_class"), F.col("ts").alias("event_time"), "value",
    )


_TYPES = ["line_crossed", "zone_entered", "speeding", "plate_read", "track_finished"]
LOG_SQL = f"""
log as (select lpad(event_id::varchar, 8, '0') as id, list_extract({_TYPES}, (event_id % 5 + 1)::int) as type, 'cam' || (user_id % 8) as stream_id, epoch_us(ts) / 1000000.0::double as wall_ts,
  user_id as track_id, {_CASE} as vehicle_class, ts as event_time, value from events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as crops: three numbers make a pixel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_id"), "embedding").where("embedding is not null")
    byte = lambda i: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 256 * F.get("embedding", 3 * F.col("j") + i).cast("double")))).cast("int")
    rows = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)))
    return rows.select("crop_id", byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def _byte(i: int) -> str:
    return f"floor(least(255.0::double, greatest(0.0::double, 128 + 256 * embedding[3 * j + {i + 1}]::double)))::int"


PIXELS_SQL = f"""
px as (select vec_id as crop_id, {_byte(0)} as b, {_byte(1)} as g, {_byte(2)} as r from embeddings, range(0, len(embedding) // 3) as s(j)),
hv as (select *, greatest(b, g, r) as v, greatest(b, g, r) - least(b, g, r) as d from px),
hd as (select *, case when d = 0 then 0.0::double when v = r then 60.0::double * (g - b) / d when v = g then 120 + 60.0::double * (b - r) / d else 240 + 60.0::double * (r - g) / d end as deg from hv),
hs as (select crop_id, v, round_even((case when deg < 0 then deg + 360 else deg end) / 2, 0)::int as h0, case when v = 0 then 0 else round_even(255.0::double * d / v, 0)::int end as s from hd),
hsv as (select crop_id, v, s, case when h0 >= 180 then h0 - 180 else h0 end as h, (s < 60 or v < 46 or (v > 232 and s < 90)) as grey from hs)"""
