"""Stored events, track summaries and plate reads: writing, history queries and retention."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType, _parse_datatype_string

from ..functions import plates as P

LIMIT = 1000


def wall_date(wall_ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(wall_ts / 86400).cast("int"))


#: Payload keys whose strings are plates.
PLATE_KEYS = ("plate", "plate_text", "text", "raw_text", "matched_plate")


def _may_hold(kind: DataType, key: str | None) -> bool:
    if isinstance(kind, StructType):
        return any(_may_hold(f.dataType, f.name) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _may_hold(kind.elementType, key)
    if isinstance(kind, MapType):
        return _may_hold(kind.valueType, PLATE_KEYS[0])
    return isinstance(kind, StringType) and key in PLATE_KEYS


def scrub(value: Column, kind: DataType, salt: str, key: str | None = None, hide=None) -> Column:
    """``value`` of type ``kind`` with every string under a plate key hashed (or what ``hide`` makes of it): in structs, maps and arrays at any depth; elements of an array stand under its key, values of a map under their entry's."""
    if isinstance(kind, StructType):
        out = value
        for f in kind.fields:
            if _may_hold(f.dataType, f.name):
                out = out.withField(f"`{f.name}`", scrub(value[f.name], f.dataType, salt, f.name, hide))
        return out
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: scrub(x, kind.elementType, salt, key, hide))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: F.when(k.isin(*PLATE_KEYS), scrub(v, kind.valueType, salt, PLATE_KEYS[0], hide)).otherwise(scrub(v, kind.valueType, salt, None, hide)))
    if not (isinstance(kind, StringType) and key in PLATE_KEYS):
        return value
    return hide(value) if hide is not None else P.hashed(value, salt)


def event_rows(events: DataFrame, mode: str = "plain", salt: str = "") -> DataFrame:
    """Events as stored; in hashed mode neither the payload nor a rule's trigger_data holds a plate. Partition columns at the end."""
    if mode == "hashed":
        events = events.withColumns({c: scrub(F.col(c), events.schema[c].dataType, salt) for c in ("data", "trigger_data") if c in events.columns})
    return events.withColumn("wall_date", wall_date(F.col("wall_ts")))


def scrub_json(text: Column, salt: str) -> Column:
    """Free JSON text with strings under plate keys hashed at any depth, lists included; a key's reach ends at the next object's own keys.

    The text is parsed, so escapes, blanks and equal values under other keys are no matter; it comes back without blanks. What is no JSON comes back null, as it can't be
    shown to be clean. Keys of free JSON aren't known to the plan, so this is a pandas UDF over Arrow batches.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scrub_text(t, salt))

    return run(text)


def scrub_text(text: str | None, salt: str) -> str | None:
    def walk(value, key):
        if isinstance(value, dict):
            return {k: walk(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, key) for v in value]
        return hashlib.sha256((salt + P.normal_form(value)).encode()).hexdigest() if isinstance(value, str) and key in PLATE_KEYS else value

    try:
        return None if text is None else json.dumps(walk(json.loads(text), None), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def track_rows(events: DataFrame, mode: str = "plain", salt: str = "") -> DataFrame:
    """One row for each track_finished; the class falls back to the event's, the last wall time to the event's."""
    d = F.col("data")
    plate = F.when(d["plate"].isNotNull(), P.at_rest(d["plate"], mode, salt))
    rows = events.where("type = 'track_finished'").select(
        "stream_id", "run_id", "track_id", F.coalesce(d["class"], F.col("vehicle_class")).alias("class"), d["first_wall_ts"].alias("first_wall_ts"), F.coalesce(d["last_wall_ts"], F.col("wall_ts")).alias("last_wall_ts"),
        *[d[c].alias(c) for c in ("duration_s", "distance_m", "avg_speed_kmh", "max_speed_kmh")], plate.alias("plate_text"), d["plate_confidence"].alias("plate_confidence"), d["color"].alias("color"), d["n_points"].alias("n_points"),
    )
    return rows.withColumn("wall_date", wall_date(F.col("last_wall_ts")))


def _plate_of(data: Column, kind: StructType) -> Column:
    """A payload's plate: plate or, if that is missing or empty, text; either may be a struct with a text of its own."""
    found = []
    for f in kind.fields:
        if f.name in ("plate", "text"):
            value = data[f.name]["text"] if isinstance(f.dataType, StructType) else data[f.name]
            found.append((f.name, F.when(value != "", value)))
    return F.coalesce(*[c for _, c in sorted(found, key=lambda x: x[0])])


def plate_rows(events: DataFrame, mode: str = "plain", salt: str = "") -> DataFrame:
    """One row for each plate_read that has a plate."""
    d, kind = F.col("data"), events.schema["data"].dataType
    has = lambda name, other: d[name] if name in kind.names else other
    none = F.lit(None).cast("double")
    rows = events.withColumn("_p", _plate_of(d, kind)).where("type = 'plate_read' and _p is not null")
    rows = rows.select("id", "stream_id", "run_id", "track_id", P.at_rest(F.col("_p"), mode, salt).alias("plate"), F.coalesce(has("confidence", none), has("plate_confidence", none)).alias("confidence"), F.coalesce(has("valid", F.lit(False)), F.lit(False)).alias("valid"), has("country", F.lit(None).cast("string")).alias("country"), "wall_ts")
    return rows.withColumn("wall_date", wall_date(F.col("wall_ts")))


#: Types of the partition columns, whatever their values look like: stream 007 is not stream 7.
PARTITIONS = {"wall_date": "date", "stream_id": "string"}


def append(rows: DataFrame, path: str) -> None:
    rows.repartition("wall_date", "stream_id").sortWithinPartitions("wall_date", "stream_id").write.mode("append").partitionBy("wall_date", "stream_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its partition columns as they were written. The files' own columns come from their footers, those of the partitions are declared."""
    found = spark.read.parquet(path).schema
    schema = StructType([StructField(f.name, _parse_datatype_string(PARTITIONS[f.name])) if f.name in PARTITIONS else f for f in found.fields])
    return spark.read.schema(schema).parquet(path)


def _page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    return rows.offset(max(0, offset)).limit(min(max(1, limit), LIMIT))


def event_filter(events: DataFrame, stream_id=None, type_=None, vehicle_class=None, since=None, until=None) -> DataFrame:
    """The bounds also become bounds on the partition column, so days outside are not read."""
    rows = events
    for c, v in (("stream_id", stream_id), ("type", type_), ("vehicle_class", vehicle_class)):
        rows = rows.where(F.col(c) == v) if v is not None else rows
    if since is not None:
        rows = rows.where(F.col("wall_ts") >= since)
        rows = rows.where(F.col("wall_date") >= wall_date(F.lit(float(since)))) if "wall_date" in rows.columns else rows
    if until is not None:
        rows = rows.where(F.col("wall_ts") <= until)
        rows = rows.where(F.col("wall_date") <= wall_date(F.lit(float(until)))) if "wall_date" in rows.columns else rows
    return rows


def event_page(events: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Newest first, then by id."""
    return _page(event_filter(events, **filters).orderBy(F.desc("wall_ts"), "id"), limit, offset)


def track_page(tracks: DataFrame, limit: int = 100, offset: int = 0, stream_id=None, vehicle_class=None, plate=None, since=None, mode: str = "plain", salt: str = "") -> DataFrame:
    """Newest first, then by track; a plate is searched exactly as it is stored. Rows without an end time come last."""
    rows = tracks
    rows = rows.where(F.col("stream_id") == stream_id) if stream_id is not None else rows
    rows = rows.where(F.col("class") == vehicle_class) if vehicle_class is not None else rows
    rows = rows.where(F.col("plate_text") == P.at_rest(F.lit(plate), mode, salt)) if plate is not None else rows
    rows = rows.where(F.col("last_wall_ts") >= since) if since is not None else rows
    return _page(rows.orderBy(F.desc_nulls_last("last_wall_ts"), "track_id"), limit, offset)


def plate_page(reads: DataFrame, query: str, limit: int = 100, mode: str = "plain", salt: str = "") -> DataFrame:
    """Newest first, then the greater id; a part of the plate in plain mode, the whole in hashed mode."""
    return _page(reads.where(P.matches_search(F.col("plate"), F.lit(query), mode, salt)).orderBy(F.desc("wall_ts"), F.desc("id")), limit, 0)


def expired(rows: DataFrame, clock: str, now: float, days: float | None) -> Column:
    """Whether a row is past its days; null clocks and null days keep."""
    return F.lit(False) if days is None else F.coalesce(F.col(clock) < now - days * 86400, F.lit(False))


def retain(rows: DataFrame, clock: str, now: float, days: float | None) -> DataFrame:
    return rows.where(~expired(rows, clock, now, days))


def _recover(spark: SparkSession, path: str) -> None:
    """Puts back a day that a purge had moved away when it was cut off; leftovers of finished ones go."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f.getPath().getName()
        if name.startswith("_border-"):
            day = jvm.org.apache.hadoop.fs.Path(root, f"wall_date={name[8:18]}")
            if name.endswith("-old") and not fs.exists(day):
                fs.rename(f.getPath(), day)
            else:
                fs.delete(f.getPath(), True)


def purge(spark: SparkSession, path: str, clock: str, now: float, days: float | None) -> int:
    """Removes what is past its days from the table at ``path`` and returns how many rows go.

    Folders of days wholly past are dropped; of their rows only the clocks are read, to count them. Only the day of the border is rewritten, beside its folder, and then put in its place.
    A purge that was cut off between the two renames is taken up by the next one. Rows without a clock stay.
    """
    if days is None:
        return 0
    _recover(spark, path)
    rows, border = load(spark, path), now - days * 86400
    last = datetime.fromtimestamp(math.floor(border / 86400) * 86400, timezone.utc).date()
    old = rows.where(F.col("wall_date") <= F.lit(last))
    gone = old.where(expired(old, clock, now, days)).count()
    if not gone:
        return 0
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda name: jvm.org.apache.hadoop.fs.Path(root, name)
    beside = f"_border-{last.isoformat()}-{uuid.uuid4().hex}"  # a leading underscore hides it from readers
    kept = rows.where(F.col("wall_date") == F.lit(last)).where(~expired(rows, clock, now, days)).drop("wall_date")
    kept.write.partitionBy("stream_id").parquet(f"{path}/{beside}")
    folders = [(f.getPath(), f.getPath().getName()) for f in fs.listStatus(root)]
    for folder, name in folders:
        day = name.removeprefix("wall_date=")
        if day != name and day != "__HIVE_DEFAULT_PARTITION__" and day < last.isoformat():
            fs.delete(folder, True)
    own = at(f"wall_date={last.isoformat()}")
    if fs.exists(own):
        fs.rename(own, at(f"{beside}-old"))
        if any(f.isDirectory() for f in fs.listStatus(at(beside))):
            fs.rename(at(beside), own)
        else:
            fs.delete(at(beside), True)
        fs.delete(at(f"{beside}-old"), True)
    else:
        fs.delete(at(beside), True)
    spark.catalog.refreshByPath(path)
    return gone


def purge_all(spark: SparkSession, tables: dict[str, tuple[str, str, float | None]], now: float) -> dict[str, int]:
    """``purge`` of each table given as (path, clock column, days): how many rows went."""
    return {name: purge(spark, path, clock, now, days) for name, (path, clock, days) in tables.items()}


def purge_counts(tables: dict[str, tuple[DataFrame, str, float | None]], now: float) -> DataFrame:
    """(table, removed, kept) for tables given with clock column and days."""
    out = None
    for name, (rows, clock, days) in tables.items():
        one = rows.agg(F.count_if(expired(rows, clock, now, days)).alias("removed"), F.count_if(~expired(rows, clock, now, days)).alias("kept")).select(F.lit(name).alias("table"), "removed", "kept")
        out = one if out is None else out.union(one)
    return out
