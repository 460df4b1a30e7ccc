"""Labels, credentials, days and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detector labels and what they are here.
LABELS = {
    "car": "car", "bus": "bus", "truck": "truck", "motorcycle": "motorcycle", "motorbike": "motorcycle", "bicycle": "bicycle", "person": "person",
    "van": "van", "minivan": "van", "minibus": "van", "pickup": "truck", "pickup_truck": "truck", "kamyon": "truck", "kamyonet": "truck", "tir": "truck",
    "otobus": "bus", "otomobil": "car", "araba": "car", "motosiklet": "motorcycle", "bisiklet": "bicycle",
    "emergency": "emergency", "ambulance": "emergency", "ambulans": "emergency", "fire_truck": "emergency", "police": "emergency", "police_car": "emergency",
}
DEFAULT_CLASSES = ["car", "van", "bus", "truck", "motorcycle", "bicycle", "emergency"]


def vehicle_class(label: Column) -> Column:
    """The class of a detector's label, null for what is no road user."""
    key = F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), key)


def scrub_credentials(text: Column) -> Column:
    """Hides user and password in URLs and the value of api_key."""
    return F.regexp_replace(F.regexp_replace(text, r"([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@", "$1***@"), r"(api_key=)[^&\s]+", "$1***")


def utc_day(wall_ts: Column) -> Column:
    """YYYYMMDD of seconds since 1970, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(wall_ts / 86400).cast("int")), "yyyyMMdd")


def remap_annotation(line: Column, mapping: dict[int, int]) -> Column:
    """An annotation line with its class id mapped; null if it is malformed, short or unmapped. Further columns stay."""
    tokens = F.split(F.trim(line), r"\s+")
    old = F.get(tokens, F.lit(0)).try_cast("double")
    new = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), old.cast("int"))
    return F.when((F.size(tokens) >= 5) & new.isNotNull(), F.array_join(F.concat(F.array(new.cast("string")), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))), " "))


def summary(e: Column, data: Column) -> Column:
    """One line of an event: struct columns ``e`` (type, track_id, vehicle_class) and its payload."""
    kind = e["type"]
    who = F.when(e["track_id"].isNotNull(), F.concat(F.lit("#"), e["track_id"].cast("string")))
    what = (
        F.when(kind == "line_crossed", F.concat_ws(" ", F.coalesce(data["line_name"], data["line"]), data["direction"]))
        .when(kind.isin("zone_entered", "zone_exited", "zone_dwell"), F.concat_ws(" ", F.coalesce(data["zone_name"], data["zone"]), F.when(data["dwell_s"].isNotNull(), F.concat(F.bround(data["dwell_s"], 1).cast("string"), F.lit(" s")))))
        .when(kind == "speeding", F.concat(F.bround(data["speed_kmh"], 1).cast("string"), F.lit(" km/h")))
        .when(kind.isin("plate_read", "watchlist_hit"), data["plate"])
        .when(kind == "rule_triggered", data["rule_name"])
        .otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))
    )
    return F.concat_ws(" · ", who, e["vehicle_class"], F.when(what != "", what))
