"""SQL functions of the engine."""

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plates import LETTERS, PROVINCE, SHAPES, TO_DIGIT_ALL, TO_DIGIT_SAFE, TO_LETTER_ALL, TO_LETTER_SAFE
from .text import LABELS

_SHAPE = "|".join(f"[{LETTERS}]{{{n}}}[0-9]{{{a},{b}}}" for n, a, b in SHAPES)
_BOX = "x1 double, y1 double, x2 double, y2 double"
_NORMAL = "regexp_replace(translate(upper(t), 'İŞĞÜÖÇ', 'ISGUOC'), '[^A-Z0-9]', '')"
_BOTH = "greatest(0.0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0D, least(ay2, by2) - greatest(ay1, by1))"
_DEPTH = "(case when abs(h[6] * x + h[7] * y + h[8]) < 1e-12D then 1e-12D else h[6] * x + h[7] * y + h[8] end)"
_SIDE = "((bx - ax) * ({1} - ay) - (by - ay) * ({0} - ax))"
_TURN = "((x - px) * (by - ay) - (y - py) * (bx - ax))"
_ON = f"abs({_TURN}) >= 1e-12D and ((ax - px) * (by - ay) - (ay - py) * (bx - ax)) / {_TURN} between 0 and 1 and ((ax - px) * (y - py) - (ay - py) * (x - px)) / {_TURN} between 0 and 1"
_CROSSING = f"case when {_SIDE.format('px', 'py')} < 0 and {_SIDE.format('x', 'y')} >= 0 and {_ON} then 1 when {_SIDE.format('px', 'py')} > 0 and {_SIDE.format('x', 'y')} <= 0 and {_ON} then -1 else 0 end"
_INSIDE = "aggregate(zip_with(points, concat(slice(points, -1, 1), slice(points, 1, size(points) - 1)), (a, b) -> (a.y > y) <> (b.y > y) and coalesce(x < (b.x - a.x) * (y - a.y) / nullif(b.y - a.y, 0.0D) + a.x, false)), false, (acc, hit) -> acc <> hit)"


def _quoted(*texts: str) -> str:
    return ", ".join(f"'{t}'" for t in texts)


def _correction() -> str:
    """The body of ``correct_plate``: candidates in order, the first legal one wins."""
    tried = ["p"]
    for digits, letters in ((TO_DIGIT_SAFE, TO_LETTER_SAFE), (TO_DIGIT_ALL, TO_LETTER_ALL)):
        for n, least, most in SHAPES:
            put = f"concat(translate(substring(p, 1, 2), {_quoted(*digits)}), translate(substring(p, 3, {n}), {_quoted(*letters)}), translate(substring(p, {3 + n}), {_quoted(*digits)}))"
            tried.append(f"case when length(p) between {2 + n + least} and {2 + n + most} then {put} end")
    found = f"get(filter(array({', '.join(tried)}), c -> c rlike '^{PROVINCE}({_SHAPE})$'), 0)"
    told = "named_struct('text', coalesce(f, p), 'valid', f is not null, 'country', case when f is not null then 'TR' end, 'corrected', coalesce(f <> p, false))"
    return f"element_at(transform(array({_NORMAL}), p -> element_at(transform(array({found}), f -> {told}), 1)), 1)"


_FIT = "least(dst_w / src_w, dst_h / src_h)"
_FITTED = f"bround(src_w * {_FIT}) / src_w", f"bround(src_h * {_FIT}) / src_h", f"floor((dst_w - bround(src_w * {_FIT})) / 2)", f"floor((dst_h - bround(src_h * {_FIT})) / 2)"
_TO = ("x1 * {0} + {2}", "y1 * {1} + {3}", "x2 * {0} + {2}", "y2 * {1} + {3}")
_FROM = ("(x1 - {2}) / ({0})", "(y1 - {3}) / ({1})", "(x2 - {2}) / ({0})", "(y2 - {3}) / ({1})")
_MAPPED = lambda forms: "named_struct(" + ", ".join(f"'{k}', {f.format(*_FITTED)}" for k, f in zip(("x1", "y1", "x2", "y2"), forms)) + ")"
_STRUCT = "struct<x1:double,y1:double,x2:double,y2:double>"
#: name: (arguments, result, body); plain SQL, so Catalyst inlines them.
FUNCTIONS = {
    "box_area": ("x1 double, y1 double, x2 double, y2 double", "double", "greatest(0.0D, x2 - x1) * greatest(0.0D, y2 - y1)"),
    "line_side": ("ax double, ay double, bx double, by double, x double, y double", "double", "(bx - ax) * (y - ay) - (by - ay) * (x - ax)"),
    "normalize_plate": ("t string", "string", "regexp_replace(translate(upper(t), 'İŞĞÜÖÇ', 'ISGUOC'), '[^A-Z0-9]', '')"),
    "tr_plate_valid": ("t string", "boolean", f"t rlike '^{PROVINCE}({_SHAPE})$'"),
    "plate_valid": ("t string", "boolean", "t rlike '^[A-Z0-9]{4,9}$'"),
    "hash_plate": ("t string, salt string", "string", "sha2(concat(salt, regexp_replace(translate(upper(t), 'İŞĞÜÖÇ', 'ISGUOC'), '[^A-Z0-9]', '')), 256)"),
    "box_width": ("x1 double, x2 double", "double", "greatest(0.0D, x2 - x1)"),
    "box_height": ("y1 double, y2 double", "double", "greatest(0.0D, y2 - y1)"),
    "box_center": (_BOX, "struct<x:double,y:double>", "named_struct('x', (x1 + x2) / 2, 'y', (y1 + y2) / 2)"),
    "box_anchor": (_BOX, "struct<x:double,y:double>", "named_struct('x', (x1 + x2) / 2, 'y', y2)"),
    "box_clip": (f"{_BOX}, w double, h double", "struct<x1:double,y1:double,x2:double,y2:double>", "named_struct('x1', least(greatest(x1, 0.0D), w), 'y1', least(greatest(y1, 0.0D), h), 'x2', least(greatest(x2, 0.0D), w), 'y2', least(greatest(y2, 0.0D), h))"),
    "box_iou": ("ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double", "double", f"coalesce({_BOTH} / nullif((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {_BOTH}, 0.0D), 0.0D)"),
    "line_crossing": ("ax double, ay double, bx double, by double, px double, py double, x double, y double", "int", _CROSSING),
    "in_polygon": ("points array<struct<x:double,y:double>>, x double, y double", "boolean", _INSIDE),
    "polygon_centroid": ("points array<struct<x:double,y:double>>", "struct<x:double,y:double>", "named_struct('x', aggregate(points, 0.0D, (a, p) -> a + p.x) / size(points), 'y', aggregate(points, 0.0D, (a, p) -> a + p.y) / size(points))"),
    "project": ("h array<double>, x double, y double", "struct<x:double,y:double>", f"named_struct('x', (h[0] * x + h[1] * y + h[2]) / {_DEPTH}, 'y', (h[3] * x + h[4] * y + h[5]) / {_DEPTH})"),
    "plate_at_rest": ("t string, mode string, salt string", "string", f"case when mode = 'hashed' then sha2(concat(salt, {_NORMAL}), 256) else {_NORMAL} end"),
    "plate_matches": ("stored string, q string, mode string, salt string", "boolean", f"case when mode = 'hashed' then stored = sha2(concat(salt, {_NORMAL.replace('upper(t)', 'upper(q)')}), 256) else contains(stored, {_NORMAL.replace('upper(t)', 'upper(q)')}) end"),
    "vehicle_class": ("label string", "string", "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in LABELS.items()) + "), replace(lower(trim(label)), ' ', '_'))"),
    "scrub_credentials": ("t string", "string", r"regexp_replace(regexp_replace(t, r'([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]+@', '$1***@'), r'(api_key=)[^&\s]+', '$1***')"),
    "correct_plate": ("t string", "struct<text:string,valid:boolean,country:string,corrected:boolean>", _correction()),
    "to_letterbox": (f"{_BOX}, src_w double, src_h double, dst_w double, dst_h double", _STRUCT, _MAPPED(_TO)),
    "from_letterbox": (f"{_BOX}, src_w double, src_h double, dst_w double, dst_h double", _STRUCT, _MAPPED(_FROM)),
    "heading_deg": ("dx double, dy double", "double", "pmod(degrees(atan2(dy, dx)), 360.0D)"),
    "utc_day": ("wall_ts double", "string", "date_format(date_add(date'1970-01-01', int(floor(wall_ts / 86400))), 'yyyyMMdd')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """The functions above, ``scrub_payload(json, salt)``, whose keys no plan knows (a pandas UDF), and the table functions."""
    from ..sources.store import scrub_text
    from .tables import register_tables

    @F.pandas_udf("string")
    def scrub_payload(texts: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([scrub_text(t, s) for t, s in zip(texts, salts)], dtype=object)

    spark.udf.register("scrub_payload", scrub_payload)
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {result} return {body}")
    return sorted([*FUNCTIONS, "scrub_payload", *register_tables(spark)])
