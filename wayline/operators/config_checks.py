"""Referential integrity of configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(dim: DataFrame, kind: str, *key: str) -> DataFrame:
    """(problem, kind, id) for ids found twice."""
    found = dim.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit("duplicate").alias("problem"), F.lit(kind).alias("kind"), F.concat_ws("/", *key).alias("id"))


def unknown(refs: DataFrame, dim: DataFrame, kind: str, *key: str) -> DataFrame:
    """(problem, kind, id) for references that no row answers: a left anti join."""
    lost = refs.join(dim.select(*key).distinct(), list(key), "left_anti").distinct()
    return lost.select(F.lit("unknown").alias("problem"), F.lit(kind).alias("kind"), F.concat_ws("/", *key).alias("id"))


def violations(streams: DataFrame, lines: DataFrame, zones: DataFrame, rules: DataFrame, watchlists: DataFrame, refs: DataFrame) -> DataFrame:
    """All violations. ``refs`` (rule_id, stream_id or null, kind, geom): what rules name; lines and zones are checked on listed streams only."""
    out = duplicates(streams, "stream", "stream_id").union(duplicates(rules, "rule", "rule_id"))
    out = out.union(duplicates(lines, "line", "stream_id", "line_id")).union(duplicates(zones, "zone", "stream_id", "zone_id"))
    out = out.union(unknown(refs.where("stream_id is not null").select("stream_id"), streams, "stream", "stream_id"))
    for kind, dim in (("line", lines), ("zone", zones)):
        own = refs.where(F.col("stream_id").isNotNull() & (F.col("kind") == kind)).select("stream_id", F.col("geom").alias(f"{kind}_id"))
        out = out.union(unknown(own, dim, kind, "stream_id", f"{kind}_id"))
    lists = refs.where("kind = 'watchlist'").select(F.col("geom").alias("watchlist_id"))
    return out.union(unknown(lists, watchlists, "watchlist", "watchlist_id"))
