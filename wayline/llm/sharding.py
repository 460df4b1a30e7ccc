"""K-d tree partitioning into shards of near-equal bytes, in DataFrame operations only.

A node is split along its widest dimension of metadata at the weighted median, so that bytes on both sides fit the number of
shards to come. Medians come from histograms of bounded size that narrow down on the place of the cut; only they and
sums for each node reach the driver. Within one value of a dimension a digest of the text decides. Equal texts have equal coordinates and share a shard,
unless one group of copies outweighs the tolerance; then it is cut by a hash of the id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BINS = 1024
#: A dimension's width in a node is the distance of these quantiles, as a share of that among all rows: a few extreme rows don't make it wide.
SPREAD = (0.05, 0.95)
#: How far the bytes at a cut may be from their share, as a share of one shard's bytes.
TOLERANCE = 0.002
#: Rows that are numbered in one sort, about.
SLOT_ROWS = 10_000
_TOP = (1 << 63) - 1


@dataclass
class Split:
    node: int
    dim: int
    value: int  # left: coordinate <= value, or
    tie: int | None = None  # coordinate < value, or = value and tie coordinate <= tie


def text_dimensions(text: Column) -> list[Column]:
    """Default dimensions, all from the text so that copies agree: its bytes, and for each million characters its bytes beyond one a character, its blanks, its line ends and its digits."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1))
    share = lambda n: F.floor(n * F.lit(1e6) / size).cast("long")
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    return [F.octet_length(text), share(F.octet_length(text) - F.char_length(text)), share(without(" ")), share(without("\n")), share(without("0123456789"))]


def _left(s: Split) -> Column:
    c = F.col(f"c{s.dim}")
    return (c <= s.value) if s.tie is None else (c < s.value) | ((c == s.value) & (F.col("tie") <= s.tie))


def _descend(splits: list[Split]) -> Column:
    """The node of a row: nodes are numbered as in a heap, 1 at the top."""
    at = {s.node: s for s in splits}

    def below(n: int) -> Column:
        return F.when(_left(at[n]), below(2 * n)).otherwise(below(2 * n + 1)) if n in at else F.lit(n)

    return below(1)


def _of_node(values: dict[int, int]) -> Column:
    """A number of the row's node, from a small constant map."""
    return F.element_at(F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, v)]), F.col("node")).cast("long")


def _cuts(points: DataFrame, dims: dict[int, int], goal: dict[int, float], slack: float) -> list[Split]:
    """The weighted median of each node: histograms between the least and the greatest value still in question."""
    done: dict[int, Split] = {}
    state = {n: {"lo": 0, "hi": _TOP, "below": 0.0, "at": None} for n in dims}
    while todo := [n for n in dims if n not in done]:
        # coordinate: the dimension's, or within one value of it (a heavy group) the tie
        tied = {n: s["at"] for n in todo if (s := state[n])["at"] is not None}
        number = {d: i for i, d in enumerate(sorted({dims[n] for n in todo}))}
        held = F.element_at(F.array(*[F.col(f"c{d}") for d in number]), _of_node({n: number[dims[n]] + 1 for n in todo}).cast("int"))
        rows = points.where(F.col("node").isin(todo)).withColumn("x", held)
        if tied:
            at = _of_node(tied)
            rows = rows.where(at.isNull() | (F.col("x") == at)).withColumn("x", F.when(at.isNull(), F.col("x")).otherwise(F.col("tie")))
        lo, hi = _of_node({n: state[n]["lo"] for n in todo}), _of_node({n: state[n]["hi"] for n in todo})
        step = _of_node({n: (state[n]["hi"] - state[n]["lo"]) // BINS + 1 for n in todo})
        rows = rows.select("node", "size", "x", lo.alias("lo"), hi.alias("hi"), step.alias("step"))
        bins = rows.where("x between lo and hi").groupBy("node", F.expr("(x - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for n in todo:
            s, own = state[n], sorted((r["bin"], r["w"], r["a"], r["b"]) for r in bins if r["node"] == n)
            below, chosen, before = s["below"], None, None
            for _, w, a, b in own:
                if below + w >= goal[n]:
                    chosen = (w, a, b)
                    break
                below, before = below + w, b
            if chosen is None:
                chosen, below = own[-1][1:], below - own[-1][1]
                before = own[-2][3] if len(own) > 1 else None
            w, a, b = chosen
            over, under = below + w - goal[n], goal[n] - below
            make = lambda v, s=s, n=n: Split(n, dims[n], v if s["at"] is None else s["at"], None if s["at"] is None else v)
            if over <= slack:
                done[n] = make(b)
            elif under <= slack and before is not None:
                done[n] = make(before)
            elif a < b:
                s |= {"lo": a, "hi": b, "below": below}
                s.setdefault("before", None)
                s["before"] = before if before is not None else s["before"]
            elif s["at"] is None and w > slack:
                s |= {"lo": 0, "hi": _TOP, "below": below, "at": a}
            elif over <= under:
                done[n] = make(b)
            elif before is not None:
                done[n] = make(before)
            else:  # nothing of what is left fits below the cut: just under it
                done[n] = Split(n, dims[n], s["at"] - 1) if s["at"] is not None else make(a - 1)
    return list(done.values())


def kd_tree(points: DataFrame, shards: int, dims: int) -> tuple[list[Split], dict[int, int]]:
    """Splits, and the shard of each leaf. ``points``: size, c0.., tie (longs from 0 on; the upper half of c is the dimension)."""
    splits: list[Split] = []
    leaves, parts = {1: 0}, {1: shards}
    ranges = [F.percentile_approx(F.shiftright(f"c{d}", 32), list(SPREAD), 2000).alias(f"q{d}") for d in range(dims)]
    top = points.agg(F.sum("size").alias("w"), *ranges).first()
    width = lambda r, d: (r[f"q{d}"][1] - r[f"q{d}"][0]) if r[f"q{d}"] else 0
    whole = {d: max(1, width(top, d)) for d in range(dims)}
    slack = TOLERANCE * (top["w"] or 0) / shards
    while open_ := [n for n in leaves if parts[n] > 1]:
        at = points.withColumn("node", _descend(splits))
        stats = at.where(F.col("node").isin(open_)).groupBy("node").agg(F.sum("size").alias("w"), *ranges).collect()
        goal, chosen = {}, {}
        for r in stats:
            n = r["node"]
            chosen[n] = max(range(dims), key=lambda d: width(r, d) / whole[d])
            goal[n] = r["w"] * (parts[n] // 2) / parts[n]
        made = {s.node: s for s in _cuts(at, chosen, goal, slack)} if chosen else {}
        for n in open_:
            first, size = leaves.pop(n), parts.pop(n)
            s = made.get(n) or Split(n, 0, _TOP)  # an empty node
            splits.append(s)
            leaves[2 * n], parts[2 * n] = first, size // 2
            leaves[2 * n + 1], parts[2 * n + 1] = first + size // 2, size - size // 2
    return splits, leaves


def shard(docs: DataFrame, shards: int = 16, dimensions: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    A row's size is its text's UTF-8 length (null: none) plus one; a null text is sharded like an empty one. Slots count
    from 0 without gaps in each shard, in an order that only the rows decide; equal rows take neighbouring
    slots. ``dimensions`` may be any numeric columns; with columns that differ between copies these may part.
    Texts of any length count whole; of the other columns none is read. An empty table gives no rows. The law is ``bytes``: a grown number of shards has no meaning.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dimensions if dimensions is not None else text_dimensions(F.col(text_col))
    digest = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    coords = [F.shiftleft(F.greatest(F.least(F.coalesce(d.cast("long"), F.lit(0)), F.lit((1 << 31) - 1)), F.lit(0)).cast("long"), 32).bitwiseOR(digest).alias(f"c{i}") for i, d in enumerate(dims)]
    points = cut(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        *coords, F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("tie"),
    ))
    splits, leaves = kd_tree(points, shards, len(dims))
    node = _descend(splits)
    number = F.coalesce(*[F.when(node == n, k) for n, k in leaves.items()]) if len(leaves) <= 2 else F.element_at(F.create_map(*[F.lit(x) for n, k in leaves.items() for x in (n, k)]), node)
    buckets = max(1, math.ceil(points.count() / (shards * SLOT_ROWS)))
    placed = points.select("id", "size", "crc", "tie", number.alias("shard"), F.pmod(F.col("tie"), F.lit(buckets)).alias("bucket"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    start = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "id", "crc", "size"))
    slots = placed.withColumn("inner", inner).join(start, ["shard", "bucket"])
    return slots.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        (F.col("start") + F.col("inner") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
