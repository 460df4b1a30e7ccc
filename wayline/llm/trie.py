"""A trie of conversation prefixes and what sharing each prefix saves.

Every turn of a conversation gets a 128-bit key of the turns up to it, so equal prefixes have equal keys wherever they lie. Only the part of the trie where different
conversations still run together needs a tree: what hangs below is a chain of one conversation (and its copies), known in closed form from running sums.
The paths of that part are sorted and cut into shards. A shard is written as balanced parentheses, its running excess held with least and greatest values for
each block and a tree above them; findclose delimits every subtree, the rank of leaf pairs counts its leaves and cumulative arrays give its savings. Nodes on the
spines, where a shard's first or last path runs, may lie in other shards too; their sums are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import by_key
from .common import cut

#: Turns of a conversation that are numbered in one window; longer conversations are numbered block by block.
BLOCK_TURNS = 1024
#: Ids of a node's members that are joined in one string.
BLOCK_IDS = 65_536
#: Places of paths that make a shard, about.
SHARD_PLACES = 200_000
#: Parentheses of a block of the excess.
BLOCK_BITS = 64
NODE = ["p", "q"]


# --- turns to keys ----------------------------------------------------------------------------------------------


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, points): each conversation's turns numbered from 1 by turn (null first; ties by digests of role and text), two digests of role and text, and the text's code points.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; repeated rows are turns each.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), text, role).alias("b"), F.char_length(text).cast("long").alias("points"),
        F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62))).alias("block"),
    )
    inner = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "a", "b", "points"))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).where("before > 0").drop("n")
    out = rows.withColumn("inner", inner).join(before, ["conv_id", "block"], "left")
    return out.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("inner")).cast("long").alias("d"), "a", "b", "points")


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: the first h of conversation c - c % ``every`` (all if it has fewer, none if it is absent), then c's own after its first h,
    h being the CRC-32 of the decimal c modulo ``most``. Rows as from ``ordered``, and all conversation ids (some may have no turn left)."""
    c = F.col("conv_id")
    base = c - c % every
    heads = rows.where((c % every == 0) & (F.col("d") < most)).select(c.alias("base"), "d", "a", "b", "points")
    known = heads.groupBy("base").agg(F.max("d").alias("there"))
    h = F.crc32(c.cast("string").cast("binary")) % most
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", base.alias("base"), h.alias("h")).join(known, "base", "left")
    convs = cut(convs.withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    taken = convs.where("k > 0").join(heads, "base").where("d <= k").select("conv_id", "d", "a", "b", "points")
    own = rows.join(convs, "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("k")).alias("d"), "a", "b", "points")
    return taken.union(own), convs.select("conv_id")


def keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, d, p, q, pp, pq, points, upto): key of the prefix that ends with the turn and of the one before it, and the code points of the prefix.

    A key sums (xor) digests of place and turn. Long conversations are summed in blocks, to which what the blocks before sum up to is added.
    """
    own = rows.select("conv_id", "d", F.xxhash64("a", "b", "d").alias("x"), F.xxhash64(F.lit("second"), "d", "b", "a").alias("y"), "points", F.expr(f"(d - 1) div {BLOCK_TURNS}").alias("block"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("points").alias("bs"))
    carry = sums.select("conv_id", "block", F.bit_xor("bx").over(past).alias("cx"), F.bit_xor("by").over(past).alias("cy"), F.sum("bs").over(past).alias("cs")).where("block > 0")
    out = own.withColumns({"p": F.bit_xor("x").over(so_far), "q": F.bit_xor("y").over(so_far), "upto": F.sum("points").over(so_far)}).join(carry, ["conv_id", "block"], "left")
    add = lambda name, c: F.col(name).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long")))
    out = out.withColumns({"p": add("p", F.col("cx")), "q": add("q", F.col("cy")), "upto": F.col("upto") + F.coalesce("cs", F.lit(0))})
    return out.select("conv_id", "d", "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("pp"), F.col("q").bitwiseXOR(F.col("y")).alias("pq"), "points", "upto")


def digests(ends: DataFrame) -> DataFrame:
    """(p, q, sha) from (p, q, conv_id): SHA-256 of the ids in ascending order, joined by commas. Blocks of ids are joined side by side; a node's blocks pass in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK_IDS).cast("long").alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        pack = lambda done: pa.RecordBatch.from_pydict({"p": pa.array([k[0] for k, _ in done], pa.int64()), "q": pa.array([k[1] for k, _ in done], pa.int64()), "sha": pa.array([s for _, s in done], pa.string())})
        for b in batches:
            done = []
            for p, q, text in zip(*[b.column(c).to_pylist() for c in ("p", "q", "ids")]):
                if (p, q) != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = (p, q), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pack(done)
        if key is not None:
            yield pack([(key, sha.hexdigest())])

    return by_key(blocks, NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "p long, q long, sha string")


# --- balanced parentheses ---------------------------------------------------------------------------------------


class Parentheses:
    """A sequence of parentheses (true opens) with its excess in blocks, and a tree of least and greatest values over the blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.n = bits, len(bits)
        blocks = -(-self.n // BLOCK_BITS)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        top = np.iinfo(np.int32).max
        excess = np.full(self.leaves * BLOCK_BITS, top, np.int32)
        excess[: self.n] = np.cumsum(np.where(bits, 1, -1))
        self.excess = excess.reshape(self.leaves, BLOCK_BITS)
        self.least = np.full(2 * self.leaves, top, np.int32)
        self.most = np.full(2 * self.leaves, -top, np.int32)
        self.least[self.leaves :] = self.excess.min(axis=1)
        self.most[self.leaves :] = np.where(self.excess == top, -top, self.excess).max(axis=1)
        level = self.leaves // 2
        while level:
            child = np.arange(level, 2 * level) * 2
            self.least[level : 2 * level] = np.minimum(self.least[child], self.least[child + 1])
            self.most[level : 2 * level] = np.maximum(self.most[child], self.most[child + 1])
            level //= 2

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where each of ``opens`` closes: the first place behind it with an excess one lower. Steps of one go both ways, so a block holds it if the value lies between its least and its greatest."""
        block, inner = opens // BLOCK_BITS, opens % BLOCK_BITS
        goal = self.excess[block, inner] - 1
        out = np.full(len(opens), -1)
        for lo in range(0, len(opens), 1 << 14):  # matrices of a bounded size
            own = slice(lo, lo + (1 << 14))
            hit = (self.excess[block[own]] == goal[own, None]) & (np.arange(BLOCK_BITS) > inner[own, None])
            out[own] = np.where(hit.any(axis=1), block[own] * BLOCK_BITS + hit.argmax(axis=1), -1)
        left = np.flatnonzero(out < 0)
        node, aim = block[left] + self.leaves, goal[left]
        up = np.arange(len(left))
        while len(up):  # up to the nearest neighbour to the right that holds the value
            right = np.minimum(node[up] + 1, len(self.least) - 1)
            found = (node[up] % 2 == 0) & (self.least[right] <= aim[up]) & (self.most[right] >= aim[up])
            node[up] = np.where(found, right, node[up] // 2)
            up = up[~found]
        while (low := node < self.leaves).any():  # and down to its first block
            node[low] = np.where(self.least[2 * node[low]] <= aim[low], 2 * node[low], 2 * node[low] + 1)
        for lo in range(0, len(left), 1 << 14):
            own = slice(lo, lo + (1 << 14))
            b = node[own] - self.leaves
            out[left[own]] = b * BLOCK_BITS + (self.excess[b] == aim[own, None]).argmax(axis=1)
        return out


def shard_sums(lengths: np.ndarray, p: np.ndarray, q: np.ndarray, worth: np.ndarray, leaf: np.ndarray) -> dict[str, np.ndarray]:
    """For every node of the sorted paths (``lengths`` places each): its key, the leaves and the worth of its subtree, and whether it lies on a spine.

    A place may say again what it said for an earlier path through the same node; the worth of a node is said once, wherever that is.
    """
    starts = np.cumsum(lengths) - lengths
    path = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(p)) - starts[path]
    # places in common with the path before
    there = (path > 0) & (depth < lengths[np.maximum(path - 1, 0)])
    before = np.where(there, starts[np.maximum(path - 1, 0)] + depth, 0)
    same = there & (p == p[before]) & (q == q[before])
    shared = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, depth), starts)
    shared = np.minimum(shared, lengths)
    new = depth >= shared[path]
    opened = lengths - shared
    closed = np.concatenate([[0], lengths[:-1]])
    closed = np.maximum(closed - shared, 0)
    runs = np.stack([closed, opened], axis=1).ravel()
    bits = np.concatenate([np.repeat(np.tile([False, True], len(lengths)), runs), np.zeros(lengths[-1], bool)])
    opens = np.flatnonzero(bits)
    # the node of a place that was opened by an earlier path
    node, stack = np.zeros(len(p), np.int64), np.zeros(int(lengths.max()), np.int64)
    node[new] = np.arange(len(opens))
    for i in np.flatnonzero(shared > 0).tolist():
        last = i - 1
        stack[shared[last] : lengths[last]] = node[starts[last] + shared[last] : starts[last] + lengths[last]]
        node[starts[i] : starts[i] + shared[i]] = stack[: shared[i]]
    own = np.bincount(node, worth, minlength=len(opens)) if len(p) else worth
    ends = Parentheses(bits).find_close(opens)
    pairs = np.zeros(len(bits) + 1, np.int64)
    pairs[opens[leaf[new]] + 1] = 1  # rank of the pairs () that are leaves of the whole trie
    pairs = np.cumsum(pairs)
    sums = np.zeros(len(bits) + 1)
    sums[opens + 1] = own
    sums = np.cumsum(sums)
    spine = np.zeros(len(opens), bool)
    spine[node[: lengths[0]]] = True
    spine[node[starts[-1] : starts[-1] + lengths[-1]]] = True
    return {"p": p[new], "q": q[new], "leaves": pairs[ends + 1] - pairs[opens], "saved": np.rint(sums[ends + 1] - sums[opens]).astype(np.int64), "spine": spine}


_OUT = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("spine", pa.bool_())])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(parts: list[pa.Array]) -> pa.RecordBatch:
        paths = pa.concat_arrays(parts)
        lengths, flat = paths.value_lengths().to_numpy(), paths.flatten()
        get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        out = shard_sums(lengths.astype(np.int64), get("p"), get("q"), get("worth").astype(float), get("leaf"))
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _OUT], schema=_OUT)

    parts, size = [], 0
    for b in batches:
        step = 256
        for lo in range(0, b.num_rows, step):
            part = b.column("path").slice(lo, step)
            if size and size + len(part.flatten()) > SHARD_PLACES:
                yield made(parts)
                parts, size = [], 0
            parts.append(part)
            size += len(part.flatten())
    if parts:
        yield made(parts)


# --- the trie ---------------------------------------------------------------------------------------------------


def _none() -> Column:
    return F.lit(0).cast("long")


def prefix_trie(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every distinct prefix of the conversations of ``rows`` (as from ``ordered``), the empty one included.

    ``conversations``: all their ids, if some may have no row. No conversations give no nodes. A conversation may be of any length and any share of the rows, and any number
    of them may be equal: of a group of copies one goes on, with their number; only the places at which it still runs together with a different conversation go into one row.
    """
    keys = cut(keyed(rows))
    convs = (rows.select("conv_id") if conversations is None else conversations).distinct()
    last = keys.groupBy("conv_id").agg(F.max_by(F.struct("p", "q"), "d").alias("k"), F.sum("points").alias("total"))
    ends = cut(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("k.p", _none()).alias("p"), F.coalesce("k.q", _none()).alias("q"), F.coalesce("total", _none()).alias("total")))
    shas = digests(ends)
    kinds = ends.groupBy(*NODE).agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.min("total").alias("total"))
    paths = cut(keys.join(kinds.select("conv_id", "copies", "total"), "conv_id"))  # one conversation of each group of copies
    nodes = cut(paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.min("pp").alias("pp"), F.min("pq").alias("pq"), F.min("points").alias("points"), F.sum("copies").alias("n_convs"),
        F.count("*").alias("kinds"), F.min(F.col("total") - F.col("upto") + F.col("points")).alias("below"),
    ))
    # below the last node that two different conversations share: a chain
    chains = nodes.where("kinds = 1").select(*NODE, "conv_id", "depth", F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("below")).alias("saved_tokens"))
    heads = chains.groupBy("conv_id").agg(F.min_by(F.struct(F.col("depth").alias("d"), "p", "q", F.col("saved_tokens").alias("worth"), F.lit(True).alias("leaf")), "depth").alias("place"))
    open_ = nodes.where("kinds > 1").select(*NODE, F.col("conv_id").alias("owner"), ((F.col("n_convs") - 1) * F.col("points")).alias("worth"))
    shared = paths.join(open_, NODE).select("conv_id", F.struct("d", "p", "q", F.when(F.col("conv_id") == F.col("owner"), F.col("worth")).otherwise(0).alias("worth"), F.lit(False).alias("leaf")).alias("place"))
    trails = shared.union(heads).groupBy("conv_id").agg(F.array_sort(F.collect_list("place")).alias("path"))
    order = F.transform("path", lambda x: F.struct(x["p"], x["q"]))
    sums = cut(trails.select("path", order.alias("_o")).repartitionByRange("_o").sortWithinPartitions("_o").select("path").mapInArrow(_shards, "p long, q long, leaves long, saved long, spine boolean"))
    merged = sums.where("spine").groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).union(sums.where("not spine").select(*NODE, "leaves", "saved"))
    inner = nodes.where("kinds > 1").join(merged, NODE).select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    below = inner.union(chains.select(*NODE, "n_leaves", "saved_tokens"))
    # the root
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    totals = heads.agg(F.count("*").alias("n_leaves"), F.coalesce(F.sum("place.worth"), _none()).alias("chained")).crossJoin(open_.agg(F.coalesce(F.sum("worth"), _none()).alias("open")))
    root = top.crossJoin(totals).select(_none().alias("p"), _none().alias("q"), "conv_id", _none().alias("depth"), _none().alias("pp"), _none().alias("pq"), "n_convs", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("chained") + F.col("open")).alias("saved_tokens"))
    every = nodes.join(below, NODE).select(*NODE, "conv_id", "depth", "pp", "pq", "n_convs", "n_leaves", "saved_tokens").union(root)
    children = nodes.groupBy(F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("parent"))
    out = every.join(children, NODE, "left").join(shas, NODE, "left").join(parents, ["pp", "pq"], "left").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("_least"))))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.col("_least")).when(F.col("depth") > 1, F.col("parent")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", _none()).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
