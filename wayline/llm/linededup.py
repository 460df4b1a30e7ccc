"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines of MIN_CHARS characters or more within THRESHOLD edits of each other are linked; of each class of linked or
equal lines the first occurrence stays (the smallest document id, then the first place in it). With ``short`` every
line that is not blank takes part: equal ones of any length, and from NEAR_CHARS characters on those one edit apart.

Each distinct line is split into threshold-plus-one segments. Two lines within the threshold have some segment of one
as it stands in the other, at a place that depends on the segment's number and on both lengths, so a line probes,
for each possible length, only those substrings. Keys with more than HUGE * HUGE comparisons are not compared pair by pair: a further segment of what is left of the line is added to the key, again and
again (what is left holds at most as many edits, so one of threshold-plus-one pieces of it matches again).
Pairs that meet must first have signatures close enough for the threshold (parities of the counts of characters, in long lines of words, and those of characters side by side); what
is left is verified with a banded bit-parallel edit distance over the part between the lines' common beginning and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh

THRESHOLD = 2
MIN_CHARS = 25
#: The shortest line that is compared by one edit; shorter ones must be equal.
NEAR_CHARS = 12
#: A key costs its own segments times all of its rows in comparisons. Up to CROWD own segments that is a few for each row; beyond, keys are dealt anew, and
#: keys of more than HUGE squared comparisons get longer. These bound the work for each key; pairs are the same on either side of them (tested).
CROWD, HUGE = 32, 4000
#: Up to so many rows of one or two numbers are broadcast (a few MB); more are shuffled.
SMALL = 100_000
#: Lines of up to so many characters have signatures by characters, longer ones by words.
SHORT = 80


def segments(length: Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each segment: as even as can be, the longer ones last."""
    size = F.floor(length / (threshold + 1)).cast("int")
    short = F.lit(threshold + 1) - length % (threshold + 1)
    return [(size * i + F.greatest(F.lit(0), F.lit(i) - short), size + F.when(F.lit(i) >= short, 1).otherwise(0)) for i in range(threshold + 1)]


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift) of the substrings to look up. Shift 0 in lines of equal length is the line's own segment."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            for shift in range(max(-i, less - threshold + i), min(i, less + threshold - i) + 1):
                if less or shift:
                    out.append((less, i, shift))
    return out


def _keys(lines: DataFrame, threshold: int, least: int, *more: str) -> DataFrame:
    """Rows (key, h, own): each line's own segments and its probes; ``more`` may add at (segment), lx (the other line's length) and line."""
    looks = [(0, i, 0) for i in range(threshold + 1)] + probes(threshold)
    spec = F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("at"), F.lit(shift).alias("shift")) for less, i, shift in looks])
    # a short list that every line is crossed with: one small expression for the key stays within the compiler's limits
    rows = lines.select("h", "line", "length", F.inline(spec))
    rows = rows.withColumn("lx", F.col("length") - F.col("less"))
    size = F.floor(F.col("lx") / (threshold + 1)).cast("int")
    extra = F.greatest(F.lit(0), F.col("at") - (threshold + 1) + F.col("lx") % (threshold + 1))
    start = size * F.col("at") + extra + F.col("shift")
    size = size + F.when(F.col("at") >= F.lit(threshold + 1) - F.col("lx") % (threshold + 1), 1).otherwise(0)
    rows = rows.withColumn("_s", start).withColumn("_n", size).where((F.col("_s") >= 0) & (F.col("_s") + F.col("_n") <= F.col("length")) & (F.col("lx") >= least))
    key = F.xxhash64("lx", "at", F.substring(F.col("line"), F.col("_s") + 1, F.col("_n")))
    return rows.select("h", key.alias("key"), F.expr("less = 0 and shift = 0").alias("own"), *more)


def signature(line: Column) -> Column:
    """63 parities of how often characters (words in long lines) occur, by hash; the top bit tells which."""
    short = F.char_length(line) <= SHORT
    units = F.when(short, F.split(line, "")).otherwise(F.split(line, " "))
    bit = lambda u: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(u), F.lit(63)).cast("int"))
    return F.aggregate(units, F.when(short, F.lit(0)).otherwise(F.lit(-(1 << 63))).cast("long"), lambda a, u: a.bitwiseXOR(bit(u)))


def neighbours(line: Column) -> Column:
    """63 parities of how often two characters stand side by side, for lines of any length: a replaced word flips more of them than the edits allow, where letters alone are much the same."""
    bit = lambda u: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(u, F.lit(63)).cast("int"))
    both = lambda cs: F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.xxhash64(a, b))
    return F.aggregate(_let(F.filter(F.split(line, ""), lambda c: c != ""), both), F.lit(0).cast("long"), lambda a, u: a.bitwiseXOR(bit(u)))


def _alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether signatures allow ``threshold`` edits: one flips at most two parities of characters, or three of words. Signatures of different kinds allow anything."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return (a.bitwiseXOR(b) < 0) | (apart <= F.when(a < 0, 3 * threshold).otherwise(2 * threshold))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(xs: Column, ys: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters (plain columns, as they are read at every step), or a number above ``threshold``.

    Only a diagonal band of 2 * threshold + 2 cells is kept, as differences in the bits of two numbers that move down
    the band with each character of ``y`` (``xs`` must not be the shorter one). The top bit follows the lower edge of the band until it
    meets the end of ``xs``; from there the distance is followed along the last row.
    """
    width = 2 * threshold + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda v: F.lit(v).cast("long")
    inv = lambda v: v.bitwiseXOR(long(full))
    m = F.size(xs)

    def step(s: Column, j: Column) -> Column:
        eq = long(0)
        for b in range(width):
            at = j + (threshold - width + 1 + b)
            eq = eq + F.when((at >= 0) & (at < m) & (F.get(xs, at) == F.get(ys, j)), long(1 << b)).otherwise(long(0))

        def after(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(inv(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            low = F.shiftright(d0, 1)
            edge = j - (m - threshold)  # below zero the top bit's row is still inside xs
            row = F.call_function("shiftright", F.lit(top >> 1).cast("long"), F.greatest(edge, F.lit(0)))
            on = lambda v: F.when(v.bitwiseAND(row) != 0, 1).otherwise(0)
            gain = F.when(edge < 0, F.when(d0.bitwiseAND(long(top)) != 0, 0).otherwise(1)).otherwise(on(hp) - on(hn))
            return F.struct(hn.bitwiseOR(inv(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), (s["d"] + gain).alias("d"))

        return _let(eq, lambda e: _let(e.bitwiseAND(s["vp"]).__add__(s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(e).bitwiseOR(s["vn"]).bitwiseAND(long(full)), after))

    start = F.struct(long(full ^ ((1 << (width - threshold - 1)) - 1)).alias("vp"), long(0).alias("vn"), F.lit(threshold).alias("d"))
    steps = F.when(F.size(ys) > 0, F.sequence(F.lit(0), F.size(ys) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["d"])


def _meet(rows: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs a < b of rows (key, h, own, sig, beside) that share a key, one of them at least with its own segment, and have both signatures alike."""
    own = rows.where("own").select("key", F.col("h").alias("x"), F.col("sig").alias("xs"), F.col("beside").alias("xc"))
    other = rows.select("key", "h", "sig", "beside")
    near = _alike(F.col("xs"), F.col("sig"), threshold) & (F.bit_count(F.col("xc").bitwiseXOR(F.col("beside"))) <= 4 * threshold)  # an edit takes two of them at most and makes two
    pairs = own.join(other, (own["key"] == other["key"]) & (F.col("x") != F.col("h")) & near)
    return pairs.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b"))


def _halves(free: Column, threshold: int) -> Column:
    """Splits pieces in two until there are threshold-plus-one of them."""
    for _ in range(threshold + 1):
        split = F.flatten(F.transform(free, lambda p: F.array(
            F.struct(p["s"].alias("s"), F.floor(p["l"] / 2).cast("int").alias("l")),
            F.struct((p["s"] + F.floor(p["l"] / 2)).cast("int").alias("s"), (p["l"] - F.floor(p["l"] / 2)).cast("int").alias("l")))))
        free = F.when(F.size(free) > threshold, free).otherwise(split)
    return free


def _crowded(rows: DataFrame, threshold: int) -> DataFrame:
    """Candidates among rows (key, h, own, line, free) of crowded keys: the key is made longer by one more piece until few share it."""
    out, shifts = None, list(range(-threshold, threshold + 1))
    for _ in range(16):
        pieces = rows.withColumn("free", _halves(F.col("free"), threshold)).select("*", F.posexplode("free").alias("k", "p"))
        rest = F.filter("free", lambda q, n: n != F.col("k"))
        longer = lambda shift: F.xxhash64("key", "k", F.substring(F.col("line"), F.col("p.s") + 1 + shift, F.col("p.l")))
        at = F.explode(F.when(F.col("own"), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, shifts))))
        moved = pieces.select("*", at.alias("shift")).where("p.s + shift >= 0 and p.s + shift + p.l <= char_length(line)")
        made = cut(moved.select(longer(F.col("shift")).alias("key"), "h", "own", "sig", "beside", "line", rest.alias("free"), F.col("p.l").alias("l")).dropDuplicates(["key", "h", "own"]))
        full = made.groupBy("key").agg(F.count_if("own").alias("n"), F.count("*").alias("all"), F.max("l").alias("l")).where(f"n * (all - n) > {HUGE * HUGE} and l > 0").select("key")
        full = cut(full)
        few = _meet(made.join(full, "key", "left_anti").select("key", "h", "own", "sig", "beside"), threshold)
        out = few if out is None else out.union(few)
        if full.isEmpty():
            return out
        rows = made.join(full, "key").select("key", "h", "own", "sig", "beside", "line", "free")
    return out.union(_meet(rows.select("key", "h", "own", "sig", "beside"), threshold))


def line_links(lines: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS) -> DataFrame:
    """Pairs (a, b) of ids ``h`` of distinct lines (h, line, length), ``least`` characters long at least, within ``threshold`` edits."""
    keys = _keys(lines, threshold, least)
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("own").alias("own")).where("lo != hi and own").select("key")
    shared = cut(shared)
    rows = cut(_keys(lines, threshold, least).join(_few(shared), "key"))
    involved = cut(rows.select("h").distinct())
    signed = lines.join(_few(involved), "h", "left_semi").select("h", signature(F.col("line")).alias("sig"), neighbours(F.col("line")).alias("beside"))
    signed = cut(signed)
    rows = cut(rows.join(_few(signed), "h"))
    full = cut(rows.groupBy("key").agg(F.count_if("own").alias("n"), F.count("*").alias("all")).where(f"n > {CROWD} and all > {2 * CROWD}").select("key"))
    pairs = _meet(rows.join(_few(full), "key", "left_anti"), threshold)
    if not full.isEmpty():
        many = cut(_keys(lines, threshold, least, "line", "at", "lx").join(_few(full), "key").join(signed, "h"))  # few rows; what follows would be too large a plan to compile along with the keys
        huge = cut(many.groupBy("key").agg(F.count_if("own").alias("n"), F.count("*").alias("all")).where(f"n * all > {HUGE * HUGE}").select("key"))
        dense = many.join(_few(huge), "key", "left_anti").select("key", "h", "own", "sig", "beside")
        pairs = pairs.union(_meet(cut(dense), threshold))
        if not huge.isEmpty():
            many = many.join(_few(huge), "key")
            cuts = F.array(*[F.struct(s.cast("int").alias("s"), n.cast("int").alias("l")) for s, n in segments(F.col("lx"), threshold)])
            many = many.withColumn("free", F.filter(cuts, lambda p, i: i != F.col("at"))).select("key", "h", "own", "sig", "beside", "line", "free")
            # a line's own segment also meets, shifted, those of other lines of its length
            both = many.union(many.where("own").withColumn("own", F.lit(False)))
            pairs = pairs.union(_crowded(both, threshold))
    pairs = cut(pairs.distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    texts = cut(lines.join(_few(wanted), "h", "left_semi").select("h", "line"))
    left, right = texts.select(F.col("h").alias("a"), F.col("line").alias("x")), texts.select(F.col("h").alias("b"), F.col("line").alias("y"))
    chars = lambda c: F.filter(F.split(c, ""), lambda u: u != "")
    longer = F.char_length("x") >= F.char_length("y")
    held = pairs.join(left, "a").join(right, "b").select("a", "b", chars(F.when(longer, F.col("x")).otherwise(F.col("y"))).alias("x"), chars(F.when(longer, F.col("y")).otherwise(F.col("x"))).alias("y"))
    held = cut(_between(held))  # arrays stand as columns from here on
    return held.where(banded_distance(F.col("x"), F.col("y"), threshold) <= threshold).select("a", "b")


def _between(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the arrays x and y cut down to what lies between their common beginning and their common end; edits lie there alone."""
    differ = F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q))
    same = lambda d, most: F.least(most, F.coalesce(F.nullif(F.array_position(d, True), F.lit(0)) - 1, F.size(d).cast("long"))).cast("int")
    out = pairs.withColumn("_head", same(differ, F.size("y").cast("long")))
    differ = F.zip_with(F.reverse("x"), F.reverse("y"), lambda p, q: ~p.eqNullSafe(q))
    out = out.withColumn("_tail", same(differ, (F.size("y") - F.col("_head")).cast("long")))
    rest = lambda c: F.slice(c, F.col("_head") + 1, F.size(c) - F.col("_head") - F.col("_tail")).alias(c)
    return out.select("a", "b", rest("x"), rest("y"))


def _places(docs: DataFrame, id_col: str, text_col: str, short: bool) -> DataFrame:
    """Rows (id, row, pos, line) of the lines that take part."""
    made = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return made.where(F.regexp_like("line", F.lit(r"\S")) if short else F.char_length("line") >= MIN_CHARS)


def _names(line: Column) -> list[Column]:
    """A line's 128-bit name: two hashes with seeds of their own."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(h1, h2, class, first): the name of each line found more than once or near another, its class and the first document with a line of the class."""
    lines = _places(docs, id_col, text_col, short).groupBy("line").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # numbered as they are written: each distinct line has a number of its own
    lines = cut(lines.select(F.monotonically_increasing_id().alias("h"), "line", F.char_length("line").alias("length"), "first", "n"))
    links = line_links(lines.where(F.col("length") >= MIN_CHARS), threshold)
    if short:  # of two lines one edit apart the longer one may reach MIN_CHARS
        links = links.union(line_links(lines.where(F.col("length").between(NEAR_CHARS, MIN_CHARS)), 1, NEAR_CHARS))
    linked = components(links).withColumnsRenamed({"node": "h", "root": "class"})
    near = lines.select("h", *_names(F.col("line")), "first", "n").join(_few(linked), "h", "left").where("n > 1 or class is not null")
    near = near.select("h1", "h2", F.coalesce("class", "h").alias("class"), "first")
    firsts = near.groupBy("class").agg(F.min("first").alias("first"))
    return cut(near.select("h1", "h2", "class").join(firsts, "class").select("h1", "h2", "class", "first"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with ``lines_removed`` (long) and the text left after removing all but the first line of each class.

    Lines are split at \\n; shorter ones than MIN_CHARS stay unless ``short`` lets them take part; blank ones always stay. A null text stays null, an empty one empty;
    a text or line of any length takes part whole. Rows that repeat id and text are one document and are treated alike; equal ids with other texts count as the same
    place in the order. A ``lines_removed`` that came in is replaced; all other columns pass through, whatever their names. An empty table gives none.
    """
    names = [c for c in docs.columns if c.lower() != "lines_removed"]
    id_, row_, gone_ = fresh(docs, "id_of"), fresh(docs, "row_of"), fresh(docs, "gone")
    seen = _places(docs, id_col, text_col, short).select("id", "row", "pos", *_names(F.col("line")))
    seen = seen.join(_few(repeated_lines(docs, threshold, id_col, text_col, short)), ["h1", "h2"]).select("id", "row", "pos", "class", "first")
    ours = seen.where(F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "row", "class").agg(F.min("pos").alias("pos"))
    every = seen.select("id", "row", "pos", F.lit(1).alias("mark")).union(ours.select("id", "row", "pos", F.lit(0)))
    marks = every.groupBy("id", "row").agg(F.collect_set(F.when(F.col("mark") == 1, F.col("pos"))).alias("seen"), F.collect_set(F.when(F.col("mark") == 0, F.col("pos"))).alias("stay"))
    gone = marks.select(F.col("id").alias(id_), F.col("row").alias(row_), F.array_except("seen", "stay").alias(gone_)).where(F.size(gone_) > 0)
    held = docs.join(gone, docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text_col]) == F.col(row_)), "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    text = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return held.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], F.coalesce(F.size(gone_), F.lit(0)).cast("long").alias("lines_removed"))


def drop_repeats(docs: DataFrame, short: bool = False) -> DataFrame:
    """The documents with repeated lines removed, in the columns that came in; one that loses all of its lines, or all but blank ones, goes.

    Null and empty texts lose nothing and stay; rows that repeat id and text fare alike.
    """
    kept, mark = docs, None
    if "lines_removed" in docs.columns:  # set aside under another name
        mark = fresh(docs, "kept_lines_removed")
        kept = docs.withColumnRenamed("lines_removed", mark)
    out = dedup_lines(kept, short=short).where((F.col("lines_removed") == 0) | F.regexp_like("text", F.lit(r"\S"))).drop("lines_removed")
    return (out.withColumnRenamed(mark, "lines_removed") if mark else out).select(*[f"`{c}`" for c in docs.columns])
