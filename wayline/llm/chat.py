"""Chat formatting with linked tool calls, in DataFrame operations only.

Calls and results are hash-joined by conversation and call identifier, put in topological order (a result after
its call, a call after the results it waits for), arguments are validated against the tools' schemas,
and every item is serialised as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("message", "call", "result")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``status``: ok, duplicate (a later row for a call already made or answered), unanswered or orphan."""
    made = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("called"))
    got = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("answered"))
    both = made.join(got, ["conv_id", "call_id"], "full")
    at = ["conv_id", "call_id"]
    calls = calls.join(both, at, "left").withColumn("status", F.when(F.col("turn") > F.col("called"), "duplicate").when(F.col("answered").isNull(), "unanswered").otherwise("ok"))
    results = results.join(both, at, "left").withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("turn") > F.col("answered"), "duplicate").otherwise("ok"))
    return calls.drop("called", "answered"), results.drop("called", "answered")


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``, an array of texts, empty if the arguments fit: ``schemas`` (tool, field, type, required) has Spark's variant type names.

    Problems: 'unknown tool', 'not an object', and 'missing', 'unknown' or 'type' with the field's name, sorted.
    """
    fields = F.map_from_entries(F.collect_set(F.struct(F.col("field"), F.struct("type", "required"))))
    tools = schemas.groupBy("tool").agg(fields.alias("_fields"))
    parsed = calls.withColumn("_args", F.try_parse_json(F.col("arguments"))).join(tools, "tool", "left")
    is_map = F.coalesce(F.startswith(F.schema_of_variant("_args"), F.lit("OBJECT")), F.lit(False))
    entries = F.map_entries(F.when(is_map, F.col("_args")).cast("map<string,variant>"))
    given = F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.schema_of_variant(e["value"]).alias("t"))), F.array().cast("array<struct<k:string,t:string>>"))
    names = F.transform(given, lambda g: g["k"])
    odd = F.transform(given, lambda g: F.when(~F.map_contains_key("_fields", g["k"]), F.concat(F.lit("unknown "), g["k"])).when(F.element_at("_fields", g["k"])["type"] != g["t"], F.concat(F.lit("type "), g["k"])))
    lacking = F.transform(F.filter(F.map_entries("_fields"), lambda f: f["value"]["required"] & ~F.array_contains(names, f["key"])), lambda f: F.concat(F.lit("missing "), f["key"]))
    problems = F.array_sort(F.filter(F.concat(odd, lacking), lambda p: p.isNotNull()))
    problems = F.when(F.col("_fields").isNull(), F.array(F.lit("unknown tool"))).when(~is_map, F.array(F.lit("not an object"))).otherwise(problems)
    return parsed.withColumn("problems", problems).drop("_fields")


def order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological keys: ``nodes`` (conv_id, node, turn, one row each) with key_turn and key_step, ``edges`` (conv_id, src, dst).

    A node's key is its turn and step 0, or, if later, the key of a node it waits for with one more step. Only nodes
    behind something that stands after them move, so well-ordered conversations need one round; the rounds are as many as the longest
    chain of moves. Nodes on or behind a circle come to as many steps as there are nodes, or more, and stop at twice that: ``circular``.
    """
    limit = nodes.groupBy("conv_id").agg(F.count("*").alias("most"))
    state = cut(nodes.join(limit, "conv_id").select("conv_id", "node", "most", F.struct(F.col("turn").alias("t"), F.lit(0).alias("s")).alias("key")))
    edges = cut(edges.distinct())
    while True:
        from_ = state.select("conv_id", F.col("node").alias("src"), F.col("key").alias("src_key"))
        to = state.select("conv_id", F.col("node").alias("dst"), F.col("key").alias("dst_key"), "most")
        moved = edges.join(from_, ["conv_id", "src"]).join(to, ["conv_id", "dst"])
        later = F.struct(F.col("src_key.t").alias("t"), (F.col("src_key.s") + 1).alias("s"))
        moved = moved.where(later > F.col("dst_key")).where(F.col("src_key.s") < 2 * F.col("most")).groupBy("conv_id", F.col("dst").alias("node")).agg(F.max(later).alias("new"))
        moved = cut(moved)
        if moved.isEmpty():
            break
        state = cut(state.join(moved, ["conv_id", "node"], "left").select("conv_id", "node", "most", F.coalesce("new", "key").alias("key")))
    return state.select("conv_id", "node", F.col("key.t").alias("key_turn"), F.col("key.s").alias("key_step"), (F.col("key.s") >= F.col("most")).alias("circular"))


def _json(**fields: Column) -> Column:
    """Canonical JSON: keys in order, no blanks, nulls left out; variants have their keys in order by themselves."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def format_chat(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, key_turn, key_step, kind, turn, call_id, status, problems, json): a row for each message (conv_id, turn, role, text),
    call (conv_id, turn, call_id, tool, arguments, waits_for) and result (conv_id, turn, call_id, content).

    A conversation reads in the order (key_turn, key_step, turn, kind, call_id). Nothing is gathered by conversation, so one of any
    length is like many. Null texts are left out of the JSON; rows with a null conv_id or call_id link to nothing; repeated rows
    stay, and share their key; a call's ``problems`` are joined by commas ('' if valid). Texts and arguments of any length are taken whole. Other columns of the tables are
    ignored, whatever their names. Any table may be empty.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "waits_for")
    calls, results = link(calls, results.select("conv_id", "turn", "call_id", "content"))
    calls = validate(calls, schemas.select("tool", "field", "type", "required"))
    node = lambda kind: F.concat(F.lit(kind + ":"), F.col("call_id"))
    nodes = calls.select("conv_id", node("call").alias("node"), "turn").union(results.select("conv_id", node("result"), "turn")).where("node is not null and conv_id is not null")
    nodes = nodes.groupBy("conv_id", "node").agg(F.min("turn").alias("turn"))
    waits = calls.select("conv_id", F.explode("waits_for").alias("w"), node("call").alias("dst")).select("conv_id", F.concat(F.lit("result:"), "w").alias("src"), "dst")
    edges = waits.union(results.select("conv_id", node("call"), node("result"))).where("src is not null and dst is not null")
    keys = cut(order(nodes, edges))

    def placed(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn("node", node(kind)).join(keys, ["conv_id", "node"], "left")

    def out(rows: DataFrame, kind: str, json: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        has = lambda c, other: F.col(c) if c in rows.columns else other
        return rows.select(
            "conv_id", F.coalesce(has("key_turn", F.col("turn")), "turn").alias("key_turn"), F.coalesce(has("key_step", F.lit(0)), F.lit(0)).alias("key_step"), F.lit(kind).alias("kind"), "turn",
            has("call_id", none).alias("call_id"), F.when(has("circular", F.lit(False)), "circular").otherwise(has("status", F.lit("ok"))).alias("status"),
            (F.array_join("problems", ",") if kind == "call" else none).alias("problems"), json.alias("json"),
        )

    text = out(messages, "message", _json(role=F.col("role"), content=F.col("text")))
    call = out(placed(calls, "call"), "call", _json(role=F.lit("assistant"), id=F.col("call_id"), name=F.col("tool"), arguments=F.col("_args")))
    result = out(placed(results, "result"), "result", _json(role=F.lit("tool"), id=F.col("call_id"), content=F.col("content")))
    return text.unionByName(call).unionByName(result)


#: Tools of the calls that ``from_turns`` reads out of plain conversations.
TOOLS = [("search", "query", "STRING", True), ("search", "limit", "BIGINT", True), ("lookup", "query", "STRING", True), ("lookup", "limit", "BIGINT", False), ("note", "query", "STRING", True)]


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations, which have no tool calls of their own: an assistant's whole turn is read as the query of a call, and the user's next turn as its result.

    Each call waits for the one before. The tool goes by the turn's length, and calls whose length is a multiple of five give ``limit`` as a text, so all of validation is passed through.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.char_length(text)
    names = F.array(F.lit("search"), F.lit("lookup"), F.lit("note"))
    plain, quoted = F.to_json(F.struct(text.alias("query"), size.alias("limit"))), F.to_json(F.struct(text.alias("query"), size.cast("string").alias("limit")))
    at = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", at(0).alias("call_id"), F.get(names, size % 3).alias("tool"), F.when(size % 5 == 0, quoted).otherwise(plain).alias("arguments"), F.when(F.col("turn") >= 2, F.array(at(2))).otherwise(F.array().cast("array<string>")).alias("waits_for"),
    )
    results = turns.where("role = 'user' and turn > 0").select("conv_id", "turn", at(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
