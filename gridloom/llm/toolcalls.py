"""Tool-call linking in chat messages, in DataFrame expressions alone.

Messages are rows (conv_id, turn, role, text). An assistant's text that is a JSON object with `tool_calls`, a list of
{"id", "name", "arguments", "after"}, makes calls; a text of role `tool` that is an object {"tool_call_id", "content"}
is a result. Calls and results are joined by conversation and identifier, the n-th call of an identifier with its n-th
result. Calls may name others that they come after; depths along these names order them, and calls on a cycle have none.
Arguments are checked against schemas, and everything is written as canonical JSON: sorted keys, no white space, numbers
in one form, or as they are written where that form would change them.

The result has a row for each message that is no result and says something beside its calls or makes none, one for each
call and one for each result, with the places that order a conversation: sort by (anchor, depth, slot, turn). A
conversation is never gathered into one row or task, however long it is.

Edge cases: text that is no JSON object, or none of these, is plain content; a null text is null content; null ids and
turns stay null and link nothing; a result without a call has `linked` false and keeps its own turn; arguments that are
no object, or have a key twice, are invalid and written as a string; a null role is that of plain content; repeated rows are repeated calls and results; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, partitions

CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
#: What Spark calls the kinds of JSON values, by the name that schemas use.
KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*", "array": "^ARRAY.*", "null": "^VOID$",
}


#: Numbers that a decimal of 38 digits or a double may change: long ones, and ones with three digits of exponent.
LONG_NUMBER = (
    r"(?<![\w.+-])-?(?:(?=[\d.]{17,}[eE])\d+(?:\.\d+)?[eE][+-]?\d+|\d+(?:\.\d+)?[eE][+-]?\d{3,}|(?=(?:\d\.?){39})\d+(?:\.\d+)?)(?![\w.+-])"
)
#: Characters for private use that stand for the ends of such a number, a backslash and a quote while it is set apart.
NUMBER, BACKSLASH, QUOTE = "\ue000", "\ue001", "\ue002"


def has_long(text: Column) -> Column:
    return F.rlike(text, F.lit(LONG_NUMBER))


def is_odd(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{NUMBER}{BACKSLASH}{QUOTE}]"))


def marked(text: Column) -> Column:
    """JSON text whose long numbers are strings between two marks; null if it has such numbers and marks of its own."""
    simple = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    # A string is followed by empty marks, which go again; only numbers outside strings keep theirs.
    found = F.regexp_replace(simple, f'("[^"]*")|({LONG_NUMBER})', f'$1"{NUMBER}$2{NUMBER}"')
    found = F.replace(found, F.lit(f'"{NUMBER}{NUMBER}"'), F.lit(""))
    found = F.replace(F.replace(found, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))
    return F.when(~has_long(text), text).when(~is_odd(text), found)


def unmarked(text: Column) -> Column:
    """What was marked as it was written."""
    return F.regexp_replace(text, f'"?{NUMBER}([^"{NUMBER}]+){NUMBER}"?', "$1")


def canonical(text: Column) -> Column:
    """JSON text in one form: variants keep the keys of objects sorted; null for what is no JSON.

    Numbers that a variant would change are kept as they are written. A text with such a number and a mark of its own is
    taken for no JSON.
    """
    as_it_is = F.to_json(F.try_parse_json(text))
    return F.when(~has_long(text), as_it_is).otherwise(unmarked(F.to_json(F.try_parse_json(marked(text)))))


def problems(calls: DataFrame, schemas: dict[str, dict]) -> Column:
    """What is wrong with each call's arguments, in order; schemas: {name: {"properties": {key: {"type"}}, "required": []}}."""
    known = {n: {k: p.get("type", "") for k, p in s.get("properties", {}).items()} for n, s in schemas.items()}
    # Schemas are settings of the job, a few kB, and become literals.
    kinds = F.from_json(F.lit(json.dumps(known)), "map<string,map<string,string>>")
    needed = F.from_json(F.lit(json.dumps({n: s.get("required", []) for n, s in schemas.items()})), "map<string,array<string>>")
    own, required = F.try_element_at(kinds, F.col("name")), F.try_element_at(needed, F.col("name"))
    given = F.from_json("arguments", "map<string,variant>")
    pattern = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    entries = F.map_entries(given)
    missing = F.transform(F.array_except(required, F.map_keys(given)), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.array_contains(F.map_keys(own), k)), lambda k: F.concat(F.lit("unknown:"), k))

    def mismatched(e: Column) -> Column:
        wanted = F.try_element_at(pattern, F.try_element_at(own, e["key"]))
        return wanted.isNotNull() & ~F.rlike(F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")), wanted)

    wrong = F.transform(F.filter(entries, mismatched), lambda e: F.concat(F.lit("type:"), e["key"]))
    is_object = F.coalesce(F.trim("arguments").startswith("{"), F.lit(False)) & given.isNotNull()
    found = (
        F.when(F.col("name").isNull() | own.isNull(), F.array(F.lit("no schema")))
        .when(~is_object, F.array(F.lit("no object")))
        .otherwise(F.concat(missing, unknown, wrong))
    )
    return F.array_join(F.sort_array(found), ",")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls with an identifier; a call on or behind a cycle has depth null.

    A call's depth is the greatest of its terms: a number, or what another call's depth is and a number more. Each round
    places the calls whose terms are all numbers, and puts these, and calls with one open term, in the place of their
    names: a chain halves each round, and no call has more terms than it began with. A round that places none has
    cycles and what is behind them left.
    """
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("before")).where("call_id IS NOT NULL").distinct()
    edges = edges.join(named.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi")
    most, placed = partitions(calls.sparkSession), 0
    number = lambda n: F.lit(n).cast("long").alias("more")
    terms = cut(
        named.select("conv_id", "call_id", F.lit(None).cast("string").alias("before"), number(0))
        .unionByName(edges.select("conv_id", "call_id", "before", number(1)))
    )
    while True:
        open_term = F.struct("before", "more")
        calls_now = terms.groupBy("conv_id", "call_id").agg(
            F.count("before").alias("open"), F.max(F.when(F.col("before").isNull(), F.col("more"))).alias("known"),
            F.max(F.when(F.col("before").isNotNull(), open_term)).alias("one"),
        )
        calls_now = cut(calls_now.coalesce(most))
        before, placed = placed, calls_now.where("open = 0").count()
        if placed == before:
            break
        about = calls_now.select("conv_id", F.col("call_id").alias("before"), "open", "known", "one")
        found = terms.where("before IS NOT NULL").join(about, ["conv_id", "before"])
        # On cycles numbers would grow without end.
        more = lambda x: F.least(F.col("more") + x, F.lit(1 << 40)).alias("more")
        said = F.struct(F.lit(None).cast("string").alias("before"), more(F.col("known")))
        instead = F.struct(F.col("one.before").alias("before"), more(F.col("one.more")))
        again = F.array(F.when(F.col("open") <= 1, said), F.when(F.col("open") == 1, instead).when(F.col("open") > 1, open_term))
        opened = found.select("conv_id", "call_id", F.explode(F.array_compact(again)).alias("t")).select("conv_id", "call_id", "t.before", "t.more")
        terms = opened.unionByName(terms.where("before IS NULL")).groupBy("conv_id", "call_id", "before").agg(F.max("more").alias("more"))
        terms = cut(terms.coalesce(most))
    return calls_now.select("conv_id", "call_id", F.when(F.col("open") == 0, F.col("known").cast("int")).alias("depth"))


def link(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, kind, call_id, anchor, depth, slot, linked, problems, json): a row for each message and each call."""
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("long", has_long(F.col("text")))
    plainly = lambda c: F.when(F.col("long"), unmarked(c)).otherwise(c)
    said = F.when(F.col("role") == "assistant", F.from_json(marked(F.col("text")), CALLS))
    made = said["tool_calls"]
    got = F.when(F.col("role") == "tool", F.from_json(marked(F.col("text")), RESULT))
    nth = lambda *order: F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*order))
    calls = rows.select("conv_id", "turn", "long", F.posexplode(made).alias("slot", "c")).select(
        "conv_id", "turn", "slot", plainly(F.col("c.id")).alias("call_id"), plainly(F.col("c.name")).alias("name"),
        plainly(F.col("c.arguments")).alias("arguments"), F.transform("c.after", plainly).alias("after"),
    )
    calls = cut(calls.withColumn("nth", nth("turn", "slot", "arguments")))
    results = rows.where(got["tool_call_id"].isNotNull()).select("conv_id", "turn", plainly(got["tool_call_id"]).alias("call_id"), plainly(got["content"]).alias("content"))
    results = cut(results.withColumn("nth", nth("turn", "content")))
    placed = calls.join(depths(calls).withColumnRenamed("depth", "chain"), ["conv_id", "call_id"], "left")
    # Calls that nothing precedes are not among the depths.
    depth = F.when(F.coalesce(F.size("after"), F.lit(0)) <= 0, 0).otherwise(F.col("chain"))
    placed = cut(placed.select("conv_id", "turn", "slot", "call_id", "nth", "name", "arguments", depth.alias("depth")))
    answered = results.select("conv_id", "call_id", "nth", F.lit(True).alias("linked"))
    own = ["conv_id", "call_id", "nth"]
    call_rows = placed.join(answered, own, "left").select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("turn").alias("anchor"), "depth", F.col("slot").cast("long").alias("slot"),
        F.coalesce("linked", F.lit(False)).alias("linked"), problems(placed, schemas or {}).alias("problems"),
        written({"arguments": F.coalesce(canonical(F.col("arguments")), quoted("arguments")), "id": quoted("call_id"), "name": quoted("name")}).alias("json"),
    )
    asked = placed.select(*own, F.col("turn").alias("asked_at"), F.col("slot").alias("asked_as"), F.col("depth").alias("asked_depth"))
    result_rows = results.join(asked, own, "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.coalesce("asked_at", "turn").alias("anchor"),
        F.coalesce("asked_depth", F.lit(0)).alias("depth"), F.coalesce("asked_as", F.lit(0)).cast("long").alias("slot"),
        F.col("asked_at").isNotNull().alias("linked"), F.when(F.col("asked_at").isNull(), "no call").otherwise("").alias("problems"),
        written({"content": F.coalesce(canonical(F.col("content")), quoted("content")), "tool_call_id": quoted("call_id")}).alias("json"),
    )
    # What a message says beside its calls is its content; one that only calls is whole in its call rows.
    spoken = rows.where(got["tool_call_id"].isNull() & (made.isNull() | (F.size(made) == 0) | said["content"].isNotNull()))
    plain = spoken.withColumn("content", F.when(made.isNull(), F.col("text")).otherwise(plainly(said["content"]))).select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("anchor"), F.lit(0).alias("depth"),
        F.lit(-1).cast("long").alias("slot"), F.lit(True).alias("linked"), F.lit("").alias("problems"),
        written({"content": quoted("content"), "role": quoted("role")}).alias("json"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def quoted(name: str) -> Column:
    """A string as JSON; null as null."""
    return F.coalesce(F.expr(f"substring(to_json(array({name})), 2, length(to_json(array({name}))) - 2)"), F.lit("null"))


def written(fields: dict[str, Column]) -> Column:
    """An object of fields whose values are JSON already, keys in order."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
