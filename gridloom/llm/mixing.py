"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus one drawn copy.

Everything here is DataFrame expressions. Only per-source totals are aggregated, with partial sums before the shuffle,
so a source that holds a third of all rows is one row a task when it reaches the exchange. A copy is drawn by id, text
and, for rows that are equal in id, source and text, their number among these.

Edge cases: a null text has size 0; null is a source of its own, the last in order; a source without words has target
0 and its documents are never taken; ids may be null or repeat, each row has its own draw, and reruns agree; an empty
table gives an empty result; other columns of the input are neither read nor returned by `rates` and `mix`, and
`repeat` returns exactly the input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import HOT_KEYS, cut, numbered, split_by, spread_join

#: A word is a run of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources in order weigh this much, over and over.
WEIGHTS = (1, 2, 3)
#: No source is taken more than so many times over.
MOST = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def rates(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate, weight) for rows of (source, size); weight is the number of a source's rows.

    Targets share the sum of all sizes by weight; a target stops at `most` times its source's size and the excess is
    shared again. The level at which no more targets stop is found in one ordered pass over the sources.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", most * F.col("source_size"))
    ranked = ranked.withColumn("stops_at", F.col("stop") / F.col("weight"))
    below = Window.orderBy("stops_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("stops_at", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(below), F.lit(0)))
        / F.sum("weight").over(onward),
    )
    level = F.min_by(F.when(F.col("level") <= F.col("stops_at"), F.col("level")),
                     F.when(F.col("level") <= F.col("stops_at"), F.struct("stops_at", "place"))).over(everything)
    ranked = ranked.withColumn("target", F.least(F.col("stop").cast("double"), level * F.col("weight")))
    return ranked.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        F.col("rows").alias("weight"),
    )


def draw(doc_id: Column, digest: Column, nth: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id, the text's digest, the occurrence and the seed alone."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, nth.cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / float(2**52)


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (drawn < rate - whole).cast("long")).cast("long")


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def source_key(source: Column) -> Column:
    """Another string for each source, null among them."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def counted(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """rows with __nth, the number of a row among those equal in __key, for rows that sized holds too.

    Keys that repeat are found on the hashes alone; only rows that may have one are numbered.
    """
    repeated = sized.groupBy("__key").count().where("count > 1").select("__key")
    some, others = split_by(rows, repeated, "__key")
    return others.withColumn("__nth", F.lit(0).cast("long")).unionByName(numbered(some, ["__key"], "__nth").withColumn("__nth", F.col("__nth").cast("long")))


def with_sources(rows: DataFrame, per_source: DataFrame, total: int) -> DataFrame:
    """Up to HOT_KEYS sources are sent to the rows; of more only the large ones, and the others are joined by shuffle."""
    per_source = cut(per_source)
    if per_source.count() <= HOT_KEYS:
        return rows.join(F.broadcast(per_source.drop("weight")), "__source")
    return spread_join(rows, per_source, "__source", total)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies), one row for each row of docs."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), digest_of(F.col("text")).alias("digest"))
    sized = cut(sized.withColumns({"__key": F.xxhash64("doc_id", "source", "digest"), "__source": source_key(F.col("source"))}))
    per_source = rates(sized, weights, most).withColumn("__source", source_key(F.col("source"))).drop("source")
    joined = with_sources(counted(sized, sized), per_source, sized.count())
    taken = copies(F.col("rate"), draw(F.col("doc_id"), F.col("digest"), F.col("__nth"), seed))
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", taken.alias("copies"))


def repeat(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: the columns of docs, each document as often as it is taken."""
    text, own = docs["text"], {"__source": source_key(docs["source"]), "__digest": digest_of(docs["text"])}
    own["__key"] = F.xxhash64(docs["doc_id"], docs["source"], own["__digest"])
    sized = cut(docs.select("source", size_of(text).alias("size"), own["__key"].alias("__key")))
    per_source = rates(sized, weights, most).select(source_key(F.col("source")).alias("__source"), F.col("rate").alias("__rate"), "weight")
    joined = with_sources(counted(docs.withColumns(own), sized), per_source, sized.count())
    taken = joined.withColumn("__copies", copies(F.col("__rate"), draw(F.col("doc_id"), F.col("__digest"), F.col("__nth"), seed))).where("__copies > 0")
    again = F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast("int"))).alias("__again")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], again).drop("__again")
