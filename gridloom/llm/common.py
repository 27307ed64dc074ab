"""Helpers shared by the text operators: shared folders, cut lineage, memory of workers, joins with hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context.getCheckpointDir()
        if current:
            return current
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


_held: dict[object, object] = {}


def held(key, make: Callable[[], T]) -> T:
    """make(), kept in this Python worker from task to task until another key is asked for or let_go() is called."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Forgets what this Python worker holds: it serves one stage after another, and what an operator keeps would
    otherwise lie beside what the next one needs."""
    _held.clear()


#: Rows that go to a Python worker at a time, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Rows of this session go to Python workers BATCH_ROWS at a time at most, from now on.

    Spark's own 10,000 whole texts are tens of MB on both sides of each task, and the executor's side grows by doubling.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A filter of keys has so many words of 64 bits, whatever it holds: 16 MB.
FILTER_WORDS = 1 << 20
#: A key is hot when it has more than one in so many of all rows; so many keys can be hot at most.
HOT_KEYS = 25_000


def split_by(frame: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(some, others) of frame: others have a hash in the long column `key` that is none of keys', and go no further.

    keys become a filter of FILTER_WORDS words, built where they are and sent to the rows, so that only those that it
    hits need an exact and shuffled join. It is of one size always; the fuller it is, the more rows it hits.
    """
    place = F.pmod(key, F.lit(64 * FILTER_WORDS))
    bit = F.expr(f"shiftleft(1L, cast(`{key}` & 63 AS INT))")
    words = keys.groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    words = F.broadcast(cut(words))
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    joined = frame.join(words, F.shiftright(place, 6) == F.col("__word"), "left").withColumn("__hit", hit).drop("__word", "__bits")
    return joined.where("__hit").drop("__hit"), joined.where("not __hit").drop("__hit")


def numbered(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """frame with a column that numbers the rows of equal keys, which hold no null, from 0.

    Rows are numbered where they are, and a partition's numbers start where the partitions before it ended, so that a
    key with any number of rows is in no one task.
    """
    held = cut(frame.withColumn("__part", F.spark_partition_id()))
    own = [*keys, "__part"]
    local = held.withColumn("__own", F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1))))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begin = held.groupBy(*own).agg(F.count("*").alias("__rows"))
    begin = begin.select(*own, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__begin"))
    both = local.join(begin, own).withColumn(name, F.col("__begin") + F.col("__own") - 1)
    return both.drop("__part", "__own", "__begin")


def spread_join(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of side, which has one row for each key and in `weight` how many of the `total` rows have it.

    Hot keys, HOT_KEYS at most, are sent to where their rows are; the others have few rows and are joined by shuffle.
    """
    side, most = cut(side), total // HOT_KEYS
    hot, others = side.where(F.col("weight") > most).drop("weight"), side.where(F.col("weight") <= most).drop("weight")
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(hot), key).unionByName(few)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges has two long columns a and b. Returns (node, root): root is the smallest node that can be reached.
    Nodes without an edge to another node are absent. Each round cuts its lineage; the edges stay on the executors
    and only a count reaches the driver.
    """
    current = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight")))
        about = lowest.agg(F.sum("weight").alias("total"), F.count_if(F.expr("m < u AND weight > 1")).alias("open")).first()
        # Settled when all are stars: whoever has a smaller neighbour has no other.
        if not about["open"]:
            break
        total = about["total"]
        # Every edge is taken from its larger end to the least neighbour of its smaller end.
        large = spread_join(current.select("v", F.col("u").alias("w")), lowest.withColumnRenamed("u", "v"), "v", total)
        large = large.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(lowest.where("m < u").select("u", F.col("m").alias("v")))
        large = cut(large.distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        small_star = spread_join(large, lowest, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(small_star.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
