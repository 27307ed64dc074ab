"""Matrices and datasets from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.matrix import SparseMatrix
from gridloom.sources.dataset import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines whose cells one task sums, about.
TASK_LINES = 250_000


def summed(lines: DataFrame, i: str, j: str, value, n: int) -> DataFrame:
    """The cells of n lines. Many lines are dealt to as many tasks as their number asks, so that a task's memory for sums,
    and for joins by place that follow, does not grow with the table."""
    placed = lines.withColumns({"i": F.col(i).cast("long"), "j": F.col(j).cast("long")})
    tasks = -(-n // TASK_LINES)
    if tasks > lines.sparkSession.sparkContext.defaultParallelism:
        placed = placed.repartition(tasks, "i", "j")
    return placed.groupBy("i", "j").agg(value.alias("v"))


def supply(spark: SparkSession, sf_dir: str, value=None) -> SparseMatrix:
    """Suppliers by parts: the quantity of all lines, or another aggregate of them."""
    value = F.sum("l_quantity") if value is None else value
    shape = table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()
    lines = table(spark, sf_dir, "lineitem")
    return SparseMatrix(shape, cells=summed(lines, "l_suppkey", "l_partkey", value, lines.count()))


def supply_lines(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    return supply(spark, sf_dir, F.count("*").cast("double"))


def basket(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Orders by parts; some orders have no line."""
    shape = table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "part").count()
    lines = table(spark, sf_dir, "lineitem")
    return SparseMatrix(shape, cells=summed(lines, "l_orderkey", "l_partkey", F.sum("l_quantity"), lines.count()))


def activity(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Users by a number in the events' properties: how often."""
    events = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    bounds = events.agg(F.max("user_id").alias("u"), F.max("k").alias("k"), F.count("k").alias("n")).first()
    cells = summed(events.where("k IS NOT NULL"), "user_id", "k", F.count("*").cast("double"), bounds["n"])
    return SparseMatrix(((bounds["u"] or 0) + 1, (bounds["k"] or 0) + 1), cells=cells)


def vectors(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Vectors by component: signed, and every cell stored."""
    rows = table(spark, sf_dir, "embeddings")
    shape = rows.count(), rows.select(F.max(F.size("embedding"))).first()[0] or 0
    cells = rows.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return SparseMatrix(shape, cells=cells.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")))


def supply_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    obs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), "s_name", "s_nationkey", "s_acctbal")
    var = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("j"), "p_brand", "p_type", "p_size", "p_retailprice")
    x = supply(spark, sf_dir)
    near = obs.select("i", (F.col("i") + 1).alias("i2"), F.lit(1.0).alias("v")).where(F.col("i2") < x.shape[0])
    return Dataset(x, obs, var, raw=x, layers={"lines": supply_lines(spark, sf_dir)}, obsp={"near": near}, uns={"unit": "pieces"}, obs_label="s_name")
