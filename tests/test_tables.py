from pyspark.sql import functions as F

from gridloom.sources import tables


def test_many_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    lines = spark.range(6_000).select((F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 11).alias("l_partkey"), (F.col("id") % 3).cast("double").alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(11).write.parquet(f"{tmp_path}/part.parquet")
    few = tables.supply(spark, str(tmp_path))
    monkeypatch.setattr(tables, "TASK_LINES", 500)
    many = tables.supply(spark, str(tmp_path))
    assert many.cells.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, many.cells.collect())) == sorted(map(tuple, few.cells.collect()))
    plan = (many / tables.supply_lines(spark, str(tmp_path))).cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "12), REPARTITION_BY_NUM" in plan
