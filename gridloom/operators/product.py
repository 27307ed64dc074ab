"""Products with dense vectors (k, x) and dense matrices (k, c, x) in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import SparseMatrix

#: A dense operand is broadcast up to this many places; longer ones are joined by shuffle.
BROADCAST_PLACES = 1_000_000


def checked(length: int, axis_length: int) -> None:
    if length != axis_length:
        raise ValueError(f"an operand of length {length} is not aligned with an axis of length {axis_length}")


def hinted(operand: DataFrame, length: int, width: int = 1) -> DataFrame:
    return F.broadcast(operand) if length * width <= BROADCAST_PLACES else operand


def contracted(cells: DataFrame, operand: DataFrame, gone: str, left: str, extra: list[str], length: int, width: int) -> DataFrame:
    """Sums over the place `gone`; zeros of the operand are left out before the join."""
    useful = hinted(operand.where("x <> 0"), length, width)
    return cells.join(useful, F.col(gone) == F.col("k")).groupBy(left, *extra).agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def matvec(a: SparseMatrix, x: DataFrame, length: int) -> DataFrame:
    """a @ x: (i, y) for every row."""
    checked(length, a.shape[1])
    return a._filled(1, contracted(a.cells, x, "j", "i", [], length, 1), [F.coalesce("y", F.lit(0.0)).alias("y")])


def vecmat(x: DataFrame, a: SparseMatrix, length: int) -> DataFrame:
    """x @ a: (j, y) for every column."""
    checked(length, a.shape[0])
    return a._filled(0, contracted(a.cells, x, "i", "j", [], length, 1), [F.coalesce("y", F.lit(0.0)).alias("y")])


def grid(a: SparseMatrix, name: str, width: int) -> DataFrame:
    n = a.shape[name == "j"]
    columns = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c")
    return a.spark.range(n).select(F.col("id").alias(name), columns)


def matmat(a: SparseMatrix, b: DataFrame, length: int, width: int) -> DataFrame:
    """a @ b: (i, c, y) for every row and column of b."""
    checked(length, a.shape[1])
    sparse = contracted(a.cells, b, "j", "i", ["c"], length, width)
    return grid(a, "i", width).join(sparse, ["i", "c"], "left").select("i", "c", F.coalesce("y", F.lit(0.0)).alias("y"))


def matmat_left(b: DataFrame, a: SparseMatrix, length: int, width: int) -> DataFrame:
    """b @ a for b as (k, c, x), with c its row: (j, c, y)."""
    checked(length, a.shape[0])
    sparse = contracted(a.cells, b, "i", "j", ["c"], length, width)
    return grid(a, "j", width).join(sparse, ["j", "c"], "left").select("j", "c", F.coalesce("y", F.lit(0.0)).alias("y"))
