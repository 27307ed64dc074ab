"""Filter and normalize a dataset in one plan: rows by a condition and by total, columns by total and detections.

Comparisons are strict but for the number of detections. The column filter sees the rows that the condition keeps,
before the filter on row totals; scales are computed on what both filters keep. Values are depth-scaled by the median
row total, scaled by column sums and log-transformed, not centred, and stored as floats.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import SparseMatrix
from gridloom.operators.normalize import side
from gridloom.sources.dataset import Dataset, held


def prepare(
    data: Dataset, min_row_total: float = 10.0, col_threshold: float = 0.0, min_rows: int | None = None, obs_filter: Column | str | None = None
) -> Dataset:
    if min_rows is not None and (isinstance(min_rows, bool) or not isinstance(min_rows, int)):
        raise TypeError("min_rows must be an int")
    if min_rows is not None and min_rows < 0:
        raise ValueError("min_rows must not be negative")
    if obs_filter is not None:
        if data.obs is None:
            raise ValueError("obs_filter needs the obs table")
        data = data.subset(rows=obs_filter)
        if not data.x.shape[0]:
            raise ValueError("obs_filter selected no rows")
    x = data.x.persist()
    n_rows, n_cols = x.shape
    rows = x.sum(1).where(F.col("v") > min_row_total).select("i")
    detected = F.count_if(F.col("v") > 0)
    per_column = x.cells.groupBy("j").agg(F.sum(F.col("v").cast("double")).alias("total"), detected.alias("found"))
    filled = x._filled(0, per_column, [F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("found", F.lit(0)).alias("found")])
    enough = F.col("total") > col_threshold * n_rows
    cols = filled.where(enough & (F.col("found") >= min_rows) if min_rows is not None else enough).select("j")
    kept = data.follow({0: held(rows, "i", n_rows), 1: held(cols, "j", n_cols)})
    # What was read for the filters is held until release() too.
    totals = kept.x.sum(1).persist()
    return replace(kept, x=depth_and_log(kept.x, totals), held=(*kept.held, x.stored, totals))


def depth_and_log(x: SparseMatrix, totals: DataFrame) -> SparseMatrix:
    """log10(1 + 1000 * v / (row total / median row total) / column sum), as floats; the row totals are used four times."""
    middle = F.broadcast(totals.agg(F.median("v").alias("middle")))  # one row
    scales = totals.where("v <> 0").join(middle).where("middle > 0").select("i", (F.col("v") / F.col("middle")).alias("s"))
    scaled = x.cells.join(side(scales, x.shape[0]), "i").select("i", "j", (F.col("v") / F.col("s")).alias("x"))
    sums = scaled.groupBy("j").agg(F.sum("x").alias("g")).where("g <> 0")
    value = F.log10(1 + 1000 * F.col("x") / F.col("g")).cast("float")
    cells = scaled.join(side(sums, x.shape[1]), "j").select("i", "j", value.alias("v"))
    return SparseMatrix(x.shape, x.major, cells=cells)
