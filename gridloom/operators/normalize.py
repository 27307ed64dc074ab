"""The normalized view: depth-scaled, column-scaled, log-transformed and mean-centred, never filled unless asked.

value = log10(1 + 1000 * v / row_scale[i] / col_scale[j]) - col_mean[j], and -col_mean[j] where no cell is stored.
Values must not be negative. The view is three small tables of statistics and the stored cells; products add the
centring as a term of rank one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.matrix import STRETCH, SparseMatrix, Tiles, bounded
from gridloom.operators.product import checked, contracted, grid, hinted

#: Statistics of an axis are broadcast up to this length; longer ones are joined by shuffle.
BROADCAST_AXIS = 1_000_000
#: Numbers in arrays that take about the memory of one broadcast row.
NUMBERS_A_ROW = 4


def side(frame: DataFrame, length: int) -> DataFrame:
    return F.broadcast(frame) if length <= BROADCAST_AXIS else frame


class Normalized:
    def __init__(self, matrix: SparseMatrix):
        self.matrix, self.shape, self.spark = matrix, matrix.shape, matrix.spark

    def __repr__(self) -> str:
        return f"<Normalized {self.shape[0]}x{self.shape[1]}>"

    def _refuse(self, *_):
        raise RuntimeError("arithmetic on a normalized view is not supported")

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = _refuse

    @cached_property
    def row_scale(self) -> DataFrame:
        """(i, s): row totals over their exact median, all rows counted; 1 where a total or the median is 0."""
        totals = self.matrix.sum(1)
        middle = totals.agg(F.median("v").alias("middle"))
        scale = F.when((F.col("middle") > 0) & (F.col("v") != 0), F.col("v") / F.when(F.col("middle") > 0, F.col("middle"))).otherwise(F.lit(1.0))
        # The median is one row.
        return totals.join(F.broadcast(middle)).select("i", scale.alias("s"))

    @cached_property
    def scaled(self) -> DataFrame:
        """(i, j, x): stored values over the row scale."""
        return self.matrix.cells.join(side(self.row_scale, self.shape[0]), "i").select("i", "j", (F.col("v") / F.col("s")).alias("x"))

    @cached_property
    def stored_col_scale(self) -> DataFrame:
        return self.scaled.groupBy("j").agg(F.sum("x").alias("g"))

    @property
    def col_scale(self) -> DataFrame:
        """(j, g): column sums of the scaled values."""
        return self.matrix._filled(0, self.stored_col_scale, [F.coalesce("g", F.lit(0.0)).alias("g")])

    @cached_property
    def delta(self) -> DataFrame:
        """(i, j, d): the transformed values of stored cells, before centring."""
        scale = side(self.stored_col_scale, self.shape[1])
        d = F.when(F.col("g") > 0, F.log10(1 + 1000 * F.col("x") / F.when(F.col("g") > 0, F.col("g")))).otherwise(F.lit(0.0))
        return self.scaled.join(scale, "j").select("i", "j", d.alias("d"))

    @cached_property
    def col_mean(self) -> DataFrame:
        """(j, m): means of the transformed values over all rows."""
        sums = self.delta.groupBy("j").agg(F.sum("d").alias("d"))
        return self.matrix._filled(0, sums, [(F.coalesce("d", F.lit(0.0)) / F.lit(float(max(1, self.shape[0])))).alias("m")])

    def window(self, rows=slice(None), cols=slice(None), most: int | None = None, digits: int | None = None) -> DataFrame:
        """(i, j, v) of every cell of a window; the statistics stay those of the whole matrix.

        With `digits` values are rounded, which takes longer than to make a cell: once for each column and stored cell.
        """
        end = (lambda v: v) if digits is None else (lambda v: F.round(v, digits))
        picked = SparseMatrix(self.shape, cells=self.delta.withColumnRenamed("d", "v")).select(rows, cols)
        bounded(picked.shape, most)
        means = SparseMatrix((1, self.shape[1]), cells=self.col_mean.select(F.lit(0).cast("long").alias("i"), "j", F.col("m").alias("v"))).select(slice(None), cols)
        tiles = Tiles(picked.shape, STRETCH)
        # The means of a tile's columns are one array, which all tiles of these columns share.
        place = F.struct("j", F.col("v").alias("m"), end(F.lit(0.0) - F.col("v")).alias("rest"))
        group = F.expr(f"j div {tiles.columns}L").alias("group")
        groups = means.cells.groupBy(group).agg(F.sort_array(F.collect_list(place)).alias("own"))
        arrays = groups.select("group", F.col("own.m").alias("ms"), F.col("own.rest").alias("rests"))
        made = tiles.runs(picked.cells).join(side(arrays, 2 * picked.shape[1] // NUMBERS_A_ROW), "group")
        first = F.expr(f"cast(begin div {tiles.rows}L as int)")
        head = F.when(F.col("v").isNull(), F.get("rests", first)).otherwise(end(F.col("v") - F.get("ms", first)))
        return tiles.unrolled(made.withColumn("head", head), F.get("rests", F.col("across")), "rests")

    toarray = window
    __getitem__ = lambda self, key: self.window(*(key if isinstance(key, tuple) else (key,)))

    def select(self, rows=slice(None), cols=slice(None)) -> Normalized:
        """A new view with its own statistics."""
        return Normalized(self.matrix.select(rows, cols))

    def _as_matrix(self) -> SparseMatrix:
        return SparseMatrix(self.shape, self.matrix.major, cells=self.delta.withColumnRenamed("d", "v"))

    def matmat(self, b: DataFrame, length: int, width: int) -> DataFrame:
        """view @ b for b as (k, c, x): (i, c, y); the centring is one number for each column of b."""
        checked(length, self.shape[1])
        a = self._as_matrix()
        sparse = contracted(a.cells, b, "j", "i", ["c"], length, width)
        means = side(self.col_mean, self.shape[1])
        centre = b.join(means, F.col("k") == F.col("j")).groupBy("c").agg(F.sum(F.col("m") * F.col("x")).alias("z"))
        filled = grid(a, "i", width).join(sparse, ["i", "c"], "left").join(hinted(centre, width), "c", "left")
        return filled.select("i", "c", (F.coalesce("y", F.lit(0.0)) - F.coalesce("z", F.lit(0.0))).alias("y"))

    def matmat_left(self, b: DataFrame, length: int, width: int) -> DataFrame:
        """b @ view for b as (k, c, x), with c its row: (j, c, y); the centring is a row sum of b by a column mean."""
        checked(length, self.shape[0])
        a = self._as_matrix()
        sparse = contracted(a.cells, b, "i", "j", ["c"], length, width)
        sums = hinted(b.groupBy("c").agg(F.sum("x").alias("z")), width)
        filled = grid(a, "j", width).join(sparse, ["j", "c"], "left").join(sums, "c", "left").join(side(self.col_mean, self.shape[1]), "j")
        return filled.select("j", "c", (F.coalesce("y", F.lit(0.0)) - F.coalesce("z", F.lit(0.0)) * F.col("m")).alias("y"))

    def matvec(self, x: DataFrame, length: int) -> DataFrame:
        return self.matmat(x.withColumn("c", F.lit(0)), length, 1).select("i", "y")

    def vecmat(self, x: DataFrame, length: int) -> DataFrame:
        return self.matmat_left(x.withColumn("c", F.lit(0)), length, 1).select("j", "y")
