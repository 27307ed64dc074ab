"""A sparse matrix as a DataFrame: cells (i, j, v), or groups (major, value, n, minors) of equal values in a row or column.

Groups may be cut into blocks, and their places packed as bytes until something asks for them.

Cells that are not stored are zero. Stored zeros stay stored. Values are finite numbers; sums are doubles. All methods
but `validate`, `item` and those that say so only declare a plan.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import codec
from gridloom.operators.keys import Places, Stride, resolve

#: Up to so many listed places are sent with the code that unpacks groups.
PLACES_IN_TASKS = 100_000

AXES = {0: "j", 1: "i"}


def across(axis: int) -> str:
    """The place that stays when an axis is reduced."""
    if axis not in AXES:
        raise ValueError(f"axis {axis!r} is neither 0, 1 nor None")
    return AXES[axis]


class SparseMatrix:
    def __init__(
        self, shape: tuple[int, int], major: str = "row", cells: DataFrame | None = None, groups: DataFrame | None = None,
        packed: DataFrame | None = None, blocked: bool = False,
    ):
        if packed is not None:
            groups = packed.select("major", "value", "n", codec.unpack("packed").alias("minors"))
        if major not in ("row", "col"):
            raise ValueError(f"major {major!r} is neither row nor col")
        if (cells is None) == (groups is None):
            raise ValueError("either cells or groups are needed")
        self.shape, self.major = (int(shape[0]), int(shape[1])), major
        self._cells, self._groups, self._packed, self.blocked = cells, groups, packed, blocked

    def __repr__(self) -> str:
        return f"<SparseMatrix {self.shape[0]}x{self.shape[1]}, grouped by {self.major}>"

    @property
    def spark(self) -> SparkSession:
        return (self._cells if self._groups is None else self._groups).sparkSession

    @property
    def places(self) -> tuple[str, str]:
        """The names of the major and the minor place."""
        return ("i", "j") if self.major == "row" else ("j", "i")

    @property
    def n_major(self) -> int:
        return self.shape[self.major == "col"]

    @property
    def n_minor(self) -> int:
        return self.shape[self.major == "row"]

    # Forms

    @cached_property
    def cells(self) -> DataFrame:
        """(i, j, v)."""
        if self._cells is not None:
            return self._cells.select("i", "j", "v")
        a, b = self.places
        exploded = self._groups.select(F.col("major").alias(a), F.explode("minors").alias(b), F.col("value").alias("v"))
        return exploded.select("i", "j", "v")

    @cached_property
    def groups(self) -> DataFrame:
        """(major, value, n, minors): n is stored so that sums of rows never read the places."""
        if self._groups is not None:
            kept = self._groups.select("major", "value", "n", "minors")
            if not self.blocked:
                return kept
            whole = kept.groupBy("major", "value").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("minors"))).alias("minors"))
            return whole.select("major", "value", "n", "minors")
        a, b = self.places
        return self._cells.groupBy(F.col(a).alias("major"), F.col("v").alias("value")).agg(
            F.count("*").alias("n"), F.sort_array(F.collect_list(b)).alias("minors")
        )

    def blocks(self, width: int = 1 << 16) -> DataFrame:
        """(major, value, block, n, minors): groups cut at multiples of width, so that a common value makes no huge row."""
        a, b = self.places
        keys = [F.col(a).alias("major"), F.col("v").alias("value"), F.floor(F.col(b) / width).alias("block")]
        return self.cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(b)).alias("minors"))

    def grouped(self) -> SparseMatrix:
        return SparseMatrix(self.shape, self.major, groups=self.groups)

    def stored_blocks(self, width: int = 1 << 16, packed: bool = False) -> DataFrame:
        """The rows of `blocks`, near ones in near partitions and sorted, with one shuffle of the cells; with their places
        as bytes in `packed` if asked.

        Partitions hold ranges of the major axis, which is numbered without gaps, so no sample has to find their bounds;
        a long row or column is spread by its blocks. Cells are sorted by one number, and grouped in Arrow batches as they pass.
        """
        a, b = self.places
        ranges = 8 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        keys = {"range": F.floor(F.col(a) / max(1, -(-self.n_major // ranges))), "block": F.floor(F.col(b) / width)}
        dealt = self.cells.withColumns(keys).repartition("range", "block")
        blocks = max(1, -(-self.n_minor // width))
        stretch = (F.col(a) * F.lit(blocks) + F.col("block")).cast("long").alias("stretch")
        cells = dealt.select(stretch, F.col("v").alias("value"), F.col(b).cast("long").alias("minor")).sortWithinPartitions("stretch")
        kind = cells.schema["value"].dataType.simpleString()
        made = "packed binary" if packed else "minors array<long>"
        return cells.mapInArrow(grouper(blocks, packed), f"major long, value {kind}, block long, n long, {made}")

    def regroup(self, major: str) -> SparseMatrix:
        """The same matrix grouped by the other axis: one shuffle."""
        return self if major == self.major else SparseMatrix(self.shape, major, cells=self.cells)

    def _with(self, shape: tuple[int, int], packed: DataFrame | None, groups: DataFrame | None, major: str | None = None) -> SparseMatrix:
        own = {"groups": groups} if packed is None else {"packed": packed}
        return SparseMatrix(shape, major or self.major, blocked=self.blocked, **own)

    def persist(self) -> SparseMatrix:
        self.stored.persist()
        return self

    @property
    def stored(self) -> DataFrame:
        """The frame that the matrix is made of: cells or groups."""
        return self.cells if self._groups is None else self._groups

    @property
    def T(self) -> SparseMatrix:  # noqa: N802
        """No data moves: names are swapped."""
        major = "col" if self.major == "row" else "row"
        if self._groups is not None:
            return self._with(self.shape[::-1], self._packed, self._groups, major)
        return SparseMatrix(self.shape[::-1], major, cells=self._cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))

    def packed(self) -> DataFrame:
        """(major, value, n, packed): places as bytes."""
        return self.groups.select("major", "value", "n", codec.pack("minors").alias("packed"))

    @classmethod
    def from_packed(cls, packed: DataFrame, shape: tuple[int, int], major: str) -> SparseMatrix:
        return cls(shape, major, packed=packed, blocked="block" in packed.columns)

    def validate(self) -> SparseMatrix:
        """Runs a job: places inside the shape, no place twice."""
        outside = ~(F.col("i").between(0, self.shape[0] - 1) & F.col("j").between(0, self.shape[1] - 1))
        bad = self.cells.agg(F.count_if(F.coalesce(outside | F.col("v").isNull(), F.lit(True))).alias("bad")).first()["bad"]
        if bad:
            raise ValueError(f"{bad} cells are outside {self.shape} or null")
        if self.cells.groupBy("i", "j").count().where("count > 1").limit(1).count():
            raise ValueError("a place is stored twice")
        return self

    def toarray(self, rows: slice = slice(None), cols: slice = slice(None), most: int | None = None) -> DataFrame:
        """(i, j, v) with every cell of a window, or of the whole; above `most` cells, if given, it is refused."""
        window = self.select(rows, cols)
        bounded(window.shape, most)
        tiles = Tiles(window.shape, STRETCH)
        return tiles.unrolled(tiles.runs(window.cells).withColumn("head", F.coalesce("v", F.lit(0.0))), F.lit(0.0)).select("i", "j", "v")

    # Values

    def _values(self, change) -> SparseMatrix:
        if self._groups is not None:
            changed = lambda f: f if f is None else f.withColumn("value", change(F.col("value")))
            return self._with(self.shape, changed(self._packed), changed(self._groups))
        return SparseMatrix(self.shape, self.major, cells=self.cells.withColumn("v", change(F.col("v"))))

    def scale(self, s: float) -> SparseMatrix:
        if s == 0:
            empty = (self.cells if self._groups is None else self._groups).limit(0)
            return SparseMatrix(self.shape, self.major, **{"cells" if self._groups is None else "groups": empty})
        return self._values(lambda v: v * F.lit(s))

    def divide_by(self, s: float) -> SparseMatrix:
        """Stored values only; a zero divisor gives infinities and NaN, as floating point has it."""
        if s == 0:
            inf = F.lit(float("inf"))
            return self._values(lambda v: F.when(v > 0, inf).when(v < 0, -inf).otherwise(F.lit(float("nan"))))
        return self._values(lambda v: v.cast("double") / F.lit(float(s)))

    def __neg__(self) -> SparseMatrix:
        return self._values(lambda v: -v)

    def log1p(self) -> SparseMatrix:
        return self._values(lambda v: F.when(v > -1, F.log1p(v)).when(v == -1, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))

    def astype(self, kind: str) -> SparseMatrix:
        """Groups whose values become equal stay apart until they are grouped anew."""
        return self._values(lambda v: v.cast(kind))

    def __mul__(self, other):
        from gridloom.operators import elementwise

        return self.scale(other) if isinstance(other, (int, float)) else elementwise.multiply(self, other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        from gridloom.operators import elementwise

        return self.divide_by(other) if isinstance(other, (int, float)) else elementwise.divide(self, other)

    def __add__(self, other):
        from gridloom.operators import elementwise

        return elementwise.add_scalar(self, other) if isinstance(other, (int, float)) else elementwise.add(self, other)

    __radd__ = __add__

    def __sub__(self, other):
        from gridloom.operators import elementwise

        return elementwise.add_scalar(self, -other) if isinstance(other, (int, float)) else elementwise.add(self, -other)

    def __rsub__(self, other):
        return -self + other

    # Places

    def select(self, rows=slice(None), cols=slice(None)) -> SparseMatrix:
        """Rows and columns by key, each on its own; lists may repeat and reorder."""
        found = {axis: resolve(key, self.shape[axis]) for axis, key in ((0, rows), (1, cols)) if not (isinstance(key, slice) and key == slice(None))}
        return self.take(found)

    def take(self, keys: dict) -> SparseMatrix:
        """Keys of rows (0) and columns (1), resolved. The major one picks groups before their places are unpacked or
        exploded; a stride of the minor one leaves them grouped too."""
        shape = tuple(keys[axis].count if axis in keys else self.shape[axis] for axis in (0, 1))
        if self._groups is None:
            cells = self._cells.select("i", "j", "v")
            for axis, key in keys.items():
                cells = self._moved(cells, "ij"[axis], key)
            return SparseMatrix(shape, self.major, cells=cells.select("i", "j", "v"))
        major, minor = (0, 1) if self.major == "row" else (1, 0)
        out = self
        if major in keys:
            moved = lambda f: f if f is None else self._moved(f, "major", keys[major]).select(*f.columns)
            out = self._with(shape, moved(self._packed), moved(self._groups))
        if minor not in keys:
            return self._with(shape, out._packed, out._groups)
        key = keys[minor]
        if isinstance(key, Places) and out._packed is not None and key.count <= PLACES_IN_TASKS:
            # Other places never leave the task that unpacks them.
            groups = out._packed.select("major", "value", codec.unpack_some(key.places)("packed").alias("minors"))
            cells = SparseMatrix(self.shape, self.major, groups=groups).cells
            return SparseMatrix(shape, self.major, cells=self._moved(cells, "ij"[minor], key).select("i", "j", "v"))
        if isinstance(key, Stride):
            inside = F.transform(F.filter("minors", key.condition), key.new_place)
            groups = out._groups.withColumn("minors", inside if key.step > 0 else F.reverse(inside)).withColumn("n", F.size("minors").cast("long"))
            return self._with(shape, None, groups.where("n > 0"))
        out = SparseMatrix(self.shape, self.major, groups=out._groups)
        return SparseMatrix(shape, self.major, cells=self._moved(out.cells, "ij"[minor], key).select("i", "j", "v"))

    def _moved(self, frame: DataFrame, name: str, key) -> DataFrame:
        """frame without the rows whose place is not in the key, and with new places."""
        if isinstance(key, Stride):
            return frame.where(key.condition(F.col(name))).withColumn(name, key.new_place(F.col(name)))
        return frame.join(key.table(self.spark), F.col(name) == F.col("old")).withColumn(name, F.col("new")).drop("old", "new")

    def where(self, axis: int, places: DataFrame) -> DataFrame:
        """The cells whose row (axis 0) or column (axis 1) is in the column `place` of places, not renumbered."""
        return self.cells.join(places, F.col("ij"[axis]) == F.col("place"), "left_semi")

    def __getitem__(self, key):
        key = key if isinstance(key, tuple) else (key, slice(None))
        if len(key) != 2:
            raise IndexError("a matrix has two axes")
        if all(isinstance(k, int) and not isinstance(k, bool) for k in key):
            return self.item(*key)
        return self.select(*key)

    def item(self, i: int, j: int) -> float:
        """Runs a job: one cell."""
        return self.item_frame(i, j).first()["v"]

    def item_frame(self, i: int, j: int) -> DataFrame:
        a, b = (resolve(k, n).places[0] for k, n in zip((i, j), self.shape, strict=True))
        return self.cells.where((F.col("i") == a) & (F.col("j") == b)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))

    # Reductions

    def _per(self, axis: int, by_group: dict[str, Column], by_cell: dict[str, Column]) -> DataFrame:
        """Aggregates along an axis: over groups where the axis left is the major one, else over cells."""
        name = across(axis)
        if self._groups is not None and name == self.places[0]:
            return self._groups.groupBy(F.col("major").alias(name)).agg(*[c.alias(k) for k, c in by_group.items()])
        return self.cells.groupBy(name).agg(*[c.alias(k) for k, c in by_cell.items()])

    def _filled(self, axis: int, sparse: DataFrame, zero) -> DataFrame:
        name = across(axis)
        n = self.shape[name == "j"]
        return self.spark.range(n).withColumnRenamed("id", name).join(sparse, name, "left").select(name, *zero)

    def sum(self, axis: int | None = None) -> DataFrame:
        total = F.sum(F.col("v").cast("double"))
        by_group = F.sum(F.col("value").cast("double") * F.col("n"))
        if axis is None:
            frame, c = (self.cells, total) if self._groups is None else (self._groups, by_group)
            return frame.agg(F.coalesce(c, F.lit(0.0)).alias("v"))
        return self._filled(axis, self._per(axis, {"v": by_group}, {"v": total}), [F.coalesce("v", F.lit(0.0)).alias("v")])

    def mean(self, axis: int | None = None) -> DataFrame:
        """Sums over the length of the axis; NaN where that is zero."""
        n = self.shape[0] * self.shape[1] if axis is None else self.shape[axis]
        value = F.col("v") / F.lit(float(n)) if n else F.lit(float("nan"))
        return self.sum(axis).withColumn("v", value)

    def nnz(self, axis: int | None = None) -> DataFrame:
        """Stored cells, zeros among them included."""
        if axis is None:
            frame, c = (self.cells, F.count("*")) if self._groups is None else (self._groups, F.sum("n"))
            return frame.agg(F.coalesce(c, F.lit(0)).alias("v"))
        counted = self._per(axis, {"v": F.sum("n")}, {"v": F.count("*")})
        return self._filled(axis, counted, [F.coalesce("v", F.lit(0)).cast("long").alias("v")])

    def stats(self) -> DataFrame:
        """(nnz, n_unique, count_nonzero)."""
        real = F.when(F.col("value") != 0, F.col("n")).otherwise(0)
        groups = self._groups.groupBy("major", "value").agg(F.sum("n").alias("n")) if self.blocked else self.groups
        return groups.select("value", "n").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.count("*").alias("n_unique"), F.coalesce(F.sum(real), F.lit(0)).alias("count_nonzero")
        )

    def max(self, axis: int | None = None) -> DataFrame:
        return self._extreme(axis, F.max, F.greatest)

    def min(self, axis: int | None = None) -> DataFrame:
        return self._extreme(axis, F.min, F.least)

    def _extreme(self, axis: int | None, pick, of_two) -> DataFrame:
        """Zero takes part only where some cell is not stored."""
        zero = F.lit(0.0)

        def with_zero(n: int) -> Column:
            return F.when(F.coalesce("n", F.lit(0)) < n, of_two(F.coalesce("v", zero), zero)).otherwise(F.col("v")).alias("v")

        by_group, by_cell = (
            {"v": pick(F.col(c).cast("double")), "n": k} for c, k in (("value", F.sum("n")), ("v", F.count("*")))
        )
        if axis is None:
            frame, own = (self.cells, by_cell) if self._groups is None else (self._groups, by_group)
            return frame.agg(*[c.alias(k) for k, c in own.items()]).select(with_zero(self.shape[0] * self.shape[1]))
        return self._filled(axis, self._per(axis, by_group, by_cell), [with_zero(self.shape[axis])])


def grouper(blocks: int, packed: bool):
    """Makes (major, value, block, n, minors or packed) of (stretch, value, minor) in order of the stretch, which is
    major * blocks + block."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
            if not len(table):
                continue
            # The last stretch may go on in the next batch; it is as long as a block at most.
            stretch = table["stretch"].to_numpy()
            whole = int(np.searchsorted(stretch, stretch[-1]))
            if whole:
                yield grouped(table.slice(0, whole))
            rest = table.slice(whole).combine_chunks().to_batches()[0]
        if rest is not None:
            yield grouped(pa.Table.from_batches([rest]))

    def grouped(table: pa.Table) -> pa.RecordBatch:
        value = table["value"].combine_chunks()
        real = pa.types.is_floating(value.type)
        if real:
            value = pc.add(value, pa.scalar(0.0, value.type))  # no negative zero
        table = table.set_column(1, "value", value)
        order = pc.sort_indices(table, [("stretch", "ascending"), ("value", "ascending"), ("minor", "ascending")])
        stretch, value, minor = (table[c].take(order).combine_chunks() for c in ("stretch", "value", "minor"))
        differs = pc.not_equal(value[1:], value[:-1])
        if real:
            differs = pc.and_not(differs, pc.and_(pc.is_nan(value[1:]), pc.is_nan(value[:-1])))
        differs = pc.if_else(pc.is_null(differs), pc.xor(value[1:].is_null(), value[:-1].is_null()), differs)
        stretch = stretch.to_numpy()
        begin = np.flatnonzero(np.r_[True, (np.diff(stretch) != 0) | differs.to_numpy(zero_copy_only=False)])
        n = np.diff(begin, append=len(stretch))
        own = codec.packed(minor.to_numpy(), n) if packed else codec.listed(minor.to_numpy(), np.cumsum(n))
        major, block = np.divmod(stretch[begin], blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(major), value.take(pa.array(begin)), pa.array(block), pa.array(n, pa.int64()), own],
            names=["major", "value", "block", "n", "packed" if packed else "minors"],
        )

    return run


#: Cells that a task makes of a dense result, about.
TASK_CELLS = 2_000_000


#: Cells of a tile of a dense result, and how many rows and columns the tiles of a task span at most.
STRETCH = 1 << 16
TILE_ROWS = 1 << 8
TASK_COLUMNS = 1 << 16


def bounded(shape: tuple[int, int], most: int | None) -> None:
    if most is not None and shape[0] * shape[1] > most:
        raise ValueError(f"{shape[0]} x {shape[1]} cells are more than {most}")


class Tiles:
    """A dense result cut into tiles, each a few columns of a band of rows, whose cells are counted column by column.

    Tiles are numbered along a band, bands along a strip of columns, and a task makes successive tiles. So a file that
    it writes has few rows and columns, which come again and again in the same order: such columns are stored in about
    a fifth of a byte a cell, where whole rows took four bytes and more.
    """

    def __init__(self, shape: tuple[int, int], stretch: int):
        self.shape, (height, width) = shape, shape
        bands = max(1, -(-height // min(TILE_ROWS, stretch)))
        self.rows = max(1, -(-height // bands))
        self.columns = max(1, stretch // self.rows)
        tiles = max(1, -(-width // self.columns))
        strips = -(-tiles // max(1, TASK_COLUMNS // self.columns))
        self.across, self.bands = -(-tiles // strips), max(1, -(-height // self.rows))
        self.count = strips * self.bands * self.across if height * width else 0

    def numbered(self, cells: DataFrame) -> DataFrame:
        """(tile, at, v) of cells (i, j, v)."""
        group = F.expr(f"j div {self.columns}L").alias("group")
        placed = cells.select("i", "j", group, "v").select("i", "j", "v", "group", F.expr(f"i div {self.rows}L").alias("band"))
        tile = F.expr(f"(group div {self.across}L * {self.bands}L + band) * {self.across}L + group % {self.across}L")
        at = F.expr(f"cast((j - group * {self.columns}L) * {self.rows}L + i - band * {self.rows}L as int)")
        return placed.select(tile.alias("tile"), at.alias("at"), "v")

    def runs(self, cells: DataFrame) -> DataFrame:
        """(tile, group, begin, end, v): places of a tile from begin up to end, of which only the first is stored if v is
        not null; a group is the tiles of the same columns.

        Runs are what is shuffled for a dense result: stored cells, and one beginning for each tile. Their cells are
        made afterwards, by the tasks that hold them.
        """
        spark, (height, width) = cells.sparkSession, self.shape
        group = F.expr(f"tile div {self.bands * self.across}L * {self.across}L + tile % {self.across}L").alias("group")
        begins = spark.range(self.count).select(F.col("id").alias("tile"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("v"))
        inside = F.col("i").between(0, height - 1) & F.col("j").between(0, width - 1)
        stored = cells.where(inside).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        # As many partitions as the result needs: what is shuffled is small against it.
        most_tasks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(spark.sparkContext.defaultParallelism, min(most_tasks, -(-height * width // TASK_CELLS)))
        task = F.expr(f"cast(tile div {max(1, -(-self.count // tasks))}L as int)").alias("task")
        dealt = begins.unionByName(self.numbered(stored)).select(task, "tile", "at", "v").repartitionById(tasks, "task")
        # A tile's beginning comes before a cell that is stored there, and is left empty by it.
        after = F.lead("at").over(Window.partitionBy("task", "tile").orderBy("at", F.col("v").asc_nulls_first()))
        end = F.expr(f"cast(least({self.columns}L, {width}L - group * {self.columns}L) as int) * {self.rows}")
        runs = dealt.withColumn("after", after).select("tile", group, "at", "after", "v")
        return runs.select("tile", "group", F.col("at").alias("begin"), F.coalesce("after", end).alias("end"), "v").where("begin < end")

    def unrolled(self, runs: DataFrame, rest: Column, *more: str) -> DataFrame:
        """(i, j, v): the cells of runs, of which the first has the value `head`, and others the column `rest` of
        i, j, `more` and `across`, the place of a cell's column in its tile."""
        left, top = F.expr(f"group * {self.columns}L").alias("left"), F.expr(f"tile div {self.across}L % {self.bands}L * {self.rows}L").alias("top")
        each = runs.select(left, top, "begin", "head", *more, F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
        placed = each.select(F.expr(f"top + at % {self.rows}").alias("i"), "left", F.expr(f"cast(at div {self.rows} as int)").alias("across"), "at", "begin", "head", *more)
        cells = placed.select("i", (F.col("left") + F.col("across")).alias("j"), "across", "at", "begin", "head", *more)
        if self.rows * self.bands > self.shape[0]:
            cells = cells.where(F.col("i") < self.shape[0])
        return cells.select("i", "j", F.when(F.col("at") == F.col("begin"), F.col("head")).otherwise(rest).alias("v"))


def dense(spark: SparkSession, shape: tuple[int, int], most: int | None = None) -> DataFrame:
    """(i, j) for every cell of a window, made by blocks of rows on the executors."""
    bounded(shape, most)
    if not shape[0] * shape[1]:
        return spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("j"))
    width = F.lit(shape[1]).cast("long")
    blocks = max(spark.sparkContext.defaultParallelism, -(-shape[0] * shape[1] // TASK_CELLS))
    return spark.range(0, shape[0] * shape[1], 1, blocks).select(F.expr(f"id div {shape[1]}L").alias("i"), F.pmod("id", width).alias("j"))
