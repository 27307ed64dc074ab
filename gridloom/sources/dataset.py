"""A matrix with tables about its rows and columns, and its place on disk.

Every aligned field follows a selection: obs and obsm rows (i), var and varm columns (j), obsp pairs of rows (i, i2),
varp pairs of columns (j, j2), layers and raw cells (i, j). On disk a dataset is a folder of Parquet tables, one for
each field, and a manifest; matrices are stored grouped, or packed with places as bytes, in any folder that Spark
writes. Selections by a condition run a job that counts what they keep, since a matrix knows its shape, and hold the kept
places until `release`; selections by place run none.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.keys import Table, numbered, resolve
from gridloom.operators.matrix import SparseMatrix

LAYOUTS = ("grouped", "packed")
#: The place columns that a field follows, by kind.
FOLLOWS = {"obsm": {"i": 0}, "varm": {"j": 1}, "obsp": {"i": 0, "i2": 0}, "varp": {"j": 1, "j2": 1}}


@dataclass(frozen=True)
class Dataset:
    x: SparseMatrix
    obs: DataFrame | None = None
    var: DataFrame | None = None
    raw: SparseMatrix | None = None
    layers: dict[str, SparseMatrix] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict = field(default_factory=dict)
    #: The columns of obs and var that hold labels.
    obs_label: str | None = None
    var_label: str | None = None
    held: tuple[DataFrame, ...] = ()

    def __post_init__(self):
        for m in (self.x, self.raw, *self.layers.values()):
            if m is not None and not isinstance(m, SparseMatrix):
                raise TypeError(f"{type(m).__name__} is no matrix")
        for name, m in self.layers.items():
            if m.shape != self.x.shape:
                raise ValueError(f"layer {name} has shape {m.shape}, not {self.x.shape}")

    def matrix(self, layer: str | None = None, use_raw: bool = False) -> SparseMatrix:
        if layer is not None and use_raw:
            raise ValueError("either a layer or raw, not both")
        if use_raw:
            if self.raw is None:
                raise ValueError("there is no raw matrix")
            return self.raw
        return self.x if layer is None else self.layers[layer]

    def with_layer(self, name: str, matrix: SparseMatrix) -> Dataset:
        return replace(self, layers=self.layers | {name: matrix})

    def with_x(self, matrix: SparseMatrix) -> Dataset:
        if matrix.shape != self.x.shape:
            raise ValueError(f"shape {matrix.shape}, not {self.x.shape}")
        return replace(self, x=matrix)

    def with_raw(self, matrix: SparseMatrix | None) -> Dataset:
        """raw has the rows of x, and columns of its own number."""
        if matrix is not None and not isinstance(matrix, SparseMatrix):
            raise TypeError(f"{type(matrix).__name__} is no matrix")
        if matrix is not None and matrix.shape[0] != self.x.shape[0]:
            raise ValueError(f"raw has {matrix.shape[0]} rows, not {self.x.shape[0]}")
        return replace(self, raw=matrix)

    def release(self) -> None:
        """Lets go of what selections hold."""
        for frame in self.held:
            frame.unpersist()

    def __getitem__(self, key) -> Dataset:
        """data[rows, cols]: ints, slices, lists, masks, tables of places, or labels; every field follows."""
        key = key if isinstance(key, tuple) else (key, slice(None))
        if len(key) != 2:
            raise IndexError("a dataset has two axes")
        found = {}
        for axis, k in enumerate(key):
            if isinstance(k, str) or (isinstance(k, list) and k and all(isinstance(x, str) for x in k)):
                found[axis] = self._labelled(axis, [k] if isinstance(k, str) else k)
            elif not (isinstance(k, slice) and k == slice(None)):
                found[axis] = resolve(k, self.x.shape[axis])
        return self.follow(found)

    def _labelled(self, axis: int, labels: list[str]) -> Table:
        """Runs a job: each label must be there once."""
        table, label, name = ((self.obs, self.obs_label, "i"), (self.var, self.var_label, "j"))[axis]
        if table is None or label is None:
            raise KeyError(f"there are no labels of {'rows' if axis == 0 else 'columns'}")
        spark = self.x.spark
        asked = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "new long, label string"))  # the caller's list
        places = table.select(F.col(label).alias("label"), F.col(name).cast("long").alias("old")).join(asked, "label").select("old", "new").persist()
        if sorted(r["new"] for r in places.select("new").collect()) != list(range(len(labels))):
            places.unpersist()
            raise KeyError("a label is missing or there more than once")
        return Table(places, len(labels))

    def subset(self, rows: Column | str | None = None, cols: Column | str | None = None) -> Dataset:
        """Rows by a condition on obs and columns by one on var, renumbered in order; every field follows."""
        kept = {}
        for axis, (condition, table, name) in enumerate(((rows, self.obs, "i"), (cols, self.var, "j"))):
            if condition is not None:
                if table is None:
                    raise ValueError(f"a condition on {'obs' if axis == 0 else 'var'} needs that table")
                kept[axis] = held(table.where(condition).select(name), name, self.x.shape[axis])
        return self.follow(kept)

    def follow(self, kept: dict) -> Dataset:
        """kept: resolved keys of the rows (0) and columns (1) that stay."""
        def moved(frame: DataFrame, places: dict[str, int]) -> DataFrame:
            for name, axis in places.items():
                if axis in kept:
                    frame = self.x._moved(frame, name, kept[axis])
            return frame

        def raw_keys(m: SparseMatrix) -> dict:
            # raw may have other columns than x; then only rows are picked.
            return kept if m.shape == self.x.shape else {a: k for a, k in kept.items() if a == 0}

        fields = {k: {n: moved(t, places) for n, t in getattr(self, k).items()} for k, places in FOLLOWS.items()}
        held = (*self.held, *[k.frame for k in kept.values() if isinstance(k, Table)])
        return Dataset(
            self.x.take(kept), self.obs and moved(self.obs, {"i": 0}), self.var and moved(self.var, {"j": 1}),
            self.raw and self.raw.take(raw_keys(self.raw)), {n: m.take(kept) for n, m in self.layers.items()},
            uns=self.uns, obs_label=self.obs_label, var_label=self.var_label, held=held, **fields,
        )

    def write(self, path: str, layout: str = "grouped", compression: str = "zstd") -> None:
        if layout not in LAYOUTS:
            raise ValueError(f"layout {layout!r} is none of {LAYOUTS}")
        spark, manifest = self.x.spark, {"layout": layout, "matrices": {}, "tables": [], "uns": self.uns, "labels": [self.obs_label, self.var_label]}
        written: dict[int, str] = {}
        for name, m in {"x": self.x, "raw": self.raw, **{f"layers/{n}": m for n, m in self.layers.items()}}.items():
            if m is not None:
                # One matrix in two places is computed and written once.
                at = written.setdefault(id(m), name)
                manifest["matrices"][name] = {"shape": m.shape, "major": m.major, "at": at}
                if at == name:
                    frame = m.stored_blocks(packed=layout == "packed")
                    frame.write.option("compression", compression).parquet(f"{path}/{name}")
        tables = {"obs": self.obs, "var": self.var, **{f"{k}/{n}": t for k in FOLLOWS for n, t in getattr(self, k).items()}}
        for name, table in tables.items():
            if table is not None:
                manifest["tables"].append(name)
                table.write.option("compression", compression).parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Dataset:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])

        def matrix(name: str) -> SparseMatrix:
            about = manifest["matrices"][name]
            frame = spark.read.parquet(f"{path}/{about['at']}")
            shape = tuple(about["shape"])
            if manifest["layout"] == "packed":
                return SparseMatrix.from_packed(frame, shape, about["major"])
            return SparseMatrix(shape, about["major"], groups=frame, blocked=True)

        tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
        fields = {k: {n.split("/", 1)[1]: t for n, t in tables.items() if n.startswith(f"{k}/")} for k in FOLLOWS}
        layers = {n.split("/", 1)[1]: matrix(n) for n in manifest["matrices"] if n.startswith("layers/")}
        labels = manifest.get("labels", [None, None])
        raw = matrix("raw") if "raw" in manifest["matrices"] else None
        return Dataset(matrix("x"), tables.get("obs"), tables.get("var"), raw, layers, uns=manifest["uns"], obs_label=labels[0], var_label=labels[1], **fields)


def held(places: DataFrame, name: str, length: int) -> Table:
    """The key of places that stay, some of 0 to length - 1, renumbered in order; runs a job and is held until released."""
    frame = numbered(places, name, length).persist()
    return Table(frame, frame.count())
