"""Row and column keys: integers, slices, masks and lists become either a stride or a list of places."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Listed places are sent as a broadcast table up to this many; more are joined by shuffle.
BROADCAST_PLACES = 1_000_000


@dataclass(frozen=True)
class Stride:
    """Places start, start + step, ...; count of them."""

    start: int
    step: int
    count: int

    def condition(self, place: Column) -> Column:
        first, last = sorted((self.start, self.start + self.step * (self.count - 1)))
        inside = place.between(first, last) if self.count else F.lit(False)
        return inside if abs(self.step) == 1 else inside & (F.pmod(place - self.start, F.lit(abs(self.step))) == 0)

    def new_place(self, place: Column) -> Column:
        return ((place - self.start) / self.step).cast("long") if self.step != 1 else place - self.start


@dataclass(frozen=True)
class Places:
    """Listed places, in order and with repeats."""

    places: tuple[int, ...]

    @property
    def count(self) -> int:
        return len(self.places)

    def table(self, spark: SparkSession) -> DataFrame:
        frame = spark.createDataFrame(pa.table({"new": pa.array(range(self.count), pa.int64()), "old": pa.array(self.places, pa.int64())}))
        return F.broadcast(frame) if self.count <= BROADCAST_PLACES else frame


@dataclass(frozen=True)
class Table:
    """Places in a table (old, new) of `count` rows: they never pass the driver."""

    frame: DataFrame
    count: int

    def table(self, spark: SparkSession) -> DataFrame:
        return F.broadcast(self.frame) if self.count <= BROADCAST_PLACES else self.frame


def numbered(places: DataFrame, name: str, length: int) -> DataFrame:
    """(old, new): new places 0, 1, ... in the order of the old ones, which are some of 0 to length - 1.

    Ranges of old places are numbered each on their own and begin where those before them ended; a few ranges for each
    partition, whose counts are one small table.
    """
    ranges = 4 * int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    old = places.select(F.col(name).cast("long").alias("old"), F.floor(F.col(name) / max(1, -(-length // ranges))).alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = old.groupBy("range").agg(F.count("*").alias("n"))
    begin = F.broadcast(counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))  # `ranges` rows
    local = old.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("old")))
    return local.join(begin, "range").select("old", (F.col("begin") + F.col("own") - 1).cast("long").alias("new"))


def resolve(key, n: int) -> Stride | Places | Table:
    """key: an int, a slice, a list of booleans of length n, a list of ints, or a table of places (old, new); negative
    ints count from the end."""
    if isinstance(key, DataFrame):
        return Table(key.select("old", "new"), key.count())
    if isinstance(key, slice):
        start, stop, step = key.indices(n)
        return Stride(start, step, len(range(start, stop, step)))
    if isinstance(key, int) and not isinstance(key, bool):
        key = [key]
    if not isinstance(key, Sequence) or isinstance(key, str):
        raise TypeError(f"{key!r} is no key")
    if len(key) and all(isinstance(k, bool) for k in key):
        if len(key) != n:
            raise IndexError(f"a mask of length {len(key)} for an axis of length {n}")
        return Places(tuple(i for i, k in enumerate(key) if k))
    places = []
    for k in key:
        if isinstance(k, bool) or not isinstance(k, int):
            raise TypeError(f"{k!r} is no place")
        if not -n <= k < n:
            raise IndexError(f"{k} is outside an axis of length {n}")
        places.append(k % n)
    return Places(tuple(places))
