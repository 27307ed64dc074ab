"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over shards of fingerprints, components of the links.

Two fingerprints that differ in at most two of 64 bits agree in one of three blocks of bits, so a shard is all distinct
fingerprints with one block's value, and every link lies inside a shard. A shard's BK-tree travels to the task that
searches it. Shards above a size are dealt again by blocks of their remaining bits, and what is still above it is cut
into chunks: each pair of chunks is one tree with its queries, so no task gets an unbounded shard and no pair of
fingerprints is left out. A task emits a spanning forest of the links that it found, never all pairs.

Edge cases: a null or empty text, or one of white space alone, has fingerprint zero and links like any other; repeated
rows share a fingerprint and a component; a component of rows that all have a null id has a null component_id; an empty
table gives an empty result; other columns of the input are not read (`near_duplicates`) or come back as they are
(`keep_one`).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from gridloom.llm.common import components, cut, let_go, partitions, small_batches, split_by, spread_join

#: Fixed by the definition of the fingerprint.
SHINGLE = 3
SEED = 42
RADIUS = 2
#: A tree holds at most so many fingerprints, or a pair of chunks of so many.
SHARD = 256
#: First bit and width of the blocks, and of the blocks of what remains beside each.
BLOCKS = ((0, 22), (22, 21), (43, 21))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    let_go()
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = 0
        while node < len(self.values):
            d = (self.values[node] ^ value).bit_count()
            if d == 0:
                return
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.values)
                break
            node = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most radius away; only edges whose distance can lead to one are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[node])
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among values, one fewer than their number at most."""
    tree, parent, links = BKTree(), {}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in dict.fromkeys(values):
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((value, other))
        tree.add(value)
    return links


def searcher(radius: int):
    def search(batches):
        unit, held = None, []

        def found(rows):
            links = forest(rows, radius)
            a, b = np.array(links, np.uint64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            units = batch.column("unit").to_numpy(zero_copy_only=False)
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ends = [*(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)] if len(units) else []
            begin = 0
            for end in ends:
                if units[begin] != unit and held:
                    if len(held) > 1:
                        yield found(held)
                    held = []
                unit = units[begin]
                held += values[begin:end].tolist()
                begin = end
        if len(held) > 1:
            yield found(held)

    return search


def bits(start: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def parts_beside(band: int) -> list[Column]:
    """The bits beside a block, in three blocks."""
    spans = [(s + o, w) for k, (s, width) in enumerate(BLOCKS) if k != band for o, w in ((0, width // 2), (width // 2, width - width // 2))]
    ranges = [spans[:1], spans[1:3], spans[3:]]
    return [F.concat_ws("-", *[bits(s, w).cast("string") for s, w in r]) for r in ranges]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between the fingerprints in column fp, enough to connect all that are connected."""
    if radius > 2:
        raise ValueError("three blocks cover a radius of two bits at most")
    spark = distinct.sparkSession

    def counted(frame: DataFrame) -> DataFrame:
        sizes = frame.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1")
        return cut(frame.join(sizes, "unit"))

    first = counted(
        distinct.select("fp", F.posexplode(F.array(*[bits(s, w) for s, w in BLOCKS])).alias("band", "block")).select(
            "fp", "band", F.xxhash64("band", "block").alias("unit")
        )
    )
    beside = F.coalesce(*[F.when(F.col("band") == k, F.array(*parts_beside(k))) for k in range(3)])
    second = counted(
        first.where(F.col("n") > shard)
        .select("fp", F.col("unit").alias("above"), F.posexplode(beside).alias("part", "block"))
        .select("fp", F.xxhash64("above", "part", "block").alias("unit"))
    )
    chunks = F.ceil(F.col("n") / shard).cast("long")
    cut_up = (
        second.where(F.col("n") > shard)
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select("fp", F.xxhash64("unit", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("unit"))
    )
    units = (
        first.where(F.col("n") <= shard).select("unit", "fp")
        .unionByName(second.where(F.col("n") <= shard).select("unit", "fp"))
        .unionByName(cut_up)
    )
    dealt = units.repartition(partitions(spark), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(searcher(radius), "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id, weight) for each distinct fingerprint of rows (doc_id, fp); weight is its number of rows."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight")))
    roots = components(links(distinct.select("fp")))
    rooted = cut(
        distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.col("weight").alias("rows"), F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("weight"))
    found = spread_join(rooted.select("fp", "rows", "root"), least, "root", rooted.count())
    return found.select("fp", "root", "component_id", F.col("rows").alias("weight"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    small_batches(docs.sparkSession)
    prints = cut(docs.select("doc_id", fingerprints("text").alias("fp")))
    found = spread_join(prints, classes(prints).drop("root"), "fp", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs; of each component the row with the smallest id, null being the last, then the smallest hash of
    its text; of rows with one id and one text the one with the smallest hash of all its columns.

    Rows that are alone in their component are told by a filter of fixed size and pass without a shuffle.
    """
    text_hash = F.xxhash64("text")
    small_batches(docs.sparkSession)
    prints = cut(docs.select("doc_id", text_hash.alias("text_hash"), fingerprints("text").alias("fp")))
    found = spread_join(prints, classes(prints.select("doc_id", "fp")).select("fp", "root", "weight"), "fp", prints.count())
    keys = found.groupBy("root", F.xxhash64("doc_id", "text_hash").alias("__key"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    keys = cut(keys.agg(F.count("*").alias("copies")))
    first = keys.groupBy("root").agg(F.min(F.struct("none", "id", "text_hash")).alias("k"), F.count("*").alias("weight"))
    judged = spread_join(keys, first, "root", prints.count()).withColumn("stays", F.struct("none", "id", "text_hash") == F.col("k"))
    names = ["__key", "__none", "__id", "__hash"]
    gone = cut(judged.where("copies > 1 OR NOT stays").select(F.col("__key"), F.col("none").alias("__none"), F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"))
    own = [F.xxhash64("doc_id", text_hash), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), text_hash]
    some, others = split_by(docs.withColumns(dict(zip(names, own, strict=True))), gone, "__key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = some.groupBy(*names).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
    once = once.join(gone.where("NOT stays").drop("stays"), names, "left_anti").select("__row.*")
    return others.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(once)
