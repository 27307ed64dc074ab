"""Near-duplicate vectors by product quantisation over coarse inverted lists, with an exact cosine rerank.

A bounded sample fits the coarse centroids, kept apart from one another, and codebooks for subspaces of the residuals.
Every distinct vector is stored in, and probes, its nearest lists; for each it carries a residual code and the code's
error. Inside a list a query's table of distances to the codewords gives asymmetric distances; by the triangle
inequality a vector whose distance is above the radius plus its code's error is no link, all others are compared
exactly in double precision. A pair counts in the first list that both share, so each link counts once on each side.
Lists above a size are cut into chunks and every pair of chunks is one unit of work, so no task gets an unbounded list.
A unit returns sums and a spanning forest, never its pairs. Vectors of each length have lists of their own; a length
that no index is fitted for has one list, in which all pairs are compared exactly.

With six lists a pair at the threshold shares none less than once in a thousand times (measured: 0.9997 of random pairs
at cosine 0.95 and 1000 lists share one).

Edge cases: vectors that are null, zero, or that hold null or non-finite components link with nothing and are their own
component; vectors of different lengths are not compared; equal vectors are one row with a weight; ids may repeat; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, partitions, spread_join

COSINE = 0.95
#: Vectors that the index is fitted on, at most; all vectors are indexed.
SAMPLE = 12_288
#: Coarse centroids at most, and lists that each vector is in and probes.
MOST_LISTS = 4096
PROBES = 6
#: Lengths that an index is fitted for, the commonest ones; the others have one list each.
FITTED = 16
SUBSPACES = 8
CODEWORDS = 256
#: Centroids are at most so similar to one another, so that a crowd of near copies does not spread over many lists.
APART = 0.8


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def lloyd(points: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        owner = nearest(points, centres)
        count = np.bincount(owner, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, owner, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """Points in order, each at most APART similar to those before, `most` of them at most."""
    kept = np.empty((0, points.shape[1]))
    for i in range(0, len(points), 256):
        block = points[i : i + 256]
        block = block[(block @ kept.T).max(1, initial=-1) < APART]
        own = block @ block.T
        chosen: list[int] = []
        for k in range(len(block)):
            if not chosen or own[k, chosen].max() < APART:
                chosen.append(k)
        kept = np.concatenate([kept, block[chosen]])
        if len(kept) >= most:
            break
    return kept[:most]


class Single:
    """One list and no code, whose error is infinite: everything is compared exactly."""

    def __init__(self, dim: int):
        self.centres, self.cuts, self.books = np.zeros((1, dim)), [], []

    def lists(self, unit: np.ndarray, probes: int) -> np.ndarray:
        return np.zeros((len(unit), 1), int)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((len(residual), 0), np.uint8), np.full(len(residual), np.inf)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.zeros((len(residual), len(codes)))


class Index:
    """Coarse centroids and codebooks."""

    def __init__(self, sample: np.ndarray, n_lists: int, subspaces: int = SUBSPACES):
        sample = sample / np.linalg.norm(sample, axis=1)[:, None]
        centres = lloyd(sample, spread(sample, n_lists), 5)
        norms = np.linalg.norm(centres, axis=1)
        centres = centres[norms > 1e-9] / norms[norms > 1e-9, None]
        self.centres = spread(centres, n_lists)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [lloyd(residual[:, c], residual[: min(CODEWORDS, len(residual))][:, c], 5) for c in self.cuts]

    def lists(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each vector, ascending by number."""
        m = min(probes, len(self.centres))
        similar = unit @ self.centres.T
        top = np.argpartition(-similar, m - 1, axis=1)[:, :m] if m < len(self.centres) else np.tile(np.arange(m), (len(unit), 1))
        return np.sort(top, axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual to what its code stands for."""
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        error = sum(((residual[:, c] - b[codes[:, k]]) ** 2).sum(1) for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(error)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of exact residuals to codes, by table lookup."""
        total = np.zeros((len(residual), len(codes)))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, c]
            table = (part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


class Lists:
    """An index for each length of vectors; `first` is the number of its first list, below zero for lengths without one."""

    def __init__(self, indexes: dict[int, Index]):
        self.indexes, self.first, n = indexes, {}, 0
        for d, index in sorted(indexes.items()):
            self.first[d] = n
            n += len(index.centres)
        self.n = n

    def of(self, dim: int) -> tuple[Index | Single, int]:
        return (self.indexes[dim], self.first[dim]) if dim in self.indexes else (Single(dim), -dim)


def stacked(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def assigned(shared, probes: int, kind: pa.DataType):
    """Rows (uid, weight, list, lists, code, error, vec) for each distinct vector and list."""

    def run(batches):
        for batch in batches:
            length = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for dim in np.unique(length).tolist():
                own, first = shared.value.of(dim)
                part = batch.take(pa.array(np.flatnonzero(length == dim)))
                unit = stacked(part.column("embedding"))
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                lists = own.lists(unit, probes)
                for k in range(lists.shape[1]):
                    codes, error = own.encode(unit - own.centres[lists[:, k]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("uid"), part.column("weight"), pa.array(first + lists[:, k], pa.int32()),
                            pa.array(list((first + lists).astype(np.int32)), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()),
                            pa.array(error), part.column("embedding").cast(pa.list_(kind)),
                        ],
                        names=["uid", "weight", "list", "lists", "code", "error", "vec"],
                    )

    return run


def compare(index: Index | Single, threshold: float, rows: dict, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each vector of a unit links to, by weight, and a label shared by all that links connect.

    both: the unit is a pair of different chunks, and only pairs across them count.
    """
    vec, lists, weight, side, place = rows["vec"], rows["lists"], rows["weight"], rows["side"], rows["list"]
    n, radius = len(vec), np.sqrt(max(0.0, 2 - 2 * threshold))
    unit = vec / np.linalg.norm(vec, axis=1)[:, None]
    residual = unit - rows["centre"]
    count, pairs = np.zeros(n, np.int64), []
    for a in range(0, n, 128):
        q = slice(a, min(n, a + 128))
        near = index.distances(residual[q], rows["code"]) <= radius + rows["error"] + 1e-6
        near &= np.arange(n) > np.arange(n)[q][:, None]
        if both:
            near &= side[q][:, None] != side
        columns = np.flatnonzero(near.any(0))
        if not len(columns):
            continue
        exact = unit[q] @ unit[columns].T
        i, j = np.nonzero(near[:, columns] & (exact >= threshold))
        i, j = i + a, columns[j]
        pairs.append((i, j))
        common = (lists[i][:, :, None] == lists[j][:, None, :]).any(2)
        first = np.where(common, lists[i], np.iinfo(np.int32).max).min(1) == place
        count += np.bincount(i[first], weight[j[first]], n).astype(np.int64)
        count += np.bincount(j[first], weight[i[first]], n).astype(np.int64)
    label = np.arange(n)
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
    return count, label


def searched(shared, threshold: float):
    def run(batches):
        held, unit = [], None

        def found():
            table = pa.Table.from_batches(held).combine_chunks()
            # The two chunks of a pair are told apart by their numbers.
            chunk = table.column("chunk").to_numpy()
            vec, place = stacked(table.column("vec").combine_chunks()), int(table.column("list")[0].as_py())
            own, first = shared.value.of(vec.shape[1])
            rows = {
                "vec": vec, "centre": own.centres[place - first], "lists": stacked(table.column("lists").combine_chunks()).astype(np.int32),
                "weight": table.column("weight").to_numpy(), "error": table.column("error").to_numpy(), "list": place,
                "code": np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(table), len(own.cuts)), "side": chunk,
            }
            count, label = compare(own, threshold, rows, bool(table.column("pair")[0].as_py()))
            uid = table.column("uid").to_numpy()
            keep = (count > 0) | (label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(count[keep]), pa.array(uid[label[keep]])], names=["uid", "links", "other"])

        for batch in batches:
            units = batch.column("unit").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)] if len(units) else []
            begin = 0
            for end in ends:
                if units[begin] != unit and held:
                    yield found()
                    held = []
                unit = units[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield found()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, probes: int = PROBES, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    number = "double" if "double" in dict(rows.dtypes)["embedding"] else "float"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    grouped = cut(rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight")))
    distinct = grouped.withColumn("uid", F.monotonically_increasing_id())
    # One row for each length of vectors.
    lengths = {r["d"]: r["n"] for r in grouped.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return alone
    n, common = sum(lengths.values()), sorted(lengths, key=lambda d: (-lengths[d], d))[:FITTED]
    each = sample // len(common)
    share = F.create_map(*[F.lit(x) for d in common for x in (d, 1_000_000 if lengths[d] <= each else 950_000 * each // lengths[d])])
    drawn = distinct.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < F.try_element_at(share, F.size("embedding")))
    fitted_on: dict[int, list] = {}
    for r in drawn.select("embedding").limit(sample).collect():
        fitted_on.setdefault(len(r[0]), []).append(r[0])

    def fitted(dim: int) -> Index:
        # One order, whatever came first, and not one of the values'.
        own = np.array(fitted_on[dim], np.float64)
        own = np.random.default_rng(0).permutation(own[np.lexsort(own.T)])
        return Index(own, min(MOST_LISTS, max(1, int(4 * lengths[dim] ** 0.5))))

    # At most MOST_LISTS centroids and SUBSPACES codebooks of CODEWORDS entries for each of FITTED lengths, and no more
    # centroids than `sample` vectors: a few MB at any size of the table.
    index = spark.sparkContext.broadcast(Lists({d: fitted(d) for d in fitted_on}))
    n_lists = max(1, index.value.n)
    kind = pa.float64() if number == "double" else pa.float32()
    stored = cut(
        distinct.select("uid", "weight", "embedding").mapInArrow(
            assigned(index, probes, kind), f"uid long, weight long, list int, lists array<int>, code binary, error double, vec array<{number}>"
        )
    )
    chunk = min(4096, max(128, probes * n // n_lists))
    sizes = F.broadcast(stored.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    # One row for each list.
    units = (
        stored.join(sizes, "list")
        .withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("pair", F.col("chunk") != F.col("with"))
        .withColumn("unit", F.concat_ws("-", "list", F.least("chunk", "with"), F.greatest("chunk", "with")))
        .drop("chunks", "with")
    )
    # A vector meets its own chunk in one unit; in the units with other chunks only pairs across count.
    found = cut(
        units.repartition(partitions(spark), "unit").sortWithinPartitions("unit")
        .mapInArrow(searched(index, threshold), "uid long, links long, other long")
    )
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    rooted = (
        distinct.join(counts, "uid", "left").join(roots, distinct["uid"] == roots["node"], "left")
        .select("embedding", "least_id", F.col("weight").alias("copies"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    )
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("weight"))
    classes = spread_join(rooted, least, "root", n).select("embedding", "n_links", "component_id", F.col("copies").alias("weight"))
    linked = spread_join(rows.where(usable), classes, "embedding", grouped.agg(F.sum("weight")).first()[0]).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return linked.unionByName(alone)
