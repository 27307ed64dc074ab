"""Best-fit packing with certified bin counts.

Documents become token ids, only those above the capacity are cut, and the pieces are dealt to partitions without a
key. Each partition packs best-fit decreasing and compares its bins with lower bounds from dual feasible functions.
Its emptiest bins, more of them the further its count is above the bound, go back; partitions exchange these documents,
fewer partitions each round, and pack them again, until one partition is left.

Edge cases: a null or empty text is the end id alone; repeated rows are packed as often as they come; ids may be null
or repeat; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, partitions, small_batches
from gridloom.llm.pieces import encoder, rows_of

CAPACITY = 4096
#: So many pieces are packed by one task at most, but for what a round hands back.
ROWS_PER_TASK = 200_000
#: Partitions whose documents meet in one of the next round.
MEET = 16
ROUNDS = 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: its place in the document, length and checksum of its ids."""

    def run(batches):
        own = encoder(path)
        for doc_ids, texts in rows_of(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(doc_ids, own.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bin and the place in it of each size, and what each bin holds."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while some bin has room for r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        if room > size:
            open_bins.setdefault(room - size, []).append(b)
            rooms |= 1 << (room - size)
    return bins, places, fill


def lower_bound(counts: np.ndarray, capacity: int, most_k: int = 64) -> int:
    """Bins that any packing needs; counts[s] is the number of pieces of size s, for s up to the capacity.

    Dual feasible functions: sizes below a threshold count nothing and those above its complement a whole bin; and
    sizes rounded down to multiples of 1/k where they aren't multiples of 1/(k+1).
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    least = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - least + 1]
    between = volume[capacity - least + 1] - volume[least]
    best = int(np.max(large - (-between // capacity)))
    for k in range(1, most_k + 1):
        exact = (k + 1) * sizes % capacity == 0
        value = np.where(exact, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def give_back(fill: list[int], bound: int, capacity: int) -> np.ndarray:
    """Bins whose documents are exchanged: the emptiest, and eight more for each bin above the bound."""
    fill = np.array(fill)
    order = np.argsort(fill, kind="stable")[: 1 + 8 * (len(fill) - bound)]
    return order[fill[order] < capacity]


def pack_partition(round_number: int, last: bool, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=False, kind="stable", ignore_index=True)
        bins, places, fill = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        bound = lower_bound(np.bincount(rows["length"], minlength=capacity + 1), capacity)
        back = np.zeros(len(fill), bool)
        if not last:
            back[give_back(fill, bound, capacity)] = True
        base = (round_number << 56) | (TaskContext.get().partitionId() << 32)
        yield rows.assign(sequence_id=base + bins, offset=places, done=~back[bins])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of pieces with sequence_id and offset."""
    pieces = cut(pieces)
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    if n == 0:
        return whole
    tasks = max(-(-n // rows_per_task), min(partitions(pieces.sparkSession), -(-n // 2000)))
    done = [whole]
    for r in range(1, ROUNDS + 1):
        last = tasks == 1 or r == ROUNDS
        packed = cut(rest.repartition(tasks).mapInPandas(pack_partition(r, last, capacity), f"{PIECES}, sequence_id long, offset long, done boolean"))
        done.append(packed.where("done").drop("done"))
        if last:
            break
        rest = packed.where("not done").drop("sequence_id", "offset", "done")
        tasks = max(-(-tasks // MEET), -(-rest.count() // rows_per_task), 1)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
