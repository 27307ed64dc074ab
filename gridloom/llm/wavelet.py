"""Token ids as wavelet matrices: each shard is one compressed file of bit-planes with rank and select.

Documents are dealt in order of id over range partitions; a task appends the end id to each document's ids and closes
a shard when it holds enough. Shards are rows of a Parquet table in the shared folder, so any store that Spark writes
can hold them: where the shard starts, its documents and their lengths, and the compressed planes.

Edge cases: a null or empty text is the end id alone; null ids come first; rows of equal id follow the hash of their
text; a document is never cut, so a huge one makes a large shard; an empty table gives an empty index; other columns
of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import new_path, partitions, small_batches
from gridloom.llm.pieces import encoder, rows_of

SHARD_TOKENS = 1 << 20
MAGIC = b"GLW1"
#: The encoders here remember twice as much as elsewhere: beside them their workers hold one shard's ids only.
MEMORY = 2


class WaveletMatrix:
    """A sequence of unsigned numbers as bit-planes, most significant first.

    At each level the numbers whose bit is 0 go before those whose bit is 1, in order; a plane holds the bits as they
    stand at its level.
    """

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        width = max(1, int(values.max()).bit_length()) if len(values) else 1
        current = values.astype(np.uint16 if width <= 16 else np.uint32)
        planes = []
        for level in range(width - 1, -1, -1):
            ones = (current & current.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            # Places cost less than masks where bits are mixed.
            current = np.concatenate([np.compress(~ones, current), np.compress(ones, current)])
        return cls(len(values), planes)

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1)
        body = [press.compress(p.tobytes()) for p in self.planes]
        head = np.array([self.n, len(body), *map(len, body)], "<u8")
        return b"".join([MAGIC, head.tobytes(), *body])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, width = np.frombuffer(data, "<u8", 2, 4).tolist()
        sizes = np.frombuffer(data, "<u8", width, 20).tolist()
        at, planes, open_ = 20 + 8 * width, [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(np.frombuffer(open_.decompress(data[at : at + size]), np.uint8))
            at += size
        return cls(n, planes)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All numbers, from the lowest plane up."""
        current = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = self.bits(level)
            before = np.empty_like(current)
            zeros = self.n - int(np.count_nonzero(ones))
            before[np.flatnonzero(~ones)] = current[:zeros]
            before[np.flatnonzero(ones)] = current[zeros:] | (1 << (len(self.planes) - 1 - level))
            current = before
        return current

    def _directory(self) -> list[np.ndarray]:
        """Ones before each byte of each plane."""
        if self._ranks is None:
            self._ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in self.planes]
        return self._ranks

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        byte, rest = divmod(i, 8)
        ones = int(self._directory()[level][byte])
        return ones + (int(self.planes[level][byte]) & ((1 << rest) - 1)).bit_count() if rest else ones

    def _find(self, level: int, bit: int, k: int) -> int:
        """Where a plane has its k-th bit of this kind, from 0."""
        ranks = self._directory()[level]
        ranks = ranks if bit else 8 * np.arange(len(ranks)) - ranks
        byte = int(np.searchsorted(ranks, k, side="right")) - 1
        left = k - int(ranks[byte])
        for j in range(8):
            if int(self.planes[level][byte]) >> j & 1 == bit:
                if left == 0:
                    return 8 * byte + j
                left -= 1
        raise IndexError(k)

    def _zeros(self, level: int) -> int:
        return self.n - int(self._directory()[level][-1])

    def access(self, i: int) -> int:
        """The number at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            value = value << 1 | bit
            i = self._zeros(level) + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        if value < 0 or value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            if value >> (len(self.planes) - 1 - level) & 1:
                z = self._zeros(level)
                begin, end = z + self._ones(level, begin), z + self._ones(level, end)
            else:
                begin, end = begin - self._ones(level, begin), end - self._ones(level, end)
        return begin, end

    def rank(self, value: int, end: int) -> int:
        """How often value stands before place end."""
        return self.count(value, 0, end)

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self._range(value, begin, self.n if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of value, from 0."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, bit, i - self._zeros(level) if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


SHARDS = "part int, shard int, part_start long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Writes the shards of docs and returns the path of their table."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "wavelet")

    def run(batches):
        own, part = encoder(tokenizer, MEMORY), TaskContext.get().partitionId()
        start = shard = held = 0
        doc_ids, arrays = [], []

        def close():
            data = WaveletMatrix.build(np.concatenate(arrays)).to_bytes()
            one = {"part": part, "shard": shard, "part_start": start, "n_tokens": held, "doc_ids": doc_ids, "lengths": [len(a) for a in arrays], "data": data}
            return pa.RecordBatch.from_pylist([one], schema=schema)

        kinds = {"part": pa.int32(), "shard": pa.int32(), "part_start": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "data": pa.binary()}
        schema = pa.schema(list(kinds.items()))
        for numbers, texts in rows_of(batches):
            for doc_id, ids in zip(numbers, own.ids(texts), strict=True):
                doc_ids.append(doc_id)
                arrays.append(np.append(ids, np.uint32(end_id)))
                held += len(arrays[-1])
                if held >= shard_tokens:
                    yield close()
                    start, shard, held = start + held, shard + 1, 0
                    doc_ids, arrays = [], []
        if arrays:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInArrow(run, SHARDS).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards alone."""
    shards = spark.read.schema(SHARDS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["data"]).decode().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(sums), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["part_start"] + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"],
                )

    decoded = shards.select("part", "part_start", "doc_ids", "lengths", "data").mapInArrow(
        run, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"
    )
    # One row for each range partition, a number that is chosen and does not grow with the rows.
    return decoded.join(F.broadcast(bases), F.col("part") == F.col("of_part")).select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
