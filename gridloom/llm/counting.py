"""Token counts of whole texts; huge ones are encoded as overlapping chunks on many tasks and spliced.

A chunk is encoded with offsets. A tokenizer's pattern scans from left to right and looks only ahead, so once two scans
of one text begin a word at the same place they agree from there on; a chunk's scan is that of the whole text up to
where its end comes into sight. The first word start that two neighbours share inside their overlap, outside a margin
before the end of the left one, is thus a proven boundary, and a document's count is what each chunk has between its
boundaries. A document with an overlap that has no such boundary is chunked anew with chunks and overlaps of twice the
size, until it succeeds or one chunk holds it whole.

Edge cases: a null text counts as empty; rows of equal text are encoded once; ids may be null or repeat; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from gridloom.llm.common import cut, partitions, spread_join
from gridloom.llm.pieces import LONGEST_SPECIAL, encoder

#: Texts of more characters are cut into chunks.
HUGE = 65_536
CHUNK = 32_768
OVERLAP = 256
#: A word start so near a chunk's end may not be one in the whole text: the longest string that is looked at as a whole
#: is a special one.
MARGIN = LONGEST_SPECIAL
CHUNKS = "key string, k long, n_chunks long, at long, ends long, left_end long, chunk string"
PARTS = "key string, k long, n_chunks long, n_tokens long, head array<struct<place:long,token:long>>, tail array<struct<place:long,token:long>>"


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk; each begins `overlap` before its predecessor's end."""
    spans, at = [], 0
    while True:
        end = min(len(text), at + chunk)
        spans.append((at, end))
        if end == len(text):
            return spans
        at = end - overlap


def word_starts(tokenizer, chunk: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of tokens of chunk, and the place and token at which each of its words starts."""
    encoding = tokenizer.encode(chunk, add_special_tokens=False)
    n = len(encoding.ids)
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    places = np.array([a for a, _ in encoding.offsets], np.int64).reshape(-1)
    first = np.ones(n, bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return n, places[first], np.flatnonzero(first)


def cut_texts(chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                spans = chunks_of(text, chunk, overlap)
                for k, (a, b) in enumerate(spans):
                    one = (key, k, len(spans), a, b, spans[k - 1][1] if k else 0, text[a:b])
                    yield pd.DataFrame([one], columns=["key", "k", "n_chunks", "at", "ends", "left_end", "chunk"])

    return run


def encode_chunks(path: str, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                n, places, tokens = word_starts(own.tokenizer, r.chunk)
                places = places + r.at
                first, last = places <= r.left_end - MARGIN, (places >= r.ends - overlap) & (places <= r.ends - MARGIN)
                pairs = [[{"place": int(p), "token": int(t)} for p, t in zip(places[m], tokens[m], strict=True)] for m in (first, last)]
                rows.append((r.key, r.k, r.n_chunks, n, pairs[0] if r.k else [], pairs[1] if r.k < r.n_chunks - 1 else []))
            yield pd.DataFrame(rows, columns=["key", "k", "n_chunks", "n_tokens", "head", "tail"])

    return run


def splice(parts: DataFrame) -> DataFrame:
    """(key, n_tokens): null where two neighbours share no word start."""
    left = parts.select("key", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    joined = parts.join(left, ["key", "k"], "left")
    # Both lists are short: they lie inside one overlap.
    places = F.array_intersect(F.transform("head", lambda x: x["place"]), F.transform("before", lambda x: x["place"]))
    meets = F.array_min(places)

    def token(pairs: str):
        return F.get(F.filter(pairs, lambda x: x["place"] == F.col("meets")), 0)["token"]

    each = (
        joined.withColumn("meets", F.when(F.col("k") > 0, meets))
        .withColumn("skips", F.when(F.col("k") > 0, token("head")).otherwise(0))
        .withColumn("stops", F.when(F.col("k") > 0, token("before")).otherwise(0))
    )
    # The chunk before ends at `stops`, so its tokens from there on are not counted.
    lasts = each.select("key", (F.col("k") - 1).alias("k"), F.col("stops").alias("until")).where("k >= 0")
    counted = each.select("key", "k", "n_chunks", "n_tokens", "skips").join(lasts, ["key", "k"], "left")
    own = F.when(F.col("k") == F.col("n_chunks") - 1, F.col("n_tokens")).otherwise(F.col("until")) - F.col("skips")
    return counted.groupBy("key").agg(
        F.when(F.count(own) == F.count("*"), F.sum(own)).alias("n_tokens")
    )


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) for rows (key, text, n_chars) of distinct keys."""
    done, todo = None, texts
    longest = texts.agg(F.max("n_chars")).first()[0] or 0
    while True:
        dealt = todo.select("key", "text").mapInPandas(cut_texts(chunk, overlap), CHUNKS).repartition(partitions(texts.sparkSession))
        counts = cut(splice(cut(dealt.mapInPandas(encode_chunks(path, overlap), PARTS))))
        found = counts.where("n_tokens IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        if chunk >= longest or not counts.where("n_tokens IS NULL").limit(1).count():
            return done
        todo = todo.join(counts.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap


def token_counts(docs: DataFrame, path: str, limit: int = 1024, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs."""

    @pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(path).counts(texts.tolist()))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(F.length("text") <= huge).select("doc_id", n_bytes, counted("text").alias("n_tokens"))
    # Read once and kept apart: texts of this length are few, and the rounds below ask for them again and again.
    long = cut(rows.where(F.length("text") > huge).select("doc_id", "text", n_bytes, F.sha2("text", 256).alias("key")))
    texts = long.select("key", "text", F.length("text").alias("n_chars")).dropDuplicates(["key"])
    keyed = long.select("doc_id", "n_bytes", "key")
    counts = count_huge(texts, path, chunk, overlap).join(keyed.groupBy("key").agg(F.count("*").alias("weight")), "key")
    found = spread_join(keyed, counts, "key", long.count()).select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(found).withColumn("over_limit", F.col("n_tokens") > limit)
