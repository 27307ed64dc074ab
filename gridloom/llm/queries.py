"""The operators of this subpackage as queries over the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import counting, language, mixing, orderminhash, packing, simhash, toolcalls, toxicity, vectors, wavelet


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_orderminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.compare_edited(documents(spark, sf_dir))


def op5_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return wavelet.read(spark, path)


#: Tools that conversations may call.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"), SCHEMAS)


def op7_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS weight, CAST(3 * source_size AS BIGINT) AS stop FROM r),
a AS (SELECT *, CAST(stop AS DOUBLE) / weight AS stops_at FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stops_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY stops_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM a),
v AS (SELECT level FROM l WHERE level <= stops_at ORDER BY stops_at, place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), (SELECT level FROM v) * weight) AS target FROM l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.digest || ':' || CAST(d.nth AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM x
"""

def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces_of(documents(spark, sf_dir), path, end_id=1))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_orderminhash": op4_orderminhash,
    "op5_wavelet": op5_wavelet,
    "op6_toolcalls": op6_toolcalls,
    "op7_counting": op7_counting,
    "op8_vectors": op8_vectors,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}
ORACLE_SQL = {"op9_mixing": OP9_SQL}
