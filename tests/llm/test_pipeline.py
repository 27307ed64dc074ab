import os

import pytest

import corpus_pipeline
from gridloom.llm import mixing, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "near_duplicates":
            classes = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(classes)
        if name == "mixing":
            assert counts[-1] == sum(r.copies for r in mixing.mix(before).collect())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[1] > 0.7 * counts[0]
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    assert docs.where("piece = 0").count() == mixed.count()
