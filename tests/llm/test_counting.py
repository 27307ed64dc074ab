import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import counting

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk, overlap", [(200, 60), (400, 100)])
def test_chunks_splice_to_the_whole(spark, chunk, overlap):
    texts = [
        "The quick brown fox, it's 123 jumping  over\n\n lazy dogs! " * 40,
        "word<|endoftext|>more <|endoftext|> " * 60,
        "a" * 3000,  # no boundary at all
        "x" * 900 + " and then words follow " * 30,
        " " * 700 + "über größe ñandú " * 50 + "\n" * 300,
        "€" * 500 + "日本語" * 300 + " end",
        "don't we'll they've I'd " * 80,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in counting.token_counts(docs, PATH, huge=300, chunk=chunk, overlap=overlap).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == library(texts)
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (got[i].n_tokens > 1024) for i, t in enumerate(texts))


def test_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in counting.token_counts(odd, PATH, huge=1000, chunk=500, overlap=100).na.fill(-1).collect())
    rows = odd.collect()
    n = library([r.text for r in rows])
    expected = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True))
    assert got == expected


def test_empty_table(spark, odd):
    assert counting.token_counts(odd.limit(0), PATH).count() == 0
