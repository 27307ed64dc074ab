import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.pieces import PieceEncoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "a b\n", "it's we're 'r e", "don' t", "x  y", "x  y",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|> b<|startoftext|>", "é ́x", "Σ aΣ Σb", "...  !!! ?",
    "tab\t x", "1 23 456  7", "über größe", "\U0001f600 \U0001f600\U0001f600", "\x1c x \x1d", None,
]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = public_tokenizers.path(request.param)
    return Tokenizer.from_file(path), PieceEncoder(path)


def same(both, texts):
    library, own = both
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.ids(texts)] == expected
    assert own.counts(texts).tolist() == [len(x) for x in expected]


def test_hard_texts(both):
    same(both, HARD)
    same(both, HARD + [" ".join(str(t) for t in HARD)])


def test_no_texts(both):
    same(both, [])


def test_plain_words_take_the_short_way(both):
    own = both[1]
    assert own.spelling is not None
    words = ["Straße", "élève", "NIÑO", "don", "Ünïcödé", "ÿ", "x", "İstanbul", "ΑΣ", "œuvre", "ªb", "straße", "ǅ"]
    same(both, [" ".join(w + m for w in words for m in ["", ",", ".", "!?", "'s", "..", ",x"])] + words + [" " + w for w in words])
    same(both, [" ".join(w + m for m in [",", ".", ""] for w in words)])


@pytest.mark.parametrize("name", NAMES)
def test_two_lines_and_runs_of_marks_take_the_short_way(name, monkeypatch):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), PieceEncoder(path)
    words = ["inwh.\nWas", "it$$$", "Élève,###", "a\nb", "x!!\nÜber.&&", "ß:;\nI", "don.\nS", "at%*%*"]
    asked = []

    class Watched:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return [library.encode(t, **more) for t in texts]

        encode_batch = encode_batch_fast

    monkeypatch.setattr(own, "tokenizer", Watched())
    same((library, own), [" ".join(words), *words, *[" " + w for w in words], " ".join(reversed(words))])
    assert not any(asked)
    same((library, own), ["a\n\nb c.\n\nD e\n f.\n g", "it's\nwe're $$$$$ a$$$$$ b", "a<\n|b a.\n.b a\n'S", "a.\nb.\nc"])
    assert any(asked)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(" \n\t\r ab'srtl.,é́ßΣσ1!<|>endoftext"), max_size=40), max_size=4))
def test_any_text(both, texts):
    same(both, texts)


def test_memory_is_bounded(both, monkeypatch):
    import gridloom.llm.pieces as pieces

    monkeypatch.setattr(pieces, "MOST_PIECES", 50)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 100)
    texts = [" ".join(f"word{i * j}" for j in range(20)) for i in range(30)]
    same(both, texts)
    assert len(both[1].numbers) < 200 and isinstance(both[1].flat, np.ndarray)


def test_whole_texts_go_to_workers_in_small_batches(spark):
    from gridloom.llm import common, packing

    docs = spark.range(5000).selectExpr("id AS doc_id", "'some words' AS text").coalesce(1)
    packing.pieces_of(docs, public_tokenizers.path(NAMES[0]), end_id=1)
    sizes = docs.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= common.BATCH_ROWS


def test_a_larger_memory_forgets_later_and_changes_no_ids(monkeypatch):
    from gridloom.llm import pieces

    monkeypatch.setattr(pieces, "MOST_PIECES", 50)
    path = public_tokenizers.path(NAMES[0])
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(9)) for i in range(10)] * 2
    held = []
    for memory in (1, 2):
        own, most = pieces.PieceEncoder(path, memory), 0
        for t in texts:
            assert next(own.ids([t])).tolist() == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
            most = max(most, len(own.numbers))
        held.append(most)
    assert held[0] < 70 < held[1] <= 109
