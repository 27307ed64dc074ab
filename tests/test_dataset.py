from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import codec
from gridloom.operators.matrix import SparseMatrix
from gridloom.plans.prepare import prepare
from gridloom.sources.dataset import Dataset


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=40))
def test_codec_round_trip(places):
    data = codec.encode(np.array(sorted(places), np.int64))
    assert codec.decode(data).tolist() == sorted(places)


def test_codec_bytes():
    assert codec.encode(np.array([3, 131, 260])).hex() == "037f8001"
    assert codec.encode(np.array([0, 1, 20000])).hex() == "00009e9c01"
    for edge in (127, 128, 16383, 16384, 2097151, 2097152, (1 << 35) - 1, 1 << 35):
        assert codec.decode(codec.encode(np.array([edge]))).tolist() == [edge]
    for bad in ([1, 1], [-1]):
        with pytest.raises(ValueError):
            codec.encode(np.array(bad))


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(0)
    dense = rng.integers(0, 8, (12, 6)) * (rng.random((12, 6)) > 0.4).astype(float)
    dense[3] = 0
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    x = SparseMatrix(dense.shape, cells=spark.createDataFrame(cells, "i long, j long, v double"))
    obs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)], "i long, kind string")
    var = spark.createDataFrame([(j, f"g{j}") for j in range(6)], "j long, gene string")
    near = spark.createDataFrame([(i, (i + 2) % 12, 1.0) for i in range(12)], "i long, i2 long, v double")
    return dense, Dataset(x, obs, var, raw=x, layers={"twice": x * 2}, obsp={"near": near}, uns={"a": 1})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 1 << 40), max_size=12), max_size=8))
def test_codec_of_many_lists(lists):
    sizes = np.array([len(x) for x in lists], np.int64)
    digits, ends = codec.encode_all(np.array([p for x in lists for p in sorted(x, reverse=True)], np.int64), sizes)
    data = [digits[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert [codec.decode(d.tobytes()).tolist() for d in data] == [sorted(x) for x in lists]
    places, stops = codec.decode_all(digits, np.diff(ends, prepend=0))
    assert [places[a:b].tolist() for a, b in zip([0, *stops], stops, strict=False)] == [sorted(x) for x in lists]


def filled(m):
    out = np.zeros(m.shape)
    for r in m.cells.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize("layout", ["grouped", "packed"])
def test_round_trip(spark, data, tmp_path, layout):
    dense, d = data
    d.write(str(tmp_path / layout), layout)
    back = Dataset.read(spark, str(tmp_path / layout))
    assert (filled(back.x) == dense).all() and (filled(back.matrix("twice")) == 2 * dense).all() and (filled(back.matrix(use_raw=True)) == dense).all()
    assert back.uns == {"a": 1} and back.obs.count() == 12 and back.obsp["near"].count() == 12


def test_subset_moves_every_field(data):
    dense, d = data
    part = d.subset("kind = 'b'", "gene > 'g1'")
    assert (filled(part.x) == dense[1::2, 2:]).all() and (filled(part.layers["twice"]) == 2 * dense[1::2, 2:]).all()
    assert sorted(tuple(r) for r in part.obs.collect()) == [(i, "b") for i in range(6)]
    assert sorted((r.i, r.i2) for r in part.obsp["near"].collect()) == [(i, (i + 1) % 6) for i in range(6)]


def test_getitem(spark, data):
    dense, d = data
    d = replace(d, obs_label="name", obs=d.obs.selectExpr("*", "concat('r', i) AS name"), var_label="gene")
    for key, rows, cols in (
        ((slice(2, 9, 2), slice(None, None, -1)), slice(2, 9, 2), slice(None, None, -1)), ((5, slice(1, 3)), [5], slice(1, 3)),
        (([True] + [False] * 10 + [True], [4, 0, 4]), [0, 11], [4, 0, 4]), ((["r7", "r2"], "g3"), [7, 2], [3]), ([-1, 3], [-1, 3], slice(None)),
    ):
        part = d[key]
        expected = dense[rows][:, cols]
        assert part.x.shape == expected.shape and (filled(part.x) == expected).all() and (filled(part.layers["twice"]) == 2 * expected).all()
        assert part.obs.count() == expected.shape[0] and part.var.count() == expected.shape[1] and (filled(part.raw) == expected).all()
        part.release()
    assert [r.name for r in d[["r7", "r2"], :].obs.orderBy("i").collect()] == ["r7", "r2"]
    for bad in ((["r7", "nobody"], slice(None)), (slice(None), "g99")):
        with pytest.raises(KeyError):
            d[bad]
    with pytest.raises(KeyError):
        data[1]["r1", :]
    with pytest.raises(IndexError):
        d[1, 2, 3]


def test_raw_setter(data):
    dense, d = data
    wide = d.x.select(slice(None), [0, 1, 2, 3, 4, 5, 0])
    part = d.with_raw(wide)[1:4]
    assert part.matrix(use_raw=True).shape == (3, 7) and (filled(part.raw)[:, :6] == dense[1:4]).all()
    assert d.with_raw(None).raw is None
    with pytest.raises(TypeError):
        d.with_raw(dense)
    with pytest.raises(ValueError):
        d.with_raw(d.x.select(slice(0, 3)))


def test_wrong_parts(data):
    _, d = data
    with pytest.raises(TypeError):
        Dataset("no matrix")
    with pytest.raises(ValueError):
        d.matrix("twice", use_raw=True)
    with pytest.raises(ValueError):
        d.with_x(d.x.select(slice(0, 3)))
    with pytest.raises(ValueError):
        d.write("nowhere", layout="other")


def reference(dense, least_row, threshold):
    rows = dense.sum(1) > least_row
    cols = dense.sum(0) > threshold * len(dense)
    kept = dense[rows][:, cols]
    total = kept.sum(1)
    x = np.divide(kept, (total / np.median(total))[:, None], where=total[:, None] > 0, out=np.zeros_like(kept))
    g = x.sum(0)
    return np.log10(1 + 1000 * np.divide(x, g, where=g > 0, out=np.zeros_like(x))).astype(np.float32)


@pytest.mark.parametrize("least_row, threshold", [(-1, 0.2), (7.5, 0.4), (4, 2.2)])
def test_prepare(data, least_row, threshold):
    dense, d = data
    got = prepare(d, least_row, threshold)
    expected = reference(dense, least_row, threshold)
    assert got.x.shape == expected.shape and np.allclose(filled(got.x), expected, atol=1e-5)


def test_prepare_filters_in_order(data):
    dense, d = data
    got = prepare(d, 10, 1.0, min_rows=3, obs_filter="kind = 'a'")
    part = dense[::2]
    cols = (part.sum(0) > len(part)) & ((part > 0).sum(0) >= 3)
    assert got.x.shape == ((part.sum(1) > 10).sum(), cols.sum())
    assert got.obs.count() == got.x.shape[0] and got.var.count() == got.x.shape[1]


def test_prepare_checks_its_settings(data):
    _, d = data
    with pytest.raises(TypeError):
        prepare(d, min_rows=True)
    with pytest.raises(ValueError):
        prepare(d, min_rows=-1)
    with pytest.raises(ValueError, match="no rows"):
        prepare(d, obs_filter="kind = 'z'")
