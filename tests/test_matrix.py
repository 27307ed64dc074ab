import re

import numpy as np
import pytest

from gridloom.functions import codec
from gridloom.operators import elementwise, product
from gridloom.operators.matrix import SparseMatrix
from gridloom.operators.normalize import Normalized

SHAPES = [(1, 3), (4, 4), (9, 2), (15, 11)]


def make(spark, dense, major="row", grouped=False):
    cells = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    m = SparseMatrix(dense.shape, major, cells=spark.createDataFrame(cells, "i long, j long, v double"))
    return m.grouped() if grouped else m


def filled(m):
    out = np.zeros(m.shape)
    for r in m.cells.collect():
        out[r.i, r.j] = r.v
    return out


def vector(frame, name, value="v"):
    return np.array([r[value] for r in frame.orderBy(name).collect()], float)


@pytest.fixture(params=SHAPES, ids=str)
def signed(request):
    """Every third cell is zero, the others repeat some values of either sign, half ones among them."""
    i, j = np.indices(request.param)
    return np.where((i + 2 * j) % 3 == 0, 0.0, ((5 * i + 3 * j) % 9 - 3.5))


@pytest.mark.parametrize("major", ["row", "col"])
def test_forms_and_reductions(spark, signed, major):
    m = make(spark, signed, major, grouped=True)
    assert (filled(m) == signed).all()
    assert (filled(m.T) == signed.T).all()
    assert (filled(m.regroup("col" if major == "row" else "row").grouped()) == signed).all()
    for axis, name in ((0, "j"), (1, "i")):
        assert (vector(m.sum(axis), name) == signed.sum(axis)).all()
        assert np.allclose(vector(m.mean(axis), name), signed.mean(axis))
        assert (vector(m.nnz(axis), name) == (signed != 0).sum(axis)).all()
        assert (vector(m.max(axis), name) == signed.max(axis)).all()
        assert (vector(m.min(axis), name) == signed.min(axis)).all()
    assert m.sum().first().v == signed.sum() and m.max().first().v == signed.max() and m.min().first().v == signed.min()


def test_full_negative_columns_do_not_report_zero(spark):
    full = make(spark, np.array([[-6.5, -0.25], [-2, -9], [-7, -1]]))
    assert vector(full.max(0), "j").tolist() == [-2, -0.25] and vector(full.max(1), "i").tolist() == [-0.25, -2, -1]
    holed = make(spark, np.array([[-6.5, -0.25], [0, -9], [-7, -1]]))
    assert vector(holed.max(0), "j").tolist() == [0, -0.25] and vector((-holed).min(0), "j").tolist() == [0, 0.25]


def test_equal_values_are_grouped_and_stored_zeros_stay(spark):
    dense = np.tile([4.0, 0, 4, 1], (6, 1))
    stats = make(spark, dense, "col").stats().first()
    assert (stats.nnz, stats.n_unique, stats.count_nonzero) == (18, 3, 18)
    assert make(spark, dense, "row").stats().first().n_unique == 12
    zero = SparseMatrix((2, 2), cells=spark.createDataFrame([(0, 0, 0.0), (1, 1, 2.0)], "i long, j long, v double"))
    stats = zero.stats().first()
    assert (stats.nnz, stats.count_nonzero) == (2, 1)


def test_scalars(spark):
    dense = np.array([[1.0, 0, -2], [0, 4, 0]])
    m = make(spark, dense, grouped=True)
    assert (filled(m * 2) == dense * 2).all() and (filled(m / 4) == dense / 4).all() and (filled(-m) == -dense).all()
    assert (m * 0).cells.count() == 0 and (filled(0 - m) == -dense).all() and m + 0 is m
    assert np.allclose(filled(make(spark, abs(dense)).log1p()), np.log1p(abs(dense)))
    assert filled((m / 3).astype("int")).tolist() == np.trunc(dense / 3).tolist()
    assert sorted(r.v for r in (m / 0).cells.collect()) == [float("-inf"), float("inf"), float("inf")]
    with pytest.raises(NotImplementedError):
        m + 1


def test_cell_by_cell(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 4, (6, 5)).astype(float) for _ in range(2))
    x, y = make(spark, a), make(spark, b)
    assert (filled(x + y) == a + b).all() and (filled(x - y) == a - b).all() and (filled(x * y) == a * b).all()
    with np.errstate(all="ignore"):
        assert np.array_equal(filled(x / y)[a != 0], (a / b)[a != 0])
    assert (filled(x * make(spark, b[:1])) == a * b[:1]).all()
    with pytest.raises(ValueError, match="inconsistent shapes"):
        x + make(spark, np.ones((5, 6)))
    with pytest.raises(TypeError):
        elementwise.add(x, "text")


KEYS = [
    (slice(1, 4), slice(None)), (slice(None, None, -2), slice(2)), ([3, 0, 3], [1, 1, 4]), (2, slice(None)), ([True, False] * 3, slice(None)),
    ([-1], [-2, 0]), ([], slice(None)), (slice(None), slice(4, 1, -1)),
]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_selection(spark, key):
    dense = np.arange(30.0).reshape(6, 5)
    rows, cols = ([k] if isinstance(k, int) else k for k in key)
    rows = np.arange(6)[rows if isinstance(rows, slice) else np.array(rows, bool if True in rows else int)]
    expected = dense[rows][:, cols if isinstance(cols, slice) else np.array(cols, int)]
    got = make(spark, dense, grouped=True)[key]
    assert got.shape == expected.shape and (filled(got) == expected).all()


def test_keys_are_checked(spark):
    m = make(spark, np.eye(3))
    assert m[1, 1] == 1 and m[-1, 0] == 0
    for key in ([3], [-4], [True, False]):
        with pytest.raises(IndexError):
            m.select(key)
    with pytest.raises(IndexError):
        m[0, 0, 0]
    with pytest.raises(TypeError):
        m.select("ab")


def test_validation(spark):
    cells = lambda *rows: SparseMatrix((2, 2), cells=spark.createDataFrame(rows, "i long, j long, v double"))
    cells((0, 1, 1.0)).validate()
    for rows in ([(0, 2, 1.0)], [(-1, 0, 1.0)], [(0, 0, 1.0), (0, 0, 2.0)], [(None, 0, 1.0)]):
        with pytest.raises(ValueError):
            cells(*rows).validate()
    with pytest.raises(ValueError):
        cells((0, 0, 1.0)).sum(2)


def operand(spark, b):
    return spark.createDataFrame([(k, c, float(b[k, c])) for k in range(b.shape[0]) for c in range(b.shape[1])], "k long, c int, x double")


def table(frame, a, b, shape):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r[a], r[b]] = r.y
    return out


def test_products(spark, signed):
    m, rng = make(spark, signed, grouped=True), np.random.default_rng(1)
    b, c = rng.normal(size=(signed.shape[1], 2)), rng.normal(size=(signed.shape[0], 2))
    right = product.matmat(m, operand(spark, b), len(b), 2)
    assert np.allclose(table(right, "i", "c", (signed.shape[0], 2)), signed @ b)
    left = product.matmat_left(operand(spark, c), m, len(c), 2)
    assert np.allclose(table(left, "j", "c", (signed.shape[1], 2)), signed.T @ c)
    with pytest.raises(ValueError, match="not aligned"):
        product.matvec(m, operand(spark, b), len(b) + 1)


def normalized(dense):
    total = dense.sum(1)
    middle = np.median(total)
    scale = np.where(total != 0, total / middle, 1) if middle > 0 else np.ones(len(dense))
    x = dense / scale[:, None]
    g = x.sum(0)
    d = np.where(g > 0, np.log10(1 + 1000 * x / np.where(g > 0, g, 1)), 0)
    return d - d.mean(0)


@pytest.mark.parametrize("shape", [(8, 6), (12, 5)])
def test_normalized_view(spark, shape):
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 5, shape) * (rng.random(shape) > 0.4).astype(float)
    dense[2], dense[:, 1] = 0, 0
    view, expected = Normalized(make(spark, dense)), normalized(dense)
    window = lambda f, s: np.array([r.v for r in f.orderBy("i", "j").collect()]).reshape(s)
    assert np.allclose(window(view.toarray(), shape), expected, atol=1e-9)
    assert np.allclose(window(view[1:5, [4, 0]], (4, 2)), expected[1:5][:, [4, 0]], atol=1e-9)
    assert np.allclose(window(view.select(slice(2, 8)).toarray(), (6, shape[1])), normalized(dense[2:8]), atol=1e-9)
    b, c = rng.normal(size=(shape[1], 2)), rng.normal(size=(shape[0], 2))
    assert np.allclose(table(view.matmat(operand(spark, b), len(b), 2), "i", "c", (shape[0], 2)), expected @ b)
    assert np.allclose(table(view.matmat_left(operand(spark, c), len(c), 2), "j", "c", (shape[1], 2)), expected.T @ c)
    with pytest.raises(RuntimeError):
        view + 1


def test_plans(spark, tmp_path):
    """Row totals never read the places, and products of the view need no cartesian product."""
    m = make(spark, np.arange(12.0).reshape(4, 3))
    m.groups.write.parquet(str(tmp_path / "g"))
    stored = SparseMatrix(m.shape, groups=spark.read.parquet(str(tmp_path / "g")))
    plan = stored.sum(1)._jdf.queryExecution().toString()
    assert "minors" not in plan[plan.index("ReadSchema") :]
    view = Normalized(m).matmat(operand(spark, np.ones((3, 1))), 3, 1)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # Only the median, one row, is joined without a key.
    sent = re.findall(r"IdentityBroadcastMode[^\n]*\n[^\n]*middle#", plan)
    assert len(sent) == plan.count("BroadcastNestedLoopJoin")


def test_major_keys_pick_groups_before_they_are_opened(spark, tmp_path):
    m = make(spark, np.arange(24.0).reshape(6, 4))
    m.packed().write.parquet(str(tmp_path / "p"))
    stored = SparseMatrix.from_packed(spark.read.parquet(str(tmp_path / "p")), m.shape, "row")
    for key, above in (([4, 1, 4], "Join"), (slice(1, 5, 2), "Filter")):
        plan = stored.select(key)._groups._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index(above) < plan.index("Relation"), plan
        assert "Generate" not in plan and (filled(stored.select(key)) == np.arange(24.0).reshape(6, 4)[key]).all()
    strided = stored.select(slice(None), slice(None, None, -2))
    assert strided._groups is not None and (filled(strided) == np.arange(24.0).reshape(6, 4)[:, ::-2]).all()


def test_blocks_are_groups_in_parts(spark):
    dense = np.tile([2.0, 2, 0, 5, 5, 5, 2], (3, 1))
    blocks = make(spark, dense).stored_blocks(width=3)
    m = SparseMatrix(dense.shape, groups=blocks, blocked=True)
    assert blocks.count() == 9 and (filled(m) == dense).all() and (filled(m.grouped()) == dense).all()
    assert tuple(m.stats().first()) == (18, 6, 18) and m.groups.count() == 6
    assert vector(m.sum(1), "i").tolist() == dense.sum(1).tolist() and vector(m.nnz(1), "i").tolist() == [6, 6, 6]


def test_places_from_a_table(spark):
    dense = np.arange(20.0).reshape(5, 4)
    table = spark.createDataFrame([(3, 0), (0, 1), (3, 2)], "old long, new long")
    for m in (make(spark, dense), make(spark, dense, grouped=True)):
        assert (filled(m.select(table)) == dense[[3, 0, 3]]).all() and (filled(m.select(slice(None), table)) == dense[:, [3, 0, 3]]).all()


def test_numbering_needs_no_single_task(spark):
    from gridloom.operators.keys import numbered

    got = {r.old: r.new for r in numbered(spark.range(1000).where("id % 7 = 3 OR id > 980"), "id", 1000).collect()}
    assert got == {old: new for new, old in enumerate(x for x in range(1000) if x % 7 == 3 or x > 980)}


def test_listed_places_are_picked_where_groups_are_unpacked(spark, tmp_path):
    dense = np.tile([2.0, 2, 0, 5, 5, 5, 2, 7], (6, 1))
    m = make(spark, dense)
    m.stored_blocks(width=3, packed=True).write.parquet(str(tmp_path / "p"))
    stored = SparseMatrix.from_packed(spark.read.parquet(str(tmp_path / "p")), m.shape, "row")
    picked = stored.select([4, 1, 4], [6, 3, 6, 2])
    assert (filled(picked) == dense[[4, 1, 4]][:, [6, 3, 6, 2]]).all() and filled(stored.select(slice(None), [])).shape == (6, 0)
    plan = picked.cells._jdf.queryExecution().optimizedPlan().toString()
    # Bytes are opened once, after rows are picked, and by what knows the places that are asked for.
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Generate") < plan.index("ArrowEvalPython") < plan.rindex("Join"), plan
    opened = stored._packed.select(codec.unpack_some([6, 1, 2])("packed").alias("p")).select("p").collect()
    assert {x for r in opened for x in r.p} == {1, 6}


def test_stored_groups_go_on_over_batches(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(-2, 3, (9, 40)).astype(float)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for m in (make(spark, dense), make(spark, dense).T):
            blocks = m.stored_blocks(width=16)
            back = SparseMatrix(m.shape, m.major, groups=blocks, blocked=True)
            rows = sorted((r.major, r.value, r.block, r.n, r.minors) for r in blocks.collect())
            assert rows == sorted((r.major, r.value, r.block, r.n, r.minors) for r in m.blocks(16).collect())
            packed = SparseMatrix.from_packed(m.stored_blocks(width=16, packed=True), m.shape, m.major)
            assert (filled(back) == filled(m)).all() and (filled(packed) == filled(m)).all()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
