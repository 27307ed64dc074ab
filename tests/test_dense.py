import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import elementwise
from gridloom.operators.matrix import STRETCH, SparseMatrix, dense
from gridloom.operators.normalize import Normalized
from test_matrix import filled, make, normalized


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def whole(frame, shape):
    rows = frame.collect()
    assert len(rows) == shape[0] * shape[1] == len({(r.i, r.j) for r in rows})
    out = np.empty(shape)
    for r in rows:
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    a = rng.integers(1, 9, (9, 13)) * (rng.random((9, 13)) > 0.6).astype(float)
    a[3], a[:, 5], a[0, 0], a[-1, -1] = 0, 0, 4, 6
    return a


def test_multiply_dense_takes_an_operand_by_place(spark, values):
    m, x = make(spark, values), np.add.outer(np.arange(9) * 13, np.arange(13)) % 5
    by_place = ((F.col("i") * 13 + F.col("j")) % 5).cast("double")
    by_table = dense(spark, m.shape).withColumn("x", by_place)
    got = elementwise.multiply_dense(m, by_place)
    assert (filled(got) == values * x).all() and (filled(elementwise.multiply_dense(m, by_table)) == values * x).all()
    assert "Exchange" not in plan(got.cells)


@pytest.mark.parametrize("sign", [1, -1])
def test_with_dense_shuffles_stored_cells_only(spark, values, sign):
    m, x = make(spark, values), np.add.outer(np.arange(9) * 13, np.arange(13)) % 5
    by_place = ((F.col("i") * 13 + F.col("j")) % 5).cast("double")
    got = elementwise.with_dense(m, by_place, sign)
    assert (whole(got, m.shape) == x + sign * values).all() and "Join" not in plan(got)
    by_table = dense(spark, m.shape).withColumn("x", by_place)
    assert (whole(elementwise.with_dense(m, by_table, sign), m.shape) == x + sign * values).all()
    with pytest.raises(ValueError, match="more than"):
        elementwise.with_dense(m, by_place, sign, most=100)


def test_toarray_joins_no_dense_table(spark, values):
    m = make(spark, values)
    assert (whole(m.toarray(), m.shape) == values).all() and "Join" not in plan(m.toarray())
    assert (whole(m.toarray(slice(1, 8, 3), slice(None, None, -2)), (3, 7)) == values[1:8:3, ::-2]).all()
    assert m.toarray(slice(0, 0)).count() == 0 == m.toarray(slice(None), slice(0, 0)).count()


def test_long_rows_are_made_by_stretches(spark):
    n = 2 * STRETCH + 3
    at = [0, STRETCH - 1, STRETCH, 2 * STRETCH + 2]
    m = SparseMatrix((2, n), cells=spark.createDataFrame([(1, j, j + 1.0) for j in at] + [(1, n, 5.0), (2, 0, 5.0)], "i long, j long, v double"))
    counted = m.toarray().groupBy("i").agg(F.count("*").alias("n"), F.countDistinct("j").alias("d"), F.max("j").alias("last"), F.sum("v").alias("s"))
    assert sorted(map(tuple, counted.collect())) == [(0, n, n, n - 1, 0.0), (1, n, n, n - 1, sum(at) + 4.0)]
    assert sorted((r.j, r.v) for r in m.toarray().where("v <> 0").collect()) == [(j, j + 1.0) for j in at]


def test_a_normalized_window_shares_means_by_stretches(spark, values, monkeypatch):
    import gridloom.operators.matrix as matrix
    import gridloom.operators.normalize as normalize

    monkeypatch.setattr(matrix, "STRETCH", 4)
    monkeypatch.setattr(normalize, "STRETCH", 4)
    view, expected = Normalized(make(spark, values)), normalized(values)
    for axis in (normalize.BROADCAST_AXIS, 0):
        monkeypatch.setattr(normalize, "BROADCAST_AXIS", axis)
        assert np.allclose(whole(view.toarray(), values.shape), expected, atol=1e-9)
        assert np.allclose(whole(view[2:7, [12, 0, 12, 6, 1]], (5, 5)), expected[2:7][:, [12, 0, 12, 6, 1]], atol=1e-9)


def test_one_row_or_column_is_not_repeated_for_products(spark, values):
    full, row, col, one = (make(spark, a) for a in (values, values[:1], values[:, :1], values[:1, :1]))
    as_array = {id(full): values, id(row): values[:1], id(col): values[:, :1], id(one): values[:1, :1]}
    for a in (full, row, col, one):
        for b in (full, row, col, one):
            x, y = as_array[id(a)], as_array[id(b)]
            assert (filled(a * b) == x * y).all() and (a * b).shape == (x * y).shape
            with np.errstate(all="ignore"):
                expected = np.where(np.broadcast_to(x, (x * y).shape) != 0, x / y, 0)
            assert np.allclose(filled(a / b), expected)
            assert (filled(a + b) == x + y).all()
    assert "Generate" not in plan((full * row).cells) + plan((col * full).cells)


@pytest.mark.parametrize("rows, columns", [(1, 2), (2, 4), (4, 6), (256, 1 << 16)])
def test_tiles_of_any_size_make_every_cell_once(spark, values, monkeypatch, rows, columns):
    import gridloom.operators.matrix as matrix

    monkeypatch.setattr(matrix, "STRETCH", 6)
    monkeypatch.setattr(matrix, "TILE_ROWS", rows)
    monkeypatch.setattr(matrix, "TASK_COLUMNS", columns)
    monkeypatch.setattr(matrix, "TASK_CELLS", 20)
    for a in (values, values.T, values[:1], values[:, :1], values[:7, :11]):
        assert (whole(make(spark, a).toarray(), a.shape) == a).all()
        x = np.add.outer(np.arange(a.shape[0]) * 13, np.arange(a.shape[1])) % 5
        assert (whole(elementwise.with_dense(make(spark, a), ((F.col("i") * 13 + F.col("j")) % 5).cast("double")), a.shape) == x + a).all()


def test_a_normalized_result_is_rounded_once_for_a_column(spark, values):
    view = Normalized(make(spark, values))
    got = view.toarray(digits=3)
    each = F.round(F.col("v"), 3).alias("v")
    assert (whole(got, values.shape) == whole(view.toarray().select("i", "j", each), values.shape)).all()


@pytest.mark.parametrize("name", ["norm_toarray_whole", "norm_toarray"])
def test_normalized_queries_round_no_cell_of_its_own(spark, name):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    above, below = plan(entry.queries()[name](spark, folder)).split("Generate", 1)
    assert "round(" not in above and "round(" in below


def scattered(spark):
    return SparseMatrix((150, 20_000), cells=spark.range(1_500).selectExpr("id % 150 AS i", "id * 7 AS j", "double(id % 9 + 1) AS v"))


def written(frame, folder):
    """Bytes and rows of the frame as Parquet."""
    frame.write.parquet(str(folder))
    files = list(folder.glob("*.parquet"))
    return sum(f.stat().st_size for f in files), sum(pq.read_metadata(f).num_rows for f in files)


def test_a_normalized_result_takes_little_room(spark, tmp_path):
    size, rows = written(Normalized(scattered(spark)).toarray(digits=6), tmp_path / "out")
    assert rows == 3_000_000 and size < rows // 2


def test_a_whole_array_takes_little_room(spark, tmp_path):
    size, rows = written(scattered(spark).toarray(), tmp_path / "out")
    assert rows == 3_000_000 and size < rows // 2


@pytest.mark.parametrize("sign", [1, -1])
def test_a_sum_with_a_dense_operand_takes_little_room(spark, tmp_path, sign):
    m, by_place = scattered(spark), ((F.col("i") * 20_000 + F.col("j")) % 9).cast("double")
    size, rows = written(elementwise.with_dense(m, by_place, sign), tmp_path / "out")
    assert rows == 3_000_000 and size < rows // 2
