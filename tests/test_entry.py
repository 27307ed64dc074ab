import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_matrix_query_has_an_oracle():
    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert all(n == "pipeline" or n.startswith("op") for n in missing)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_their_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name in ("vcs_groups_row", "sum_axis0_basket", "max_axis1_supply", "divide", "norm_col_mean", "packed_lengths", "prepare_obs_filter"):
        got, columns = entry.queries()[name](spark, SF), None
        columns = sorted(got.columns)
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        rows = [tuple(r) for r in got.select(columns).collect()]
        near = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
        assert sorted(map(near, rows), key=repr) == sorted(map(near, expected), key=repr), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_dense_queries_over_whole_matrices(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    count = lambda t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
    for name, rows in (("add_dense", "supplier"), ("rsub_dense", "supplier"), ("multiply_dense", None), ("vcs_toarray", "supplier"), ("norm_toarray", "orders")):
        got = [tuple(r) for r in entry.queries()[f"{name}_whole"](spark, SF).select("i", "j", "v").collect()]
        expected = con.execute(f"SELECT i, j, v FROM ({entry.oracle_sql()[name + '_whole']})").fetchall()
        assert len(got) == (count(rows) * count("part") if rows else len(expected)), name
        for a, b in zip(sorted(got), sorted(expected), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6, name


def test_dense_results_have_no_cap(spark):
    from gridloom.operators.elementwise import with_dense
    from gridloom.operators.matrix import SparseMatrix, dense

    m = SparseMatrix((1_100, 10_000), cells=spark.createDataFrame([(1_099, 9_999, 2.0)], "i long, j long, v double"))
    assert m.toarray().count() == 11_000_000
    last = with_dense(m, dense(spark, m.shape).selectExpr("i", "j", "1D AS x")).where("v > 1").collect()
    assert [tuple(r) for r in last] == [(1_099, 9_999, 3.0)]
