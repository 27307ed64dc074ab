import numpy as np

from gridloom.plans.prepare import prepare
from gridloom.sources.dataset import Dataset
from test_matrix import filled, make


def test_row_totals_are_summed_once_and_released(spark):
    dense = np.random.default_rng(3).integers(1, 9, (12, 6)).astype(float)
    out = prepare(Dataset(make(spark, dense)), min_row_total=1.0)
    assert len(out.held) == 4 and all(f.storageLevel.useMemory for f in out.held)
    # Row totals come from what is held: the only sums over cells left are those of columns.
    plan = out.x.cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [i#") == 0 and "InMemoryRelation [i#" in plan
    x = dense / (dense.sum(1) / np.median(dense.sum(1)))[:, None]
    assert np.allclose(filled(out.x), np.log10(1 + 1000 * x / x.sum(0)), atol=1e-5)
    out.release()
    assert not any(f.storageLevel.useMemory for f in out.held)
