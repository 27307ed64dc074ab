import numpy as np

from gridloom.llm.language import ByteNetwork


def test_reading_equals_the_states_that_training_uses():
    rng = np.random.default_rng(5)
    for labels, shape in ((3, (37, 9)), (1, (5, 1)), (2, (1, 4))):
        net = ByteNetwork([str(k) for k in range(labels)], seed=4)
        net.p["b"] += rng.normal(size=labels).astype(np.float32)
        x = rng.integers(0, 257, shape)
        got = net.scan(x)
        assert got.shape == (shape[0], labels, shape[1])
        assert np.allclose(got.transpose(0, 2, 1), net.labels(net.states(x)[0]), atol=1e-6)
