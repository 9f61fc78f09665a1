import itertools

import numpy as np
import pytest

from quillon.llm import mixing


def optimum(p, tokens, goal):
    """The least residual of nonnegative rates, by trying every set of documents whose rate is not 0."""
    a = (p * tokens[:, None]).T
    w = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9, hermitian=True)
    root = np.linalg.cholesky(w + 1e-15 * np.eye(len(w))).T
    best = goal @ w @ goal
    for k in range(1, len(p) + 1):
        for some in itertools.combinations(range(len(p)), k):
            r = np.linalg.lstsq(root @ a[:, some], root @ goal, rcond=None)[0]
            if (r >= -1e-12).all():
                miss = a[:, some] @ r - goal
                best = min(best, miss @ w @ miss)
    return best, w


@pytest.mark.parametrize("weights", [[1.0, 1.0, 1.0], [8.0, 1.0, 0.2], [0.0, 1.0, 0.0], [1.0, 0.0, 30.0]])
def test_rates_reach_the_constrained_optimum(spark, weights):
    """Also where the targets are out of reach of nonnegative rates."""
    p = np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4], [0.6, 0.4, 0.0], [0.1, 0.5, 0.4]])
    tokens = np.array([100.0, 40.0, 60.0, 300.0, 5.0])
    cells = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, tokens, strict=True)], "p array<double>, tokens long")
    rate, reached = mixing.fit_rates(cells, 3, weights)
    goal = np.array(weights) / sum(weights) * tokens.sum()
    best, w = optimum(p, tokens, goal)
    miss = np.array(reached) - goal
    assert np.sqrt(miss @ w @ miss / tokens.sum()) <= np.sqrt(best / tokens.sum()) + 5e-3
    rates = np.array([r[0] for r in cells.select(rate.alias("r")).collect()])
    assert (rates >= 0).all() and np.allclose((p * (tokens * rates)[:, None]).sum(0), reached, rtol=1e-6)
