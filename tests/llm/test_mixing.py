"""The fit of document rates against non-negative least squares."""

import numpy as np
import pytest

from adjudica.llm import mixing


def least_squares(a, b):
    """Lawson and Hanson's non-negative least squares."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(1000):
        g = a.T @ (b - a @ x)
        g[free] = -np.inf
        if g.max() <= 1e-12:
            break
        free[g.argmax()] = True
        while True:
            z = np.zeros(len(x))
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            step = min(1.0, (x[low] / (x[low] - z[low])).min())
            x = x + step * (z - x)
            free &= x > 1e-14
            x[~free] = 0
    return x


@pytest.mark.parametrize("case", ["soft", "collinear", "unreachable", "rare", "edge", "one cell", "no tokens"])
def test_rates_are_least_squares(spark, case):
    r = np.random.default_rng(3)
    p, share = r.dirichlet([0.5, 0.8, 1.0], 4000), np.array([0.3, 0.3, 0.4])
    if case == "collinear":
        p = np.column_stack([p[:, 0] * 0.5, p[:, 0] * 0.5 + 1e-3 * p[:, 1], 1 - p[:, 0] - 1e-3 * p[:, 1]])
        share = np.array([0.7, 0.1, 0.2])
    elif case == "unreachable":
        p, share = 0.2 + 0.4 * p, np.array([0.9, 0.1, 0.0])
    elif case == "rare":
        p, share = r.dirichlet([0.004, 0.5, 3.0], 4000), np.array([0.5, 0.25, 0.25])
    elif case == "edge":
        p, share = 0.5 * p + 0.5 * np.array([0.0, 0.5, 0.5]), np.array([0.48, 0.5, 0.02])
    elif case == "one cell":
        p, share = np.tile([0.2, 0.3, 0.5], (5, 1)), np.array([0.6, 0.2, 0.2])
    n = r.integers(1, 900, len(p)) * (case != "no tokens")
    cells = spark.createDataFrame([(int(a), [float(x) for x in q]) for a, q in zip(n, p, strict=True)], "n long, p array<double>").repartition(4)
    pull, gap, converged = mixing.fitted(cells, share, steps=80)
    a = (p * n[:, None]).T / max(n.sum(), 1)
    want = a @ least_squares(a, share) - share
    assert converged and np.abs(gap - want).max() < 1e-3, (gap, want)
    assert np.abs(a @ mixing.moved(p, pull) - share - gap).max() < 1e-7


def test_a_fit_cut_short_says_so(spark):
    cells = spark.createDataFrame([(10, [0.9, 0.1]), (30, [0.2, 0.8])], "n long, p array<double>")
    assert mixing.fitted(cells, np.array([0.6, 0.4]), steps=0)[2] is False
