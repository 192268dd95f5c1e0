"""The tie-aware ranking: gradient at the maximum, both paths, and hard shapes."""

import math

import numpy as np
import pytest

from adjudica.operators import davidson as V

SCHEMA = "m1 string, m2 string, w_ij long, w_ji long, t_ij long"


def shape(name):
    r = np.random.default_rng(7)
    if name == "dense":
        return [(f"m{i:02}", f"m{j:02}", 3 + (7 * i + j) % 5, 2 + (i + 3 * j) % 4, (i * j) % 3) for i in range(8) for j in range(i + 1, 8)]
    if name == "chain":
        return [(f"m{i:02}", f"m{i + 1:02}", int(r.integers(1, 9)), int(r.integers(1, 9)), int(r.integers(0, 4))) for i in range(59)]
    if name == "no ties":
        return [(f"m{i}", f"m{j}", int(r.integers(1, 9)), int(r.integers(1, 9)), 0) for i in range(6) for j in range(i + 1, 6)]
    if name == "two groups":
        return [("a", "b", 5, 3, 1), ("x", "y", 2, 9, 2)]
    if name == "large counts":
        return [(f"m{i}", f"m{j}", 10**9 + i * 10**7, 10**9 - j * 10**7, 10**8) for i in range(5) for j in range(i + 1, 5)]
    return [("a", "b", 7, 0, 0), ("b", "c", 3, 2, 1)]  # one that never loses


@pytest.mark.parametrize("name", ["dense", "chain", "no ties", "two groups", "large counts", "never loses"])
def test_maximum_on_both_paths(spark, name):
    rows = shape(name)
    edges = spark.createDataFrame(rows, SCHEMA)
    here = {r.model: r for r in V.bradley_terry(edges).collect()}
    there = {r.model: r for r in V.bradley_terry(edges.repartition(3), local=0).collect()} if name in ("dense", "never loses") else here
    assert set(here) == set(there) == {m for r in rows for m in r[:2]} and all(r.converged for r in (*here.values(), *there.values()))
    if name != "never loses":
        assert max(abs(here[m].score - there[m].score) for m in here) < 1e-6
    decisions = sum(w + v + t for _, _, w, v, t in rows)
    for r in V.expected_points(edges, V.bradley_terry(edges)).collect():
        assert abs(r.expected - r.won) <= 2e-8 * max(1, decisions) + 1e-9 * r.won
    gamma = next(iter(here.values())).tie_parameter
    assert (gamma == -math.inf) == (sum(r[4] for r in rows) == 0)
    assert here[min(here)].score == 0


def test_prior_and_empty(spark):
    edges = spark.createDataFrame(shape("never loses"), SCHEMA)
    bound = {r.model: r.score for r in V.bradley_terry(edges, prior=0.5).collect()}
    assert abs(bound["b"]) < 5
    for local in (0, 10):
        assert V.bradley_terry(edges.where("false"), local=local).count() == 0


def test_likelihood_is_the_models(spark):
    rows = shape("dense")
    got = V.bradley_terry(spark.createDataFrame(rows, SCHEMA)).collect()
    s, g = {r.model: r.score for r in got}, got[0].tie_parameter
    ll = 0.0
    for i, j, w, v, t in rows:
        p, q, tie = math.exp(s[i]), math.exp(s[j]), math.exp(g + (s[i] + s[j]) / 2)
        ll += w * math.log(p / (p + q + tie)) + v * math.log(q / (p + q + tie)) + t * math.log(tie / (p + q + tie))
    assert abs(ll - got[0].log_likelihood) < 1e-8 * abs(ll)
