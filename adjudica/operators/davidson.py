"""Davidson's tie-aware Bradley-Terry model at any number of edges, by one truncated Newton method.

P(i beats j), P(j beats i) and P(tie) are in the ratio exp(a), exp(b), exp(g + (a + b) / 2) for scores a and b. The log-likelihood is concave; a
Newton direction is solved by conjugate gradients, preconditioned with the diagonal, of which each step is a sum
over edges, and the best of a ladder of step lengths is taken. It ends when no entry of the gradient passes ``TOLERANCE`` of all decisions. Up to ``LOCAL``
edges, counted first, one task sums over its arrays; more edges stay where they are and each sum is a pass
over all executors, with the same steps. Parameters are one number for each model: up to ``MODELS`` of them (40 MB)
travel to tasks; more raise an error.

A model that never loses, or never wins, has no finite score: its score ends where the gradient is under the bound;
``prior`` adds wins to both sides of each edge. Without ties the tie parameter is minus infinity. Unconnected groups of models have scores of
their own around zero. No edges give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import settled

LOCAL, MODELS, TOLERANCE, STEPS, INNER = 1_000_000, 5_000_000, 1e-8, 60, 400
LADDER = tuple(2.0**-k for k in range(12))
SCHEMA = "model string, score double, tie_parameter double, log_likelihood double, converged boolean"

#: A sum over edges: arrays of an edge (i, j, w, v, t) to named numbers and to entries of a vector as (indices, values).
Terms = Callable[..., tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]


def shares(x: np.ndarray, tied: bool, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of both wins and of a tie, and the log of their common denominator."""
    a, b = x[i], x[j]
    top = np.maximum(a, b)
    p, q = np.exp(a - top), np.exp(b - top)
    tie = np.exp((a + b) / 2 + x[-1] - top) if tied else np.zeros(len(a))
    total = p + q + tie
    return p / total, q / total, tie / total, np.log(total) + top


def likelihood(x: np.ndarray, tied: bool, i: np.ndarray, j: np.ndarray, w: np.ndarray, v: np.ndarray, t: np.ndarray) -> float:
    log_total = shares(x, tied, i, j)[3]
    return float((w * x[i] + v * x[j] + t * ((x[i] + x[j]) / 2 + (x[-1] if tied else 0.0)) - (w + v + t) * log_total).sum())


def gradient_terms(x: np.ndarray, tied: bool) -> Terms:
    """Log-likelihood, its gradient, and behind it the diagonal of minus its second derivatives."""
    size = len(x)

    def terms(i, j, w, v, t):
        p, q, tie, _ = shares(x, tied, i, j)
        n, g = w + v + t, np.full(len(i), size - 1)
        up = [(i, w + t / 2 - n * (p + tie / 2)), (j, v + t / 2 - n * (q + tie / 2)), (g, t - n * tie)]
        curve = [(i + size, n * (p + tie / 4 - (p + tie / 2) ** 2)), (j + size, n * (q + tie / 4 - (q + tie / 2) ** 2)), (g + size, n * tie * (1 - tie))]
        return np.array([likelihood(x, tied, i, j, w, v, t)]), up + curve

    return terms


def product_terms(x: np.ndarray, tied: bool, d: np.ndarray) -> Terms:
    """Minus the second derivatives times a direction."""

    def terms(i, j, w, v, t):
        p, q, tie, _ = shares(x, tied, i, j)
        n = w + v + t
        of_tie = (d[i] + d[j]) / 2 + d[-1]
        mean = p * d[i] + q * d[j] + tie * of_tie
        one, two, both = n * p * (d[i] - mean), n * q * (d[j] - mean), n * tie * (of_tie - mean)
        return np.zeros(0), [(i, one + both / 2), (j, two + both / 2), (np.full(len(i), len(x) - 1), both)]

    return terms


def ladder_terms(x: np.ndarray, tied: bool, d: np.ndarray) -> Terms:
    return lambda i, j, w, v, t: (np.array([likelihood(x + s * d, tied, i, j, w, v, t) for s in LADDER]), [])


def over_arrays(edges: tuple[np.ndarray, ...]) -> Callable[[Terms, int, int], tuple[np.ndarray, np.ndarray]]:
    def total(terms: Terms, numbers: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        found, entries = terms(*edges)
        return found, sum((np.bincount(k, x, size) for k, x in entries), np.zeros(size))

    return total


def over_executors(edges: DataFrame) -> Callable[[Terms, int, int], tuple[np.ndarray, np.ndarray]]:
    """Sums over settled rows ``i``, ``j``, ``w``, ``v``, ``t``: a task sends the entries that its edges touch."""

    def total(terms: Terms, numbers: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(numbers + size)
            for x in batches:
                if len(x):
                    found, entries = terms(x["i"].to_numpy(), x["j"].to_numpy(), *(x[c].to_numpy(float) for c in ("w", "v", "t")))
                    out[:numbers] += found
                    for k, y in entries:
                        out[numbers:] += np.bincount(k, y, size)
            some = np.flatnonzero(out)
            yield pd.DataFrame({"k": some, "x": out[some]})

        got = edges.mapInPandas(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(numbers + size)
        out[got["k"].to_numpy()] = got["x"].to_numpy()
        return out[:numbers], out[numbers:]

    return total


def fit(total: Callable[[Terms, int, int], tuple[np.ndarray, np.ndarray]], models: int, decisions: float, ties: float, steps: int = STEPS) -> tuple[np.ndarray, float, float, bool]:
    """Scores (the first model's is zero), tie parameter, log-likelihood and whether the gradient vanished."""
    size, tied = models + 1, ties > 0
    x, value, done = np.zeros(size), 0.0, False
    for _ in range(steps):
        (value,), both = total(gradient_terms(x, tied), 1, 2 * size)
        slope, curve = both[:size], np.maximum(both[size:], 1e-12 * max(1.0, decisions))
        if not tied:
            slope[-1] = 0.0
        if np.abs(slope).max() <= TOLERANCE * max(1.0, decisions):
            done = True
            break
        # conjugate gradients: exact enough that the last steps converge quadratically
        d, rest = np.zeros(size), slope.copy()
        z = rest / curve
        way, fit_of = z.copy(), rest @ z
        goal = fit_of * min(1e-2, np.abs(slope).max() / max(1.0, decisions)) ** 2
        for _ in range(INNER):
            pushed = total(product_terms(x, tied, way), 0, size)[1]
            if not tied:
                pushed[-1] = 0.0
            bend = way @ pushed
            if bend <= 0:
                break
            step = fit_of / bend
            d, rest = d + step * way, rest - step * pushed
            z = rest / curve
            after = rest @ z
            if after <= goal:
                break
            way, fit_of = z + after / fit_of * way, after
        d = d if d.any() else slope / curve
        values = total(ladder_terms(x, tied, d), len(LADDER), 0)[0]
        best = int(np.argmax(values))
        if values[best] <= value and np.abs(slope).max() <= 100 * TOLERANCE * max(1.0, decisions):
            done = True  # at the rounding of the likelihood
            break
        x = x + LADDER[best] * d
    theta = x[:-1] - x[0] if models else x[:-1]
    return theta, float(x[-1]) if tied else -math.inf, float(value), done


def fit_davidson(edges: pd.DataFrame) -> tuple[dict[str, float], float, float, bool]:
    """Score of each model (in order of name, the first's is zero), tie parameter, log-likelihood and whether it converged, from rows ``m1``, ``m2``, ``w_ij``, ``w_ji``, ``t_ij`` of one task."""
    names = sorted({*edges["m1"], *edges["m2"]})
    at = {m: k for k, m in enumerate(names)}
    w, v, t = (edges[c].to_numpy(float) for c in ("w_ij", "w_ji", "t_ij"))
    arrays = (edges["m1"].map(at).to_numpy(np.int64), edges["m2"].map(at).to_numpy(np.int64), w, v, t)
    theta, gamma, value, done = fit(over_arrays(arrays), len(names), float((w + v + t).sum()), float(t.sum()))
    return dict(zip(names, theta.tolist(), strict=True)), gamma, value, done


def bradley_terry(edges: DataFrame, prior: float = 0.0, local: int = LOCAL) -> DataFrame:
    """``model``, ``score``, ``tie_parameter``, ``log_likelihood`` and ``converged`` from rows ``m1``, ``m2``, ``w_ij``, ``w_ji``, ``t_ij``, one for each pair of models."""
    spark = edges.sparkSession
    edges = settled(edges.where("m1 is not null and m2 is not null").select("m1", "m2", (F.col("w_ij") + F.lit(prior)).cast("double").alias("w"), (F.col("w_ji") + F.lit(prior)).cast("double").alias("v"), F.col("t_ij").cast("double").alias("t")))
    if edges.count() <= local:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [b for b in batches if len(b)]
            if rows:
                theta, gamma, value, done = fit_davidson(pd.concat(rows).rename(columns={"w": "w_ij", "v": "w_ji", "t": "t_ij"}))
                yield pd.DataFrame({"model": list(theta), "score": list(theta.values()), "tie_parameter": gamma, "log_likelihood": value, "converged": done})

        return edges.coalesce(1).mapInPandas(run, SCHEMA)
    models = edges.select("m1").union(edges.select("m2")).distinct()
    many = models.count()
    if many > MODELS:
        raise ValueError(f"{many} models: more than {MODELS} parameters do not travel to tasks")
    names = sorted(r[0] for r in models.collect())
    index = spark.createDataFrame(pd.DataFrame({"m": names, "k": np.arange(many)}), "m string, k long")
    side = lambda n, k: index.select(F.col("m").alias(n), F.col("k").alias(k))
    numbered = settled(edges.join(side("m1", "i"), "m1").join(side("m2", "j"), "m2").select("i", "j", "w", "v", "t"))
    sums = numbered.agg(F.sum(F.col("w") + F.col("v") + F.col("t")), F.sum("t")).first()
    theta, gamma, value, done = fit(over_executors(numbered), many, sums[0], sums[1])
    return spark.createDataFrame(pd.DataFrame({"model": names, "score": theta, "tie_parameter": gamma, "log_likelihood": value, "converged": done}), SCHEMA)


def expected_points(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """For each model the points (a win one, a tie half) that the fit expects of its decisions, next to those it has: equal at the maximum."""
    one = scores.select(F.col("model").alias("m1"), F.col("score").alias("a"), F.col("tie_parameter").alias("g"))
    two = scores.select(F.col("model").alias("m2"), F.col("score").alias("b"))
    n, top = F.col("w_ij") + F.col("w_ji") + F.col("t_ij"), F.greatest("a", "b")
    p, q, tie = F.exp(F.col("a") - top), F.exp(F.col("b") - top), F.exp((F.col("a") + F.col("b")) / 2 + F.col("g") - top)
    j = edges.join(one, "m1").join(two, "m2")
    row = lambda m, mine, won: F.struct(F.col(m).alias("model"), (n * (mine + tie / 2) / (p + q + tie)).alias("expected"), (F.col(won) + F.col("t_ij") / 2).alias("won"))
    return j.select(F.inline(F.array(row("m1", p, "w_ij"), row("m2", q, "w_ji")))).groupBy("model").agg(F.sum("expected").alias("expected"), F.sum("won").alias("won"))
