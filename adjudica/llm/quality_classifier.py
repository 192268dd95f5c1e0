"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

1. Fourteen statistics of each whole text, in Arrow batches.
2. z = sqrt(2/D) cos(W x + b) approximates a Gaussian kernel over standardised statistics;
   W and b come from a seed, so every task draws the same ones.
3. Each partition sums z z' and z y; Spark adds the partial sums; the driver solves one
   D x D system (its size is a parameter and does not grow with the data).
4. Ridge scores of the training rows are counted in 1,000 bins; pool-adjacent-violators over
   the bins gives the calibration, read by linear interpolation.

Training rows are labelled rows with a label of 0 or 1; a document with several labels counts
once for each. Null and empty texts have zero statistics and get a score as well. Without
any training row every score is 0.5. Only statistics of the text feed a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, text_of
from .quality_rules import STOP_WORDS, SYMBOLS

FEATURES, SEED, RIDGE, BINS = 192, 20240601, 1e-3, 1000
NAMES = ("words", "word_length", "symbols", "distinct_words", "distinct_triples", "distinct_lines", "line_length", "stop_words", "digits", "capitals", "punctuation", "non_ascii", "exclamations", "bars")
STOP = frozenset(STOP_WORDS.split())
CLASSES = [np.frombuffer(x, np.uint8) for x in (SYMBOLS.encode(), b"0123456789", bytes(range(65, 91)), b".,;:!?()\"'-", b"!", b"|")]


def describe(text: str) -> tuple[float, ...]:
    """Bounded ratios and logarithms of counts of a whole text, in the order of ``NAMES``."""
    w = WORD.findall(text)
    rows = [x for x in text.split("\n") if WORD.search(x)]
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    symbols, digits, capitals, marks, shouts, bars = (int(raw[c].sum()) for c in CLASSES)
    n, chars, n_lines = max(len(w), 1), max(len(text), 1), max(len(rows), 1)
    triples = len(set(zip(w, w[1:], w[2:], strict=False))) / (len(w) - 2) if len(w) > 2 else 1.0
    return (
        np.log1p(len(w)), np.log1p(sum(map(len, w)) / n), np.log1p(10 * symbols / n), len(set(w)) / n, triples, len(set(rows)) / n_lines,
        np.log1p(n / n_lines), sum(x.lower() in STOP for x in w) / n, np.log1p(100 * digits / chars), np.log1p(100 * capitals / chars),
        np.log1p(100 * marks / chars), int(raw[128:].sum()) / chars, shouts / n, bars / n,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``_x``, the statistics of each row's text, and ``_also0``, ..."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(describe(t), dtype=float) for t in texts])

    return docs.select(F.col(id_col).alias("_id"), described(text_of(text_col)).alias("_x"), *(F.col(c).alias(f"_also{i}") for i, c in enumerate(also)))


def draw(n: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, features)) / np.sqrt(n), rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int, seed: int) -> np.ndarray:
    """Features of rows of statistics, and a constant."""
    w, b = draw(x.shape[1], features, seed)
    z = np.sqrt(2 / features) * np.cos((np.clip((x - mean) / scale, -6, 6)) @ w + b)
    return np.hstack([z, np.ones((len(z), 1))])


def isotonic(mass: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing means of ``good`` over bins with ``mass`` rows."""
    blocks: list[list[float]] = []
    for m, g in zip(mass, good, strict=True):
        blocks.append([m, g, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            m2, g2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + m2, blocks[-1][1] + g2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / m) for m, g, k in blocks]) if blocks else np.array([])


class Scorer:
    """A fitted model: a few thousand numbers, whatever the size of the data."""

    def __init__(self, mean, scale, beta, knots, values, features, seed):
        self.mean, self.scale, self.beta, self.knots, self.values, self.features, self.seed = mean, scale, beta, knots, values, features, seed

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.features, self.seed) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def fit(rows: DataFrame, features: int = FEATURES, seed: int = SEED, ridge: float = RIDGE) -> Scorer | None:
    """Fit to ``rows`` (``_x``, ``_y``); None without rows."""
    size = len(NAMES)
    stats = rows.select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not stats:
        return None
    mean, scale = np.zeros(size), np.ones(size)
    for r in stats:
        mean[r.i], scale[r.i] = r.m, r.s if r.s and r.s > 1e-9 else 1.0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((features + 1, features + 2))
        for b in batches:
            if len(b):
                z = fourier(np.stack(b["_x"].to_numpy()), mean, scale, features, seed)
                a += z.T @ np.hstack([z, b[["_y"]].to_numpy(float)])
        yield pd.DataFrame({"i": np.arange(features + 1), "v": list(a)})

    def added(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": x["i"].iloc[:1], "v": [np.sum(np.stack(x["v"].to_numpy()), 0)]})

    # A row of the matrix from each partition, packed; a task adds those of one row.
    total = np.zeros((features + 1, features + 2))
    for r in rows.select("_x", "_y").mapInPandas(sums, "i int, v array<double>").groupBy("i").applyInPandas(added, "i int, v array<double>").collect():
        total[r.i] = r.v
    n = total[features, features]
    beta = np.linalg.solve(total[:, :-1] + ridge * n * np.diag([*np.ones(features), 1e-9]), total[:, -1])
    model = Scorer(mean, scale, beta, None, None, features, seed)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                k = np.clip(np.floor((model.raw(np.stack(b["_x"].to_numpy())) + 0.5) * BINS / 2), 0, BINS - 1)
                yield pd.DataFrame({"k": k.astype("int32"), "y": b["_y"].to_numpy(float)})

    bins = rows.select("_x", "_y").mapInPandas(binned, "k int, y double").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("k").toPandas()
    model.knots = (bins["k"].to_numpy() + 0.5) * 2 / BINS - 0.5
    model.values = isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy(float))
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, threshold: float = 0.3, features: int = FEATURES, also: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` and the columns ``also``: labels are learnt outside fold 0 of crc32(id)."""
    df = cut(statistics(docs, id_col, text_col, also))  # narrow: texts are read once and never shuffled
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % folds == 0, F.lit(False))
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held)
    model = fit(cut(df.join(y, "_id").select("_x", "_y")), features)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    score = F.lit(0.5) if model is None else scored("_x")
    df = df.select(F.col("_id").alias(id_col), held.alias("held_out"), score.alias("score"), *(F.col(f"_also{i}").alias(c) for i, c in enumerate(also)))
    return df.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *also)
