"""Mixing sources to target weights by soft membership.

1. A classifier learnt from a labelled table gives each document posteriors over the domains:
   naive Bayes over hashed words (mean log-likelihood of the whole text, sharpened by its word
   count up to ``SHARP`` words), fitted by summed counts per partition. Every labelled row counts.
2. Document rates r >= 0 minimise |sum_d r_d tokens_d p_d / N - T|^2, where T are the targets and
   N is the number of tokens, by projected gradient from rates of one. With e the gap of the domain totals, p_d.e is the
   gradient of a token of d, and a step of length a leads to max(0, 1 - a p_d.e). Steps are implicit: e is the
   gap at the rates that the step leads to, so a step may be as long as one likes, and at the end of a step of length a the rates are least
   squares but for a pull of 1 / a towards one, which breaks ties. Lengths grow from 10^2 to 10^10 (``LENGTHS``). The e of a step is
   found by Newton steps over the domains: one pass sums totals and second moments of the rows that are not at zero, at a ladder of
   Newton lengths, of which the best is taken. A rate is a function of a posterior and of a e, so no state of rows is kept, and
   the passes run over the distinct posteriors (to six places) with their sums of tokens.
   It ends when all domain totals are within ``tolerance`` of their targets (as shares of N), or with the longest step: no rates come closer
   to such targets. ``converged`` says whether one of both was reached within ``steps`` passes, ``miss`` the largest gap that is left.
3. ``copies`` rounds a rate to whole copies without bias, by a hash of the id and text.

Domains are the keys of ``targets``; labelled rows of other or null domains are not learnt from.
Texts that are null or empty have no tokens, prior posteriors and a rate like any other. If no
row is labelled, all domains are alike. Rows that share an id share the labels of that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .minhash_dedup import WordHashes

BUCKETS, SHARP, STEPS, TOLERANCE, STILL = 1 << 13, 40, 200, 1e-4, 1e-8
LENGTHS, LADDER = (1e2, 1e4, 1e6, 1e8, 1e10), tuple(0.5**i for i in range(16))
#: Equal shares for the languages of the corpus.
TARGETS = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}


def buckets(text: str, memo: WordHashes) -> np.ndarray:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return (np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)) % np.uint64(BUCKETS)).astype(np.int64)


def log_likelihoods(known: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log word shares (domain x bucket) and log priors from rows ``_t`` and ``_y``."""
    place = {d: i for i, d in enumerate(domains)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, n = WordHashes(), np.zeros((len(domains), BUCKETS + 1))
        for x in batches:
            for t, y in zip(x["_t"], x["_y"], strict=True):
                k = place[y]
                n[k, :BUCKETS] += np.bincount(buckets(t, memo), minlength=BUCKETS)
                n[k, BUCKETS] += 1
        k, b = np.nonzero(n)
        yield pd.DataFrame({"k": k, "b": b, "n": n[k, b]})

    total = np.zeros((len(domains), BUCKETS + 1))
    for r in known.mapInPandas(counted, "k int, b int, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).collect():
        total[r.k, r.b] = r.n
    words, rows = total[:, :BUCKETS] + 0.5, total[:, BUCKETS] + 1
    return np.log(words / words.sum(1, keepdims=True)), np.log(rows / rows.sum())


def moved(p: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Rates of posteriors after a projected step from one; ``pull`` is the gap times the length of the step."""
    return np.maximum(0.0, 1 - p @ pull)


def fitted(cells: DataFrame, share: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, bool]:
    """``pull``, the gap it leaves, and whether the fit came to its end, over rows ``n`` (tokens) and ``p`` (posterior)."""
    k = len(share)
    width = 2 + k + k * k

    def summed(pulls: list[np.ndarray]) -> np.ndarray:
        """For each pull: tokens, tokens times squared rates, totals by domain, and second moments of what is not at zero."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = np.zeros((len(pulls), width))
            for x in batches:
                if len(x):
                    p, n = np.stack(x["p"].to_numpy()), x["n"].to_numpy(float)
                    for i, pull in enumerate(pulls):
                        r = moved(p, pull)
                        v[i] += np.concatenate([[n.sum(), n @ r**2], (n * r) @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel()])
            yield pd.DataFrame({"i": np.arange(v.size), "v": v.ravel()})

        out = np.zeros(len(pulls) * width)
        for r in cells.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        return out.reshape(-1, width) / max(out[0], 1.0)

    pull, at, passes = np.zeros(k), summed([np.zeros(k)])[0], 1
    gap = lambda s: s[2 : 2 + k] - share
    for length in LENGTHS:
        value = lambda s, x: s[1] / 2 + share @ x + x @ x / (2 * length)  # noqa: B023, E731
        while True:
            if np.abs(gap(at)).max() < tolerance:
                return pull, gap(at), True
            slope = pull / length - gap(at)
            if np.abs(slope).max() < STILL:
                break
            if passes >= steps:
                return pull, gap(at), False
            newton = np.linalg.solve(at[2 + k :].reshape(k, k) + np.eye(k) / length, slope)
            pulls = [pull - t * newton for t in LADDER]
            found, passes = summed(pulls), passes + 1
            values = [value(s, x) for s, x in zip(found, pulls, strict=True)]
            best = int(np.argmin(values))
            if values[best] >= value(at, pull):  # nothing left above rounding
                break
            pull, at = pulls[best], found[best]
    return pull, gap(at), True


def mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``id_col``, ``n_tokens``, ``domain`` (likeliest), ``posterior`` (in the order of domains), ``rate``, ``copies``, ``converged`` and ``miss``."""
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    share = np.array([targets[d] for d in domains], float) / sum(targets.values())
    docs = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    labels = labelled.select(F.col(id_col).alias("_id"), F.col(domain_col).alias("_y")).where(F.col("_y").isin(domains) & F.col("_id").isNotNull()).distinct()
    words, prior = log_likelihoods(docs.join(labels, "_id").select("_t", "_y"), domains)

    @F.pandas_udf("struct<n:long,p:array<double>>")
    def soft(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts in batches:
            n, p = [], []
            for t in texts:
                b = buckets(t, memo)
                score = prior + (words[:, b].mean(1) * min(len(b), SHARP) if len(b) else 0.0)
                q = np.exp(score - score.max())
                n.append(len(b))
                p.append(q / q.sum())
            yield pd.DataFrame({"n": n, "p": p})

    unit = F.pmod(F.xxhash64("_id", "_t"), F.lit(1 << 20)) / float(1 << 20)
    rows = cut(docs.select("_id", soft("_t").alias("x"), unit.alias("u")).select("_id", "x.n", "x.p", "u"))
    cells = cut(rows.groupBy(F.transform("p", lambda v: F.round(v, 6)).alias("p")).agg(F.sum("n").alias("n")).select("n", "p"))
    pull, gap, converged = fitted(cells, share, steps, tolerance)

    @F.pandas_udf("double")
    def rated(p: pd.Series) -> pd.Series:
        return pd.Series(moved(np.stack(p.to_numpy()), pull) if len(p) else [], dtype="float64")

    out = rows.withColumn("rate", rated("p"))
    whole = F.floor("rate")
    likeliest = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_tokens"), likeliest.alias("domain"), F.col("p").alias("posterior"), "rate", (whole + (F.col("u") < F.col("rate") - whole).cast("long")).alias("copies"), F.lit(converged).alias("converged"), F.lit(float(np.abs(gap).max(initial=0.0))).alias("miss"))
