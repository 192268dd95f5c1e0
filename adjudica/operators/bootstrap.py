"""Bootstrap intervals from sufficient statistics.

Resampling n independent units is a multinomial draw over the counts of their distinct
values, so cost follows the number of cells, not of rows. Cells are dealt over chunks by a hash; the share of a
chunk comes from conditional binomials down a tree of chunks, which every chunk draws for itself along its own path, so
no task sees a whole group. Seeds belong to groups, nodes and blocks of replicates: results do not hang on partitioning.

Whole clusters are resampled by Poisson(1) weights that a hash alone decides: a task multiplies the matrix of weights, block of replicates by
block of clusters, with the sums of its clusters, and sends one row a replicate.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import settled

#: Replicates and clusters of a block, distinct values of a chunk, and groups that a task holds sums of.
BLOCK, CLUSTERS, CHUNK, HELD = 500, 2048, 1024, 32
#: Cumulative Poisson(1) probabilities in units of 2^-32.
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777)


def _seed(*parts: object) -> int:
    return int.from_bytes(sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def cells(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by``, ``value`` and how many units have it."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def grouping(by: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in by)) if by else F.lit("all")


def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk of a group its path down a binary tree of chunks: the units left of and right of each node, and its side."""
    for x in batches:
        for g, chunks in zip(x["group_id"], x["chunks"], strict=True):
            number = [c["chunk"] for c in chunks]
            before = np.concatenate([[0], np.cumsum([c["n"] for c in chunks])])
            rows = []
            for i in range(len(number)):
                lo, hi, path = 0, len(number), []
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    path.append({"node": lo * len(number) + hi, "left": int(before[mid] - before[lo]), "right": int(before[hi] - before[mid]), "goes_left": i < mid})
                    lo, hi = (lo, mid) if i < mid else (mid, hi)
                rows.append(path)
            yield pd.DataFrame({"group_id": g, "chunk": number, "path": rows, "units": int(before[-1])})


def replicates(df: DataFrame, value: str, by: list[str], iterations: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """Replicate means of each group: ``group_id``, ``replicate``, ``stat`` and ``units``. Reads ``df`` at once, for the table of its cells, which sizes, chunks and paths all start from."""
    each = settled(cells(df, value, by).select(grouping(by).alias("group_id"), "value", "n"))
    size = each.groupBy("group_id").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = each.join(size, "group_id").withColumn("chunk", F.pmod(F.xxhash64("value"), F.col("parts")))
    packed = dealt.groupBy("group_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("cells"), F.sum("n").alias("n"))
    tree = dealt.groupBy("group_id", "chunk").agg(F.sum("n").alias("n")).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "n"))).alias("chunks"))
    ways = tree.mapInPandas(paths, "group_id string, chunk long, path array<struct<node:long,left:long,right:long,goes_left:boolean>>, units long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, int]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for g, (total, units) in held.items():
                yield pd.DataFrame({"group_id": g, "replicate": np.arange(iterations), "s": total, "units": units})
            held.clear()

        for x in batches:
            for g, c, path, units in zip(x["group_id"], x["cells"], x["path"], x["units"], strict=True):
                v, n = np.array([r["value"] for r in c]), np.array([r["n"] for r in c])
                if g not in held and len(held) >= HELD:
                    yield from flush()
                total = held.setdefault(g, (np.zeros(iterations), int(units)))[0]
                for b in range(-(-iterations // BLOCK)):
                    k = min(BLOCK, iterations - b * BLOCK)
                    drawn = np.full(k, units)
                    for step in path:
                        left = np.random.default_rng(_seed(seed, g, b, step["node"])).binomial(drawn, step["left"] / (step["left"] + step["right"]))
                        drawn = left if step["goes_left"] else drawn - left
                    own = _seed(seed, g, b) if not len(path) else _seed(seed, g, b, "chunk", path[-1]["node"], path[-1]["goes_left"])
                    total[b * BLOCK : b * BLOCK + k] += np.random.default_rng(own).multinomial(drawn, n / n.sum()) @ v
        yield from flush()

    sums = packed.drop("n").join(ways, ["group_id", "chunk"]).repartition("group_id", "chunk").mapInPandas(run, "group_id string, replicate long, s double, units long")
    return sums.groupBy("group_id", "replicate").agg((F.sum("s") / F.max("units")).alias("stat"), F.max("units").alias("units"))


def interval(reps: DataFrame, confidence: float = 0.95, interpolate: bool = False) -> DataFrame:
    """Percentile interval of finite replicates: order statistics at floor(alpha (B - 1)), or interpolated."""
    good = reps.where(F.col("stat").isNotNull() & ~F.isnan("stat"))
    alpha = (1 - confidence) / 2
    if interpolate:
        g = good.groupBy("group_id").agg(F.percentile("stat", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"), F.count("*").alias("replicates"), F.max("units").alias("units"))
        return g.select("group_id", "replicates", F.when(F.col("units") > 1, F.col("q")[0]).alias("ci_low"), F.when(F.col("units") > 1, F.col("q")[1]).alias("ci_high"))
    w = Window.partitionBy("group_id")
    ranked = good.withColumn("_k", F.row_number().over(w.orderBy("stat", "replicate")) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("_k") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("stat")))
    g = ranked.groupBy("group_id").agg(at(alpha).alias("lo"), at(1 - alpha).alias("hi"), F.count("*").alias("replicates"), F.max("units").alias("units"))
    return g.select("group_id", "replicates", F.when(F.col("units") > 1, F.col("lo")).alias("ci_low"), F.when(F.col("units") > 1, F.col("hi")).alias("ci_high"))


def bootstrap_ci(df: DataFrame, value: str, by: list[str] = (), iterations: int = 10_000, seed: int = 20260818, confidence: float = 0.95, interpolate: bool = False) -> DataFrame:
    """Interval of the mean of ``value`` (a rate for 0/1, a paired delta for -1/0/1); null under two units."""
    return interval(replicates(df, value, list(by), iterations, seed), confidence, interpolate)


def stratified_bootstrap(df: DataFrame, value: str, stratum: str, strata: list[str], iterations: int = 10_000, seed: int = 20260818) -> DataFrame:
    """Interval of the equal-weight mean of stratum means, resampled within strata; null if one is empty."""
    reps = replicates(df.where(F.col(stratum).isin(strata)), value, [stratum], iterations, seed)
    macro = reps.groupBy("replicate").agg(F.avg("stat").alias("m"), F.count("*").alias("k"), F.sum("units").alias("units"))
    return interval(macro.select(F.lit("macro").alias("group_id"), "replicate", F.when(F.col("k") == len(strata), F.col("m")).alias("stat"), "units"))


def poisson_weight(unit: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) weight by hash alone: the same whatever the order or partition of rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), unit.cast("string"), replicate.cast("string")), 256), 1, 8), 16, 10).cast("long")
    w = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        w = F.when(h < POISSON[k], k).otherwise(w)
    return w


#: Kappa of a 3 x 3 table of counts ``n_<human>_<judge>``; null without rows and where the expected agreement is one.
CLASSES = ("a", "b", "t")
_TOTAL = "(" + " + ".join(f"n_{h}_{j}" for h in CLASSES for j in CLASSES) + ")"
_AGREED = "(" + " + ".join(f"n_{c}_{c}" for c in CLASSES) + ")"
_CHANCE = "(" + " + ".join(f"cast({' + '.join(f'n_{c}_{x}' for x in CLASSES)} as double) * ({' + '.join(f'n_{x}_{c}' for x in CLASSES)})" for c in CLASSES) + f") / (cast({_TOTAL} as double) * {_TOTAL})"
KAPPA = f"case when {_TOTAL} > 0 and {_CHANCE} <> 1 then ({_AGREED} / cast({_TOTAL} as double) - {_CHANCE}) / (1 - {_CHANCE}) end"
AGREEMENT = f"case when {_TOTAL} > 0 then {_AGREED} / cast({_TOTAL} as double) end"


def table_cells(human: str, judge: str) -> list[Column]:
    """The nine counts of the table of two labels, as aggregates for ``KAPPA`` and ``AGREEMENT``."""
    names = dict(zip(CLASSES, ("ANSWER_A", "ANSWER_B", "TIE"), strict=True))
    return [F.count_if((F.col(human) == names[h]) & (F.col(judge) == names[j])).alias(f"n_{h}_{j}") for h in CLASSES for j in CLASSES]


def table_interval(df: DataFrame, human: str, judge: str, statistic: str, by: list[str] = (), iterations: int = 10_000, seed: int = 20260818) -> DataFrame:
    """Interval over independent units of a statistic (SQL text) of the nine cells: a multinomial over the cells of each group."""
    names = [f"n_{h}_{j}" for h in CLASSES for j in CLASSES]
    packed = df.groupBy(grouping(by).alias("group_id")).agg(*table_cells(human, judge)).select("group_id", F.array(*names).alias("cells"))
    work = packed.select("group_id", "cells", F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // BLOCK) - 1))).alias("block")).repartition("group_id", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for g, c, b in zip(x["group_id"], x["cells"], x["block"], strict=True):
                n, k = np.array(c, np.int64), min(BLOCK, iterations - b * BLOCK)
                if n.sum():
                    drawn = np.random.default_rng(_seed(seed, g, b)).multinomial(n.sum(), n / n.sum(), size=k)
                    yield pd.DataFrame({"group_id": g, "replicate": b * BLOCK + np.arange(k), "units": int(n.sum()), **{name: drawn[:, i] for i, name in enumerate(names)}})

    reps = work.mapInPandas(run, "group_id string, replicate long, units long, " + ", ".join(f"{n} long" for n in names))
    return interval(reps.select("group_id", "replicate", "units", F.expr(statistic).alias("stat")))


def hash_weights(units: list[str], replicates: range, seed: int) -> np.ndarray:
    """``poisson_weight`` as a matrix, replicates by units."""
    digits = np.array([[int.from_bytes(sha256(f"{seed}:{u}:{r}".encode()).digest()[:4], "big") for u in units] for r in replicates], np.int64)
    return np.searchsorted(np.array(POISSON), digits, side="right")


def mixed_weights(units: list[str], replicates: range, seed: int) -> np.ndarray:
    """Poisson(1) weights from one digest a unit and a 64-bit mix: for many clusters."""
    h = np.array([int.from_bytes(sha256(f"{seed}:{u}".encode()).digest()[:8], "big") for u in units], np.uint64)
    x = h[None, :] + np.arange(replicates.start + 1, replicates.stop + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(32)
    return sum((x >= np.uint64(t)).astype(np.int64) for t in POISSON)


WEIGHTS = {"sha256": hash_weights, "mixed": mixed_weights}


def clustered_sums(df: DataFrame, cluster: str, sums: list[Column], iterations: int, seed: int, weights: str = "sha256") -> DataFrame:
    """Weighted sums of each replicate over whole resampled clusters: ``replicate`` and the names of ``sums``.

    ``sums``: named aggregates, whole numbers, that say all of a cluster that an estimator needs (counts after its own eligibility).
    Without clusters there are no rows. A null cluster is one of its own. The result of ``sha256`` weights is that of ``poisson_weight`` row by row;
    ``mixed`` weights cost a digest a cluster instead of one a cluster and replicate.
    """
    c = df.groupBy(cluster).agg(*sums)
    names = [x for x in c.columns if x != cluster]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = c.select(F.coalesce(F.col(cluster).cast("string"), F.lit("None")).alias("_unit"), *(F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in names)).repartition(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            for at in range(0, len(x), CLUSTERS):
                part = x.iloc[at : at + CLUSTERS]
                units, values = part["_unit"].tolist(), part[names].to_numpy(np.int64)
                total = np.zeros((iterations, len(names)), np.int64) if total is None else total
                for b in range(0, iterations, BLOCK):
                    block = range(b, min(b + BLOCK, iterations))
                    total[block.start : block.stop] += WEIGHTS[weights](units, block, seed) @ values
        if total is not None:
            yield pd.DataFrame({"replicate": np.arange(iterations), **{n: total[:, i] for i, n in enumerate(names)}})

    sent = rows.mapInPandas(run, "replicate long, " + ", ".join(f"{n} long" for n in names))
    return sent.groupBy("replicate").agg(*(F.sum(n).alias(n) for n in names))


def clustered_statistic(df: DataFrame, cluster: str, sums: list[Column], statistic: str, iterations: int = 10_000, seed: int = 20260818, weights: str = "sha256") -> DataFrame:
    """``clustered_sums`` and ``stat``, an estimator (SQL text over the sums) that is applied anew to each replicate; null where it cannot be estimated."""
    return clustered_sums(df, cluster, sums, iterations, seed, weights).select("*", F.expr(statistic).alias("stat"))


def clustered_report(df: DataFrame, cluster: str, sums: list[Column], statistics: dict[str, str], iterations: int = 10_000, seed: int = 20260818, weights: str = "sha256") -> DataFrame:
    """One row for each of several estimators over the same replicates: point, interval, clusters, replicates, valid and non-estimable ones, and the most rows of a cluster."""
    reps = settled(clustered_sums(df, cluster, sums, iterations, seed, weights))
    long = reps.select("replicate", F.explode(F.map_from_arrays(F.array(*map(F.lit, statistics)), F.array(*map(F.expr, statistics.values())))).alias("group_id", "stat"))
    size = df.groupBy(cluster).agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.max("n").alias("multiplicity"))
    total = df.agg(*sums)
    points = total.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, statistics)), F.array(*map(F.expr, statistics.values())))).alias("metric", "point"))
    ci = interval(long.join(F.broadcast(size.select(F.col("clusters").alias("units")))))
    valid = long.groupBy(F.col("group_id").alias("metric")).agg(F.count("*").alias("bootstrap_replicates"), F.count_if(F.col("stat").isNotNull() & ~F.isnan("stat")).alias("valid_replicates"))
    out = points.join(valid, "metric", "left").join(ci.select(F.col("group_id").alias("metric"), "ci_low", "ci_high"), "metric", "left").join(F.broadcast(size))
    return out.withColumn("non_estimable_replicates", F.col("bootstrap_replicates") - F.col("valid_replicates"))


def clustered_bootstrap(df: DataFrame, cluster: str, value: str, iterations: int = 10_000, seed: int = 20260818) -> DataFrame:
    """Weighted replicate means over whole clusters: one row of sums for each cluster, then weights.

    ``value`` is a small integer (0/1, or a delta); a replicate without weight is null and counted.
    """
    sums = [F.sum(F.col(value).cast("long")).alias("ws"), F.count("*").alias("wn")]
    return clustered_statistic(df.where(F.col(value).isNotNull()), cluster, sums, "case when wn > 0 then ws / cast(wn as double) end", iterations, seed)


def clustered_interval(reps: DataFrame, clusters: int) -> DataFrame:
    """Interval over ``clusters`` clusters, with valid and non-estimable replicates."""
    ci = interval(reps.select(F.lit("clustered").alias("group_id"), "replicate", "stat", F.lit(clusters).alias("units")))
    lost = reps.agg(F.count_if(F.col("stat").isNull()).alias("non_estimable"))
    return ci.crossJoin(F.broadcast(lost))


def compare_intervals(official: DataFrame, clustered: DataFrame, null_value: float = 0.0) -> DataFrame:
    """Widths, their difference, and whether the null value changes sides; further columns of ``clustered`` (counts of replicates, clusters, multiplicity) stay."""
    more = [c for c in clustered.columns if c not in ("metric", "ci_low", "ci_high")]
    j = official.select("metric", F.col("ci_low").alias("lo1"), F.col("ci_high").alias("hi1")).join(clustered.select("metric", F.col("ci_low").alias("lo2"), F.col("ci_high").alias("hi2"), *more), "metric")
    inside = lambda lo, hi: (F.col(lo) <= null_value) & (F.col(hi) >= null_value)
    widths = ((F.col("hi1") - F.col("lo1")).alias("official_width"), (F.col("hi2") - F.col("lo2")).alias("clustered_width"), (F.col("hi2") - F.col("lo2") - F.col("hi1") + F.col("lo1")).alias("width_difference"))
    changed = F.coalesce(inside("lo1", "hi1") != inside("lo2", "hi2"), F.lit(False))
    return j.select("metric", *widths, inside("lo1", "hi1").alias("null_inside_official"), inside("lo2", "hi2").alias("null_inside_clustered"), changed.alias("changed"), *more)
