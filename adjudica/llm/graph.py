"""Connected components of an edge table, by alternating large and small stars.

Both steps are groupings and equi-joins over all executors; rounds grow with the logarithm of
the longest path. Edges are counted first: up to ``SMALL`` of them, a bound that does not grow
with the data, one task's union-find is the shorter way to the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SMALL = 400_000


def union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in batches:
        for a, b in zip(e["a"], e["b"], strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            p, q = root(a), root(b)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"node": part, "root": [root(x) for x in part]})


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node`` and ``root`` (the least node that it is joined with) for each node of ``a``-``b`` edges."""
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    if before[0] <= small:
        kind = e.schema["a"].dataType.simpleString()
        return e.coalesce(1).mapInPandas(union_find, f"node {kind}, root {kind}")
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        e = cut(small.distinct())
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
