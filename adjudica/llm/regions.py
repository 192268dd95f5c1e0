"""Exact links within regions of candidates, with hot regions dealt over many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .graph import connected_components

#: (payloads, sides, join): calls join(i, j) for linked members; join says whether they were apart.
Linker = Callable[[list[bytes], list[int], "Union"], None]


class Union:
    """Union-find over the members of one group; ``made`` holds the joins that changed it."""

    def __init__(self, n: int):
        self.up, self.made = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def apart(self, i: int, j: int) -> bool:
        return self.root(i) != self.root(j)

    def join(self, i: int, j: int) -> None:
        p, q = self.root(i), self.root(j)
        if p != q:
            self.up[p] = q
            self.made.append((i, j))


def streamed(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, a list for each value of the first column."""
    key, rows = None, []
    for x in batches:
        for r in zip(*(x[c] for c in columns), strict=True):
            if rows and r[0] != key:
                yield rows
                rows = []
            key = r[0]
            rows.append(r)
    if rows:
        yield rows


def group_links(groups: DataFrame, linker: Linker) -> DataFrame:
    """Spanning links of groups: rows ``g``, ``side``, ``node`` and ``body``, dealt by ``g`` and streamed in its order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in streamed(batches, ["g", "side", "node", "body"]):
            if len(rows) > 1:
                found = Union(len(rows))
                linker([r[3] for r in rows], [r[1] for r in rows], found)
                yield pd.DataFrame([(rows[i][2], rows[j][2]) for i, j in found.made], columns=["a", "b"])

    return groups.select("g", "side", "node", "body").repartition("g").sortWithinPartitions("g").mapInPandas(run, "a binary, b binary")


def regions_of(candidates: DataFrame, region: int) -> DataFrame:
    """``root``, ``node``, ``size`` and three chunk numbers, for the nodes of candidate edges ``a``-``b``."""
    parts = connected_components(candidates)
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    chunk = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.ceil(F.col("size") / region)).alias(f"c{i}")
    return parts.join(spread(sizes), "root").select("root", "node", "size", *map(chunk, range(3)))


def region_links(members: DataFrame, linker: Linker, region: int) -> DataFrame:
    """Links that span what is linked in each region; ``members``: ``regions_of`` with a ``body``.

    A region of up to ``region`` nodes is one group. A larger one is dealt over chunks three
    times, which joins its core; then what is not in its largest component is compared, in
    blocks, with every chunk. So any two nodes of a region are compared or already joined.
    """
    group = lambda *c: F.concat_ws(":", F.base64("root"), *c)
    text = lambda c: F.col(c).cast("string")
    row = lambda df, g, side: df.select(g.alias("g"), F.lit(side).alias("side"), "node", "body")
    hot = members.where(F.col("size") > region)
    first = row(members, group(F.lit("0"), text("c0")), 0)
    for i in (1, 2):
        first = first.unionByName(row(hot, group(F.lit(str(i)), text(f"c{i}")), 0))
    links = cut(group_links(first, linker))
    if hot.limit(1).count():
        parts = connected_components(links).withColumnRenamed("root", "comp")
        named = hot.join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        core = named.groupBy("root", "comp").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("core"))
        named = named.join(core, "root")
        loose = named.where("comp <> core").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("size") / region)))
        blocks, chunks = loose.select("root", "block").distinct(), named.select("root", "c0").distinct()
        at: Column = group(F.lit("x"), text("block"), text("c0"))
        crossed = row(loose.drop("c0").join(chunks, "root"), at, 1).unionByName(row(named.join(blocks, "root"), at, 0))
        links = links.unionByName(cut(group_links(crossed, linker)))
    return links
