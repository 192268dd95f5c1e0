"""Embedding near-dedup by spherical-cap filters from structured random product codes.

Equal vectors of a label become one node first (partially aggregated), with the number of its copies. A
filter is a direction; its cap holds the vectors that exceed a threshold in it. Directions form ``codes`` random product
codes: a rotation each, and a direction for every pair of codewords of the two halves, so that
sorted scores of the halves list-decode a vector to the filters it exceeds without a look at
all of them. The threshold is the vector's own: its ``lists`` best directions of each code are its filters, so no
vector has few and none has many. Vectors at a cosine of 0.98 in 64 dimensions share no filter of one code with
probability 0.001 (1,024 directions) to 0.018 (a million), of all four with 1e-12 to 1e-7.

Vectors of one filter and label are compared in double precision. Filters with one vector are left out by counts
before vectors are shuffled; a filter with more than ``block`` vectors is dealt as pairs of blocks, each a task's rows of its own,
so that a hot filter, or a third of all rows in one spot, is compared in full without meeting in one task (the comparisons
of n unlike vectors within one cap are n squared; what is sent grows with n times its blocks). A pair that shares several filters
counts in the least of them only, known from the lists that its rows carry. A task sends sums of links and a
spanning forest, never pairs. Components are those of all forests.

Codewords grow with the square root of the number of unlike vectors, so that caps do not fill up with the table.

Edges: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, has no link. Vectors of
different lengths are not compared. Rows may share an id: each is a vector of its own. Null ids
are no one's least id; among null ids alone the component is null, and the row is kept. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .graph import connected_components

CODES, LISTS, SEED = 4, 6, 11
#: Codewords of a half, at least and at most.
FEWEST, MOST = 16, 1024
#: Vectors of a filter that are compared in one go.
BLOCK = 2048


def codes(dim: int, words: int, n: int, seed: int = SEED) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """``n`` product codes: a rotation and the unit codewords of each half (of one whole under 16 dimensions)."""
    r = np.random.default_rng([seed, dim, words])
    out = []
    for _ in range(n):
        turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        halves = []
        for part in np.array_split(np.arange(dim), 2 if dim >= 16 else 1):
            c = r.normal(size=(words, len(part)))
            halves.append(c / np.linalg.norm(c, axis=1)[:, None])
        out.append((turn, halves))
    return out


def decoded(unit: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]], lists: int) -> np.ndarray:
    """The ``lists`` directions of a code in which each vector scores best.

    The best sums of two sorted lists lie within the best ``lists`` of both.
    """
    turn, halves = code
    y, at, best = unit @ turn, 0, None
    for words in halves:
        score = y[:, at : at + words.shape[1]] @ words.T
        at += words.shape[1]
        name = np.argsort(-score, axis=1, kind="stable")[:, :lists]
        score = np.take_along_axis(score, name, 1)
        if best is None:
            best, names = score, name
        else:
            joint = (best[:, :, None] + score[:, None, :]).reshape(len(y), -1)
            both = (names[:, :, None] * len(words) + name[:, None, :]).reshape(len(y), -1)
            top = np.argsort(-joint, axis=1, kind="stable")[:, :lists]
            best, names = np.take_along_axis(joint, top, 1), np.take_along_axis(both, top, 1)
    return names


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square passes the range of doubles."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def listed(words: int, n: int, lists: int):
    """Nodes to their filters, numbered through all codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            for width in np.unique(batch["dim"].to_numpy()):
                mine = batch.filter(pa.array(batch["dim"].to_numpy() == width))
                for start in range(0, mine.num_rows, 512):
                    rows = mine.slice(start, 512)
                    if width not in known:
                        known[width] = codes(int(width), words, n)
                    u = units(flat(rows.column("v"), width).astype(float))
                    found = np.concatenate([decoded(u, c, lists) + i * words * words for i, c in enumerate(known[width])], axis=1)
                    yield pa.RecordBatch.from_arrays([rows["k"], pa.FixedSizeListArray.from_arrays(pa.array(found.ravel(), pa.int32()), found.shape[1]).cast(pa.list_(pa.int32()))], ["k", "filters"])

    return run


def shared_before(lists: np.ndarray, this: int) -> np.ndarray:
    """Which pairs of rows share a filter under ``this``: they are counted there."""
    row, col = np.nonzero(lists < this)
    name, inverse, n = np.unique(lists[row, col], return_inverse=True, return_counts=True)
    often = n[inverse] > 1
    if not often.any():
        return np.zeros((len(lists), len(lists)), bool)
    name, inverse = np.unique(inverse[often], return_inverse=True)
    held = np.zeros((len(lists), len(name)), np.float32)
    held[row[often], inverse] = 1
    return held @ held.T > 0


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric table of links joins."""
    todo, out = linked.any(1), []
    while todo.any():
        root = int(todo.argmax())
        todo[root], edge = False, [root]
        while len(edge):
            new = np.flatnonzero(linked[edge].any(0) & todo)
            todo[new] = False
            out += [(root, int(x)) for x in new]
            edge = new
    return out


def compared(least: float):
    """Rows sorted by group to sums of links (``b`` null) and edges; a group is one filter of one label, or a pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            column = {c: rows[c].to_numpy() for c in ("group", "kind", "filter", "block", "first", "last", "n", "dim")}
            keys, v, lists = (rows[c].combine_chunks() for c in ("k", "v", "filters"))
            new = np.ones(len(keys), bool)
            new[1:] = np.any([column[c][1:] != column[c][:-1] for c in ("group", "kind", "filter", "first", "last")], axis=0)
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(keys))
            total, a, b = np.zeros(len(keys), np.int64), [], []
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                if e - s < 2:
                    continue
                u = units(flat(v.slice(s, e - s), column["dim"][s]).astype(float))
                linked = u @ u.T >= least
                np.fill_diagonal(linked, False)
                if column["first"][s] != column["last"][s]:
                    linked &= column["block"][s:e, None] != column["block"][None, s:e]
                some = np.flatnonzero(linked.any(1))
                if not len(some):
                    continue
                shared = shared_before(np.array([lists[s + i].as_py() for i in some.tolist()]), column["filter"][s])
                linked[np.ix_(some, some)] &= ~shared
                total[s:e] = linked @ column["n"][s:e]
                for x, y in forest(linked):
                    a.append(keys[s + x])
                    b.append(keys[s + y])
            some = np.flatnonzero(total)
            if len(some):
                none = pa.nulls(len(some), pa.string())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), none, pa.array(total[some])], ["a", "b", "links"])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([0] * len(a), pa.int64())], ["a", "b", "links"])

        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= 4096:
                rows = pa.Table.from_batches(waiting)
                group = rows["group"].to_numpy()
                ready = int(np.searchsorted(group == group[-1], True)) if group[0] != group[-1] else 0
                if ready:
                    yield from done(rows.slice(0, ready))
                waiting, size = [x for x in rows.slice(ready).to_batches() if x.num_rows], len(group) - ready
        if size:
            yield from done(pa.Table.from_batches(waiting))

    return run


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *, least: float = 0.98, n_codes: int = CODES, lists: int = LISTS, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row; see the module for rules and edges."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    narrow = "float" in vectors.schema[vector_col].dataType.simpleString()
    v = v.cast("array<float>" if narrow else "array<double>")
    zero = F.lit(0.0).cast("float" if narrow else "double")
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    # minus zero becomes zero: equal vectors have equal bytes
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda x: x + zero).alias("v"))
    digest = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "v")), 16, "0") for i in (1, 2)))
    rows = rows.withColumn("k", F.when(F.coalesce(usable, F.lit(False)), digest))
    good = rows.where("k is not null")
    nodes = cut(good.groupBy("k").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("label").alias("label"), F.any_value("v").alias("v")))
    words = words or min(MOST, max(FEWEST, 1 << (nodes.count().bit_length() + 1) // 2))
    held = cut(nodes.select("k", F.size("v").alias("dim"), "v").mapInArrow(listed(words, n_codes, lists), "k string, filters array<int>"))
    spots = held.join(nodes.select("k", F.xxhash64("label", F.size("v")).alias("kind")), "k").select("k", "kind", F.explode("filters").alias("filter"))
    crowded = spots.groupBy("kind", "filter").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    met = spots.join(spread(crowded), ["kind", "filter"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "k"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "block").alias("first"), F.greatest(i, "block").alias("last")))
    dealt = met.select("k", "kind", "filter", "block", F.explode(pairs).alias("x")).select("*", "x.*").drop("x")
    full = dealt.join(nodes.select("k", "n", "v", F.size("v").alias("dim")), "k").join(held, "k")
    full = full.withColumn("group", F.xxhash64("kind", "filter", "first", "last"))
    out = "a string, b string, links long"
    grouped = full.repartition("group").sortWithinPartitions("group", "kind", "filter", "first", "last")
    found = cut(grouped.select("group", "kind", "filter", "block", "first", "last", "n", "k", "dim", "v", "filters").mapInArrow(compared(least), out))
    links = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("k"), "root")
    members = nodes.select("k", "n", "least").join(links, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    members = cut(members.select("k", "root", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(spread(smallest), "root").select("k", "n_links", "component_id")
    linked = good.select("vec_id", "k").join(spread(named), "k").select("vec_id", "n_links", "component_id")
    alone = rows.where("k is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def duckdb_sql(least: float = 0.98) -> str:
    """The same by comparing all pairs of a label."""
    return f"""
with recursive
v as materialized (
  select vec_id, label, x, sqrt(list_dot_product(x, x)) as norm from (select vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0) where list_dot_product(x, x) > 0),
e as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {least}),
reach as (select a as s, b as t from e union select reach.s, e.b from reach join e on reach.t = e.a)
select d.vec_id, coalesce(n.n, 0)::bigint as n_links, least(d.vec_id, coalesce(r.t, d.vec_id))::bigint as component_id, d.vec_id <= coalesce(r.t, d.vec_id) as kept
from embeddings d left join (select a, count(*) as n from e group by a) n on n.a = d.vec_id left join (select s, min(t) as t from reach group by s) r on r.s = d.vec_id
"""
