"""Vector code compression: exact product codes, found with metric trees over the parts.

Vectors become integers, are cut into parts, and each part position gets a codebook by rounds of
nearest entries and floored means. Points never leave their chunk of a scan partition: a chunk
holds, for each part position, an anchors hierarchy built middle-out (about sqrt(n) anchors, each
grown further inside, merged upwards by the smallest joint ball), whose balls cache count and sum. A round
walks each tree from its root with the list of entries that may still be nearest; a ball hands
down only what no other entry beats everywhere in it, and a ball with one entry left adds its cached sum without
a look at its points. Bounds only prune, with a margin above rounding; what is left is compared in
integers, so codes and means are exact. A round sends one row of sums a task, added in buckets; the driver
holds the codebooks, whose size the parameters fix.

Edges: rows whose vector is null, holds null or non-finite components, or whose length is not that of the kept
vector with the least id (then vector), or no multiple of ``parts``, are dropped. Ids may repeat or be null (last in order).
Fewer vectors than entries give fewer entries. Integers of 2^20 or more are compared as Python's
integers, without trees; errors beyond 64 bits are null. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, spread

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a chunk, and points that a ball keeps without parting.
CHUNK, LEAF = 4096, 24
#: Integers under this stay within 64 bits in all sums of a chunk.
PLAIN = 1 << 20
#: Rows of sums that a round leaves for the driver.
BUCKETS = 64


def integers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v), exact at every size."""
    if not v.size or np.abs(v).max() * SCALE < PLAIN:
        return np.floor(v * SCALE).astype(np.int64)
    one = lambda x: math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE
    return np.array([[one(float(x)) for x in row] for row in v], dtype=object)


def whole(rows: list[list[int]]) -> np.ndarray:
    """Entries as 64-bit integers where they fit the plain way, else as Python's."""
    big = any(abs(x) >= PLAIN for row in rows for x in row)
    return np.array(rows, dtype=object if big else np.int64)


def anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point: each new anchor is the point farthest from its own and takes the points that are nearer to it."""
    pivot, owner = [0], np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(pivot) < k:
        p = int(far.argmax())
        if far[p] == 0:
            break
        apart = np.sqrt(((x[pivot] - x[p]) ** 2).sum(1))
        near = np.flatnonzero(far >= apart[owner] / 2)  # others cannot be nearer to the new one
        d = np.sqrt(((x[near] - x[p]) ** 2).sum(1))
        won = d < far[near]
        owner[near[won]], far[near[won]] = len(pivot), d[won]
        pivot.append(p)
    return owner


def merged(balls: list, x: np.ndarray, members: list[np.ndarray]) -> tuple:
    """One tree over ``balls``: the two whose joint ball is smallest are joined until one is left."""
    centre = np.array([x[m].mean(0) for m in members])
    radius = np.array([np.sqrt(((x[m] - c) ** 2).sum(1)).max() for m, c in zip(members, centre, strict=True)])
    n = np.array([len(m) for m in members], float)
    joint = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
    np.fill_diagonal(joint, np.inf)
    balls = list(balls)
    for _ in range(len(balls) - 1):
        a, b = divmod(int(joint.argmin()), len(balls))
        apart = np.sqrt(((centre[a] - centre[b]) ** 2).sum())
        centre[a] = (centre[a] * n[a] + centre[b] * n[b]) / (n[a] + n[b])
        radius[a], n[a] = max((apart + radius[a] + radius[b]) / 2, radius[a], radius[b]), n[a] + n[b]
        balls[a], n[b] = (balls[a], balls[b]), 0
        joint[b], joint[:, b] = np.inf, np.inf
        row = np.sqrt(((centre - centre[a]) ** 2).sum(1)) + radius + radius[a]
        row[(n == 0) | (np.arange(len(n)) == a)] = np.inf
        joint[a], joint[:, a] = row, row
    return balls[a] if len(balls) > 1 else balls[0]


def grown(x: np.ndarray, ids: np.ndarray) -> np.ndarray | tuple:
    """A tree over the points ``ids``: pairs of trees, with arrays of points as leaves."""
    if len(ids) <= LEAF:
        return ids
    owner = anchors(x[ids], math.isqrt(len(ids)) + 1)
    if not owner.any():
        return ids
    members = [ids[owner == a] for a in range(owner.max() + 1)]
    members = [m for m in members if len(m)]
    return merged([grown(x, m) for m in members], x, members)


def tree(x: np.ndarray) -> dict:
    """Balls of the points of one part: rows of points in tree order, and what each ball caches."""
    if x.dtype == object:
        return {"order": np.arange(len(x)), "x": x, "start": np.array([0]), "end": np.array([len(x)]), "kids": np.array([[-1, -1]]), "plain": False}
    order, start, end, kids, todo = [], [], [], [], [(grown(x.astype(float), np.arange(len(x))), -1, 0)]
    at = 0
    while todo:
        ball, parent, side = todo.pop()
        if parent >= 0:
            kids[parent][side] = len(start)
        kids.append([-1, -1])
        start.append(at)
        end.append(-1)
        if isinstance(ball, tuple):
            todo += [(ball[1], len(start) - 1, 1), (ball[0], len(start) - 1, 0)]
        else:
            order.append(ball)
            at += len(ball)
            end[-1] = at
    for i in range(len(start) - 1, -1, -1):
        if end[i] < 0:
            end[i] = end[kids[i][1]]
    order, start, end = np.concatenate(order), np.array(start), np.array(end)
    x = x[order]
    running = np.concatenate([np.zeros((1, x.shape[1]), np.int64), x.cumsum(0)])
    sums = running[end] - running[start]
    centre = sums / (end - start)[:, None]
    radius = np.array([np.sqrt(((x[s:e] - c) ** 2).sum(1)).max() for s, e, c in zip(start, end, centre, strict=True)])
    return {"order": order, "x": x.astype(np.int32), "start": start, "end": end, "kids": np.array(kids), "plain": True, "sums": sums, "centre": centre, "radius": radius}


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, in integers."""
    x = x if x.dtype == object else x.astype(np.int64)
    out = (x[:, 0, None] - entries[None, :, 0]) ** 2
    for j in range(1, x.shape[1]):
        out = out + (x[:, j, None] - entries[None, :, j]) ** 2
    return out


def walk(t: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Balls that one entry owns, with the entry; and the points that remain, with theirs."""
    if not (t["plain"] and entries.dtype == np.int64):
        d = distances(t["x"], entries)
        return np.zeros(0, int), np.zeros(0, int), np.arange(len(t["x"])), np.array([int(row.argmin()) for row in d], dtype=int)
    e = entries.astype(float)
    square = (e**2).sum(1)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    balls, lists = np.array([0]), np.ones((1, len(e)), bool)
    owned, owners, left, masks = [], [], [], []
    while len(balls):
        c, r = t["centre"][balls], t["radius"][balls]
        inner = c @ e.T
        best = np.where(lists, square[None] - 2 * inner, np.inf).argmin(1)
        scale = (np.abs(c).max(1) + r + np.abs(e).max() + 1) ** 2 * c.shape[1]
        reach = 2 * (inner - inner[np.arange(len(best)), best][:, None] + r[:, None] * apart[best])
        beaten = reach < square[None] - square[best][:, None] - 1e-9 * scale[:, None]
        lists = lists & ~beaten
        one = lists.sum(1) == 1
        owned.append(balls[one])
        owners.append(best[one])
        leaf = ~one & (t["kids"][balls, 0] < 0)
        left.append(balls[leaf])
        masks.append(lists[leaf])
        inside = ~one & ~leaf
        balls, lists = t["kids"][balls[inside]].ravel(), np.repeat(lists[inside], 2, axis=0)
    left, masks = np.concatenate(left), np.concatenate(masks)
    size = t["end"][left] - t["start"][left]
    points = np.repeat(t["start"][left] - (size.cumsum() - size), size) + np.arange(size.sum())
    d = np.where(np.repeat(masks, size, axis=0), distances(t["x"][points], entries), np.iinfo(np.int64).max)
    return np.concatenate(owned), np.concatenate(owners), points, d.argmin(1) if len(d) else np.zeros(0, int)


def added(total: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    return more if total is None else total + more


def sums_of(t: dict, entries: np.ndarray) -> np.ndarray:
    """For each entry the count and the sum of its points, as Python's integers."""
    owned, owner, points, nearest = walk(t, entries)
    kind = np.int64 if t["plain"] else object
    out = np.zeros((len(entries), 1 + entries.shape[1]), kind)
    if len(owned):
        np.add.at(out, owner, np.concatenate([(t["end"] - t["start"])[owned][:, None], t["sums"][owned]], axis=1))
    x = t["x"][points].astype(kind)
    for e in np.unique(nearest):
        mine = nearest == e
        out[e, 0] += int(mine.sum())
        out[e, 1:] += x[mine].sum(0)
    return out.astype(object)


def codes_of(t: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the order of the chunk."""
    owned, owner, points, nearest = walk(t, entries)
    code = np.zeros(len(t["x"]), np.int64)
    for b, e in zip(owned, owner, strict=True):
        code[t["start"][b] : t["end"][b]] = e
    code[points] = nearest
    x = t["x"] if t["x"].dtype == object else t["x"].astype(np.int64)
    error = ((x - entries[code]) ** 2).sum(1)
    out, far = np.empty_like(code), np.empty(len(code), error.dtype)
    out[t["order"]], far[t["order"]] = code, error
    return out, far


def chunked(parts: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            width = len(table["v"][0])
            v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            blob = pickle.dumps([tree(x) for x in np.split(integers(v), parts, axis=1)])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([blob], pa.binary())], ["ids", "labels", "trees"])

        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, rows - n), batch.slice(min(rows - n, batch.num_rows))
                waiting.append(part)
                n += part.num_rows
                if n == rows:
                    yield packed(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(waiting))

    return run


def next_books(chunks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """One round: every part goes to its nearest entry, every entry to the floored mean of its parts."""

    def task_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays, total = [whole(b) for b in books], None
        for batch in batches:
            for blob in batch["trees"]:
                total = added(total, np.array([sums_of(t, e) for t, e in zip(pickle.loads(blob), arrays, strict=True)], dtype=object))
        if total is not None:
            yield pd.DataFrame({"bucket": [TaskContext.get().partitionId() % BUCKETS], "sums": [pickle.dumps(total)]})

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in rows["sums"]:
            total = added(total, pickle.loads(blob))
        return pd.DataFrame({"sums": [pickle.dumps(total)]})

    rows = chunks.select("trees").mapInPandas(task_sums, "bucket int, sums binary").groupBy("bucket").applyInPandas(joined, "sums binary").collect()
    total = sum(pickle.loads(r["sums"]) for r in rows)
    mean = lambda old, s: [int(x) // int(s[0]) for x in s[1:]] if s[0] else old
    return [[mean(old, s) for old, s in zip(book, part, strict=True)] for book, part in zip(books, total, strict=True)]


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` for each kept vector; see the module for rules and edges."""
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    kinds = {f.name: f.dataType for f in kept.schema}
    out = T.StructType([T.StructField("vec_id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width = len(first[0]["v"]) if first else 0
    if not width or width % parts:
        return spark.createDataFrame([], out).select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kept = kept.where(F.size("v") == width)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = integers(np.array([r["v"] for r in first]))
    books = [[[int(x) for x in row] for row in part] for part in np.split(seeds, parts, axis=1)]
    arrays = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("trees", T.BinaryType())])
    chunks = cut(kept.mapInArrow(chunked(parts, chunk), arrays))
    for _ in range(rounds):
        books = next_books(chunks, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = [whole(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                both = [codes_of(t, e) for t, e in zip(pickle.loads(batch["trees"][i].as_py()), final, strict=True)]
                names = ["".join(f"{c:02x}" for c in row) for row in np.array([c for c, _ in both]).T.tolist()]
                error = [e if e < 1 << 63 else None for e in map(int, sum(e for _, e in both))]
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, batch["labels"][i].values, pa.array(names, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = cut(chunks.mapInArrow(coded, out))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = rows.groupBy("label").agg(F.when(F.count("*") == F.count("error"), total).alias("_sum")).withColumn("_of", F.col("label"))
    joined = rows.join(spread(by_label).drop("label"), F.col("label").eqNullSafe(F.col("_of")), "left")
    return joined.select("vec_id", "code", "error", F.col("_sum").try_cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def duckdb_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    floored = lambda s, n: f"(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} as materialized (select id, p, min(d * {entries} + e) % {entries} as e, min(d * {entries} + e) // {entries} as d from (select parts.id, p, e,"
            f" list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint as d from parts join c{k} using (p)) group by id, p)"
        )
        if k < rounds:
            steps.append(
                f"c{k + 1} as materialized (select c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) as c from c{k} left join (select p, e, list({floored('s', 'n')} order by i)::bigint[] as c"
                f" from (select p, e, i, sum(x[i]) as s, count(*) as n from a{k} join parts using (id, p), (select unnest(range(1, 1025)) as i) where i <= len(x) group by p, e, i) group by p, e) m on c{k}.p = m.p and c{k}.e = m.e)"
            )
    return f"""
with kept as materialized (select vec_id as id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select id, p, list_transform(embedding[p * len(embedding) // {parts} + 1 : (p + 1) * len(embedding) // {parts}], lambda x: floor({SCALE} * x::double)::bigint) as x
  from kept, (select unnest(range({parts})) as p)),
c0 as materialized (select p, e, x as c from parts join (select id, row_number() over (order by id) - 1 as e from kept order by id limit {entries}) using (id)),
{', '.join(steps)},
per as (select id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by id)
select id as vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from c{rounds}) as codebooks_sha256
from per join kept using (id)
"""
