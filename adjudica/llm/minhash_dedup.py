"""MinHash near-dedup with an LSH forest; links are confirmed on full shingle sets.

A document's set holds its distinct k-word shingles (A-Z lower-cased; with fewer words the
whole sequence is one; without words the set is empty and linked with nothing). Two
documents are linked when 100 * intersection >= percent * union.

1. One scan gives each document its set's digest and 96 minhashes. Equal sets fall together
   in a partially aggregated grouping; from here on a node is a distinct set.
2. Forest: each of 24 orders starts at another 4 of the minhashes and goes on with the next
   ones. Nodes are range-partitioned and sorted by the order; neighbours whose longest common
   prefix is 4 or more are candidates, and the boundaries of partitions are compared as well. A
   pair at 0.8 shares no such prefix in any order with probability (1 - 0.8^4)^24 = 3e-6. Components of candidates are regions.
3. Depth adapts to the region. In one of up to ``REGION`` nodes all pairs of full sets are
   compared. A larger one descends to prefixes of 8 minhashes, which part texts that merely share a template (at a similarity of
   0.3 one pair in 200 meets there, where one in six met before), and takes as many more orders as keep what it may
   miss as small: 72, in which a pair at 0.8 shares no prefix with probability (1 - 0.8^8)^72 = 2e-6. The 576 minhashes
   are drawn for its nodes only. What is large even there is dealt out three times over chunks by different minhashes, which joins
   its core; then what is outside the core is compared, in blocks, with all chunks of its region.
4. Components of confirmed links. Nulls: a null text has no words, a row without an id is
   returned with a null component. Rows that share an id are separate documents with one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, spread, text_of
from .graph import connected_components
from .regions import Union, region_links, regions_of

SEED, REGION, PERCENT = 7, 512, 80
#: Orders and length of the prefix that binds: at first, and in large regions.
SHALLOW, DEEP = (24, 4), (72, 8)
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Memo of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, six spaces only
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    size = min(k, len(w))
    g = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        g = (g ^ h[j : len(h) - size + 1 + j]) * MIX
        g ^= g >> np.uint64(29)
    g *= MIX2
    return np.unique(g ^ (g >> np.uint64(32)))


def draws(orders: int, depth: int) -> np.ndarray:
    n = orders * depth
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(g: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(g), 4096):
        np.minimum(out, (g[i : i + 4096, None] * a).min(0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def digest(g: np.ndarray) -> bytes:
    return blake2b(g.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """The columns but ``_t``, and ``_t``'s set size ``n``, digest ``node`` (null if empty) and minhashes ``sig``."""

    @F.pandas_udf("struct<n:long,node:binary,sig:binary>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo, a = WordHashes(), draws(*SHALLOW)
        for texts in batches:
            sets = [shingles(t, k, memo) for t in texts]
            yield pd.DataFrame({"n": [len(g) for g in sets], "node": [digest(g) if len(g) else None for g in sets], "sig": [minhashes(g, a).tobytes() if len(g) else None for g in sets]})

    rest = [c for c in docs.columns if c != "_t"]
    return docs.select(*rest, sign("_t").alias("x")).select(*rest, "x.*")


def forest(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """Candidate edges ``a``-``b``: neighbours in each of ``trees`` sorted orders that share a prefix of ``depth`` minhashes."""

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sig = np.frombuffer(b"".join(part["sig"].to_pylist()), ">u4").astype(np.uint64).reshape(part.num_rows, -1)
                for i in range(0, trees * depth, depth):
                    # The prefix by its hash, the upper half of each of the next four minhashes as it is.
                    bucket, path = np.full(len(sig), i + 1, np.uint64), np.zeros(len(sig), np.uint64)
                    for j in range(depth):
                        bucket = (bucket ^ sig[:, i + j]) * MIX
                        bucket ^= bucket >> np.uint64(29)
                    for j in range(4):
                        path = path << np.uint64(16) | sig[:, (i + depth + j) % (trees * depth)] >> np.uint64(16)
                    yield pa.RecordBatch.from_arrays([pa.array((bucket * MIX2).view(np.int64)), pa.array(path.view(np.int64)), part["node"]], ["bucket", "path", "node"])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, part = None, None, TaskContext.get().partitionId()
        edge = lambda bucket, a, b, end: pd.DataFrame({"bucket": bucket, "a": a, "b": b, "part": end})
        for x in batches:
            if not len(x):
                continue
            bucket, node = x["bucket"].to_numpy(), x["node"].to_numpy()
            if at is None:
                yield edge([bucket[0]], [node[0]], [None], [2 * part])
            else:
                bucket, node = np.concatenate([[at], bucket]), np.concatenate([np.array([last], object), node])
            at, last = bucket[-1], node[-1]
            k = np.flatnonzero(bucket[1:] == bucket[:-1])
            yield edge(bucket[k], node[k], node[k + 1], -1)
        if at is not None:
            yield edge([at], [last], [None], [2 * part + 1])

    rows = nodes.select("node", "sig").mapInArrow(orders, "bucket long, path long, node binary")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "bucket", "path", "node").sortWithinPartitions("bucket", "path", "node")
    found = cut(rows.mapInPandas(pairs, "bucket long, a binary, b binary, part int"))

    # Two rows a partition: the last of one and the first of the next that has rows.
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = found.where("part >= 0").select("bucket", "a", *(F.lag(c).over(order).alias(f"{c}_before") for c in ("bucket", "a"))).where("bucket = bucket_before")
    return found.where("part < 0").select("a", "b").unionByName(ends.select("a", F.col("a_before").alias("b")))


def set_linker(percent: int):
    """Links of packed shingle sets: all pairs by one product of 0/1 matrices, or pair by pair where that is too wide."""

    def link(bodies: list[bytes], side: list[int], found: Union) -> None:
        sets = [np.frombuffer(b, np.uint64) for b in bodies]
        n, mixed, size, side = len(sets), any(side), np.array([len(s) for s in sets]), np.array(side)
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        if n * len(values) <= 30_000_000:
            x = np.zeros((n, len(values)), np.float32)
            x[np.repeat(np.arange(n), size), place] = 1
            both = (x @ x.T).astype(np.int64)
            good = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
            if mixed:
                good &= side[:, None] != side[None, :]
            for i, j in np.argwhere(good):
                found.join(int(i), int(j))
            return
        for i in range(n):
            for j in range(i):
                if not (mixed and side[i] == side[j]) and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]) and found.apart(i, j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        found.join(i, j)

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT, region: int = REGION, also: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (least id reachable by links), ``kept`` (it is that id) and the columns ``also``."""
    docs = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), *(F.col(c).alias(f"_also{i}") for i, c in enumerate(also))).withColumn("_h", F.xxhash64("_t"))
    with small_batches(docs.sparkSession):
        rows = cut(signed(docs, k))
    # A node's text is that of one row, named by its id and the hash of its text, as many rows may share an id.
    nodes = cut(rows.where("node is not null and _id is not null").groupBy("node").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.first("sig").alias("sig")).select("node", "rep._id", "rep._h", "sig"))
    regions = cut(regions_of(forest(nodes, *SHALLOW), region))

    # Full sets of the nodes of all regions. A map over batches stays above the join, so only those texts are shingled again.
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for x in batches:
            sets = [shingles(t, k, memo) for t in x["_t"]]
            y = pd.DataFrame({"node": [digest(g) for g in sets], "set": [g.tobytes() for g in sets]})
            yield y[(x["_want"] == y["node"]).to_numpy()]

    @F.pandas_udf("binary")
    def deep_sig(sets: pd.Series) -> pd.Series:
        a = draws(*DEEP)
        return pd.Series([minhashes(np.frombuffer(x, np.uint64), a).tobytes() for x in sets])

    wanted = regions.join(nodes.drop("sig"), "node").select("_id", "_h", F.col("node").alias("_want"))
    texts = docs.join(wanted, ["_id", "_h"]).select("_want", "_t").mapInPandas(whole, "node binary, set binary").dropDuplicates(["node"])
    with small_batches(docs.sparkSession):
        members = cut(regions.join(texts.withColumnRenamed("set", "body"), "node"))
    hot = members.where(F.col("size") > region)
    if hot.limit(1).count():
        parted = cut(regions_of(forest(hot.select("node", deep_sig("body").alias("sig")), *DEEP), region))
        members = members.where(F.col("size") <= region).unionByName(parted.join(hot.select("node", "body"), "node"))
    links = region_links(members, set_linker(percent), region)
    comp = connected_components(links)
    named = nodes.select("node", F.col("_id").alias("rep")).join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = named.join(spread(least), "root").select("node", "least")
    out = rows.drop("sig").join(named, "node", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("least", "_id")).alias("component_id"), *(F.col(f"_also{i}").alias(c) for i, c in enumerate(also)))
    return out.select(id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"), *also)


def duckdb_sql(percent: int = PERCENT) -> str:
    """Brute force for two-word shingles: all pairs that share a shingle, and the closure of their links."""
    capitals = "".join(map(chr, range(65, 91)))
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= {percent} * (a.n + b.n - c)),
u as (select x, y from l union all select y, x from l),
r(a, b) as (select doc_id, doc_id from n union select r.a, u.y from r join u on r.b = u.x),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id, d.doc_id = coalesce(m.component_id, d.doc_id) as kept
from d left join n using (doc_id) left join m using (doc_id)"""
