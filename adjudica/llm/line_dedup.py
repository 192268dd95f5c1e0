"""Line dedup: a segment-partition edit join over distinct lines.

Lines are trimmed of spaces. Two lines of ``min_chars`` code points or more are linked when their
edit distance is at most ``edits``; shorter ones, down to ``exact_chars``, only when they are
equal (a few edits would turn one short line into an unlike one), and what is shorter still
stays as it is. Blank lines always stay. Of each class of linked lines the first occurrence
(least id, then line number; ids that are null last) stays, all others go.

1. A line is cut into ``edits + 1`` segments; a line within ``edits`` holds one of them
   unchanged. Each line indexes its segments by its length, and probes, for each length that
   is not above its own, only the substrings that a multi-match-aware window allows. The hashes
   of all substrings of a batch of lines come from one running sum.
2. Lines that share a key are a group; groups of equal members are one. The members of a group
   of up to ``GROUP`` lines are compared, and only links that span what is linked leave it. The
   lines of a larger group meet again under keys with a second piece of the line, of which
   linked lines share two. What is larger even there gives a star of candidates, linear in its
   size; regions of such candidates are compared in full, and hot regions are dealt over many
   tasks, so no pair is lost.
3. Pairs are verified by a banded bit-parallel edit distance on the whole lines.

A text that is null has no lines. Rows with equal id and text are one document: each of its
rows gets the same result. Rows without an id are documents like any other, after all that have
one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, BinaryType, StructField, StructType

from .common import SPACES, cut, spread
from .graph import connected_components
from .regions import Union, group_links, region_links, regions_of

EDITS, MIN_CHARS, GROUP, REGION = 2, 25, 512, 512
#: Code points hashed at once, and lines that a task remembers as emitted.
SLICE, SEEN = 1 << 19, 300_000
BASE, INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64, kept for the longest slice so far."""
    if len(POWERS.get(int(base), ())) < n:
        p = np.full(max(n, SLICE), base, np.uint64)
        p[0] = 1
        POWERS[int(base)] = np.cumprod(p)
    return POWERS[int(base)][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Substrings:
    """Hashes of substrings of several lines, from the running sum over their joined code points."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(x) for x in lines], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * powers(BASE, len(points)), out=self.total[1:])

    def hashes(self, line: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
        a = self.start[line] + at
        h = (self.total[a + size] - self.total[a]) * powers(INVERSE, len(self.total))[a]
        return mixed(mixed(h) + seed.astype(np.uint64) * BASE).view(np.int64)


def segment(length: np.ndarray, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th of n nearly equal segments, the longer ones last."""
    base, short = length // n, n - length % n
    return i * base + np.maximum(0, i - short), base + (i >= short)


def keys_of(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, the line of each, whether it indexes the key (or only probes it), and the indexed length and segment as one number."""
    text, n, every = Substrings(lines), edits + 1, np.arange(len(lines))
    out = []
    for gap in range(edits + 1):
        some = every[text.size - gap >= n]
        length = text.size[some] - gap
        for i in range(n):
            p, k = segment(length, i, n)
            low = np.maximum(np.maximum(p - i, p + gap - (edits - i)), 0)
            high = np.minimum(np.minimum(p + i, p + gap + (edits - i)), length + gap - k)
            for move in range(-i, i + 1):
                q = p + move
                fits = (q >= low) & (q <= high)
                which = (length * 64 + i)[fits]
                out.append((text.hashes(some[fits], q[fits], k[fits], which), some[fits], np.full(len(which), gap == 0 and move == 0), which))
    key, line, own, which = map(np.concatenate, zip(*out, strict=True))
    return key, line, own, which


def keys_again(lines: list[str], crowded: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys below one crowded key of each line: one piece of the rest of the indexed line as well, wherever it may have moved.

    The indexed line has ``edits + 2`` pieces besides its segment, two of which are unchanged in a linked line.
    """
    key, line, own, which = keys_of(lines, edits)
    held = key == crowded[line]
    table = np.unique(np.stack([line[held], which[held], own[held].astype(np.int64)]), axis=1)
    line, which, own = table[0], table[1], table[2] > 0
    text, n, out = Substrings(lines), edits + 2, []
    for i in range(edits + 1):
        rows = np.flatnonzero(which % 64 == i)
        length = which[rows] // 64
        p, k = segment(length, i, edits + 1)
        left, right = p, length - p - k
        m = np.where(left == 0, 0, np.where(right == 0, n, np.clip(np.round(n * left / np.maximum(left + right, 1)).astype(np.int64), 1, n - 1)))
        for before in np.unique(m):
            part = np.flatnonzero(m == before)
            for j in range(n):
                if j < before:
                    at, size = segment(left[part], j, int(before))
                else:
                    at, size = segment(right[part], j - int(before), n - int(before))
                    at = at + p[part] + k[part]
                r = rows[part]
                for move in range(-edits, edits + 1):
                    q = at + move
                    fits = (q >= 0) & (q + size <= text.size[line[r]])
                    f = r[fits]
                    seed = crowded[line[f]].view(np.uint64) + np.uint64(j)
                    out.append((text.hashes(line[f], q[fits], size[fits], seed), line[f], own[f] & (move == 0)))
    key, line, own = map(np.concatenate, zip(*out, strict=True))
    return key, line, own


def within(a: str, b: str, k: int) -> bool:
    """Edit distance at most k: row masks of reachable places, one bit each, kept to a band of 2k + 1."""
    if abs(len(a) - len(b)) > k:
        return False
    p = len(commonprefix((a, b)))
    a, b = a[p:], b[p:]
    s = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - s], b[: len(b) - s]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= k
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 2 << i
    band = (1 << (2 * k + 1)) - 1
    reach = [(1 << (d + 1)) - 1 for d in range(k + 1)]  # bit j: a prefix of b of length j, with d edits
    for i, c in enumerate(a, 1):
        inside = band << (i - k) if i >= k else band >> (k - i)
        match, before = places.get(c, 0), 0
        new = []
        for d in range(k + 1):
            r = (reach[d] << 1) & match
            if d:
                r |= before | (before << 1) | (new[d - 1] << 1)
            new.append(r & inside)
            before = reach[d]
        reach = new
        if not reach[k]:
            return False
    return bool(reach[k] >> len(b) & 1)


def line_linker(edits: int):
    """Links of the lines of a group. An edit changes character counts by two at most, which rules
    nearly all unlike lines out in one array operation before the edit distance is asked."""

    def link(bodies: list[bytes], side: list[int], found: Union) -> None:
        lines, mixed = [b.decode("utf-8", "surrogatepass") for b in bodies], any(side)
        if len(lines) == 2:
            if within(lines[0], lines[1], edits) and (not mixed or side[0] != side[1]):
                found.join(0, 1)
            return
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        size = np.array([len(lines[i]) for i in order])
        counts = np.array([np.bincount(np.frombuffer(lines[i].encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64) for i in order], np.int32)
        sides = np.array([side[i] for i in order])
        for x, i in enumerate(order):
            end = int(np.searchsorted(size, size[x] + edits, "right"))
            near = np.abs(counts[x + 1 : end] - counts[x]).sum(1) <= 2 * edits
            if mixed:
                near &= sides[x + 1 : end] != sides[x]
            for y in np.flatnonzero(near) + x + 1:
                j = order[int(y)]
                if found.apart(i, j) and within(lines[i], lines[j], edits):
                    found.join(i, j)

    return link


def stripped(texts: pa.Array, least: int) -> Iterator[tuple[int, int, str]]:
    """(row, line number, trimmed line) of the lines of ``least`` code points or more."""
    for i, t in enumerate(texts.to_pylist()):
        if t:
            for no, x in enumerate(t.split("\n")):
                x = x.strip(SPACES)
                if len(x) >= least:
                    yield i, no, x


def digest(line: str) -> bytes:
    return md5(line.encode("utf-8", "surrogatepass")).digest()


def number_of(digests: list[bytes]) -> np.ndarray:
    """The upper 63 bits of digests; the lowest bit is free."""
    return np.frombuffer(b"".join(digests), ">i8")[::2].astype(np.int64) & np.int64(-2)


def unseen(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Slices of lines that this task has not lately met, with their digests."""
    done: set[bytes] = set()
    lines, digests, size = [], [], 0
    for x in batches:
        for _, _, line in stripped(x.column("_t"), least):
            d = digest(line)
            if d in done:
                continue
            if len(done) > SEEN:
                done.clear()
            done.add(d)
            lines.append(line)
            digests.append(d)
            size += len(line)
            if size >= SLICE:
                yield lines, digests
                lines, digests, size = [], [], 0
    if lines:
        yield lines, digests


def meet(rows: DataFrame, group: int, deep: bool) -> DataFrame:
    """Groups of ``rows`` (``key``; ``node``: a number, its lowest bit set where the line indexes the key).

    ``kind`` 0: ``node`` is of group ``g``, which has an owner and 2 to ``group`` members; groups of
    equal members have one ``g``. Of a larger one, ``kind`` 2: its members, ``g`` being the
    key, or if ``deep``, 1: edges ``g``-``node`` from one of them. Rows arrive by key; more than
    a batch and the members of one such group are never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = np.empty(0, np.int64), np.empty(0, np.int64)
        crowded = pivot = None  # the open key, if it has too many members

        def closed(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(k)))
            good = size > 1
            if len(k):
                good &= np.bitwise_or.reduceat(n & 1, first) > 0
            g = np.add.reduceat(mixed(n.view(np.uint64) >> np.uint64(1)), first) if len(k) else np.empty(0, np.uint64)
            keep = np.repeat(good, size)
            return np.repeat(mixed(g + size.astype(np.uint64)).view(np.int64), size)[keep], n[keep] & -2, np.zeros(int(keep.sum()), np.int32)

        def distinct(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows by key and node, once each; an owner's row stands for its others."""
            by = np.lexsort((-(n & 1), n >> 1, k))
            k, n = k[by], n[by]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] >> 1 != n[:-1] >> 1)])
            return k[new], n[new]

        def batch(*parts: tuple) -> pa.RecordBatch:
            g, n, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(kind)], ["g", "node", "kind"])

        def many(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal pivot
            if not deep:
                return np.full(len(n), crowded), n, np.full(len(n), 2, np.int32)
            pivot = n[0] & -2 if pivot is None else pivot
            return np.full(len(n), pivot), n & -2, np.full(len(n), 1, np.int32)

        for x in batches:
            if not x.num_rows:
                continue
            k, n = x.column("key").to_numpy(), x.column("node").to_numpy()
            parts = []
            if crowded is not None:
                end = int(np.searchsorted(k, crowded, "right"))
                if end:
                    parts.append(many(distinct(k[:end], n[:end])[1]))
                if end == len(k):
                    yield batch(*parts)
                    continue
                crowded = pivot = None
                k, n = k[end:], n[end:]
            k, n = np.concatenate([key, k]), np.concatenate([node, n])
            # Most keys stand alone: they are passed over before anything is sorted.
            alone = np.ones(len(k), bool)
            alone[1:] &= k[1:] != k[:-1]
            alone[:-1] &= k[1:] != k[:-1]
            alone[-1] = False
            k, n = distinct(k[~alone], n[~alone])
            open_at = int(np.searchsorted(k, k[-1]))
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            for at in first[(size > group) & (first < open_at)]:  # a whole key within the batch
                crowded, pivot, end = k[at], None, int(np.searchsorted(k, k[at], "right"))
                parts.append(many(n[at:end]))
            small = np.repeat(size <= group, size)
            small[open_at:] = False
            parts.append(closed(k[small], n[small]))
            crowded = pivot = None
            key, node = k[open_at:], n[open_at:]
            if len(key) > group:
                crowded = key[0]
                parts.append(many(node))
                key, node = key[:0], node[:0]
            yield batch(*parts)
        if len(key):
            yield batch(closed(key, node))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "g long, node long, kind int").distinct()


def near_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP, region: int = REGION) -> DataFrame:
    """Links ``a``-``b`` (digests) that span the classes of the lines of texts ``_t``."""

    def keyed(key: np.ndarray, node: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node | own)], ["key", "node"])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, digests in unseen(batches, min_chars):
            key, line, own, _ = keys_of(lines, edits)
            yield keyed(key, number_of(digests)[line], own)

    def emitted_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lines = [b.decode("utf-8", "surrogatepass") for b in x.column("body").to_pylist()]
            crowded, node = x.column("g").to_numpy(), x.column("number").to_numpy()
            for i in range(0, len(lines), 1000):
                key, line, own = keys_again(lines[i : i + 1000], crowded[i : i + 1000], edits)
                yield keyed(key, node[i : i + 1000][line], own)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, digests in unseen(batches, min_chars):
            yield pa.RecordBatch.from_arrays([pa.array(number_of(digests)), pa.array(digests, pa.binary()), pa.array([x.encode("utf-8", "surrogatepass") for x in lines], pa.binary())], ["number", "node", "body"])

    texts, schema = docs.select("_t"), "key long, node long"
    met = cut(meet(texts.mapInArrow(emitted, schema), group, False))
    # An owner's lowest bit is set in the rows of crowded keys only. A number that two lines share only makes more candidates.
    owned = met.where("kind = 2 and node & 1 = 1").select("g").distinct()
    members = met.where("kind = 0").unionByName(met.where("kind = 2").join(owned, "g", "left_semi")).select("g", F.expr("node & -2").alias("number"), "kind").distinct()
    asked = members.select("number").distinct()
    named = cut(texts.mapInArrow(bodies, "number long, node binary, body binary").join(asked, "number", "left_semi").distinct())
    again = meet(members.where("kind = 2").join(named, "number").select("g", "number", "body").mapInArrow(emitted_again, schema), group, True)
    again = cut(again.withColumnRenamed("node", "number"))
    small = members.where("kind = 0").unionByName(again.where("kind = 0")).select("g", "number")
    direct = group_links(small.join(named, "number").select(F.col("g").cast("string").alias("g"), F.lit(0).alias("side"), "node", "body"), line_linker(edits))
    stars = again.where("kind = 1")
    if not stars.limit(1).count():
        return direct
    name = lambda c, x: named.select(F.col("number").alias(c), F.col("node").alias(x))
    edges = stars.select("g", "number").join(name("g", "a"), "g").join(name("number", "b"), "number").select("a", "b")
    chained = regions_of(edges, region).join(named.select("node", "body"), "node")
    return direct.unionByName(region_links(chained, line_linker(edits), region))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, also: tuple[str, ...] = (), exact_chars: int | None = None) -> DataFrame:
    """``id_col``, ``n_lines`` (non-blank), ``n_removed``, ``removed`` (line numbers), ``text`` (the rest) and the columns ``also``.

    ``exact_chars`` is ``min_chars`` unless given; with 1, equal lines of every length are found.
    ``min_chars`` is above ``edits``, or there is no segment to look for.
    """
    if min_chars <= edits:
        raise ValueError("min_chars must be above edits")
    exact_chars = min_chars if exact_chars is None else max(1, min(exact_chars, min_chars))
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), *(F.col(c).alias(f"_also{i}") for i, c in enumerate(also)))
    docs = docs.withColumn("_d", F.xxhash64("_id", F.coalesce("_t", F.lit(""))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 500):
                part = x.slice(i, 500)
                found = list(stripped(part.column("_t"), exact_chars))
                row = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([digest(line) for _, _, line in found], pa.binary()), part.column("_id").take(row), part.column("_d").take(row), pa.array([no for _, no, _ in found], pa.int32())], ["node", "i", "d", "no"])

    schema = StructType([StructField("node", BinaryType()), StructField("i", docs.schema["_id"].dataType), StructField("d", LongType()), StructField("no", IntegerType())])
    lines = cut(docs.select("_id", "_d", "_t").mapInArrow(placed, schema))
    classes = cut(connected_components(near_links(docs, edits, min_chars)))
    equal = lines.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").join(classes, "node", "left_anti").select("node", F.col("node").alias("root"))
    place = F.struct(F.col("i").isNull().alias("z"), "i", "d", "no")
    shared = cut(lines.join(classes.unionByName(equal), "node").select("root", place.alias("place")))
    least = spread(shared.groupBy("root").agg(F.min("place").alias("least")))
    gone = shared.join(least, "root").where("place <> least").groupBy(F.col("place.i").alias("_i"), F.col("place.d").alias("_d")).agg(F.sort_array(F.collect_set("place.no")).alias("removed"))

    @F.pandas_udf("struct<n:long,text:string>")
    def rest(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        n, out = [], []
        for t, r in zip(texts, removed, strict=True):
            parts = t.split("\n") if t else []
            n.append(sum(1 for x in parts if x.strip(SPACES)))
            if t is not None and r is not None:
                drop = set(r.tolist())
                t = "\n".join(x for i, x in enumerate(parts) if i not in drop)
            out.append(t)
        return pd.DataFrame({"n": n, "text": pd.Series(out, dtype=object)})

    out = docs.join(gone, (docs["_d"] == gone["_d"]) & docs["_id"].eqNullSafe(gone["_i"]), "left").withColumn("x", rest("_t", "removed"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("x.n").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.col("x.text").alias("text"),
        *(F.col(f"_also{i}").alias(c) for i, c in enumerate(also)),
    )
