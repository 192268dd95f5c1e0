"""Suffix-array dedup: removes bytes of strings of ``length`` bytes that start anywhere else too.

Texts are their UTF-8 bytes (null: empty), matches never cross documents, and all strings are
judged on the input. The suffixes are sampled without loss:

1. Every string of ``length`` bytes owns one suffix, its anchor: the place, among those where
   its grams of ``GRAM`` bytes begin, whose gram hash is least. Equal strings have their anchor
   at the same offset, so only anchors (about 1 in 137 places) need sorting.
2. Anchors whose gram hash occurs at one place only are dropped. The strip of an anchor is its
   suffix (``length`` bytes) and what stands before it (``length - GRAM`` bytes). Strips that occur
   twice are covered whole; digests alone show that.
3. Where a gram has other strips as well, the distinct ones are range-partitioned by the leading bytes of their suffix, with splitters
   that Spark samples. As splitters are whole grams, and matching suffixes agree in a whole
   gram, no match stands on both sides of a boundary. Each bucket sorts its suffixes, and its
   reversed left contexts, by multikey quicksort. With both LCP arrays the strips that agree on
   o bytes before and ``length - o`` bytes after the anchor are those of one class in both.
4. A gram with more than ``HOT`` distinct strips is not given to one task: its offsets are cut into
   bands of ``BAND``. Strips that match in a band share longer leading bytes (at least ``length - BAND + 1``, from the band's first
   place on), and only those that do are sorted, in the buckets of these bytes. Leading bytes of a
   band that more than ``HOT`` strips share leave the sort: their strings meet in a partially aggregated grouping.

Texts that occur more than once are removed whole (from ``length`` bytes on). Rows without an
id, repeated ids and repeated rows are each their own document. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread, text_of

LENGTH, GRAM, HOT, BAND = 400, 128, 65_536, 21
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64; kept for the longest text so far."""
    if base not in POWERS or len(POWERS[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        POWERS[base] = np.cumprod(p)
    return POWERS[base][:n]


def anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all strings of ``length`` bytes of a text."""
    n, width = len(b), length - gram + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = (total[gram:] - total[:-gram]) * powers(INVERSE, n)[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.unique(at[np.flatnonzero(np.diff(at, prepend=-1))])
    return at, h[at].view(np.int64)


def multikey(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words, by multikey quicksort: three-way splits, deeper only in the middle."""
    out, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            out.append(rows)
        elif len(rows) < 64:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            w = words[rows, depth]
            pivot = np.partition(w, len(w) // 2)[len(w) // 2]
            todo += [(rows[w > pivot], depth), (rows[w == pivot], depth + 1), (rows[w < pivot], depth)]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def sorted_lcp(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of at most ``size`` bytes and, for each but the first in order, its LCP with the one before."""
    size8 = -(-size // 8) * 8
    flat = np.frombuffer(b"".join(s.ljust(size8, b"\0") for s in strings), np.uint8).reshape(-1, size8)
    order = multikey(flat.view(">u8").astype(np.uint64))
    rows, n = flat[order], np.array([len(s) for s in strings])[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), size8)
    return order, np.minimum(lcp, np.minimum(n[1:], n[:-1]))


def covered(left: list[bytes], right: list[bytes], length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each strip the greatest and the least o of low to high at which another strip has the same string (-1: none)."""
    n = len(left)
    order_r, lcp_r = sorted_lcp(right, length - low)
    order_l, lcp_l = sorted_lcp([x[::-1] for x in left], high)
    most, least = np.full(n, -1), np.full(n, -1)
    in_r, in_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(low, high + 1):
        in_r[order_r] = np.concatenate([[0], np.cumsum(lcp_r < length - o)])
        in_l[order_l] = np.concatenate([[0], np.cumsum(lcp_l < o)])
        key = in_r * n + in_l
        by = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[by][1:] == key[by][:-1]])
        hit = by[same | np.append(same[1:], False)]
        most[hit] = o
        least[hit[least[hit] < 0]] = o
    return most, least


def strip_of(raw: bytes, at: int, width: int, length: int) -> bytes:
    """Digest of an anchor's strip: what stands before it and its suffix."""
    start = max(0, at - width)
    return blake2b(raw[start : at + length], digest_size=16, salt=(at - start).to_bytes(8, "big")).digest()


def spans_of(intervals: list, n: int) -> list[list[int]]:
    """Disjoint covered runs, in order, of a list of (start, end), within a text of n bytes."""
    out: list[list[int]] = []
    for s, e in sorted((s, min(e, n)) for s, e in intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def leading(length: int) -> Column:
    """The bytes that all strips share which match in one band: ``low`` before the anchor and ``length - high`` from it on."""
    return F.concat(F.substring("pre", F.length("pre") - F.col("low") + 1, F.col("low")), F.substring("suffix", F.lit(1), F.lit(length) - F.col("high")))


def shared_bands(strips: DataFrame, length: int, width: int, band: int = BAND) -> DataFrame:
    """``strips`` (strip, pre, suffix) once for each band of offsets whose leading bytes another strip has too, with their
    number ``n``; ``pre`` and ``suffix`` as far as the band reaches.
    """
    digest = F.xxhash64("strip")
    # All uses read one exchange (hence the filter, which joins would add for some), so bytes are fetched once; up to the last join only digests move. Bands whose digests meet by chance are sorted for nothing.
    strips = strips.where("strip is not null").repartition(int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions")), "strip")
    bands = F.filter(
        F.array(*[F.struct(F.lit(x).alias("low"), F.lit(min(x + band - 1, width)).alias("high")) for x in range(0, width + 1, band)]),
        lambda x: (x["low"] <= F.length("pre")) & (x["high"] >= F.lit(length) - F.length("suffix")),
    )
    keys = strips.select("strip", "pre", "suffix", F.inline(bands))
    keys = keys.select("strip", "low", "high", F.xxhash64("low", leading(length)).alias("key"))
    again = keys.groupBy("key").agg(F.min(digest).alias("x"), F.max(digest).alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")
    live = keys.join(spread(again), "key").groupBy("strip").agg(F.collect_list(F.struct("low", "high", "n")).alias("bands"))
    live = strips.join(live, "strip").select("strip", "pre", "suffix", F.inline("bands"))
    return live.select("strip", F.substring("pre", F.greatest(F.lit(1), F.length("pre") - F.col("high") + 1), F.col("high")).alias("pre"), F.substring("suffix", F.lit(1), F.lit(length) - F.col("low")).alias("suffix"), "low", "high", "n")


def crowded_reach(bands: DataFrame, length: int) -> DataFrame:
    """The same as ``covered`` for bands of any number of strips: their strings meet in a partially aggregated grouping."""
    size = F.length("pre")
    offsets = F.sequence(F.greatest("low", F.lit(length) - F.length("suffix")), F.least("high", size))
    strings = bands.select("strip", size.alias("before"), F.concat("pre", "suffix").alias("s"), F.explode(offsets).alias("o"))
    # The anchor's gram stands in the string, the offset belongs to the key: overlapping strips of one place hold the same string at other offsets.
    strings = strings.select("strip", "o", F.unhex(F.sha2(F.concat(F.encode(F.col("o").cast("string"), "UTF-8"), F.lit(b":"), F.substring(F.col("s"), F.col("before") - F.col("o") + 1, F.lit(length))), 256)).alias("string"))
    again = strings.groupBy("string").agg(F.min(F.xxhash64("strip")).alias("x"), F.max(F.xxhash64("strip")).alias("y")).where("x < y").select("string")
    return strings.join(spread(again), "string").groupBy("strip").agg(F.max("o").cast("long").alias("before"), (length - F.min("o")).cast("long").alias("after"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot_strips: int = HOT, with_text: bool = False) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``touched`` (a byte was removed); a row for each row."""
    width = length - gram
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_k"), text_of(text_col).alias("_t"))
    # Texts are dealt by their digest, so rows without an id or with one id are no group.
    texts = docs.select(F.unhex(F.substring(F.sha2("_t", 256), 1, 32)).alias("text"), "_k", "_t")
    # A text goes by the first half of its SHA-256.
    rows = docs.select("_id", "_k", F.octet_length("_t").cast("long").alias("n"), F.sha2("_t", 256).alias("sha")).withColumn("text", F.unhex(F.substring("sha", 1, 32)))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            grams, places, texts, strips = [], [], [], []
            for t in x["_t"]:
                raw = t.encode("utf-8", "surrogatepass")
                at, h = anchors(np.frombuffer(raw, np.uint8), length, gram)
                if len(at):
                    grams.append(h)
                    places.append(at)
                    texts += [sha256(raw).digest()[:16]] * len(at)
                    strips += [strip_of(raw, i, width, length) for i in at.tolist()]
            if grams:
                yield pd.DataFrame({"gram": np.concatenate(grams), "at": np.concatenate(places), "text": texts, "strip": strips})

    places = docs.select("_t").mapInPandas(found, "gram long, at long, text binary, strip binary")
    place = F.xxhash64("text", "at")
    hot = places.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("gram")
    hot = cut(places.join(spread(hot), "gram").dropDuplicates(["text", "at"]))
    copies = rows.groupBy("text").agg(F.min("_k").alias("_k"), F.count("*").alias("copies"))

    # Strips at several places are covered whole; single ones of a gram with other strips need their bytes.
    known = cut(hot.groupBy("strip").agg(F.min(F.struct("text", "at")).alias("rep"), F.count("*").alias("n"), F.first("gram").alias("gram")))
    mixed = known.groupBy("gram").agg(F.count("*").alias("strips"), F.min("n").alias("least")).where("strips > 1 and least = 1").select("gram", "strips")
    asked = known.join(spread(mixed), "gram").select(F.col("rep.text").alias("text"), F.struct(F.col("rep.at").alias("at"), (F.col("strips") > hot_strips).alias("crowded")).alias("x"))
    asked = asked.groupBy("text").agg(F.collect_list("x").alias("xs")).join(copies, "text").select("text", "_k", "xs")

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for x in batches:
            out = []
            for t, text, xs in zip(x["_t"], x["text"], x["xs"], strict=True):
                if text == last:  # a repeated row
                    continue
                last, raw = text, t.encode("utf-8", "surrogatepass")
                for i, crowded in ((r["at"], r["crowded"]) for r in xs):
                    out.append((strip_of(raw, i, width, length), raw[max(0, i - width) : i], raw[i : i + length], crowded))
            yield pd.DataFrame(out, columns=["strip", "pre", "suffix", "crowded"])

    # Rows that are equal in id and text stand together and count once.
    unique = texts.join(asked, ["text", "_k"]).select("_t", "text", "xs").mapInPandas(fetched, "strip binary, pre binary, suffix binary, crowded boolean")

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for (low, high), x in pd.concat(held).groupby(["low", "high"], sort=False):
                most, least = covered(x["pre"].tolist(), x["suffix"].tolist(), length, low, high)
                keep = most >= 0
                yield pd.DataFrame({"strip": x["strip"].to_numpy()[keep], "before": most[keep], "after": length - least[keep]})

        held, size, last = [], 0, None
        for x in batches:
            while len(x):
                # A slice ends where leading bytes end; at most hot_strips rows of one band share them.
                g = [pre[len(pre) - low :] + suffix[: length - high] for pre, suffix, low, high in zip(x["pre"], x["suffix"], x["low"], x["high"], strict=True)]
                if size >= 2048:
                    same = next((i for i, k in enumerate(g) if k != last), len(g))
                    held.append(x.iloc[:same])
                    size += same
                    if same == len(g):
                        break
                    yield from solve(held)
                    held, size, x = [], 0, x.iloc[same:]
                    continue
                take = min(len(x), 2048)
                held.append(x.iloc[:take])
                size, last, x = size + take, g[take - 1], x.iloc[take:]
        if held:
            yield from solve(held)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorts = unique.where("not crowded").select("strip", "pre", "suffix", F.lit(0).alias("low"), F.lit(width).alias("high"))
    crowded = None
    if mixed.where(F.col("strips") > hot_strips).limit(1).count():
        bands = shared_bands(unique.where("crowded").drop("crowded"), length, width)
        sorts = sorts.unionByName(bands.where(F.col("n") <= hot_strips).drop("n"))
        crowded = crowded_reach(bands.where(F.col("n") > hot_strips), length)
    dealt = sorts.repartitionByRange(parts, leading(length), "low").sortWithinPartitions(leading(length), "low")
    result = dealt.mapInPandas(bucket, "strip binary, before long, after long")
    if crowded is not None:
        result = result.unionByName(crowded)

    whole = known.where("n > 1").select("strip", F.lit(width).cast("long").alias("before"), F.lit(length).cast("long").alias("after"))
    # A strip that is covered whole may match others too, and one of a crowded gram in several bands; its farthest reach is the union.
    reach = cut(whole.unionByName(result).groupBy("strip").agg(F.max("before").alias("before"), F.max("after").alias("after")))
    alone = copies.where("copies = 1").select("text")
    intervals = hot.select("strip", "text", "at").join(alone, "text").join(reach, "strip").groupBy("text").agg(F.collect_set(F.struct(F.greatest(F.lit(0), F.col("at") - F.col("before")).alias("s"), (F.col("at") + F.col("after")).alias("e"))).alias("spans"))
    single = copies.where("copies = 1").join(intervals, "text").select("text", "_k", "spans")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = []
            for t, text, spans in zip(x["_t"], x["text"], x["spans"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                runs = spans_of([(s["s"], s["e"]) for s in spans], len(raw))
                at, left = 0, []
                for s, e in runs:
                    left.append(raw[at:s])
                    at = e
                rest = b"".join([*left, raw[at:]])
                got.append((text, sum(e - s for s, e in runs), len(runs), sha256(rest).hexdigest(), rest if with_text else b""))
            yield pd.DataFrame(got, columns=["text", "n_removed", "n_spans", "kept_sha256", "kept"])

    partly = texts.join(single, ["text", "_k"]).mapInPandas(kept, "text binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = rows.join(copies.where("copies > 1").select("text", "copies"), "text", "left").join(partly, "text", "left")
    gone = F.col("copies").isNotNull() & (F.col("n") >= length)
    columns = [
        F.col("_id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        (gone | F.coalesce(F.col("n_removed") > 0, F.lit(False))).alias("touched"),
    ]
    return out.select(*columns, F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept_bytes")) if with_text else out.select(*columns)


def duckdb_sql(length: int = LENGTH) -> str:
    """Brute force: every string of ``length`` bytes by its digest, runs of repeated ones, and what is left between them."""
    return f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
b as (select r, n, x * 500 as base, substr(h, x * 1000 + 1, {1000 + 2 * length}) as part from d, unnest(range(0, n // 500 + 1)) as v(x) where n >= {length}),
w as (select r, base, part, unnest(range(0, least(500, n - {length} + 1 - base))) as j from b),
k as (select r, base + j as p, md5(substr(part, 2 * j + 1, {2 * length})) as s from w),
c as (select s from k group by s having count(*) > 1),
e as (select r, p, case when p - lag(p) over (partition by r order by p) <= {length} then 0 else 1 end as first from k semi join c using (s)),
g as (select r, p, sum(first) over (partition by r order by p) as run from e),
i as (select r, min(p) as a, max(p) + {length} as b from g group by r, run),
o as (select i.r, a, b, coalesce(lag(b) over (partition by i.r order by a), 0) as before from i),
q as (select r, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' order by a) as head from o join d using (r) group by r)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(unhex(case when q.r is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256, coalesce(removed, 0) > 0 as touched
from d left join q using (r)"""
