"""Phrase collocations, mined by Toivonen's sampling.

A sample of the rows proposes: level by level, phrases that are frequent there at a lowered
threshold. A full pass then counts every word, and every longer phrase whose two shorter parts (without
its last, without its first word) are proposed: that is the proposal together with its negative border, as far as it occurs.
A phrase of the border that turns out frequent is a failure: it joins the proposal, and a further
full pass counts what the wider proposal adds. A pass without failures closes the search, after at most
``longest`` passes; every phrase that occurs ``least`` times has then been counted in full, whatever the sample was.

Most phrases of a border occur once or twice, so the first full pass counts 64-bit hashes, which can only
join counts, never lose one; the second pass, which widens the border too, counts the phrases behind frequent hashes by their
texts, and those counts are the result. A proposal, or a set of frequent hashes, is a Bloom filter for each level, of a size that ``bits`` fixes, so what tasks
receive does not grow with the data. A false positive counts a phrase in vain; at no size does a filter lose one. Counts
are summed in a task by blocks of text, then by Spark's partial aggregation, before the shuffle.

Edges: a null text is empty, a null language is ``und``; ids only choose the sample. Texts of any length are
counted whole. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Bits of a level's filter; bytes of text that a task counts at a time, and that it splits into words at a time.
BITS, BLOCK, PIECE = 1 << 25, 3 << 20, 1 << 20
#: One row of ``every`` is in the sample; a phrase is proposed there at this share of the count to be expected.
EVERY, EASE = 4, 0.75
#: A-Z to a-z, a tab to a space, the characters that part pieces to a line end.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n\n")
#: A token that no word can be: it parts pieces.
STOP = b"."
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of what stands before its last word, and of that word."""
    h = (first ^ (first >> TURN)) * MIX + last
    return (h ^ (h >> TURN)) * MIX


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = (h ^ (h >> TURN)) * MIX
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * MIX % np.uint64(bits)).astype(np.int64)


def held(gate: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold."""
    a, b = places(h, 8 * len(gate))
    return (gate[a >> 3] >> (a & 7).astype(np.uint8) & gate[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


@contextmanager
def sent(spark: SparkSession, *filters: list[bytes]) -> Iterator[list[list]]:
    """Lists of filters as broadcasts, which executors forget afterwards: what is counted with them must be computed by then."""
    out = [[spark.sparkContext.broadcast(x) for x in part] for part in filters]
    yield out
    for part in out:
        for x in part:
            x.unpersist()


class Block:
    """Texts of one language as numbers of words, and their phrases level by level.

    ``new`` and ``old`` are the filters of this pass and of the one before it, by level; a phrase was ``reached`` by an earlier pass
    if the older filters held all its parts.
    """

    def __init__(self, lang: str) -> None:
        self.lang, self.vocabulary, self.parts, self.texts, self.waiting, self.size = lang, {STOP: 0}, [], [], 0, 0

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.waiting, self.size = self.waiting + len(text), self.size + len(text)
        if self.waiting >= PIECE:
            self.split()

    def split(self) -> None:
        tokens = b"\n".join(self.texts).translate(TABLE).replace(b"\n", b" . ").split()
        tokens.append(STOP)
        known = self.vocabulary
        for w in dict.fromkeys(tokens):
            known.setdefault(w, len(known))
        self.parts.append(np.array(list(map(known.__getitem__, tokens)), np.int32))
        self.texts, self.waiting = [], 0

    def begin(self, new: list, old: list) -> None:
        self.split()
        self.ids, self.names = np.concatenate(self.parts).astype(np.int64), list(self.vocabulary)
        self.new, self.old, self.parts = new, old, []

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of the vocabulary, and how often it occurs."""
        count = np.bincount(self.ids, minlength=len(self.names))
        count[0] = 0
        return hashed(self.lang, self.names), count

    def levels(self, longest: int, word_hash: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Size, places of the phrases of 2 words and more whose parts are proposed, their hashes, and ``reached``; all by place."""
        now, was = held(self.new[0], word_hash)[self.ids], (held(self.old[0], word_hash) if self.old else np.zeros(len(word_hash), bool))[self.ids]
        here, h, w = self.ids > 0, word_hash[self.ids], word_hash[self.ids]
        for m in range(2, longest + 1):
            here = here[:-1] & here[1:] & now[:-1] & now[1:]
            reached = was[:-1] & was[1:]
            at = np.flatnonzero(here)
            found = joined(h[at], w[at + m - 1])
            yield m, at, found, reached[at]
            if m < longest:
                h = np.zeros(len(here), np.uint64)
                now, was = np.zeros(len(here), bool), np.zeros(len(here), bool)
                h[at], now[at] = found, held(self.new[m - 1], found)
                if self.old:
                    was[at] = reached[at] & held(self.old[m - 1], found)

    def counted(self, size: int, at: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Texts and counts of the phrases at some places, told apart by their words."""
        n, words = len(self.names), [self.ids[at + j] for j in range(size)]
        if n**size < 1 << 63:
            key = words[0]
            for x in words[1:]:
                key = key * n + x
            _, first, count = np.unique(key, return_index=True, return_counts=True)
        else:
            _, first, count = np.unique(np.column_stack(words), axis=0, return_index=True, return_counts=True)
        parts = [[self.names[i] for i in x[first].tolist()] for x in words]
        return [b" ".join(x) for x in zip(*parts, strict=True)], count.tolist()


def over_blocks(count, block: int):
    """``count(block)`` over batches of language and text, by blocks of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, Block] = {}
        size = 0
        for rows in batches:
            for lang, text in zip(rows["lang"].to_pylist(), rows["text"], strict=True):
                text = text.as_py()
                blocks.setdefault(lang, Block(lang)).add(text)
                size += len(text)
                if size >= block:
                    large = blocks.pop(max(blocks, key=lambda x: blocks[x].size))
                    size -= large.size
                    yield from count(large)
        for lang in list(blocks):
            yield from count(blocks.pop(lang))

    return run


def hash_counts(rows: DataFrame, sizes: tuple[int, int], new: list, block: int) -> DataFrame:
    """``size``, ``hash`` and ``n`` of the phrases whose parts are proposed, from ``sizes[0]`` to ``sizes[1]`` words."""

    def batch(size: int, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["size", "hash", "n"])

    def count(b: Block) -> Iterator[pa.RecordBatch]:
        b.begin([np.frombuffer(x.value, np.uint8) for x in new], [])
        h, n = b.words()
        if sizes[0] == 1:
            yield batch(1, h[n > 0], n[n > 0])
        for size, _, found, _ in b.levels(sizes[1], h):
            if size >= sizes[0] and len(found):
                yield batch(size, *np.unique(found, return_counts=True))

    return rows.mapInArrow(over_blocks(count, block), "size int, hash long, n long").groupBy("size", "hash").agg(F.sum("n").alias("n"))


def phrase_counts(rows: DataFrame, longest: int, new: list, old: list, hot: list, block: int) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``n`` of what the wider proposal adds and, with ``hot``, of the phrases whose hashes are frequent; the number of words as size 0."""

    def count(b: Block) -> Iterator[pa.RecordBatch]:
        filters = [[np.frombuffer(x.value, np.uint8) for x in part] for part in (new, old, hot)]

        def batch(size: int, names: list[bytes], n: list[int]) -> pa.RecordBatch:
            k = len(names)
            return pa.RecordBatch.from_arrays([pa.array([b.lang] * k, pa.string()), pa.array([size] * k, pa.int32()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])

        b.begin(filters[0], filters[1])
        h, n = b.words()
        if hot:
            yield batch(0, [b""], [int(n.sum())])
            some = np.flatnonzero((n > 0) & held(filters[2][0], h)).tolist()
            yield batch(1, [b.names[i] for i in some], n[some].tolist())
        for size, at, found, reached in b.levels(longest, h):
            at = at[~reached | held(filters[2][size - 1], found)] if hot else at[~reached]
            if len(at):
                yield batch(size, *b.counted(size, at))

    found = rows.mapInArrow(over_blocks(count, block), "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def bits_of(hashes: DataFrame, levels: int, bits: int) -> list[bytes]:
    """Filters of levels 1 to ``levels``: words of bits, joined by Spark, so that the driver gets no more than the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, hashes = rows["size"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
            for size in np.unique(sizes):
                place = np.concatenate(places(hashes[sizes == size], bits))
                slot, where = np.unique(place >> 6, return_inverse=True)
                mask = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(mask, where, np.uint64(1) << (place & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), size, np.int32)), pa.array(slot), pa.array(mask.view(np.int64))], ["size", "slot", "mask"])

    words = hashes.where(F.col("size").between(1, levels)).select("size", "hash").mapInArrow(run, "size int, slot long, mask long").groupBy("size", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    size, slot, mask = (words[c].to_numpy() for c in ("size", "slot", "mask"))
    out = [np.zeros(bits // 64, np.int64) for _ in range(levels)]
    for m in range(levels):
        out[m][slot[size == m + 1]] = mask[size == m + 1]
    return [x.tobytes() for x in out]


def rehashed(phrases: DataFrame) -> DataFrame:
    """``size`` and ``hash`` of counted phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, size, phrase in zip(rows["lang"].to_pylist(), rows["size"].to_pylist(), rows["phrase"].to_pylist(), strict=True):
                at.setdefault((lang, size), []).append(phrase.encode().split(b" "))
            for (lang, size), found in at.items():
                h = hashed(lang, [w[0] for w in found])
                for i in range(1, size):
                    h = joined(h, hashed(lang, [w[i] for w in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64))], ["size", "hash"])

    return phrases.where("size > 0").mapInArrow(run, "size int, hash long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, least: int = 10, longest: int = 3, every: int = EVERY, ease: float = EASE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``lang``, ``size``, ``phrase``, ``n`` of each phrase of up to ``longest`` words that occurs ``least`` times, and the number of words as size 0."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(every)).alias("turn"))
    sample, rows = rows.where("turn = 0").select("lang", "text"), rows.select("lang", "text")
    enough = max(1, math.ceil(ease * least / every))
    proposal = [b"\0" * (bits // 8)] * (longest - 1)
    for m in range(1, longest):
        with sent(spark, proposal) as (new,):
            found = hash_counts(sample, (m, m), new, block).where(F.col("n") >= enough)
            proposal[m - 1] = bits_of(found, longest, bits)[m - 1]
    old = proposal
    with sent(spark, proposal) as (new,):
        hashes = cut(hash_counts(rows, (1, longest), new, block).where(F.col("n") >= least))
    hot = bits_of(hashes, longest, bits)
    wider = lambda a, b: [(np.frombuffer(x, np.int64) | np.frombuffer(y, np.int64)).tobytes() for x, y in zip(a, b, strict=False)]
    proposal, known = wider(old, hot), None
    while True:
        with sent(spark, proposal, old, [] if known else hot) as filters:
            found = cut(phrase_counts(rows, longest, *filters, block).where((F.col("n") >= least) | (F.col("size") == 0)))
        known = known.unionByName(found) if known else found
        old, proposal = proposal, wider(proposal, bits_of(rehashed(found), longest - 1, bits))
        if proposal == old:
            return known


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, least: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, **sampling) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase that occurs ``a`` times is cut where ``floor(1000000 a a / (l r))`` is lowest (then at the first such place). Phrases
    inside a longer one that occurs at least ``inside`` percent as often are dropped.
    """
    with small_batches(docs.sparkSession):
        known = frequent_phrases(docs, text_col, lang_col, id_col, least=least, longest=longest, **sampling)
    total = known.where("size = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    part = known.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = known.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    piece = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("head"), piece(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("head"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("x")).select("lang", "phrase", "a", "k", "x.*")
    both = sides.join(part, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    whole = both.withColumn("score", F.expr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    best = whole.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    outer = candidates.where("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = best.join(outer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def duckdb_sql(least: int = 10, top: int = 2000, inside: int = 50) -> str:
    """The same for phrases of 2 to 3 words, by counting everything."""
    return f"""
with pieces as materialized (
  select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
f as materialized (
  select lang, m, phrase, count(*) as n from (
    select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces, (select unnest([1, 2, 3]) as m) where len(w) >= m)
  ) group by lang, m, phrase),
c as materialized (select lang, m, phrase, n as a, string_split(phrase, ' ') as w from f where m > 1 and n >= {least}),
cuts as (select lang, m, phrase, a, w, unnest(range(1, m)) as k from c),
scored as (
  select cuts.lang, cuts.phrase, a, k, x.n as l, y.n as r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = array_to_string(w[1 : k], ' ') join f y on y.lang = cuts.lang and y.phrase = array_to_string(w[k + 1 : cuts.m], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, phrase, max(a) as a from (select lang, array_to_string(w[1:2], ' ') as phrase, a from c where m = 3 union all select lang, array_to_string(w[2:3], ' '), a from c where m = 3) group by lang, phrase),
ranked as (
  select best.*, row_number() over (partition by best.lang order by score desc, best.a desc, best.phrase) as rank
  from best left join longer on longer.lang = best.lang and longer.phrase = best.phrase where longer.a is null or 100 * longer.a < {inside} * best.a)
select ranked.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, t.n::bigint as n, score::bigint as score
from ranked join (select lang, sum(n) as n from f where m = 1 group by lang) t on t.lang = ranked.lang where rank <= {top}
"""
