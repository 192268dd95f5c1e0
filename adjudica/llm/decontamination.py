"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

Passages are windows of words with an overlap as long as the longest item, so each copy of an
item lies whole in some passage. Scores are BM25 divided by the item's score against itself;
all items at ``least`` or more are retrieved:

1. Terms are split as in MaxScore: those with the largest document frequency whose scores
   together stay under half of ``least`` for every item are weak, the rest strong. One vectorised
   pass over a text bounds the score of each (passage, item) by its strong terms.
2. Passages with a bound over the threshold go through block-max WAND: cursors sorted by
   item, a pivot by list bounds, a skip where the bounds of the current blocks are too low.
3. A retrieved item counts if enough word pairs of its question (all but the last sentence) and
   of its answer (the last one) stand in the passage.

The index is broadcast in blocks of at most ``ITEMS`` items and ``TERMS`` words in all, one
scan of the texts for each block, so its size is bounded whatever the benchmark's. Items with
under ``min_words`` words have too few for shares: a text holds one if all its words stand
in the text in a row (where letters of an unspaced script make up an item, if its characters
do), with 1 as its score and shares. Items without a word and null texts hold nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

K1, B, BLOCK, ITEMS, TERMS = 1.2, 0.75, 16, 20_000, 2_000_000
TERM = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Scripts written without spaces: Thai to Khmer, kana, Chinese characters.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the last third of a single one."""
    found = [w for w in map(terms, SENTENCE.split(text)) if w]
    if len(found) > 1:
        return [w for s in found[:-1] for w in s], found[-1]
    w = found[0] if found else []
    cut = len(w) - len(w) // 3
    return w[:cut], w[cut:]


def pairs(w: list[str]) -> set:
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)


class Phrases:
    """Short items, looked up whole: one pass over a text finds all of them."""

    def __init__(self, items: list[tuple]):
        self.found: dict[str, list] = defaultdict(list)
        for i, text in items:
            w = terms(text)
            self.found["".join(w) if UNSPACED.search(text) else f" {' '.join(w)} "].append(i)
        self.spaced, self.unspaced = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase in self.found:
            (self.spaced if phrase[0] == " " else self.unspaced).add_word(phrase, phrase)
        self.spaced.make_automaton()
        self.unspaced.make_automaton()

    def search(self, text: str) -> list[tuple]:
        if not self.found:
            return []
        w = terms(text)
        hits = {p for _, p in self.spaced.iter(f" {' '.join(w)} ")} if len(self.spaced) else set()
        hits |= {p for _, p in self.unspaced.iter("".join(w))} if len(self.unspaced) else set()
        return sorted(((i, 1.0, 1.0, 1.0) for p in hits for i in self.found[p]), key=lambda x: (x[0] is None, x[0]))


class Index:
    """Postings of one block of items: for each term items, relative scores and block maxima."""

    def __init__(self, items: list[tuple], idf: dict[str, float], mean: float, least: float, longest: int):
        self.ids, self.least = [i for i, _ in items], least
        self.parts = [tuple(map(pairs, parts(t))) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            count = Counter(terms(text))
            norm = K1 * (1 - B + B * sum(count.values()) / mean)
            own = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in count.items()}
            whole = sum(own.values())
            for w, s in own.items():
                lists[self.vocabulary.setdefault(w, len(self.vocabulary))].append((n, s / whole))
        self.items = [[n for n, _ in lists[t]] for t in range(len(self.vocabulary))]
        self.scores = [[s for _, s in lists[t]] for t in range(len(self.vocabulary))]
        self.most = [max(s) for s in self.scores]
        self.blocks = [[max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for s in self.scores]
        self.window = max(64, 2 * longest)
        # Terms that together reach half of the threshold at most: a hit needs as much from others.
        weak = np.zeros(len(items))
        self.strong = np.ones(len(self.vocabulary), bool)
        for t in sorted(range(len(self.vocabulary)), key=lambda t: -len(self.items[t])):
            if (weak[self.items[t]] + self.scores[t]).max() >= least / 2:
                break
            weak[self.items[t]] += self.scores[t]
            self.strong[t] = False
        self.weak = weak
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.items])])
        self.flat_items = np.array([i for x in self.items for i in x], np.int64)
        self.flat_scores = np.array([s for x in self.scores for s in x])

    def suspects(self, at: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Passages that may hold an item, by the bound over strong terms at places ``at`` of a text of ``n`` words."""
        hop = self.window // 2
        last = max(0, -(-(n - self.window) // hop))
        keep = self.strong[term]
        at, term = at[keep], term[keep]
        if not len(at):
            return at
        k = at // hop
        passage = np.concatenate([np.minimum(k, last), np.clip(k - 1, 0, last)])
        once = np.unique(passage * len(self.items) + np.tile(term, 2))  # each term counts once in a passage
        passage, term = once // len(self.items), once % len(self.items)
        size = self.start[term + 1] - self.start[term]
        where = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        item, score = self.flat_items[where], self.flat_scores[where]
        u, inverse = np.unique(np.repeat(passage, size) * len(self.ids) + item, return_inverse=True)
        bound = np.bincount(inverse, score) + self.weak[u % len(self.ids)]
        return np.unique(u[bound >= self.least - 1e-9] // len(self.ids))

    def wand(self, query: set[int]) -> list[tuple[int, float]]:
        """All items with a relative score of ``least`` or more for a set of terms."""
        out, cursors, floor = [], [[0, t] for t in query], self.least - 1e-9
        doc = lambda c: self.items[c[1]][c[0]]
        while True:
            cursors = [c for c in cursors if c[0] < len(self.items[c[1]])]
            cursors.sort(key=doc)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                return out
            target = doc(cursors[pivot])
            while pivot + 1 < len(cursors) and doc(cursors[pivot + 1]) == target:
                pivot += 1
            tight, limit = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(self.items[c[1]], target, c[0])
                if c[0] < len(self.items[c[1]]):
                    block = c[0] // BLOCK
                    tight += self.blocks[c[1]][block]
                    end = min((block + 1) * BLOCK, len(self.items[c[1]])) - 1
                    limit = min(limit, self.items[c[1]][end])
            if tight >= floor:
                live = [c for c in cursors[: pivot + 1] if c[0] < len(self.items[c[1]]) and doc(c) == target]
                score = sum(self.scores[c[1]][c[0]] for c in live)
                if score >= floor:
                    out.append((target, score))
                skip = target + 1
            else:
                ahead = doc(cursors[pivot + 1]) if pivot + 1 < len(cursors) else math.inf
                skip = max(target + 1, min(limit + 1, ahead))
            for c in cursors[: pivot + 1]:
                c[0] = bisect_left(self.items[c[1]], skip, c[0])

    def search(self, text: str, question: float, answer: float) -> list[tuple]:
        """(item id, score, question share, answer share) of verified items, best passage of each."""
        w = terms(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        best: dict[int, tuple] = {}
        hop = self.window // 2
        for k in self.suspects(at, ids[at], len(w)) if len(at) else ():
            low = int(k) * hop
            passage = ids[low : low + self.window]
            hits = self.wand(set(passage[passage >= 0].tolist()))
            if hits:
                mine = w[low : low + self.window]
                inside = pairs(mine) | set(mine)
                for item, score in hits:
                    q, a = ((len(p & inside) / len(p)) if p else 1.0 for p in self.parts[item])
                    if q >= question and a >= answer and (item not in best or best[item][0] < score):
                        best[item] = (score, q, a)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, dict, float, int]]:
    """Bounded blocks of items, with the statistics of the whole benchmark for their terms."""
    items = benchmark.select(F.col(item_col).alias("_item"), text_of(text_col).alias("_t"))

    @F.pandas_udf("array<string>")
    def tokens(t: pd.Series) -> pd.Series:
        return t.map(terms)

    rows = items.select("_item", "_t", tokens("_t").alias("w")).where(F.size("w") > 0)
    n, total, longest = rows.agg(F.count("*"), F.sum(F.size("w")), F.max(F.size("w"))).first()
    if not n:
        return
    blocks = max(-(-n // ITEMS), -(-total // TERMS))
    frequency = rows.select("_item", "_t", F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("_item", "_t"), F.lit(blocks)) == k)
        used = part.select(F.explode("w").alias("w")).distinct().join(frequency, "w").collect()
        idf = {r.w: math.log1p((n - r.df + 0.5) / (r.df + 0.5)) for r in used}
        got = [(r[0], r[1]) for r in part.select("_item", "_t").collect()]
        if got:
            yield sorted(got, key=lambda x: (x[0] is None, x[0], x[1])), idf, total / n, longest


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.6, question: float = 0.6, answer: float = 0.5, min_words: int = 5) -> DataFrame:
    """A row for each document and verified item: ``id_col``, ``item_col``, ``score``, ``question_share``, ``answer_share``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    id_type, item_type = texts.schema["_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {id_type}, _item {item_type}, score double, question_share double, answer_share double"
    found = []
    for items, idf, mean, longest in blocks_of(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((items, idf, mean, longest))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items, idf, mean, longest = shared.value
            short = [x for x in items if len(terms(x[1])) < min_words]
            phrases = Phrases(short)
            index = Index([x for x in items if len(terms(x[1])) >= min_words], idf, mean, least, longest)
            for x in batches:
                got = [(i, *hit) for i, t in zip(x["_id"], x["_t"], strict=True) for hit in [*index.search(t, question, answer), *phrases.search(t)]]
                yield pd.DataFrame(got, columns=["_id", "_item", "score", "question_share", "answer_share"])

        found.append(texts.mapInPandas(run, schema))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col if item_col != id_col else f"item_{item_col}"), "score", "question_share", "answer_share")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a test item. Rows are judged by their text: of rows that share an id, or have none, only those go that hold one."""
    text_col = options.get("text_col", "text")
    key = F.struct(F.col(id_col).cast("string").alias("i"), F.xxhash64(text_of(text_col)).alias("h"))
    bad = contaminated(docs.select(F.to_json(key).alias("_key"), F.col(text_col)), benchmark, "_key", **options).select(F.col("_key").alias("_bad")).distinct()
    return docs.join(bad, F.to_json(key) == bad["_bad"], "left_anti")
