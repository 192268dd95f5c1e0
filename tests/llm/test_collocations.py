"""Mined phrases against counting everything, whatever the sample proposes."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adjudica.llm import collocations

ROWS = "doc_id long, text string, lang string, phrase string, n string, size string, score string, rank string, turn string"


def docs(spark, rows):
    """Documents with further columns whose names clash with those of results and internals."""
    return spark.createDataFrame([(i, t, lang, *["x"] * 6) for i, t, lang in rows], ROWS)


def brute(rows, least=10, top=2000, inside=50, longest=3):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = {}
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in often.items():
        inner = {p[i : i + m] for m in range(1, len(p)) for i in range(len(p) - m + 1)}
        for q in inner:
            out.setdefault((lang, q), []).append(a)
    rows_of = {}
    for (lang, p), a in often.items():
        if any(100 * b >= inside * a for b in out.get((lang, p), [])):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows_of.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows_of.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def prose(seed, n, words=40):
    r = random.Random(seed)
    names = [f"W{int(words * r.random() ** 2)}" for _ in range(n)]
    return "".join(w + r.choice([" "] * 12 + ["  ", "\t", ". ", "\n", ",", "\x0b", " ! "]) for w in names)


MIXED = (
    [(i, prose(i, 80), ["en", "en", "fr", None][i % 4]) for i in range(60)]
    + [(100 + i, "New York Times and the new york times; NEW YORK", "en") for i in range(25)]
    + [(200, None, "en"), (201, "", None), (202, " \t\n.", "fr"), (203, "Ünder ÜNDER ünder " * 40, "de"), (204, "x\x00y z\x1c q " * 30, ""), (205, "a " * 5000, "fr"), (None, "no id here " * 12, "en")]
    + [(300, "echo", "en")] * 15
)


@pytest.mark.parametrize("sampling", [{}, {"every": 1}, {"every": 50, "ease": 3.0}, {"bits": 256}, {"every": 7, "bits": 64 * 5, "block": 300}, {"every": 3, "ease": 9.0}])
def test_collocations(spark, sampling):
    got = collocations.collocations(docs(spark, MIXED), **sampling).collect()
    assert sorted(map(tuple, got)) == brute(MIXED)


def test_border_failures_are_counted(spark):
    # rows of the sample know nothing of the others' phrases: three passes are needed
    ids = spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("turn")).collect()
    rows = [(r["id"], "in the sample" if r["turn"] == 0 else "never drawn before", "en") for r in ids]
    assert sorted(map(tuple, collocations.collocations(docs(spark, rows)).collect())) == brute(rows)


def test_longer_phrases_and_limits(spark):
    kw = {"least": 5, "longest": 4, "top": 7, "inside": 80}
    assert sorted(map(tuple, collocations.collocations(docs(spark, MIXED), **kw).collect())) == brute(MIXED, **kw)


def test_large_counts_are_exact(spark):
    whole = "cast({0} as decimal(15,0)) * cast({0} as decimal(15,0)) * cast(1000000 as decimal(7,0)) div (cast({1} as decimal(15,0)) * cast({2} as decimal(15,0)))"
    a, left, right = 123_456_789_012, 223_456_789_013, 323_456_789_017
    got = spark.range(1).select(F.expr(whole.format(f"{a}L", f"{left}L", f"{right}L")).alias("s")).first()["s"]
    assert got == 1000000 * a * a // (left * right)


def test_empty(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_very_long_text(spark):
    rows = [(1, "lorem ipsum dolor " * 700_000, "la")]
    got = {r["phrase"]: r["a"] for r in collocations.collocations(docs(spark, rows)).collect()}
    assert got == {"lorem ipsum dolor": 700_000, "ipsum dolor lorem": 699_999, "dolor lorem ipsum": 699_999}
