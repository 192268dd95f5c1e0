"""Text functions and validation against values that were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from adjudica.functions import tails
from adjudica.functions import text as T
from adjudica.operators import pairs as P
from adjudica.sources import io

TEXTS = {
    "a b": (2, "- a b"),
    "a\x1cb\x1f c": (3, "- a\n- b\x1f c"),
    "a\n": (1, "- a"),
    "a\r\nb\r\n\r\nc": (3, "- a\n- b\n\n- c"),
    "a\n\t\nb": (2, "- a\n\t\n- b"),
    "\t\n \n": (0, None),
    "": (0, None),
    "　x y": (2, "- 　x\n- y"),
    "one\n\n": (1, "- one\n"),
}


def test_white_space(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r for r in df.select("t", T.word_count("t").alias("n"), T.format_variant("t").alias("f"), T.verbosity_variant("t").alias("v")).collect()}
    for t, (n, f) in TEXTS.items():
        assert (got[t].n, got[t].f) == (n, f), repr(t)
        assert got[t].v == (None if f is None else t + "\n\n" + t)


def test_model_ids(spark):
    ids = {"gpt-4\n": "gpt-4o-mini", "\tclaude ": "anthropic/claude-3-haiku", None: "gpt-4o-mini", "": "gpt-4o-mini", " x/deepseek ": "deepseek/deepseek-chat", "other\n": "other"}
    rows = spark.createDataFrame([(k,) for k in ids], "m string").select("m", T.normalize_model_id("m").alias("n")).collect()
    assert {r.m: r.n for r in rows} == ids


def test_variant_checks(spark):
    rows = [("a b\n", "- a b", True), ("a b", "- a c", False), ("\n\t", "", False), ("a\r\nb", "1. a\n* b", True), ("a", "", False)]
    df = spark.createDataFrame(rows, "o string, v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.validate_format("o", "v").alias("got")).collect())


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 30) for k in (0, 1, n // 2, n) for p in (0.5, 0.2)]
    got = spark.createDataFrame(cases, "k int, n int, p double").select("*", tails.binom_sf("k", "n", "p").alias("v")).collect()
    for r in got:
        exact = sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert abs(r.v - exact) < 1e-9 or abs(r.v - exact + math.comb(r.n, r.k) * r.p**r.k * (1 - r.p) ** (r.n - r.k)) < 1e-9


def test_controlled_only(spark):
    df = spark.createDataFrame([("u1", "CONTROLLED"), ("u2", "LEGACY"), ("u3", None)], "unit_id string, evidence_class string")
    with pytest.raises(ValueError, match="u2"):
        P.require_controlled(df)
    assert P.require_controlled(df.where("unit_id = 'u1'")).count() == 1


def test_search(spark):
    df = spark.createDataFrame([(12, "GPT-4 vs x", None), (3, None, "Because 12")], "prompt_id long, model_names string, reasoning_text string")
    assert [P.search_records(df, q).count() for q in (" ", "12", "gpt", "because", "none")] == [2, 2, 1, 1, 0]


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "version": "v1",\n "pairs": [\n {"id": 1, "key": "a"},\n {"id": 2, "key": "b"}\n ]\n}\n')
    got = io.read_manifest(spark, str(tmp_path / "m.json"), "version string, pairs array<struct<id:long,key:string>>", "pairs").collect()
    assert sorted(map(tuple, got)) == [("v1", 1, "a"), ("v1", 2, "b")]


def test_dense_ids_follow_the_keys(spark):
    from adjudica.operators.ledger import dense_ids

    df = spark.range(1000).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 2).cast("string").alias("s"))
    got = [tuple(r) for r in dense_ids(df, ["k", "s"], "n").select("n", "k", "s").collect()]
    assert sorted(got) == [(i, *k) for i, k in enumerate(sorted({(r.k, r.s) for r in df.collect()}), 1)]


def test_validation_computes_a_variant_once(spark):
    f, odd = T.format_variant("t"), ["A  b", " a\t\x1cB ", "x 　y z", "a b  c\n\n d", " ", "Q̇ İ\x85\x85 r", "one\r\n- two", "  1. x"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    plan = df.select(T.validate_format("t", f))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 12
    same = df.select(T.folded("t").alias("got"), F.lower(F.trim(F.regexp_replace("t", T.SPACES, " "))).alias("want")).collect()
    assert [r.got for r in same] == [r.want for r in same]
    assert [r[0] for r in df.select(T.validate_format("t", f)).collect()] == [True] * 4 + [False] + [True] * 3


def test_document_functions_equal_their_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from adjudica.plans.catalog import ORACLES, QUERIES

    texts = [None, "", "a\n", "a\n\n", "a\r# b\n**x**", "x **y\rz**\n# b", "x\n\x0b- b **q**", "x **a\nb**\n1. c"]
    for w in (*T.WHITE, "​", "﻿"):
        texts += [w, w + w, f"a{w}b", f"a{w}", f"{w}a", f"a\n{w}\nb", f"a{w}# b\n**y**", f"#{w}b\n**y**", f"x **y{w}z** ```", f"x\n{w}- b **q**", f"x\n1.{w}b **q**"]
    rows = [*enumerate(texts), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(ORACLES["document_text_functions"])
    names = [c[0] for c in want.description]
    got = QUERIES["document_text_functions"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
