"""Stages against brute-force expectations on the smallest tables, and the registered queries."""

import re

import corpus_pipeline
from adjudica.llm import registry

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[:5] == list(corpus_pipeline.COLUMNS)
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        rows = out.collect()
        kept[name] = {r.doc_id for r in rows}
        assert kept[name] <= before and len(rows) == len(kept[name])
        docs = spark.createDataFrame(rows, out.schema)
    assert kept["mixing"] == kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(x in (r.text or "") for r in docs.collect() for x in items)
    words = {r.doc_id: re.findall(r"\S+", (r.text or "").lower()) for r in docs.collect()}
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, w in words.items() if len(w) > 1}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])


def test_queries(spark):
    names = registry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if n != "pipeline"}
    assert set(registry.oracle_sql()) <= set(names)
