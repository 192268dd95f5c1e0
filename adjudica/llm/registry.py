"""Queries of this subpackage and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations as op12
from . import decontamination as op6
from . import html_text as op8
from . import line_dedup as op9
from . import minhash_dedup as op4
from . import mixing as op3
from . import quality_classifier as op2
from . import quality_rules as op7
from . import secret_scan as op5
from . import suffix_dedup as op1
from . import token_counts as op10
from . import vector_codes as op13
from . import vector_dedup as op11
from .common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return op3.mixing(docs, docs.join(labels, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.secret_scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.quality_rules(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.html_text(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.line_dedup(table(spark, sf_dir, "documents"), exact_chars=1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.vector_dedup(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.vector_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op") and "_" in name and callable(f)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": op1.duckdb_sql(), "op4_minhash_dedup": op4.duckdb_sql(), "op7_quality_rules": op7.duckdb_sql(), "op11_vector_dedup": op11.duckdb_sql(), "op12_collocations": op12.duckdb_sql(), "op13_vector_codes": op13.duckdb_sql()}
