"""Corpus pipeline: classifier, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and
returns the columns of ``documents`` (the last adds its own). ``run`` writes every stage as
Parquet into the cluster's shared folder and rereads it as the next one's input; the folder of a
run stays as its result.

Decisions bind a row by its id and text together, so rows that share an id, or have none, each
get their own: they are classified, lose their repeated lines, hold benchmark items and get
a rate like any others. Near-dedup alone needs an id to name a group: rows without one stay there.
A null text is kept by every stage that does not reject empty texts. Empty tables give no rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudica.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_classifier
from adjudica.llm.common import table
from adjudica.sources.io import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_name``, a hash of id and text; a null of either has a place of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return docs.withColumn("_name", F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), *parts))


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    verdict = quality_classifier.quality_classifier(named(docs), table(spark, sf_dir, "labels"), also=("_name",))
    bad = verdict.where("predicted = 0").select("_name").distinct()
    return named(docs).join(bad, "_name", "left_anti").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their kept lines; one whose lines all go (nothing but repeats) goes too."""
    lines = line_dedup.line_dedup(docs, also=("lang", "source", "n_chars"), exact_chars=1)
    kept = lines.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by two-word shingles: the one with the least id (of equal rows, one)."""
    groups = minhash_dedup.near_duplicates(named(docs), k=2, also=("_name",))
    gone = groups.where("doc_id <> component_id").select("_name").distinct()
    kept = named(docs).join(gone, "_name", "left_anti")
    some = F.col("doc_id").isNotNull()
    return kept.where(some).dropDuplicates(["_name"]).select(*COLUMNS).unionByName(kept.where(~some).select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and number of copies; the labelled table is the language of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    every = named(docs)
    labelled = every.join(labels, "doc_id", "left_semi").select("_name", F.col("lang").alias("domain"))
    out = mixing.mixing(every, labelled, id_col="_name").select("_name", "domain", "rate", "copies").dropDuplicates(["_name"])
    return every.join(out, "_name").select(*COLUMNS, "domain", "rate", "copies")


STAGES = [
    ("quality_classifier", classified),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Learnt scores and signatures are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over ``documents``."""
    docs, home = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
