"""Readers and writers. Schemas are given, never inferred; paths go to Spark as they are."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import cases

_MESSAGES = "array<struct<role:string,content:string>>"
JUDGMENTS = f"question_id long, turn int, model_a string, model_b string, winner string, conversation_a {_MESSAGES}, conversation_b {_MESSAGES}"
QUESTIONS = "question_id long, category string"
BUCKET = "id long, bucket string, word_count_diff long, human_winner string, ai_winner string, model_names string"

#: Relational tables and their columns.
TABLES = {
    "prompts": "id long, text string, category string",
    "answers": "id long, prompt_id long, model_name string, text string, word_count int, format_type string",
    "human_preferences": "id long, prompt_id long, answer_a_id long, answer_b_id long, winner_id long",
    "judge_decisions": "id long, prompt_id long, judge_model_name string, answer_a_id long, answer_b_id long, position_a_id long, winner_id long, reasoning string",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where that is unset, one process has a folder of its own and a cluster gets an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/adjudica")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that ``dealt`` gives a task.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, by ``keys`` in so many partitions that a task meets about ``TASK_ROWS``. AQE sizes partitions by their packed bytes, which is millions of narrow rows."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Raw judgements with their nested conversations; broken lines fail the read."""
    return spark.read.schema(JUDGMENTS).option("mode", "FAILFAST").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("mode", "FAILFAST").json(path)


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables of a folder with the columns above, by name and type."""
    out = {}
    for name in names or TABLES:
        schema = T.StructType.fromDDL(TABLES[name])
        df = spark.read.parquet(f"{folder}/{name}")
        out[name] = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
    return out


def read_jdbc(spark: SparkSession, url: str, name: str, partitions: int, column: str = "id", **options: str) -> DataFrame:
    """A relational table over JDBC, dealt by ranges of a whole-number column whose bounds one small query takes from the table.

    Filters and columns that are asked of the result go to the database. Rows with a null in ``column`` are read with the first range. An empty table, or
    one with nulls only, is read as one range. ``options`` go to the reader (user, driver, fetchsize).
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    whole = reader().option("dbtable", name).load()
    stored = next(c for c in whole.columns if c.lower() == column.lower())
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(stored)
    low, high = reader().option("query", f"select min({quoted}) as low_id, max({quoted}) as high_id from {name}").load().first()
    if low is None or high <= low or partitions < 2:
        return whole
    return reader().options(dbtable=name, partitionColumn=stored, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions)).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Rows into a relational table; a partition is one transaction."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def explode_manifest(df: DataFrame, array_col: str) -> DataFrame:
    """Rows of a nested array next to the scalar columns of its manifest."""
    keep = [f.name for f in df.schema.fields if f.name != array_col and not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    return df.select(*keep, F.inline(array_col))


def read_manifest(spark: SparkSession, path: str, schema: str, array_col: str) -> DataFrame:
    return explode_manifest(spark.read.schema(schema).option("multiLine", True).json(path), array_col)


def read_bucket(spark: SparkSession, path: str) -> DataFrame:
    """A case bucket as CSV; null strings are empty for display."""
    return spark.read.schema(BUCKET).option("header", True).csv(path).na.fill("")


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet", by: str = "rq") -> None:
    """A folder of metric rows, partitioned by question."""
    out = df.write.mode("overwrite").partitionBy(by)
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)


def to_public_rows(metrics: DataFrame, key: str = "metric_key", value: str = "value") -> DataFrame:
    """Judge, condition and name out of metric keys ``judge:<judge>:<name>``; values that are not finite are null."""
    k = F.col(key)
    parts = F.split(k, ":", 3)
    named = F.when(k.startswith("judge:"), parts[2]).otherwise(k)
    condition = cases((named.startswith("baseline"), "BASELINE_STANDARD"), (named.startswith("dual_swap"), "DUAL_SWAP"), (named.endswith("_delta"), "DUAL_SWAP-BASELINE"))
    finite = ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    return metrics.select(k.alias("metric_key"), F.when(k.startswith("judge:"), parts[1]).alias("judge"), named.alias("metric_name"), condition.alias("condition"), F.when(finite, F.col(value)).alias("value"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
