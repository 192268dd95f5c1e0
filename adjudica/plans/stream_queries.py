"""Queries that run the streaming jobs over files derived from the given tables, and the sink round trips."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import io
from ..streaming import jobs
from . import core_queries as core
from .catalog import query
from .fixtures import duck, table


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared place."""
    return f"{io.shared_folder(spark)}/stream-{uuid4()}"


def _attempts(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "attempts")
    return a.select("pass_id", "judge", "attempt_index", "state", "actual_micro_usd", F.timestamp_seconds(60 * F.col("started_min")).alias("ts"))


@query(duck("select pass_id, attempt_index, state from attempts"))
def stream_ingest(spark, sf_dir):
    """Each attempt written twice: the replays must go."""
    home = shared_folder(spark)
    a = _attempts(spark, sf_dir).select("pass_id", "attempt_index", "state", "ts")
    # a replay is a copy: attempts are derived once
    a.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy").write.option("compression", "zstd").parquet(f"{home}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"{home}/in")
    # the ledger, as a state would hold every key of a batch in memory and write it twice
    jobs.stream_ledger(stream, f"{home}/ledger", f"{home}/state", ["pass_id", "attempt_index"]).awaitTermination()
    kept, _ = jobs.ledger_tables(spark, f"{home}/ledger", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.schema))
    return kept.select("pass_id", "attempt_index", "state")


@query(duck("select make_timestamp(cast(started_min // 5 as bigint) * 300000000) as window_start, judge, count(*) as attempts, count(*) filter (where state = 'COMPLETED') as completed, cast(sum(actual_micro_usd) as bigint) as actual_micro_usd from attempts group by 1, 2"))
def stream_status(spark, sf_dir):
    """A finished ledger: all its windows close."""
    home = shared_folder(spark)
    a = jobs.closed(_attempts(spark, sf_dir))
    a.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"{home}/in")
    status = jobs.stream_ledger_status(stream)
    schema = status.schema
    jobs.to_parquet(status, f"{home}/out", f"{home}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{home}/out")


_DELAY = 7200
#: Each row is delivered in one of six turns by its time, or two turns late; some are delivered again a turn after.
_DELIVERED = """dl as (select pass_id, judge, attempt_index, state, actual_micro_usd, started_min, f from (
    select *, cast(started_min * 6 // (m + 1) as bigint) + case when h('lt:' || pass_id || cast(attempt_index as string)) % 20 = 0 then 2 else 0 end as f from attempts, (select max(started_min) as m from attempts) t) x
  union all select pass_id, judge, attempt_index, state, actual_micro_usd, started_min, f + 1 from (
    select *, cast(started_min * 6 // (m + 1) as bigint) as f from attempts, (select max(started_min) as m from attempts) t) y where h('rp:' || pass_id || cast(attempt_index as string)) % 7 = 0)"""
_JUDGED = f"""with {_DELIVERED}, top as (select f, max(started_min) as last from dl group by f), bound as (select a.f, max(b.last) - {_DELAY} as low from top a join top b on b.f < a.f group by a.f),
  j as (select dl.*, coalesce(started_min < low, false) as late from dl left join bound on dl.f = bound.f)"""


def _turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The tables of a ledger whose files arrive in eight turns, each ingested by a start from the checkpoint."""
    home = shared_folder(spark)
    a = table(spark, sf_dir, "attempts").select("pass_id", "judge", "attempt_index", "state", "actual_micro_usd", "started_min")
    number = lambda tag: F.conv(F.substring(F.sha2(F.concat(F.lit(tag), "pass_id", F.col("attempt_index").cast("string")), 256), 1, 8), 16, 10).cast("long")
    turn = F.floor(F.col("started_min") * 6 / (F.col("m") + 1))
    a = a.crossJoin(F.broadcast(a.agg(F.max("started_min").alias("m"))))
    first = turn + F.when(number("lt:") % 20 == 0, 2).otherwise(0)
    again = F.when(number("rp:") % 7 == 0, F.array(turn + 1)).otherwise(F.array().cast("array<bigint>"))
    columns = ("pass_id", "judge", "attempt_index", "state", "actual_micro_usd", F.timestamp_seconds(60 * F.col("started_min")).alias("ts"))
    # attempts are derived once, with all turns of each; a turn then reads its own files
    delivered = a.select(F.explode(F.concat(F.array(first), again)).alias("f"), *columns)
    schema = delivered.drop("f").schema
    delivered.write.partitionBy("f").parquet(f"{home}/delivered")
    delivered = spark.read.schema(delivered.schema).parquet(f"{home}/delivered")
    for k in range(8):
        delivered.where(F.col("f") == k).drop("f").write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(schema).parquet(f"{home}/in")
        jobs.stream_ledger(stream, f"{home}/ledger", f"{home}/state", ["pass_id", "attempt_index"], delay=f"{_DELAY} minutes").awaitTermination()
    return jobs.ledger_tables(spark, f"{home}/ledger", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


@query(duck(f"{_JUDGED} select pass_id, attempt_index, 'KEPT' as fate, min(f) as batch from j where not late group by 1, 2 union all select pass_id, attempt_index, 'LATE', f from j where late"))
def stream_late_rows(spark, sf_dir):
    """Files that arrive in turns: rows kept once, and rows behind the watermark in a table of their own."""
    kept, late = _turns(spark, sf_dir)
    return kept.select("pass_id", "attempt_index", F.lit("KEPT").alias("fate"), "batch").unionByName(late.select("pass_id", "attempt_index", F.lit("LATE").alias("fate"), "batch"))


@query(duck(f"{_JUDGED}, k as (select distinct pass_id, attempt_index, judge, state, actual_micro_usd, started_min from j where not late) select make_timestamp(cast(started_min // 1440 as bigint) * 86400000000) as window_start, judge, count(*) as attempts, count(*) filter (where state = 'COMPLETED') as completed, cast(sum(actual_micro_usd) as bigint) as actual_micro_usd from k group by 1, 2"))
def stream_ledger_days(spark, sf_dir):
    """Status by day of what the turns kept."""
    return jobs.window_status(_turns(spark, sf_dir)[0], window="1 day")


_flat = "with m as (" + core._AGREEMENT + ") select case when judge is null then metric_name else 'judge:' || judge || ':' || metric_name end as metric_key, judge, metric_name, cast(null as string) as condition, value from m where category is null"


@query(_flat)
def public_rows(spark, sf_dir):
    m = core.agreement(spark, sf_dir).where("category is null")
    key = F.when(F.col("judge").isNull(), F.col("metric_name")).otherwise(F.concat(F.lit("judge:"), "judge", F.lit(":"), "metric_name"))
    return io.to_public_rows(m.select(key.alias("metric_key"), "value"))


@query(duck("select prompt_id, cast(answer_a_id as bigint) as answer_a_id from pairs"))
def manifest_pairs(spark, sf_dir):
    """A nested manifest for each prompt, and back."""
    p = table(spark, sf_dir, "pairs").groupBy("prompt_id").agg(F.collect_list(F.struct("answer_a_id")).alias("pairs"))
    return io.explode_manifest(p, "pairs")


@query(duck(f"select pair_id, judge, {core.CANON} as outcome from passes"))
def sink_round_trip(spark, sf_dir):
    home = shared_folder(spark)
    p = core.canonical_passes(spark, sf_dir).select("pair_id", "judge", F.col("canonical").alias("outcome"), F.lit("RQ1").alias("rq"))
    io.write_metrics(p, home, "json")
    return spark.read.schema("pair_id long, judge string, outcome string").json(home).drop("rq")


@query(duck(f"select pair_id, judge, {core.CANON} as outcome from passes"))
def csv_sink_round_trip(spark, sf_dir):
    home = shared_folder(spark)
    p = core.canonical_passes(spark, sf_dir).select("pair_id", "judge", F.col("canonical").alias("outcome"), F.lit("RQ1").alias("rq"))
    io.write_metrics(p, home, "csv")
    return spark.read.schema("pair_id long, judge string, outcome string").option("header", True).csv(home).drop("rq")


@query(duck("select distinct question_id, category from pairs"))
def question_source(spark, sf_dir):
    home = shared_folder(spark)
    table(spark, sf_dir, "pairs").select("question_id", "category").distinct().write.json(home)
    return io.read_questions(spark, home)


@query(duck("select question_id, 1 as turn, model_a, model_b, case human_label when 'ANSWER_A' then 'model_a' when 'ANSWER_B' then 'model_b' when 'TIE' then 'tie' end as winner, 'p' || cast(prompt_id as string) as prompt, 'a' || s as first, 'b' || s as second from pairs"))
def judgment_source(spark, sf_dir):
    """Raw judgements with nested conversations, written as JSON lines and read with the given schema."""
    home = shared_folder(spark)
    talk = lambda x: F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("p"), F.col("prompt_id").cast("string")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(x), "s").alias("content")))
    winner = F.expr("case human_label when 'ANSWER_A' then 'model_a' when 'ANSWER_B' then 'model_b' when 'TIE' then 'tie' end")
    table(spark, sf_dir, "pairs").select("question_id", F.lit(1).alias("turn"), "model_a", "model_b", winner.alias("winner"), talk("a").alias("conversation_a"), talk("b").alias("conversation_b")).write.json(home)
    j = io.read_judgments(spark, home)
    return j.select("question_id", "turn", "model_a", "model_b", "winner", F.col("conversation_a")[0]["content"].alias("prompt"), F.col("conversation_a")[1]["content"].alias("first"), F.col("conversation_b")[1]["content"].alias("second"))


@query(duck("select 'answers' as table_name, id, prompt_id from answers union all select 'human_preferences', preference_id, prompt_id from preferences union all select 'judge_decisions', id, prompt_id from decisions union all select 'prompts', id, cast(null as bigint) from prompts"))
def relational_source(spark, sf_dir):
    """The relational tables as Parquet folders, read by name and type."""
    home = shared_folder(spark)
    null = F.lit(None).cast("string")
    made = {
        "prompts": table(spark, sf_dir, "prompts"),
        "answers": table(spark, sf_dir, "answers").withColumn("format_type", F.lit("plain_text")),
        "human_preferences": table(spark, sf_dir, "preferences").withColumnRenamed("preference_id", "id"),
        "judge_decisions": table(spark, sf_dir, "decisions").withColumn("reasoning", null),
    }
    for name, df in made.items():
        df.select(T.StructType.fromDDL(io.TABLES[name]).fieldNames()).write.parquet(f"{home}/{name}")
    read = io.read_tables(spark, home)
    return io.union_all([df.select(F.lit(name).alias("table_name"), "id", F.col("prompt_id") if "prompt_id" in df.columns else F.lit(None).cast("long").alias("prompt_id")) for name, df in sorted(read.items())])


@query(duck("select pair_id as id, coalesce(human_label, '') as human_winner, case when wc_a > wc_b then 'long_first' else '' end as bucket, wc_a - wc_b as word_count_diff, model_a || ' vs ' || model_b as model_names from pairs"))
def bucket_source(spark, sf_dir):
    """A case bucket as CSV: null strings come back empty."""
    home = shared_folder(spark)
    p = table(spark, sf_dir, "pairs")
    p.select(F.col("pair_id").alias("id"), F.when(F.col("wc_a") > F.col("wc_b"), "long_first").alias("bucket"), (F.col("wc_a") - F.col("wc_b")).alias("word_count_diff"), F.col("human_label").alias("human_winner"), F.lit(None).cast("string").alias("ai_winner"), F.concat_ws(" vs ", "model_a", "model_b").alias("model_names")).write.option("header", True).csv(home)
    return io.read_bucket(spark, home).drop("ai_winner")
