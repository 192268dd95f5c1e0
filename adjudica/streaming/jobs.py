"""Structured Streaming over the pass and attempt ledgers.

``stream_ledger`` keeps three tables below a shared folder, each with a partition for every micro-batch, which a rerun of that batch
overwrites: ``kept`` (the first row of each key), ``late`` (rows behind the watermark, or without a time, with a
reason) and ``seen`` (the last time of a batch, from which later batches take their watermark).
A batch reads what earlier ones wrote and nothing of its own, so a restart at any point gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_ingest_passes(stream: DataFrame, keys: list[str] = ("run_id", "pass_number"), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row of each (run, pass) within the watermark; replays are dropped and state is bounded by it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_ledger_status(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Attempts, completions and spend of each judge and window; rows later than the watermark are dropped."""
    return window_status(stream.withWatermark(ts, delay), ts, window)


def stream_ledger(stream: DataFrame, home: str, checkpoint: str, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> StreamingQuery:
    """Ingest into the ledger all that is there now, then stop; start it again as further files arrive.

    The watermark of a batch is the latest time of earlier batches less ``delay``. Rows before it go to ``late``. Of the others the first of each key counts (by
    time, then by all columns); a key that an earlier batch kept at or after the watermark is a replay and dropped, so what
    is read back is bounded by the watermark.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def ingest(batch: DataFrame, number: int) -> None:
        rows = batch  # not kept: a source reads a batch again as it was, and a copy of all that is there now may not fit
        write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/{name}/batch={number}")
        earlier = lambda name, kind: spark.read.schema(f"{kind}, batch long").parquet(f"{home}/{name}").where(F.col("batch") < number)
        time = F.col(ts)
        bound = None
        if number:
            bound = earlier("seen", "last timestamp").agg(F.max("last") - F.expr(f"interval {delay}")).first()[0]
        behind = F.lit(False) if bound is None else time < F.lit(bound)
        out = F.coalesce(behind, F.lit(True)) | time.isNull()
        reason = F.when(time.isNull(), "NO_TIME").otherwise("LATE")
        write(rows.where(out).withColumn("reason", reason), "late")
        fresh = rows.where(~out)
        if number:
            known = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", batch long").parquet(f"{home}/kept").where(F.col("batch") < number)
            known = known if bound is None else known.where(time >= F.lit(bound))
            fresh = fresh.join(known.select(*keys).distinct(), keys, "left_anti")
        rest = [c for c in schema.names if c not in keys]
        first = fresh.groupBy(*keys).agg(F.min(F.struct(ts, *(c for c in rest if c != ts))).alias("_row"))
        write(first.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in schema.names)), "kept")
        write(rows.agg(F.max(ts).alias("last")), "seen")

    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_tables(spark: SparkSession, home: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """What ``stream_ledger`` has kept and what came late, each with its batch; ``schema`` is that of the stream."""
    return spark.read.schema(f"{schema}, batch long").parquet(f"{home}/kept"), spark.read.schema(f"{schema}, reason string, batch long").parquet(f"{home}/late")


def window_status(rows: DataFrame, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Attempts, completions and spend of each judge and window."""
    g = rows.groupBy(F.window(ts, window), "judge")
    out = g.agg(F.count("*").alias("attempts"), F.count_if(F.col("state") == "COMPLETED").alias("completed"), F.sum("actual_micro_usd").alias("actual_micro_usd"))
    return out.select(F.col("window.start").alias("window_start"), "judge", "attempts", "completed", "actual_micro_usd")


def closed(rows: DataFrame, ts: str = "ts", after: str = "1 day") -> DataFrame:
    """``rows`` of a finished ledger and one that is null but for a time ``after`` the last: it lets the watermark pass every window, and its own never closes."""
    end = rows.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts)).where(F.col(ts).isNotNull())
    return rows.unionByName(end, allowMissingColumns=True)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, then stop; the checkpoint makes a rerun exactly-once."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
