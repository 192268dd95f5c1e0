"""Relational tables over JDBC (Derby in memory), and the ledger stream over turns, late rows and restarts."""

import datetime
import os
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from adjudica.plans import fixtures
from adjudica.sources import io
from adjudica.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 4])
def test_jdbc_round_trip(spark, partitions):
    url = f"jdbc:derby:memory:m{uuid4().hex};create=true"
    prompts = spark.range(1, 301).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 5).cast("string").alias("category"))
    io.write_jdbc(prompts.coalesce(2), url, "prompts", createTableColumnTypes="text varchar(100), category varchar(20)")
    got = io.read_jdbc(spark, url, "prompts", partitions, column="id")
    assert got.rdd.getNumPartitions() == partitions
    assert sorted(map(tuple, got.select("id", "text", "category").collect())) == sorted(map(tuple, prompts.collect()))
    some = got.where("category = '3' and id > 250").select("id")
    pushed = plan_of(some)
    assert "PushedFilters" in pushed and "EqualTo(category,3)" in pushed.replace("*", "").replace(" ", "") and "text" not in pushed.split("ReadSchema")[1].lower()
    assert sorted(r.id for r in some.collect()) == list(range(253, 301, 5))


def test_jdbc_ranges_are_even_and_empty_tables_read(spark):
    url = f"jdbc:derby:memory:m{uuid4().hex};create=true"
    io.write_jdbc(spark.range(1000, 1400).coalesce(1), url, "ids")
    sizes = io.read_jdbc(spark, url, "ids", 4).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) <= 110
    io.write_jdbc(spark.range(0).coalesce(1), url, "no_rows")
    assert io.read_jdbc(spark, url, "no_rows", 4).count() == 0


SCHEMA = "k long, v string, ts timestamp"


def at(hour, minute=0):
    return datetime.datetime(2026, 1, 1, hour, minute)


TURNS = [
    [(1, "a", at(1)), (2, "b", at(2)), (1, "again", at(1, 30)), (9, "no time", None)],
    [(3, "c", at(5)), (2, "replay", at(3)), (4, "in time", at(1, 30))],
    [(5, "late", at(3)), (1, "late replay", at(1)), (6, "edge", at(4)), (3, "replay", at(5))],
    [],
    [(7, "d", at(9))],
]


def run(spark, home, turns):
    for rows in turns:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{home}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{home}/in")
        jobs.stream_ledger(stream, f"{home}/ledger", f"{home}/state", ["k"], delay="1 hour").awaitTermination()


def tables(spark, home):
    kept, late = jobs.ledger_tables(spark, f"{home}/ledger", SCHEMA)
    return sorted((r.k, r.v) for r in kept.collect()), sorted((r.k, r.v, r.reason) for r in late.collect())


KEPT = [(1, "a"), (2, "b"), (3, "c"), (4, "in time"), (6, "edge"), (7, "d")]
LATE = [(1, "late replay", "LATE"), (5, "late", "LATE"), (9, "no time", "NO_TIME")]


def test_turns_late_rows_and_replays(spark, tmp_path):
    run(spark, tmp_path, TURNS)
    assert tables(spark, tmp_path) == (KEPT, LATE)


def test_a_batch_that_was_not_committed_runs_again(spark, tmp_path):
    run(spark, tmp_path, TURNS[:3])
    commits = sorted((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(commits[-1])
    for crc in (tmp_path / "state/commits").glob(f".{commits[-1].name}.crc"):
        os.remove(crc)
    run(spark, tmp_path, TURNS[3:])
    assert tables(spark, tmp_path) == (KEPT, LATE)


def test_one_batch_of_everything_keeps_first_rows(spark, tmp_path):
    run(spark, tmp_path, [[r for turn in TURNS for r in turn]])
    kept, late = tables(spark, tmp_path)
    assert kept == [(1, "a"), (2, "b"), (3, "c"), (4, "in time"), (5, "late"), (6, "edge"), (7, "d")] and late == [(9, "no time", "NO_TIME")]


def test_streamed_attempts_are_derived_once(spark, tmp_path, monkeypatch):
    from adjudica.plans import stream_queries as Q

    data, homes = "/root/testdata/sf0.001", iter([str(tmp_path / "ingest"), str(tmp_path / "turns")])
    monkeypatch.setattr(Q, "shared_folder", lambda s: next(homes))
    kept = Q.stream_ingest(spark, data)
    sent = spark.read.parquet(str(tmp_path / "ingest" / "in"))
    assert sent.columns == ["pass_id", "attempt_index", "state", "ts"]
    assert sent.groupBy(*sent.columns).count().where("count <> 2").count() == 0 and sent.count() == 2 * kept.count()
    Q._turns(spark, data)
    turns = spark.read.parquet(str(tmp_path / "turns" / "delivered")).groupBy("pass_id", "attempt_index").count()
    assert {r[0] for r in turns.select("count").distinct().collect()} == {1, 2} and turns.count() == kept.count()


def test_ingested_attempts_leave_no_state_and_one_copy(spark, tmp_path, monkeypatch):
    from adjudica.plans import stream_queries as Q

    monkeypatch.setattr(Q, "shared_folder", lambda s: str(tmp_path))
    kept = Q.stream_ingest(spark, "/root/testdata/sf0.001")
    assert kept.count() == kept.distinct().count() == fixtures.table(spark, "/root/testdata/sf0.001", "attempts").count()
    folders = {d.name for d in (tmp_path / "state").iterdir() if d.is_dir()}
    assert "commits" in folders and "state" not in folders
    size = lambda d: sum(f.stat().st_size for f in d.rglob("*.parquet"))
    assert size(tmp_path / "ledger") < 1.5 * size(tmp_path / "in")


def test_replays_are_dropped_by_the_state_of_passes(spark, tmp_path):
    for rows in TURNS[:2]:
        spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        jobs.to_parquet(jobs.stream_ingest_passes(stream, ["k"], delay="4 hours"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.k for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_relational_tables_hold_their_columns(spark, tmp_path, monkeypatch):
    from adjudica.plans import stream_queries as Q

    monkeypatch.setattr(Q, "shared_folder", lambda s: str(tmp_path))
    assert Q.relational_source(spark, "/root/testdata/sf0.001").count() > 0
    for name, ddl in io.TABLES.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").columns == [c.split()[0] for c in ddl.split(", ")]


def test_filtered_outcomes_are_hashed_once(spark):
    """The filter of decisions stays above the outcome, so no join or filter has hashes of its own; null outcomes are kept where nothing filters them."""
    plan = fixtures.table(spark, "/root/testdata/sf0.001", "decisions")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "sha2(" in x and not x.lstrip(" :+-").startswith("Project")]
    rows = [(1, "TIE"), (2, None), (2, None)]
    df = fixtures.once(spark.createDataFrame(rows, "k int, outcome string"), "outcome")
    assert df.columns == ["k", "outcome"] and sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    p = fixtures.table(spark, "/root/testdata/sf0.001", "passes").where("presentation = 'AB' and outcome in ('ANSWER_A', 'ANSWER_B', 'TIE')")
    assert fixtures.table(spark, "/root/testdata/sf0.001", "decisions").count() == p.count()
