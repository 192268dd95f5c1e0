"""Bootstraps: clustered draws against SQL, chunks of distinct values against one cell table, and distributions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudica.operators import bootstrap as B
from adjudica.plans import history_queries as H
from adjudica.plans.fixtures import duck

DATA = "/root/testdata/sf0.001"


def rows(spark, n, clusters, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(int(c), int(v)) for c, v in zip(r.integers(0, clusters, n), r.integers(0, 2, n), strict=True)], "c long, v int")


def test_blocks_draw_what_rows_draw(spark):
    df = rows(spark, 900, 70)
    got = {r.replicate: (r.ws, r.wn) for r in B.clustered_bootstrap(df, "c", "v", 700, 5).collect()}
    each = df.groupBy("c").agg(F.sum("v").alias("s"), F.count("*").alias("n")).crossJoin(spark.range(700).withColumnRenamed("id", "replicate"))
    w = B.poisson_weight(F.col("c"), F.col("replicate"), 5)
    want = {r.replicate: (r.s, r.n) for r in each.groupBy("replicate").agg(F.sum(w * F.col("s")).alias("s"), F.sum(w * F.col("n")).alias("n")).collect()}
    assert got == want and len(got) == 700


def test_two_hundred_replicates_equal_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{DATA}/orders.parquet'")
    sql = duck(f"with {H._clustered_sql(H._tab, 'pair_id', H._cells, B.KAPPA, 200, 7, 'st')} select * from st")
    want = c.execute(sql).df().sort_values("replicate").reset_index(drop=True)
    got = B.clustered_statistic(H._labels(spark, DATA), "pair_id", B.table_cells("hl", "jl"), B.KAPPA, 200, 7).toPandas().sort_values("replicate").reset_index(drop=True)
    names = [n for n in want.columns if n != "stat"]
    assert (got[names] == want[names]).all().all() and np.allclose(got["stat"], want["stat"], atol=1e-12)


@pytest.mark.parametrize("weights", sorted(B.WEIGHTS))
def test_weights_are_poisson(weights):
    w = B.WEIGHTS[weights]([f"u{i}" for i in range(300)], range(100, 400), 3)
    assert w.shape == (300, 300) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    assert (w == B.WEIGHTS[weights]([f"u{i}" for i in range(300)], range(100, 400), 3)).all()
    assert (w[50:60, 7:9] == B.WEIGHTS[weights](["u7", "u8"], range(150, 160), 3)).all()


def test_report(spark):
    df = rows(spark, 4000, 50)
    got = B.clustered_report(df, "c", [F.sum("v").alias("s"), F.count("*").alias("n")], {"rate": "s / n", "never": "case when n < 0 then 1.0D end"}, iterations=2000, seed=4).collect()
    by = {r.metric: r for r in got}
    assert by["never"].valid_replicates == 0 and by["never"].non_estimable_replicates == 2000 and by["never"].ci_low is None
    r = by["rate"]
    assert r.clusters == 50 and r.bootstrap_replicates == r.valid_replicates == 2000 and r.multiplicity == max(x["count"] for x in df.groupBy("c").count().collect())
    assert r.ci_low < r.point < r.ci_high and r.point == df.agg(F.avg("v")).first()[0]


def test_chunks_have_the_distribution_of_one_table(spark):
    """A continuous value: chunks of 16 cells with their tree against all cells in one row."""
    r = np.random.default_rng(2)
    values = [float(x) for x in r.exponential(size=500)] + [0.0] * 200
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int")
    whole = B.replicates(df, "v", [], 4000, 1, chunk=10**6).toPandas()["stat"]
    parts = B.replicates(df.repartition(5), "v", [], 4000, 1, chunk=16).toPandas()["stat"]
    assert len(whole) == len(parts) == 4000
    se = np.std(values) / np.sqrt(len(values))
    for x in (whole, parts):
        assert abs(x.mean() - np.mean(values)) < 4 * se / np.sqrt(4000) and abs(x.std() / se - 1) < 0.05
    assert np.abs(np.quantile(whole, [0.025, 0.25, 0.5, 0.75, 0.975]) - np.quantile(parts, [0.025, 0.25, 0.5, 0.75, 0.975])).max() < 0.2 * se
    again = B.replicates(df.repartition(2), "v", [], 4000, 1, chunk=16).toPandas().sort_values("replicate")["stat"].to_numpy()
    assert np.allclose(again, B.replicates(df, "v", [], 4000, 1, chunk=16).toPandas().sort_values("replicate")["stat"].to_numpy())


def test_many_distinct_values(spark):
    df = spark.range(60_000).select((F.col("id") * 0.5).alias("v"))
    got = B.bootstrap_ci(df, "v", iterations=100).first()
    assert got.replicates == 100 and got.ci_low < 14_999.75 < got.ci_high


def test_empty_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "v double, g int")
    assert B.bootstrap_ci(df, "v", ["g"], iterations=10).count() == 0
    assert B.clustered_bootstrap(spark.createDataFrame([], "c long, v int"), "c", "v", 10, 1).count() == 0


def test_cells_are_read_once(spark, tmp_path):
    """Sizes, chunks and paths start from one table of cells: nothing after it reads the rows, and the filter on outcomes adds no hashes to a join."""
    rows(spark, 300, 5).write.parquet(f"{tmp_path}/rows")
    plan = B.replicates(spark.read.parquet(f"{tmp_path}/rows"), "v", ["c"], 20, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation " not in plan and "LogicalRDD" in plan
    plan = H._correct(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "sha2(" in x and "Join" in x]
