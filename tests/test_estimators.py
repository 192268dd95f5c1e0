"""Hand-made rows with exact expected values."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adjudica.functions import labels as L
from adjudica.functions import tails
from adjudica.functions import text as T
from adjudica.operators import bootstrap as B
from adjudica.operators import consensus as C
from adjudica.operators import dataset as S
from adjudica.operators import diagnostics as D
from adjudica.operators import estimators as E
from adjudica.operators import ledger as A
from adjudica.operators import pairs as P
from adjudica.operators import planning as W
from adjudica.sources import io

A_, B_, TIE = "ANSWER_A", "ANSWER_B", "TIE"


def values(df, key="metric_name"):
    return {r[key]: r for r in df.collect()}


def test_agreement(spark):
    rows = [(A_, A_), (B_, B_), (TIE, TIE), (A_, B_), (A_, "TIMEOUT")]
    df = spark.createDataFrame(rows, "human_label string, judge_label string").withColumns({"judge": F.lit("j"), "category": F.lit("c")})
    m = values(E.agreement(df, ((),)))
    assert (m["exact_agreement"].value, m["exact_agreement"].tie_count, m["exact_agreement"].failure_count) == (0.75, 1, 1)
    same = spark.createDataFrame([(A_, A_)], df.select("human_label", "judge_label").schema).withColumns({"judge": F.lit("j"), "category": F.lit("c")})
    k = values(E.agreement(same, ((),)))["cohens_kappa"]
    assert (k.value, k.status) == (None, "NOT_ESTIMABLE")
    none = values(E.agreement(df.where("false"), ((),)))
    assert none["exact_agreement"].status == none["cohens_kappa"].status == "NO_DATA"


def test_empty_stratum_shows_no_data(spark):
    df = spark.createDataFrame([(None, A_, "x", "c"), (A_, A_, "y", "c")], "human_label string, judge_label string, judge string, category string")
    m = {(r.judge, r.metric_name): r.status for r in E.agreement(df).where("judge is not null").collect()}
    assert m["x", "exact_agreement"] == "NO_DATA" and m["y", "exact_agreement"] == "ESTIMABLE"


def repetitions(spark, groups):
    rows = [(k, "j", i, 0, v, route) for k, g in groups.items() for i, (v, route) in enumerate(g)]
    return spark.createDataFrame(rows, "group_key string, judge string, repetition_index int, retry_count int, outcome string, route string")


def test_repeatability(spark):
    r = lambda s, bad=None: [({"A": A_, "B": B_, "X": "API_ERROR"}[c], "b" if i == bad else "a") for i, c in enumerate(s)]
    m = values(E.repeatability(repetitions(spark, {"1": r("AAAAB"), "2": r("BBBBB")}), ["judge", "route"], groups=((),)))
    assert math.isclose(m["strict_complete_repetition_consistency"].value, 0.9)
    m = values(E.repeatability(repetitions(spark, {"1": r("AAAAA", 4)}), ["judge", "route"], groups=((),)))
    assert m["strict_complete_repetition_consistency"].status == "INSUFFICIENT_ELIGIBLE_UNITS"
    m = values(E.repeatability(repetitions(spark, {"1": r("AAAAA"), "2": r("AAAAX")}), ["judge", "route"], groups=((),)))
    assert (m["strict_complete_repetition_consistency"].denominator, m["conditional_returned_judgment_consistency"].denominator) == (1, 2)


def test_order(spark):
    rows = [(A_, A_, 1, 0), (A_, B_, 0, 2), (TIE, A_, 0, 0), (A_, None, 0, 0)]
    m = values(E.order_sensitivity(spark.createDataFrame(rows, "pass_ab string, pass_ba string, slot_wins_a int, slot_wins_b int"), ((),)))
    assert m["paired_decisive_flip_rate"].value == 0.5
    assert math.isclose(m["all_paired_disagreement_rate"].value, 2 / 3)
    assert math.isclose(m["slot_win_imbalance"].value, 1 / 3) and m["incomplete_pair_count"].value == 1


def test_mappings(spark):
    df = spark.createDataFrame([(A_, "AB"), (A_, "BA"), (B_, "BA"), (TIE, "BA"), ("UNKNOWN", "AB"), (A_, "??")], "o string, p string")
    assert [r[0] for r in df.select(L.to_canonical("o", "p")).collect()] == [A_, B_, A_, TIE, "UNKNOWN", None]
    v = spark.createDataFrame([(A_, "AB"), (B_, "AB"), (A_, "BA"), (B_, "BA"), ("UNKNOWN", "AB")], "o string, p string")
    assert [r[0] for r in v.select(L.variant_outcome("o", "p")).collect()] == ["ORIGINAL", "VARIANT", "VARIANT", "ORIGINAL", None]
    d = spark.createDataFrame([(None, None), (A_, A_), ("API_ERROR", None), ("API_ERROR", A_), (A_, B_)], "a string, b string")
    assert [r[0] for r in d.select(L.dual_swap_label("a", "b")).collect()] == [None, A_, None, "API_ERROR", "MISSING_PASS"]


def test_mitigation(spark):
    rows = [(A_, A_, A_, A_), (A_, B_, A_, A_), (A_, A_, A_, B_)]
    df = spark.createDataFrame(rows, "human_label string, baseline_label string, dual_ab_label string, dual_ba_label string").withColumn("dual_label", L.dual_swap_label("dual_ab_label", "dual_ba_label"))
    m = values(C.matched_mitigation(df, ((),)))
    assert (m["agreement_delta"].value, m["baseline_agreement"].denominator, m["coverage_delta"].denominator) == (0.5, 2, 3)
    none = values(C.matched_mitigation(df.where("false"), ((),)))
    assert none["agreement_delta"].value is None and none["agreement_delta"].status == "NO_COMMON_VALID_UNITS"


@pytest.mark.parametrize(("votes", "pattern", "label"), [("TTT1", "3-1", "TIE"), ("2222", "4-0", "ORIGINAL_ANSWER_2"), ("1122", "2-2", None), ("112T", "2-1-1", None), ("11T?", "OPERATIONAL", None)])
def test_consensus(spark, votes, pattern, label):
    name = {"T": TIE, "1": "ORIGINAL_ANSWER_1", "2": "ORIGINAL_ANSWER_2", "?": None}
    df = spark.createDataFrame([(1, name[v]) for v in votes], "pair_id int, vote string")
    r = C.consensus4(df).first()
    assert (r.pattern, r.consensus) == (pattern, label)


def test_preaggregated(spark):
    rows = [("p", "agreement", 0.6, 0.8), ("q", "agreement", 0.6, 0.4), ("p", "position", 0.5, 0.2), ("q", "position", 0.5, 0.2), ("p", "only", 0.0, 1.0)]
    m = {r.metric_name: r.value for r in C.preaggregated_delta(spark.createDataFrame(rows, "pair string, metric_name string, baseline double, mitigation double")).collect()}
    assert m["agreement"] == 0.0 and math.isclose(m["position"], -0.3) and "only" not in m


def test_freeze(spark):
    rows = [(1, 1, 10, 20, 10), (2, 1, 20, 10, 10), (3, 1, 30, 40, 30), (4, 1, 40, 30, 40)]
    got = P.freeze_pairs(spark.createDataFrame(rows, "preference_id int, prompt_id int, answer_a_id int, answer_b_id int, winner_id int")).collect()
    assert [(r.answer_a_id, r.answer_b_id, r.human_label, r.collapsed) for r in got] == [(10, 20, A_, 1)]


def test_counterbalanced(spark):
    obs = spark.createDataFrame([("j", "SAME", "SAME", "SAME"), ("j", "SAME", "OTHER", "OTHER"), ("j", "OTHER", "SAME", "OTHER"), ("j", "OTHER", "TIE", "TIE")], "judge string, human_stratum string, pass_ab string, pass_ba string")
    m = {r.metric_name: r.value for r in E.counterbalanced_family(obs, ["j"]).where("judge is null").collect()}
    assert (m["stable_same_family_preference"], m["valid_stable_decisive_coverage"], m["tie_or_abstention_rate"], m["equal_weight_judge_macro_average"]) == (0.5, 0.5, 0.25, 0.5)
    assert math.isclose(m["order_sensitive_disagreement"], 1 / 3)
    two = {r.metric_name: r.value for r in E.counterbalanced_family(obs, ["j", "k"]).where("judge is null").collect()}
    assert two["equal_weight_judge_macro_average"] is None


def test_self_preference(spark):
    rows = [(2, 1, 2, "x", "gpt-4")] * 8 + [(1, 1, 2, "x", "gpt-4")] * 2 + [(1, 1, 2, "x", "y")] * 8 + [(2, 1, 2, "x", "y")] * 2 + [(1, 1, 2, "gpt-4", "gpt-3")]
    d = spark.createDataFrame(rows, "winner_id int, answer_a_id int, answer_b_id int, model_a string, model_b string")
    r = E.self_preference(d, "gpt", T.model_family("model_a"), T.model_family("model_b")).first()
    assert (r.self_win_rate, r.baseline_win_rate, r.self_preference_ratio) == (0.8, 0.8, 1.0)
    r = E.self_preference(d.where("model_b = 'y'"), "gpt", T.model_family("model_a"), T.model_family("model_b")).first()
    assert r.self_win_rate is None and r.self_preference_ratio is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.2), ("d", 0.5)], "k string, p double")
    got = {r.k: r.p_adjusted for r in D.bh_adjust(df, "p", "k").collect()}
    assert [round(got[k], 6) for k in "abcd"] == [0.004, 0.08, 0.266667, 0.5]


def test_tails():
    assert math.isclose(tails.chi2_tail(3.841458820694124), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.binomial_tail(8, 10, 0.5), 56 / 1024)
    assert math.isclose(tails.t_tail(2.228138851986273, 10), 0.05, rel_tol=1e-9)


def test_davidson_recovers_scores():
    p, nu = {"a": 1.0, "b": 2.0, "c": 4.0}, 0.7
    rows = []
    for i, j in (("a", "b"), ("a", "c"), ("b", "c")):
        root = math.sqrt(p[i] * p[j])
        d = p[i] + p[j] + nu * root
        rows.append((i, j, 1e6 * p[i] / d, 1e6 * p[j] / d, 1e6 * nu * root / d))
    theta, gamma, _, done = D.fit_davidson(pd.DataFrame(rows, columns=["m1", "m2", "w_ij", "w_ji", "t_ij"]))
    assert done and theta["a"] == 0.0
    assert math.isclose(theta["b"], math.log(2), rel_tol=1e-6) and math.isclose(theta["c"], math.log(4), rel_tol=1e-6) and math.isclose(gamma, math.log(nu), rel_tol=1e-6)


def test_bootstrap(spark):
    df = spark.range(4000).select((F.col("id") % 4 == 0).cast("int").alias("ok"))
    r = B.bootstrap_ci(df, "ok", iterations=2000).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 4000)
    assert abs((r.ci_high - r.ci_low) / 2 - half) < 0.1 * half
    again = B.bootstrap_ci(df.repartition(7), "ok", iterations=2000).first()
    assert (again.ci_low, again.ci_high) == (r.ci_low, r.ci_high)
    one = B.bootstrap_ci(df.limit(1), "ok", iterations=100).first()
    assert one.ci_low is None


def test_verdicts_and_formats(spark):
    said = spark.createDataFrame([("WINNER: A ... VERDICT: **TIE**",), ("I prefer candidate B",), (None,), ("",)], "t string")
    assert [r[0] for r in said.select(T.parse_winner("t")).collect()] == [TIE, "B", "UNKNOWN", "UNKNOWN"]
    t = spark.createDataFrame([("one\n\ntwo",), ("  ",), (None,)], "t string")
    assert [r[0] for r in t.select(T.format_variant("t")).collect()] == ["- one\n\n- two", None, None]
    ok = t.select(T.validate_format("t", T.format_variant("t")), T.validate_verbosity("t", T.verbosity_variant("t"))).collect()
    assert [tuple(r) for r in ok] == [(True, True), (False, False), (False, False)]


def test_schedule_is_balanced(spark):
    pairs = spark.range(600).select(F.col("id").alias("pair_id"), (F.col("id") % 7).cast("string").alias("category"), (2 * F.col("id")).alias("answer_a_id"), (2 * F.col("id") + 1).alias("answer_b_id"))
    a = W.assign_presentations(pairs, list("wxyz"))
    gap = a.groupBy("category", "judge").agg(F.abs(F.sum(F.when(F.col("presentation") == "AB", 1).otherwise(-1))).alias("g")).agg(F.max("g")).first()[0]
    assert gap <= 2 and A.validate_schedule(W.pass_schedule(a, pairs)).count() == 0


def test_budget_is_exact_prefix(spark):
    plan = spark.range(1000).select("id", (F.col("id") % 5 + 1).alias("cost"))
    got = W.budget_cutoff(plan, "id", "cost", 100, buckets=7).orderBy("id").collect()
    total = 0
    for r in got:
        total += r.cost
        assert r.running == total and r.included == (total <= 100)


def test_raw_files_to_dataset(spark, tmp_path):
    line = '{"question_id": 1, "turn": %d, "model_a": "m", "model_b": "n", "winner": "model_b", "conversation_a": [{"role":"user","content":"q1"},{"role":"assistant","content":"a1"},{"role":"user","content":"q2"},{"role":"assistant","content":"a2"}], "conversation_b": [{"role":"user","content":"q1"},{"role":"assistant","content":"b1"},{"role":"user","content":"q2"},{"role":"assistant","content":"b2"}]}'
    (tmp_path / "raw.json").write_text("\n".join(line % t for t in (1, 2)))
    src = S.source_rows(io.read_judgments(spark, str(tmp_path / "raw.json")))
    out = S.build_dataset(src)
    assert (out["prompts"].count(), out["answers"].count()) == (2, 4)
    records = src.withColumn("record_id", F.col("turn"))
    assert [r.code for r in S.validate_canonical(records, src).collect()] == ["OK", "OK"]
    assert {r.root_cause for r in S.reconcile(records, src).collect()} == {"ALIGNED"}


def test_metric_files(spark, tmp_path):
    df = spark.createDataFrame([("RQ1", "x", 0.5), ("RQ2", "y", None)], "rq string, metric_name string, value double")
    for fmt in ("csv", "json", "parquet"):
        io.write_metrics(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 2


def test_ranks_of_buckets(spark):
    rows = [(i, None if i % 3 == 0 else str(i % 3), i % 11) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, cell string, twin long").withColumn("d", F.sha2(F.col("twin").cast("string"), 256))
    got = {r.id: r["rank"] for r in W.ranks(df, W.bucket_starts(df, ["cell"], "d"), ["cell"], "d", "id").collect()}
    want = {}
    for cell in (None, "1", "2"):
        kept = sorted((r for r in df.collect() if r.cell == cell), key=lambda r: (r.d, r.id))
        want |= {r.id: k + 1 for k, r in enumerate(kept)}
    assert got == want and len(got) == 900
    assert W.ranks(df.limit(0), W.bucket_starts(df.limit(0), ["cell"], "d"), ["cell"], "d", "id").count() == 0


def test_ranked_rows_are_shuffled_once_without_their_digest(spark):
    order, tie = F.sha2(F.col("twin").cast("string"), 256), F.concat(F.lit("t"), F.col("id").cast("string"))
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("cell"), (F.col("id") % 11).alias("twin"))
    plain = df.withColumn("d", order).withColumn("t", tie)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = W.ranks(df, W.bucket_starts(df, ["cell"], order), ["cell"], order, tie)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4 and "sha2" not in plan[plan.index("SortMergeJoin") :].split("Exchange hashpartitioning")[0]
        want = W.ranks(plain, W.bucket_starts(plain, ["cell"], "d"), ["cell"], "d", "t").drop("d", "t")
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    texts = spark.createDataFrame([(7, 1, 2, "a", "b", "gpt-4", "claude-v1", "TIE"), (8, 3, 4, "a", "b", "vicuna-13b", "gpt-4", None)], "prompt_id long, answer_a_id long, answer_b_id long, text_a string, text_b string, model_a string, model_b string, human_label string")
    key, judges = F.concat_ws("|", "prompt_id", "answer_a_id"), spark.createDataFrame([("gpt-4o-mini",)], "judge string")
    keyed = texts.withColumn("pair_key", key)
    units = [W.units_of_questions(keyed, judges, ["RQ1", "RQ6"], "s", k) for k in (None, key)]
    assert units[0].columns == units[1].columns and len(set(map(tuple, units[1].collect()))) == 3 and units[0].exceptAll(units[1]).count() == 0


def test_balanced_units_take_the_smaller_stratum(spark):
    rows = [(i, "j", "o", None if i < 300 else "x", "SAME" if i % 7 == 0 else "OTHER") for i in range(500)] + [(999, "j", "o", "y", "SAME")]
    df = spark.createDataFrame(rows, "pair_id long, judge string, other_family string, category string, stratum string")
    got = [(r.category, r.stratum, r.n) for r in W.balanced_units(df).groupBy("category", "stratum").agg(F.count("*").alias("n")).collect()]
    assert sorted(got, key=str) == sorted([(None, "SAME", 43), (None, "OTHER", 43), ("x", "SAME", 29), ("x", "OTHER", 29)], key=str)


def test_operating_points_read_once(spark):
    rows = [("j", A_, A_, A_, A_, A_), ("j", B_, A_, B_, B_, B_), ("j", TIE, None, "TIE", A_, B_), ("k", None, B_, None, A_, None)]
    obs = spark.createDataFrame(rows, "judge string, human_label string, baseline_label string, dual_label string, dual_ab_label string, dual_ba_label string")
    points = C.operating_points(obs)
    assert points._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r.judge, r.strategy, r.metric_name): (r.numerator, r.denominator) for r in points.collect()}
    assert len(got) == 3 * (2 * len(C.POINTS) + 2)
    assert got[None, "baseline", "agreement"] == (1, 2) and got["j", "dual_swap", "agreement"] == (3, 3) and got["j", "dual_swap", "dual_pass_disagreement"] == (1, 3)
    assert got["k", "baseline", "failure_rate"] == (0, 1) and got["k", "dual_swap", "failure_rate"] == (1, 1)


def test_spearman_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: seen.add(1) or v, "long")
    points = spark.range(50).select(counted("id").alias("x"), (F.col("id") % 3).alias("y"), (2 * F.col("id")).alias("z"))
    r = D.spearman(points, "x", "z").first()
    assert (r.n, round(r.rho, 12), seen.value) == (50.0, 1.0, 50)
