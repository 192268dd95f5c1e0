"""Swap mitigation and multi-judge consensus.

Consensus is built from votes alone; reference labels are attached by a later join, so no
function that decides a consensus takes a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DECISIVE, VOTES, cases, col, dual_swap_label, is_valid
from .estimators import KAPPA, kappa_counts
from .metrics import FIELDS, Metric, by_groups, metric_rows, n_if


# Mitigation -----------------------------------------------------------------------------------
def mitigation_obs(passes: DataFrame, baseline: DataFrame, canonical: str = "canonical", keys=("pair_id", "judge")) -> DataFrame:
    """One row for each (pair, judge): human, baseline, AB and BA labels and the dual-swap label."""
    at = lambda p: F.max(F.when(F.col("presentation") == p, col(canonical)))
    dual = passes.groupBy(*keys).agg(F.max("human_label").alias("human_label"), at("AB").alias("dual_ab_label"), at("BA").alias("dual_ba_label"))
    return dual.join(baseline, list(keys)).withColumn("dual_label", dual_swap_label("dual_ab_label", "dual_ba_label"))


POINTS = [
    Metric("agreement", "agree", "valid_n"),
    Metric("cohens_kappa", None, "valid_n", value=KAPPA),
    Metric("tie_rate", "tie_n", "label_n"),
    Metric("failure_rate", "fail_n", "eligible_n"),
    Metric("coverage", "label_n", "eligible_n"),
    Metric("decisive_coverage", "decisive_n", "eligible_n"),
]


STABILITY = [Metric("dual_pass_disagreement", "differ", "pair_n"), Metric("dual_pass_stability", "same", "pair_n")]


def _label_counts(label: str) -> Column:
    valid, c = is_valid("human_label") & is_valid(label), col(label)
    return F.struct(*kappa_counts("human_label", label, valid), n_if(is_valid(c)).alias("label_n"), n_if(c == "TIE").alias("tie_n"), n_if(~is_valid(c)).alias("fail_n"), n_if(c.isin(*DECISIVE)).alias("decisive_n"))


def operating_points(obs: DataFrame, groups=((), ("judge",))) -> DataFrame:
    """Agreement, kappa, tie and failure rates and coverages of both strategies, and dual-pass stability, from one reading of ``obs``."""
    a, b = F.col("dual_ab_label"), F.col("dual_ba_label")
    both, keys = is_valid(a) & is_valid(b), list(dict.fromkeys(k for g in groups for k in g))
    stable = [n_if(both).alias("pair_n"), n_if(both & (a != b)).alias("differ"), n_if(both & (a == b)).alias("same")]
    wide = by_groups(obs, groups, F.count("*").alias("eligible_n"), *stable, _label_counts("baseline_label").alias("baseline"), _label_counts("dual_label").alias("dual_swap"))
    strategies = F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(f"{s}.*")) for s in ("baseline", "dual_swap")))
    rows = metric_rows(wide.select(*keys, "eligible_n", "pair_n", "differ", "same", F.inline(strategies)), [*keys, "strategy"], POINTS + STABILITY)
    return rows.where((F.col("strategy") == "dual_swap") | ~F.col("metric_name").isin(*(m.name for m in STABILITY))).select(*keys, *FIELDS, "strategy")


def strategy_deltas(points: DataFrame, keys=("judge",)) -> DataFrame:
    """Dual swap minus baseline for each comparable metric; null unless both are finite."""
    at = lambda s: F.max(F.when(F.col("strategy") == s, F.col("value")))
    names = [m.name for m in POINTS]
    g = points.where(F.col("metric_name").isin(names)).groupBy(*keys, "metric_name").agg(at("baseline").alias("b"), at("dual_swap").alias("d"))
    return g.select(*keys, "metric_name", (F.col("d") - F.col("b")).alias("delta"), F.when(F.col("d").isNull() | F.col("b").isNull(), "NOT_ESTIMABLE").otherwise("ESTIMABLE").alias("status"))


def matched_mitigation(obs: DataFrame, groups=((), ("judge",))) -> DataFrame:
    """Both strategies on the units where human, baseline and dual labels are valid; coverage delta over all."""
    h, b, d = F.col("human_label"), F.col("baseline_label"), F.col("dual_label")
    kept = is_valid(h) & is_valid(b) & is_valid(d)
    right_b, right_d = kept & (b == h), kept & (d == h)
    wide = by_groups(obs, groups, F.count("*").alias("eligible_n"), n_if(kept).alias("kept_n"), n_if(right_b).alias("base_ok"), n_if(right_d).alias("dual_ok"), n_if(right_b & ~right_d).alias("base_only"), n_if(right_d & ~right_b).alias("dual_only"), n_if(is_valid(b)).alias("base_valid"), n_if(is_valid(d)).alias("dual_valid"))
    return metric_rows(wide, [k for g in groups for k in g], MATCHED)


MATCHED = [
    Metric("baseline_agreement", "base_ok", "kept_n"),
    Metric("dual_swap_agreement", "dual_ok", "kept_n"),
    Metric("agreement_delta", None, "kept_n", "NO_COMMON_VALID_UNITS", "case when kept_n > 0 then (dual_ok - base_ok) / cast(kept_n as double) end"),
    Metric("coverage_delta", None, "eligible_n", value="case when eligible_n > 0 then dual_valid / cast(eligible_n as double) - base_valid / cast(eligible_n as double) end"),
    Metric("baseline_only_correct_count", None, "kept_n", value="cast(base_only as double)"),
    Metric("dual_swap_only_correct_count", None, "kept_n", value="cast(dual_only as double)"),
]


def preaggregated_delta(df: DataFrame) -> DataFrame:
    """Mean change of each metric that all pairs share (``pair, metric_name, baseline, mitigation``); noise under 1e-12 is 0."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    pairs = df.select(F.count_distinct("pair").alias("pairs"))
    ok = finite("baseline") & finite("mitigation")
    g = df.groupBy("metric_name").agg(F.count_distinct("pair").alias("n"), n_if(ok).alias("used"), F.avg(F.when(ok, F.col("mitigation") - F.col("baseline"))).alias("value"))
    return g.crossJoin(F.broadcast(pairs)).where("n = pairs").select("metric_name", "used", F.when(F.abs("value") < 1e-12, 0.0).otherwise(F.col("value")).alias("value"))


def compare_maps(base: DataFrame, mitigation: DataFrame, key: str = "metric_name", value: str = "value") -> DataFrame:
    """Changes of the keys that both hold with finite values."""
    joined = base.select(key, F.col(value).alias("b")).join(mitigation.select(key, F.col(value).alias("m")), key)
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return joined.where(finite("b") & finite("m")).select(key, (F.col("m") - F.col("b")).alias("change"))


# Consensus ------------------------------------------------------------------------------------
def _counts(votes: DataFrame, key: str, vote: str, also: list[Column] = ()) -> DataFrame:
    v = col(vote)
    return votes.groupBy(key).agg(*(n_if(v == x).alias(f"n{i}") for i, x in enumerate(VOTES)), *also).withColumn("valid_n", F.col("n0") + F.col("n1") + F.col("n2")).withColumn("top", F.greatest("n0", "n1", "n2"))


def _winner(top: Column) -> Column:
    return cases(*((F.col(f"n{i}") == top, v) for i, v in enumerate(VOTES)))


def consensus4(votes: DataFrame, key: str = "pair_id", vote: str = "vote") -> DataFrame:
    """Strict rule over four valid votes: 4-0 and 3-1 have a label, 2-2 and 2-1-1 none; fewer votes are operational."""
    c = _counts(votes, key, vote)
    most, others = F.col("top"), F.greatest(F.least("n0", "n1"), F.least("n1", "n2"), F.least("n0", "n2"))
    pattern = cases((F.col("valid_n") != 4, "OPERATIONAL"), (most == 4, "4-0"), (most == 3, "3-1"), (others == 2, "2-2"), otherwise="2-1-1")
    return c.select(key, "valid_n", pattern.alias("pattern"), F.when((F.col("valid_n") == 4) & (most >= 3), _winner(most)).alias("consensus"))


def consensus3(votes: DataFrame, key: str = "pair_id", vote: str = "vote") -> DataFrame:
    """Sensitivity rule, only for pairs with exactly three valid votes."""
    c = _counts(votes, key, vote).where("valid_n = 3")
    top = F.col("top")
    return c.select(key, cases((top == 3, "3-0"), (top == 2, "2-1"), otherwise="1-1-1").alias("pattern"), F.when(top >= 2, _winner(top)).alias("consensus"))


def ensemble_vote(votes: DataFrame, key: str, verdict: str = "verdict", ok: str = "succeeded") -> DataFrame:
    """Plurality of valid votes: a unique maximum wins, a shared one is a TIE, none is UNKNOWN; failures apart."""
    v, good = col(verdict), col(ok)
    valid = F.coalesce(v.isin("A", "B", "TIE"), F.lit(False))
    g = votes.groupBy(key).agg(*(n_if(good & (v == x)).alias(f"n_{x.lower()}") for x in ("A", "B", "TIE")), n_if(good & ~valid).alias("n_unknown"), n_if(~good).alias("n_failed"))
    top = F.greatest("n_a", "n_b", "n_tie")
    shared = sum((F.col(f"n_{x}") == top).cast("int") for x in ("a", "b", "tie")) > 1
    return g.select("*", cases((top == 0, "UNKNOWN"), (shared, "TIE"), (F.col("n_a") == top, "A"), (F.col("n_b") == top, "B"), otherwise="TIE").alias("consensus"))


def consensus_rates(c: DataFrame) -> DataFrame:
    """Planned, covered, split and operational pairs with their shares, shares of ties and patterns."""
    p, covered = F.col("pattern"), F.col("consensus").isNotNull()
    g = c.agg(F.count("*").alias("planned"), n_if(covered).alias("covered"), n_if(p.isin("2-2", "2-1-1")).alias("split"), n_if(p == "OPERATIONAL").alias("operational"), n_if(F.col("consensus") == "TIE").alias("ties"), *(n_if(p == x).alias("p" + x.replace("-", "")) for x in ("4-0", "3-1", "2-2", "2-1-1")))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    return g.select("*", share("covered", "planned").alias("coverage"), share("split", "planned").alias("split_rate"), share("operational", "planned").alias("operational_rate"), F.when(F.col("planned") > 0, (F.col("planned") - F.col("covered")) / F.col("planned")).alias("abstention_rate"), share("ties", "covered").alias("tie_share"))


def attach_reference(consensus: DataFrame, labels: DataFrame, key: str = "pair_id") -> DataFrame:
    """Reference labels join the finished consensus: the only place where the two meet."""
    return consensus.join(labels.select(key, "reference", *[c for c in ("category",) if c in labels.columns]), key)


def scored_pairs(consensus: DataFrame, votes: DataFrame, labels: DataFrame, judges: list[str], key: str = "pair_id") -> DataFrame:
    """Covered pairs with a valid reference: correctness of the consensus and of each judge, as 0/1 columns."""
    kept = attach_reference(consensus.where("consensus is not null"), labels, key).where(F.col("reference").isin(*VOTES))
    by_judge = votes.groupBy(key).agg(*(F.max(F.when(F.col("judge") == j, F.col("vote"))).alias(f"v{i}") for i, j in enumerate(judges)))
    right = lambda c: F.coalesce((F.col(c) == F.col("reference")).cast("int"), F.lit(0))
    return kept.join(by_judge, key).select(key, *[c for c in ("category",) if c in labels.columns], "pattern", "consensus", right("consensus").alias("ok"), *(right(f"v{i}").alias(f"ok{i}") for i in range(len(judges))), sum(right(f"v{i}") for i in range(len(judges))).alias("n_right"))


def consensus_vs_individual(scored: DataFrame, judges: list[str], groups=((), ("category",))) -> DataFrame:
    """Consensus agreement, each judge's on the same pairs, the equal-weight mean and the matched delta."""
    n = len(judges)
    metrics = [Metric("consensus_agreement", "ok_n", "eligible_n"), *(Metric(f"judge_agreement:{j}", f"j{i}", "eligible_n") for i, j in enumerate(judges)), Metric("equal_weight_agreement", None, "eligible_n", value=f"case when eligible_n > 0 then all_n / cast({n} * eligible_n as double) end"), Metric("consensus_minus_individual", None, "eligible_n", value=f"case when eligible_n > 0 then ({n} * ok_n - all_n) / cast({n} * eligible_n as double) end"), *(Metric(f"consensus_minus_judge:{j}", None, "eligible_n", value=f"case when eligible_n > 0 then (ok_n - j{i}) / cast(eligible_n as double) end") for i, j in enumerate(judges))]
    wide = by_groups(scored, groups, F.count("*").alias("eligible_n"), F.sum("ok").alias("ok_n"), *(F.sum(f"ok{i}").alias(f"j{i}") for i in range(n)), F.sum("n_right").alias("all_n"))
    return metric_rows(wide, [k for g in groups for k in g], metrics)


def gain_loss(scored: DataFrame, n: int) -> DataFrame:
    """Seven descriptive counts of pair-level gains and losses."""
    ok, r = F.col("ok"), F.col("n_right")
    return scored.agg(n_if((ok == 1) & (r < n)).alias("consensus_correct_individual_mean_below_one"), n_if((ok == 0) & (r > 0)).alias("consensus_incorrect_at_least_one_individual_correct"), n_if(r == n).alias("all_individuals_correct"), n_if(r == 0).alias("all_individuals_incorrect"), n_if(n * ok > r).alias("positive_change"), n_if(n * ok < r).alias("negative_change"), n_if(n * ok == r).alias("no_change"))


def retention_funnel(c: DataFrame) -> DataFrame:
    """Planned pairs, with four valid votes, covered, split and incomplete, with shares of planned."""
    g = c.agg(F.count("*").alias("planned"), n_if(F.col("valid_n") == 4).alias("four_valid"), n_if(F.col("consensus").isNotNull()).alias("covered"), n_if((F.col("valid_n") == 4) & F.col("consensus").isNull()).alias("split"), n_if(F.col("valid_n") < 4).alias("incomplete"))
    return g.select(F.inline(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("n"), F.when(F.col("planned") > 0, F.col(s) / F.col("planned")).alias("share")) for i, s in enumerate(("planned", "four_valid", "covered", "split", "incomplete"))))))


def consensus_sensitivity(votes: DataFrame, labels: DataFrame, judges: list[str], key: str = "pair_id") -> DataFrame:
    """Over pairs with four valid votes: omit each judge (three-vote rule), unanimity, decisive only, by strength, by category.

    Omitting a judge takes its vote off the pair's counts, so votes are not multiplied.
    """
    each = [F.max(F.when(F.col("judge") == j, F.col("vote"))).alias(f"v{i}") for i, j in enumerate(judges)]
    c = _counts(votes, key, "vote", each).where("valid_n = 4").join(labels.select(key, "reference", "category"), key).where(F.col("reference").isin(*VOTES))
    right = [F.coalesce((F.col(f"v{i}") == F.col("reference")).cast("int"), F.lit(0)) for i in range(len(judges))]
    total = sum(right)
    four = F.when(F.col("top") >= 3, _winner(F.col("top")))
    views = [("PRIMARY", four, total, 4), ("UNANIMITY", F.when(F.col("top") == 4, _winner(F.col("top"))), total, 4), ("DECISIVE_ONLY", F.when(four != "TIE", four), total, 4), ("STRENGTH_4-0", F.when(F.col("top") == 4, four), total, 4), ("STRENGTH_3-1", F.when(F.col("top") == 3, four), total, 4), *[(F.concat(F.lit("CATEGORY_"), F.col("category")), four, total, 4)]]
    for i, j in enumerate(judges):
        left = [F.col(f"n{k}") - (F.col(f"v{i}") == v).cast("int") for k, v in enumerate(VOTES)]
        top = F.greatest(*left)
        views.append((f"OMIT_{j}", F.when(top >= 2, cases(*((left[k] == top, v) for k, v in enumerate(VOTES)))), total - right[i], 3))
    rows = F.array(*(F.struct((label if isinstance(label, Column) else F.lit(label)).alias("label"), (decision.isNotNull()).cast("int").alias("kept"), F.coalesce((decision == F.col("reference")).cast("int"), F.lit(0)).alias("ok"), F.when(decision.isNotNull(), (12 // n) * individual).otherwise(0).alias("r12")) for label, decision, individual, n in views))
    g = c.select(F.inline(rows)).groupBy("label").agg(F.count("*").alias("eligible_n"), F.sum("kept").alias("retained_n"), F.sum("ok").alias("correct_n"), F.sum("r12").alias("r12"))
    k = F.col("retained_n")
    return g.select("label", "eligible_n", "retained_n", "correct_n", F.when(k > 0, F.col("correct_n") / k).alias("agreement"), F.when(k > 0, F.col("r12") / (12 * k)).alias("individual_baseline"), F.when(k > 0, (12 * F.col("correct_n") - F.col("r12")) / (12 * k)).alias("delta"))


def overlay_votes(historical: DataFrame, corrected: DataFrame, keys=("pair_id", "judge")) -> DataFrame:
    """Corrected votes replace historical ones where a corrected row is present, even if its vote is null (failed)."""
    c = corrected.select(*keys, F.col("vote").alias("_new"), F.lit(True).alias("_there"))
    joined = historical.join(c, list(keys), "full_outer")
    return joined.select(*keys, F.when(F.col("_there"), F.col("_new")).otherwise(F.col("vote")).alias("vote"), F.when(F.col("_there"), "CORRECTED").otherwise("HISTORICAL").alias("source"))
