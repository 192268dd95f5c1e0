"""Agreement, repeatability, order sensitivity, controlled variants and source family.

All are conditional counts over one grouping (or one per linked unit and one per stratum): no
rows of a group are collected, so skewed judges and categories cost a partial sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import DECISIVE, FAILURES, VALID, cases, col, is_valid
from .metrics import Metric, by_groups, label_counters, metric_rows, n_if

STRATA = ((), ("judge",), ("category",))


# Agreement with human labels ------------------------------------------------------------------
def kappa_counts(human: str, judge: str, valid: Column) -> list[Column]:
    """Agreement and the margins of the 3 x 3 table, as counts."""
    h, j = col(human), col(judge)
    agree = n_if(valid & (h == j)).alias("agree")
    margins = [n_if(valid & (c == v)).alias(f"{side}_{v.lower()}") for side, c in (("h", h), ("j", j)) for v in VALID]
    return [n_if(valid).alias("valid_n"), agree, *margins]


EXPECTED = "(" + " + ".join(f"cast(h_{v.lower()} as double) * j_{v.lower()}" for v in VALID) + ") / (cast(valid_n as double) * valid_n)"
#: Null without rows and where the expected agreement is one.
KAPPA = f"case when valid_n > 0 and {EXPECTED} <> 1 then (agree / cast(valid_n as double) - {EXPECTED}) / (1 - {EXPECTED}) end"


def agreement(df: DataFrame, groups=STRATA, human: str = "human_label", judge: str = "judge_label") -> DataFrame:
    """Exact three-class agreement and Cohen's kappa; strata come from all rows, so an empty one shows NO_DATA."""
    valid = is_valid(human) & is_valid(judge)
    wide = by_groups(df, groups, F.count("*").alias("eligible_n"), *kappa_counts(human, judge, valid), *label_counters(judge))
    keys = [k for g in groups for k in g]
    return metric_rows(wide, keys, [Metric("exact_agreement", "agree", "valid_n"), Metric("cohens_kappa", None, "valid_n", value=KAPPA)])


def alignment_report(df: DataFrame, human: str = "human_label", judge: str = "judge_label") -> DataFrame:
    """Rows by reason: ``valid`` or why a row is excluded, with tie counts and tie agreements."""
    h, j = col(human), col(judge)
    reason = cases((~is_valid(h), "missing_human_reference"), (~is_valid(j), F.concat(F.lit("judge_"), F.lower(F.coalesce(j, F.lit("None"))))), otherwise="valid")
    return df.groupBy(reason.alias("reason"), "category").agg(F.count("*").alias("n"), n_if(h == "TIE").alias("human_ties"), n_if(j == "TIE").alias("judge_ties"), n_if((h == "TIE") & (j == "TIE")).alias("tie_agreements"), n_if(is_valid(h) & (h == j)).alias("agreements"))


# Repeatability --------------------------------------------------------------------------------
IDENTITY = ("answer_a_id", "answer_b_id", "judge", "provider", "requested_model", "effective_model", "configured_upstream", "observed_upstream", "routing_policy", "routing_fingerprint", "condition", "temperature", "template", "top_p", "seed_policy")


def repetition_key(df: DataFrame, fields=IDENTITY) -> Column:
    """SHA-256 over the configuration fields; nulls print as None."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields if f in df.columns)), 256)


def repetition_groups(df: DataFrame, identity: list[str], verdict: str = "outcome") -> DataFrame:
    """One row for each group: modal share of valid verdicts, disagreement, failures, retries, completeness."""
    v = col(verdict)
    counts = [n_if(v == x).alias(x.lower()) for x in VALID]
    # rows of one identity are folded first, by counters alone: a distinct count would expand rows, and texts as results would have them sorted
    one = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in identity))
    k = F.col("repetition_index")
    whole = isinstance(df.schema["repetition_index"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    low, high = df.agg(F.min(k), F.max(k)).first() if whole else (None, None)
    sums = [F.sum(c).alias(c) for c in ("n_repetitions", *(x.lower() for x in VALID))]
    if whole and (low is None or (low >= 0 and high < 63)):
        masked = df.select("*", F.when(k.isNotNull(), F.expr("shiftleft(1L, cast(repetition_index as int))")).alias("_bit"))
        seen = masked.groupBy("group_key", one.alias("one"), F.col("judge").alias("_judge")).agg(F.count("*").alias("n_repetitions"), *counts, F.bit_or("_bit").alias("_bits"), F.sum("retry_count").alias("retries"))
        indices = F.coalesce(F.bit_count(F.bit_or("_bits")).cast("long"), F.lit(0)).alias("indices")
    else:
        seen = df.groupBy("group_key", one.alias("one"), F.col("judge").alias("_judge"), "repetition_index").agg(F.count("*").alias("n_repetitions"), *counts, F.sum("retry_count").alias("retries"))
        indices = F.count_distinct("repetition_index").alias("indices")
    g = seen.groupBy("group_key").agg(*sums, indices, F.min("one").alias("lo"), F.max("one").alias("hi"), F.min("_judge").alias("judge"), F.sum("retries").cast("long").alias("retries"))
    valid_n = F.col("answer_a") + F.col("answer_b") + F.col("tie")
    g = g.withColumn("valid_n", valid_n).withColumn("modal", F.greatest("answer_a", "answer_b", "tie")).withColumn("exact", (F.col("lo") == F.col("hi")) & (F.col("indices") == F.col("n_repetitions")))
    rate = F.when(F.col("valid_n") > 0, F.col("modal") / F.col("valid_n"))
    return g.select("group_key", "judge", "n_repetitions", "valid_n", "exact", "retries", rate.alias("consistency_rate"), F.when(F.col("valid_n") > 0, (F.col("valid_n") - F.col("modal")) / F.col("valid_n")).alias("disagreement_rate"), (F.col("n_repetitions") - F.col("valid_n")).alias("failure_or_unknown"), "modal")


def repeatability(df: DataFrame, identity: list[str], expected: int = 5, groups=((), ("judge",)), verdict: str = "outcome") -> DataFrame:
    """Mean modal share over exact complete groups: strict (all verdicts valid) and conditional (any valid)."""
    g = repetition_groups(df, identity, verdict)
    complete = F.col("exact") & (F.col("n_repetitions") == expected) & (F.col("valid_n") > 0)
    # shares are sixtieths at most: exact sums whatever the order of rows
    scaled = F.when(complete, F.col("modal") * 60 / F.col("valid_n")).cast("long")
    strict = complete & (F.col("valid_n") == expected)
    wide = by_groups(g, groups, F.count("*").alias("eligible_n"), n_if(strict).alias("strict_n"), n_if(complete).alias("conditional_n"), F.sum(F.when(strict, scaled)).alias("s60"), F.sum(scaled).alias("c60"))
    empty = "INSUFFICIENT_ELIGIBLE_UNITS"
    keys = [k for x in groups for k in x]
    return metric_rows(wide, keys, [Metric("strict_complete_repetition_consistency", None, "strict_n", empty, "case when strict_n > 0 then s60 / cast(60 * strict_n as double) end"), Metric("conditional_returned_judgment_consistency", None, "conditional_n", empty, "case when conditional_n > 0 then c60 / cast(60 * conditional_n as double) end")])


# Order sensitivity ----------------------------------------------------------------------------
def swap_pairs(passes: DataFrame, keys: list[str], canonical: str = "canonical") -> DataFrame:
    """One row for each pair: mapped outcomes of AB and BA, slot wins, rows and orders seen."""
    at = lambda p: F.max(F.when(F.col("presentation") == p, col(canonical)))
    return passes.groupBy(*keys).agg(at("AB").alias("pass_ab"), at("BA").alias("pass_ba"), n_if(F.col("outcome") == "ANSWER_A").alias("slot_wins_a"), n_if(F.col("outcome") == "ANSWER_B").alias("slot_wins_b"), F.count("*").alias("n_passes"), F.count_distinct("presentation").alias("n_orders"))


def order_sensitivity(pairs: DataFrame, groups=((), ("judge",))) -> DataFrame:
    """Decisive flips, disagreement of valid pairs, absolute slot imbalance and incomplete pairs."""
    a, b = F.col("pass_ab"), F.col("pass_ba")
    decisive = F.coalesce(a.isin(*DECISIVE) & b.isin(*DECISIVE), F.lit(False))
    broad = is_valid(a) & is_valid(b)
    wide = by_groups(pairs, groups, F.count("*").alias("eligible_n"), n_if(decisive).alias("decisive_n"), n_if(decisive & (a != b)).alias("flips"), n_if(broad).alias("broad_n"), n_if(broad & (a != b)).alias("differ"), n_if(a.isNull() | b.isNull()).alias("incomplete"), F.coalesce(F.sum(F.when(decisive, F.col("slot_wins_a"))), F.lit(0)).alias("wa"), F.coalesce(F.sum(F.when(decisive, F.col("slot_wins_b"))), F.lit(0)).alias("wb"), *label_counters("pass_ab", "pass_ba"))
    wide = wide.withColumn("slot_gap", F.abs(F.col("wa") - F.col("wb"))).withColumn("slot_n", F.col("wa") + F.col("wb"))
    return metric_rows(wide, [k for g in groups for k in g], ORDER_METRICS)


ORDER_METRICS = [Metric("paired_decisive_flip_rate", "flips", "decisive_n"), Metric("all_paired_disagreement_rate", "differ", "broad_n"), Metric("slot_win_imbalance", "slot_gap", "slot_n", "NO_DECISIVE_SLOT_OUTCOMES"), Metric("incomplete_pair_count", "incomplete", "eligible_n", value="cast(incomplete as double)")]


def swap_classes(pairs: DataFrame) -> DataFrame:
    """Pairs by class. Incomplete ones (not exactly one AB and one BA) are a class of their own; slot gain is signed."""
    a, b = F.coalesce("pass_ab", F.lit("")), F.coalesce("pass_ba", F.lit(""))
    both = a.isin(*DECISIVE) & b.isin(*DECISIVE)
    fails = [*FAILURES[:4]]
    named = cases(
        ((F.col("n_passes") != 2) | (F.col("n_orders") != 2), "INCOMPLETE"),
        (both & (a == b) & (a == "ANSWER_A"), "CONSISTENT_ORIGINAL_A"),
        (both & (a == b), "CONSISTENT_ORIGINAL_B"),
        (both, "DECISIVE_FLIP"),
        ((a == "TIE") & (b == "TIE"), "TIE_BOTH"),
        ((a == "TIE") | (b == "TIE"), "TIE_DISAGREEMENT"),
        (a.isin(*fails) | b.isin(*fails), "FAILURE_OR_UNKNOWN"),
        otherwise="NONDECISIVE_DISAGREEMENT",
    )
    return pairs.groupBy(named.alias("class")).agg(F.count("*").alias("n"), (F.sum("slot_wins_a") - F.sum("slot_wins_b")).cast("long").alias("signed_slot_gain"))


# Controlled variants --------------------------------------------------------------------------
REASONS = ("deterministic_transform_rejection", "presentation_order_disagreement", "operational_failure", "invalid_or_incomplete_pair")


def variant_pairs(passes: DataFrame, keys: list[str], order: str = "order_no", mapped: str = "mapped", outcome: str = "outcome", valid: str = "transform_valid") -> DataFrame:
    """One row for each unit: stable mapped outcome, or why the unit is excluded (the last cause by pass order)."""
    o = F.coalesce(col(outcome), F.lit("API_ERROR"))
    cause = cases((~col(valid), REASONS[0]), (o.isin(*VALID), None), (o == "INVALID_RESPONSE", REASONS[3]), otherwise=REASONS[2])
    m = col(mapped)
    g = passes.withColumn("_cause", cause).groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("_cause", F.when(F.col("_cause").isNotNull(), F.col(order))).alias("cause"), F.min(m).alias("lo"), F.max(m).alias("hi"), F.count(m).alias("mapped_n"), F.min(valid).alias("transform_valid"))
    stable = (F.col("n") == 2) & (F.col("mapped_n") == 2) & (F.col("lo") == F.col("hi"))
    reason = cases((F.col("n") != 2, REASONS[3]), (F.col("cause").isNotNull(), F.col("cause")), (~stable, REASONS[1]))
    return g.select(*keys, (F.col("transform_valid") & reason.isNull() & stable).alias("variant_valid"), F.when(stable, F.col("lo")).alias("variant_outcome"), "transform_valid", reason.alias("exclusion_reason"))


VARIANT_METRICS = [
    Metric("variant_win_rate", "wins", "analyzed"),
    Metric("original_win_rate", "losses", "analyzed"),
    *(Metric(name, c, "eligible_n", value=f"cast({c} as double)") for name, c in [("excluded_pair_count", "excluded"), *((f"{r}_count", f"x{i}") for i, r in enumerate(REASONS)), ("stable_decisive_pair_count", "decisive"), ("stable_tie_pair_count", "ties")]),
]


def variant_effect(pairs: DataFrame, groups=((), ("judge",))) -> DataFrame:
    """Win rates of variant and original over valid pairs, exclusions by all four reasons, stable counts."""
    v, out = F.col("variant_valid"), F.col("variant_outcome")
    wide = by_groups(pairs, groups, F.count("*").alias("eligible_n"), n_if(v & out.isNotNull()).alias("analyzed"), n_if(v & (out == "VARIANT")).alias("wins"), n_if(v & (out == "ORIGINAL")).alias("losses"), n_if(~v).alias("excluded"), *(n_if(F.col("exclusion_reason") == r).alias(f"x{i}") for i, r in enumerate(REASONS)), n_if(v & out.isin("VARIANT", "ORIGINAL")).alias("decisive"), n_if(v & (out == "TIE")).alias("ties"))
    return metric_rows(wide, [k for g in groups for k in g], VARIANT_METRICS)


# Source family --------------------------------------------------------------------------------
def family_outcomes(df: DataFrame, judge_family: Column, family_a: Column, family_b: Column, label: str = "canonical") -> DataFrame:
    """``outcome`` SELF/OTHER/TIE with ``source_family_complete`` and ``self_slot`` (the slot of the judge's family)."""
    c = col(label)
    won = cases((c == "ANSWER_A", family_a), (c == "ANSWER_B", family_b))
    return df.select("*", cases((c == "TIE", "TIE"), (won.isNull(), None), (won == judge_family, "SELF"), otherwise="OTHER").alias("family_outcome"), (family_a.isNotNull() & family_b.isNotNull()).alias("source_family_complete"), cases((family_a == judge_family, "A"), (family_b == judge_family, "B")).alias("self_slot"))


def family_preference(units: DataFrame, groups=((),)) -> DataFrame:
    """Share of SELF over complete units, or UNBALANCED_PRESENTATION if slots A and B differ by more than one."""
    ok = F.col("source_family_complete") & F.col("family_outcome").isNotNull()
    wide = by_groups(units, groups, F.count("*").alias("eligible_n"), n_if(ok).alias("valid_n"), n_if(ok & (F.col("family_outcome") == "SELF")).alias("self_n"), n_if(ok & (F.col("self_slot") == "A")).alias("slot_a"), n_if(ok & (F.col("self_slot") == "B")).alias("slot_b"))
    balanced = F.abs(F.col("slot_a") - F.col("slot_b")) <= 1
    return wide.select(*[k for g in groups for k in g], "eligible_n", "valid_n", (F.col("eligible_n") - F.col("valid_n")).alias("excluded_n"), "slot_a", "slot_b", F.when(balanced & (F.col("valid_n") > 0), F.col("self_n") / F.col("valid_n")).alias("value"), cases((~balanced, "UNBALANCED_PRESENTATION"), (F.col("valid_n") == 0, "NO_DATA"), otherwise="ESTIMABLE").alias("status"))


def counterbalanced_family(obs: DataFrame, judges: list[str]) -> DataFrame:
    """Stable preferences, disagreement, coverage, abstention, agreement by human stratum, per judge, macro-average.

    ``obs``: ``judge``, ``human_stratum`` (SAME or OTHER), ``pass_ab`` and ``pass_ba`` (SAME, OTHER, TIE, UNKNOWN or null).
    """
    a, b = F.coalesce("pass_ab", F.lit("")), F.coalesce("pass_ba", F.lit(""))
    pair = a.isin("SAME", "OTHER") & b.isin("SAME", "OTHER")
    stable = pair & (a == b)
    counts = [F.count("*").alias("eligible_n"), n_if(stable).alias("stable_n"), n_if(stable & (a == "SAME")).alias("same_n"), n_if(pair).alias("pair_n"), n_if(pair & (a != b)).alias("flip_n"), n_if(a.isin("TIE", "UNKNOWN") | b.isin("TIE", "UNKNOWN")).alias("abstain_n")]
    for s in ("SAME", "OTHER"):
        counts += [n_if(stable & (F.col("human_stratum") == s)).alias(f"{s.lower()}_stable"), n_if(stable & (F.col("human_stratum") == s) & (a == s)).alias(f"{s.lower()}_agree")]
    wide = by_groups(obs, ((), ("judge",)), *counts)
    named = wide.where(F.col("judge").isin(judges) & (F.col("stable_n") > 0))
    macro = named.agg(F.count("*").alias("n"), F.sum(F.col("same_n") / F.col("stable_n")).alias("s")).select(F.lit("equal_weight_judge_macro_average").alias("metric_name"), F.lit(None).cast("string").alias("judge"), F.when(F.col("n") == len(judges), F.col("s") / len(judges)).alias("value"), F.lit(None).cast("long").alias("numerator"), F.col("n").alias("denominator"))
    return metric_rows(wide.withColumn("other_n", F.col("stable_n") - F.col("same_n")), ["judge"], FAMILY_METRICS).select("metric_name", "judge", "value", "numerator", "denominator").unionByName(macro)


FAMILY_METRICS = [
    Metric("stable_same_family_preference", "same_n", "stable_n"),
    Metric("stable_other_family_preference", "other_n", "stable_n"),
    Metric("order_sensitive_disagreement", "flip_n", "pair_n"),
    Metric("valid_stable_decisive_coverage", "stable_n", "eligible_n"),
    Metric("tie_or_abstention_rate", "abstain_n", "eligible_n"),
    Metric("human_reference_agreement_same", "same_agree", "same_stable"),
    Metric("human_reference_agreement_other", "other_agree", "other_stable"),
    Metric("human_reference_agreement_difference", None, "stable_n", value="case when same_stable > 0 and other_stable > 0 then same_agree / cast(same_stable as double) - other_agree / cast(other_stable as double) end"),
]


def self_preference(decisions: DataFrame, judge_family: str, family_a: Column, family_b: Column) -> DataFrame:
    """Counts for self and rival match-ups; match-ups within the judge's own family are ignored."""
    a, b = family_a == judge_family, family_b == judge_family
    won_a, won_b = (F.coalesce(F.col("winner_id") == F.col(c), F.lit(False)) for c in ("answer_a_id", "answer_b_id"))
    g = decisions.agg(n_if(a != b).alias("total_self_matchups"), n_if((a & ~b & won_a) | (b & ~a & won_b)).alias("self_wins"), n_if(~a & ~b).alias("total_other_matchups"), n_if(~a & ~b & won_a).alias("other_wins"))
    rate = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n))
    own, other = rate("self_wins", "total_self_matchups"), rate("other_wins", "total_other_matchups")
    return g.select("*", own.alias("self_win_rate"), other.alias("baseline_win_rate"), F.when(other > 0, own / other).alias("self_preference_ratio"))
