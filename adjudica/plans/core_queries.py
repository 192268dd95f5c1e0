"""Queries of the controlled analysis: labels, estimators, mitigation, consensus, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import consensus as C
from ..operators import estimators as E
from ..operators.metrics import counters_sql, metric_sql
from .catalog import query
from .fixtures import JUDGES, duck, table

CANON = "case when presentation = 'AB' or outcome not in ('ANSWER_A', 'ANSWER_B') then outcome when outcome = 'ANSWER_A' then 'ANSWER_B' when outcome = 'ANSWER_B' then 'ANSWER_A' end"
VALID_SQL = "coalesce({} in ('ANSWER_A', 'ANSWER_B', 'TIE'), false)"
FAMILY = "case {} when 'gpt-3.5-turbo' then 'OPENAI' when 'gpt-4' then 'OPENAI' when 'claude-v1' then 'ANTHROPIC' when 'llama-13b' then 'META_LLAMA' when 'alpaca-13b' then 'ALPACA' when 'vicuna-13b' then 'VICUNA' end"
JUDGE_FAMILY = "case judge when 'gpt-4o-mini' then 'OPENAI' when 'anthropic/claude-3-haiku' then 'ANTHROPIC' when 'meta-llama/llama-3.3-70b-instruct' then 'META_LLAMA' end"


def canonical_passes(spark, sf_dir):
    return table(spark, sf_dir, "passes").withColumn("canonical", L.to_canonical("outcome", "presentation"))


def kappa_sql(valid: str, h: str, j: str) -> str:
    cells = ", ".join(f"count(*) filter (where {valid} and {c} = '{v}') as {s}_{v.lower()}" for s, c in (("h", h), ("j", j)) for v in L.VALID)
    return f"count(*) filter (where {valid}) as valid_n, count(*) filter (where {valid} and {h} = {j}) as agree, {cells}"


_valid = f"{VALID_SQL.format('human_label')} and {VALID_SQL.format('judge_label')}"


# P1-P16: label projections --------------------------------------------------------------------
@query(duck(f"""select pass_id, {CANON} as canonical, {CANON.replace('presentation', "(case presentation when 'AB' then 'AB' else 'BA' end)")} as by_winner,
  case when outcome = 'TIE' then 'TIE' when outcome not in ('ANSWER_A', 'ANSWER_B') or outcome is null then null when (outcome = 'ANSWER_A') = (presentation = 'AB') then 'ORIGINAL_ANSWER_1' else 'ORIGINAL_ANSWER_2' end as vote,
  case when outcome = 'TIE' then 'TIE' when outcome not in ('ANSWER_A', 'ANSWER_B') or outcome is null then null when (outcome = 'ANSWER_B') = (presentation = 'AB') then 'VARIANT' else 'ORIGINAL' end as variant,
  coalesce(outcome, case when pair_id % 3 = 0 then 'API_ERROR' when pair_id % 3 = 1 then 'TIMEOUT' else 'INVALID_RESPONSE' end) as filled,
  {VALID_SQL.format('outcome')} as valid, coalesce(outcome in ('API_ERROR', 'TIMEOUT'), false) as retryable, case when not {VALID_SQL.format('outcome')} then coalesce(outcome, 'MISSING_PASS') end as excluded_reason,
  case when outcome in ('ANSWER_A', 'ANSWER_B', 'TIE', 'UNKNOWN') then outcome when outcome is not null then 'ERROR' end as raw_verdict,
  case when outcome in ('ANSWER_A', 'ANSWER_B', 'TIE') then 'PARSED' when outcome = 'UNKNOWN' then 'MISSING_RESPONSE' when outcome = 'INVALID_RESPONSE' then 'INVALID' when outcome = 'API_ERROR' then 'PROVIDER_ERROR' else outcome end as parse_status,
  case when outcome in ('ANSWER_A', 'ANSWER_B', 'TIE', 'UNKNOWN') then 'SUCCEEDED' when outcome is not null then 'FAILED' end as run_status from passes"""))
def label_projections(spark, sf_dir):
    df = canonical_passes(spark, sf_dir)
    ab = F.col("presentation") == "AB"
    a, b = F.when(ab, F.col("answer_a_id")).otherwise(F.col("answer_b_id")), F.when(ab, F.col("answer_b_id")).otherwise(F.col("answer_a_id"))
    winner = L.cases((F.col("outcome") == "ANSWER_A", a), (F.col("outcome") == "ANSWER_B", b))
    m, s = L.outcome_semantics("outcome"), L.storage_status("outcome")
    status = L.cases((F.col("pair_id") % 3 == 0, "PROVIDER_ERROR"), (F.col("pair_id") % 3 == 1, "TIMEOUT"), otherwise="INVALID")
    return df.select("pass_id", "canonical", L.map_by_winner("outcome", winner, "answer_a_id", "answer_b_id").alias("by_winner"), L.map_vote("outcome", a, b, "answer_a_id", "answer_b_id").alias("vote"), L.variant_outcome("outcome", "presentation").alias("variant"), L.pass_outcome("outcome", F.lit(None).cast("string"), status).alias("filled"), m["valid"].alias("valid"), m["retryable"].alias("retryable"), m["excluded_reason"].alias("excluded_reason"), s["raw_verdict"].alias("raw_verdict"), s["parse_status"].alias("parse_status"), s["run_status"].alias("run_status"))


_dual = "case when a = b and a in ('ANSWER_A', 'ANSWER_B', 'TIE') then a when a is null or b is null then null when a not in ('ANSWER_A', 'ANSWER_B', 'TIE') or b not in ('ANSWER_A', 'ANSWER_B', 'TIE') then 'API_ERROR' else 'MISSING_PASS' end"
_duals = f"canon as (select pair_id, judge, presentation, outcome, human_label, {CANON} as canonical from passes), dual as (select pair_id, judge, max(human_label) as human_label, max(canonical) filter (where presentation = 'AB') as a, max(canonical) filter (where presentation = 'BA') as b, count(*) filter (where outcome = 'ANSWER_A') as wa, count(*) filter (where outcome = 'ANSWER_B') as wb from canon group by 1, 2)"


@query(duck(f"""with {_duals}, d as (select *, case when a in ('ANSWER_A', 'ANSWER_B') and b in ('ANSWER_A', 'ANSWER_B') then case when a = b then 'CONSISTENT' else 'DISAGREEMENT' end
  when a = 'TIE' and b = 'TIE' then 'CONSISTENT_TIE' when a = 'UNKNOWN' and b = 'UNKNOWN' then 'CONSISTENT_UNKNOWN' else 'PARTIAL_OR_NONDECISIVE' end as decision from dual)
  select pair_id, judge, {_dual} as dual_label, decision, case decision when 'CONSISTENT' then 'SAME_DECISIVE_WINNER' when 'DISAGREEMENT' then 'DECISIVE_FLIP' when 'PARTIAL_OR_NONDECISIVE' then 'PARTIAL_EXECUTION' else decision end as stored,
  case when coalesce(a = b, false) then a else 'TIE' end as sandbox_verdict, not coalesce(a = b, false) as position_bias_detected from d"""))
def dual_pass_decisions(spark, sf_dir):
    pairs = E.swap_pairs(canonical_passes(spark, sf_dir), ["pair_id", "judge"])
    box = L.sandbox_dual("pass_ab", "pass_ba")
    d = pairs.withColumn("decision", L.dual_pass_decision("pass_ab", "pass_ba"))
    return d.select("pair_id", "judge", L.dual_swap_label("pass_ab", "pass_ba").alias("dual_label"), "decision", L.stored_decision("decision").alias("stored"), box["verdict"].alias("sandbox_verdict"), box["position_bias_detected"].alias("position_bias_detected"))


@query(duck("""select preference_id, case when winner_id is null then 'TIE' when winner_id = answer_a_id then 'ANSWER_A' when winner_id = answer_b_id then 'ANSWER_B' end as label,
  case when winner_id = answer_a_id then 1.0::double when winner_id = answer_b_id then 0.0::double else 0.5::double end as win_value, case preference_id % 4 when 0 then 'ANSWER_A' when 1 then 'ANSWER_B' when 2 then 'TIE' end as upstream,
  case when score >= 0.5 then 'Top Tier' when score >= 0 then 'Competitive' when score >= -1 then 'Below Average' else 'Weak' end as tier, case when preference_id % 5 = 0 then 'LIVE_SANDBOX' else 'LEGACY_EXPLORATORY' end as evidence
  from (select *, preference_id % 9 / 2.0 - 2 as score from preferences)"""))
def preference_labels(spark, sf_dir):
    df = table(spark, sf_dir, "preferences")
    k = F.col("preference_id")
    upstream = L.cases((k % 4 == 0, "model_a"), (k % 4 == 1, "model_b"), (k % 4 == 2, "tie"), otherwise="?")
    return df.select("preference_id", L.winner_id_to_label("winner_id", "answer_a_id", "answer_b_id").alias("label"), L.win_value("winner_id", "answer_a_id", "answer_b_id").alias("win_value"), L.winner_to_label(upstream).alias("upstream"), L.quality_tier(k % 9 / 2.0 - 2).alias("tier"), L.evidence_class(F.when(k % 5 == 0, "live").otherwise("math")).alias("evidence"))


# E1-E5 ----------------------------------------------------------------------------------------
_labelled = f"labelled as (select judge, category, human_label, {CANON} as judge_label from passes)"
_AGREEMENT = duck(f"with {_labelled}, " + metric_sql(f"select judge, category, count(*) as eligible_n, {kappa_sql(_valid, 'human_label', 'judge_label')}, {counters_sql('judge_label')} from labelled group by grouping sets ((), (judge), (category))", ["judge", "category"], [E.Metric("exact_agreement", "agree", "valid_n"), E.Metric("cohens_kappa", None, "valid_n", value=E.KAPPA)]))


@query(_AGREEMENT)
def agreement(spark, sf_dir):
    return E.agreement(canonical_passes(spark, sf_dir).withColumnRenamed("canonical", "judge_label"))


@query(duck(f"""with {_labelled} select case when not {VALID_SQL.format('human_label')} then 'missing_human_reference' when not {VALID_SQL.format('judge_label')} then 'judge_' || lower(coalesce(judge_label, 'None')) else 'valid' end as reason, category, count(*) as n,
  count(*) filter (where human_label = 'TIE') as human_ties, count(*) filter (where judge_label = 'TIE') as judge_ties, count(*) filter (where human_label = 'TIE' and judge_label = 'TIE') as tie_agreements, count(*) filter (where human_label = judge_label) as agreements from labelled group by 1, 2"""))
def alignment_report(spark, sf_dir):
    return E.alignment_report(canonical_passes(spark, sf_dir).withColumnRenamed("canonical", "judge_label"))


# E6-E8 ----------------------------------------------------------------------------------------
_groups = """g as (select group_key, judge, count(*) as n_repetitions, count(*) filter (where outcome = 'ANSWER_A') as na, count(*) filter (where outcome = 'ANSWER_B') as nb, count(*) filter (where outcome = 'TIE') as nt,
  count(distinct repetition_index) as indices, count(distinct route) as routes, cast(sum(retry_count) as bigint) as retries from repetitions group by 1, 2),
  h as (select group_key, judge, n_repetitions, na + nb + nt as valid_n, greatest(na, nb, nt) as modal, indices = n_repetitions and routes = 1 as exact, retries from g)"""


@query(duck(f"with {_groups} select group_key, judge, n_repetitions, valid_n, exact, retries, case when valid_n > 0 then modal / cast(valid_n as double) end as consistency_rate, case when valid_n > 0 then (valid_n - modal) / cast(valid_n as double) end as disagreement_rate, n_repetitions - valid_n as failure_or_unknown, modal from h"))
def repetition_groups(spark, sf_dir):
    return E.repetition_groups(table(spark, sf_dir, "repetitions"), ["answer_a_id", "answer_b_id", "judge", "route"])


_rep_metrics = [E.Metric("strict_complete_repetition_consistency", None, "strict_n", "INSUFFICIENT_ELIGIBLE_UNITS", "case when strict_n > 0 then s60 / cast(60 * strict_n as double) end"), E.Metric("conditional_returned_judgment_consistency", None, "conditional_n", "INSUFFICIENT_ELIGIBLE_UNITS", "case when conditional_n > 0 then c60 / cast(60 * conditional_n as double) end")]


@query(duck(f"with {_groups}, " + metric_sql("select judge, count(*) as eligible_n, count(*) filter (where ok and valid_n = 5) as strict_n, count(*) filter (where ok) as conditional_n, sum(modal * 60 // nullif(valid_n, 0)) filter (where ok and valid_n = 5) as s60, sum(modal * 60 // nullif(valid_n, 0)) filter (where ok) as c60 from (select *, exact and n_repetitions = 5 and valid_n > 0 as ok from h) group by grouping sets ((), (judge))", ["judge"], _rep_metrics, ())))
def repeatability(spark, sf_dir):
    return E.repeatability(table(spark, sf_dir, "repetitions"), ["answer_a_id", "answer_b_id", "judge", "route"])


@query(duck("select distinct group_key, sha256(cast(answer_a_id as string) || '|' || cast(answer_b_id as string) || '|' || judge || '|' || route || '|None') as key from (select group_key, answer_a_id, answer_b_id, judge, route from repetitions)"))
def repetition_keys(spark, sf_dir):
    df = table(spark, sf_dir, "repetitions").withColumn("none", F.lit(None).cast("string"))
    return df.select("group_key", E.repetition_key(df, ["answer_a_id", "answer_b_id", "judge", "route", "none"]).alias("key")).distinct()


# E9-E10 ---------------------------------------------------------------------------------------
_dec = "(a in ('ANSWER_A', 'ANSWER_B') and b in ('ANSWER_A', 'ANSWER_B'))"
_broad = f"({VALID_SQL.format('a')} and {VALID_SQL.format('b')})"
_order_wide = f"select judge, count(*) as eligible_n, count(*) filter (where {_dec}) as decisive_n, count(*) filter (where {_dec} and a <> b) as flips, count(*) filter (where {_broad}) as broad_n, count(*) filter (where {_broad} and a <> b) as differ, count(*) filter (where a is null or b is null) as incomplete, abs(coalesce(sum(wa) filter (where {_dec}), 0) - coalesce(sum(wb) filter (where {_dec}), 0)) as slot_gap, coalesce(sum(wa + wb) filter (where {_dec}), 0) as slot_n, {counters_sql('a', 'b')} from dual group by grouping sets ((), (judge))"


@query(duck(f"with {_duals}, " + metric_sql(_order_wide, ["judge"], E.ORDER_METRICS)))
def order_sensitivity(spark, sf_dir):
    return E.order_sensitivity(E.swap_pairs(canonical_passes(spark, sf_dir), ["pair_id", "judge"]))


@query(duck(f"""with canon as (select pair_id, judge, presentation, outcome, {CANON} as canonical from passes where not (presentation = 'BA' and pair_id % 11 = 0)),
  dual as (select pair_id, judge, coalesce(max(canonical) filter (where presentation = 'AB'), '') as a, coalesce(max(canonical) filter (where presentation = 'BA'), '') as b, count(*) as n, count(distinct presentation) as o, count(*) filter (where outcome = 'ANSWER_A') - count(*) filter (where outcome = 'ANSWER_B') as gain from canon group by 1, 2)
  select case when n <> 2 or o <> 2 then 'INCOMPLETE' when {_dec} then case when a = b then case a when 'ANSWER_A' then 'CONSISTENT_ORIGINAL_A' else 'CONSISTENT_ORIGINAL_B' end else 'DECISIVE_FLIP' end when a = 'TIE' and b = 'TIE' then 'TIE_BOTH' when a = 'TIE' or b = 'TIE' then 'TIE_DISAGREEMENT'
  when a in ('UNKNOWN', 'INVALID_RESPONSE', 'API_ERROR', 'TIMEOUT') or b in ('UNKNOWN', 'INVALID_RESPONSE', 'API_ERROR', 'TIMEOUT') then 'FAILURE_OR_UNKNOWN' else 'NONDECISIVE_DISAGREEMENT' end as class, count(*) as n, cast(sum(gain) as bigint) as signed_slot_gain from dual group by 1"""))
def swap_classes(spark, sf_dir):
    passes = canonical_passes(spark, sf_dir).where(~((F.col("presentation") == "BA") & (F.col("pair_id") % 11 == 0)))
    return E.swap_classes(E.swap_pairs(passes, ["pair_id", "judge"]))


# E11-E12, P8 ----------------------------------------------------------------------------------
_vp = """mapped as (select doc_id, judge, order_no, case when outcome = 'TIE' then 'TIE' when outcome not in ('ANSWER_A', 'ANSWER_B') or outcome is null then null when (outcome = 'ANSWER_B') = (presentation = 'AB') then 'VARIANT' else 'ORIGINAL' end as m, doc_id % 17 > 0 as tv,
  case when doc_id % 17 = 0 then 'deterministic_transform_rejection' when outcome in ('ANSWER_A', 'ANSWER_B', 'TIE') then null when outcome = 'INVALID_RESPONSE' then 'invalid_or_incomplete_pair' else 'operational_failure' end as cause from variants),
  vg as (select doc_id, judge, count(*) as n, max_by(cause, order_no) filter (where cause is not null) as cause, min(m) as lo, max(m) as hi, count(m) as k, bool_and(tv) as tv from mapped group by 1, 2),
  vp as (select doc_id, judge, tv, case when n <> 2 then 'invalid_or_incomplete_pair' when cause is not null then cause when not (k = 2 and lo = hi) then 'presentation_order_disagreement' end as reason, case when n = 2 and k = 2 and lo = hi then lo end as outcome from vg)"""


def _variant_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "variants").withColumn("mapped", L.variant_outcome("outcome", "presentation")).withColumn("transform_valid", F.col("doc_id") % 17 > 0)
    return E.variant_pairs(v.drop("text"), ["doc_id", "judge"])


@query(duck(f"with {_vp} select doc_id, judge, tv and reason is null and outcome is not null as variant_valid, outcome as variant_outcome, tv as transform_valid, reason as exclusion_reason from vp"))
def variant_pairs(spark, sf_dir):
    return _variant_pairs(spark, sf_dir)


_vw = "select judge, count(*) as eligible_n, count(*) filter (where ok) as analyzed, count(*) filter (where ok and outcome = 'VARIANT') as wins, count(*) filter (where ok and outcome = 'ORIGINAL') as losses, count(*) filter (where not ok) as excluded, " + ", ".join(f"count(*) filter (where reason = '{r}') as x{i}" for i, r in enumerate(E.REASONS)) + ", count(*) filter (where ok and outcome <> 'TIE') as decisive, count(*) filter (where ok and outcome = 'TIE') as ties from (select *, tv and reason is null and outcome is not null as ok from vp) group by grouping sets ((), (judge))"


@query(duck(f"with {_vp}, " + metric_sql(_vw, ["judge"], E.VARIANT_METRICS, ())))
def variant_effect(spark, sf_dir):
    return E.variant_effect(_variant_pairs(spark, sf_dir))


# E13-E17 --------------------------------------------------------------------------------------
_fam = f"fam as (select pair_id, judge, category, {JUDGE_FAMILY} as jf, {FAMILY.format('model_a')} as fa, {FAMILY.format('model_b')} as fb, {CANON} as canonical from passes where presentation = 'AB' and judge <> 'deepseek/deepseek-chat'), one as (select *, case when canonical = 'TIE' then 'TIE' when canonical = 'ANSWER_A' then case when fa = jf then 'SELF' else 'OTHER' end when canonical = 'ANSWER_B' then case when fb = jf then 'SELF' else 'OTHER' end end as outcome, case when fa = jf then 'A' when fb = jf then 'B' end as slot from fam where (fa = jf) <> (fb = jf))"


@query(duck(f"""with {_fam}, w as (select judge, count(*) as eligible_n, count(*) filter (where outcome is not null) as valid_n, count(*) filter (where outcome = 'SELF') as self_n, count(*) filter (where outcome is not null and slot = 'A') as slot_a, count(*) filter (where outcome is not null and slot = 'B') as slot_b from one group by grouping sets ((), (judge)))
  select judge, eligible_n, valid_n, eligible_n - valid_n as excluded_n, slot_a, slot_b, case when abs(slot_a - slot_b) <= 1 and valid_n > 0 then self_n / cast(valid_n as double) end as value, case when abs(slot_a - slot_b) > 1 then 'UNBALANCED_PRESENTATION' when valid_n = 0 then 'NO_DATA' else 'ESTIMABLE' end as status from w"""))
def family_preference(spark, sf_dir):
    from ..functions.text import judge_family, source_family

    df = canonical_passes(spark, sf_dir).where("presentation = 'AB' and judge <> 'deepseek/deepseek-chat'")
    jf, fa, fb = judge_family("judge"), source_family("model_a"), source_family("model_b")
    return E.family_preference(E.family_outcomes(df.where((fa == jf) != (fb == jf)), jf, fa, fb), ((), ("judge",)))


_cb = f"""cb0 as (select pair_id, judge, human_label, presentation, {JUDGE_FAMILY} as jf, {FAMILY.format('model_a')} as fa, {FAMILY.format('model_b')} as fb, {CANON} as canonical from passes where judge <> 'deepseek/deepseek-chat' and human_label in ('ANSWER_A', 'ANSWER_B')),
  cb1 as (select *, case when canonical in ('TIE', 'UNKNOWN') then canonical when canonical in ('ANSWER_A', 'ANSWER_B') then case when (canonical = 'ANSWER_A') = (fa = jf) then 'SAME' else 'OTHER' end end as o, case when (human_label = 'ANSWER_A') = (fa = jf) then 'SAME' else 'OTHER' end as hs from cb0 where (fa = jf) <> (fb = jf)),
  cb as (select pair_id, judge, max(hs) as hs, coalesce(max(o) filter (where presentation = 'AB'), '') as a, coalesce(max(o) filter (where presentation = 'BA'), '') as b from cb1 group by 1, 2),
  cbs as (select *, a in ('SAME', 'OTHER') and b in ('SAME', 'OTHER') as pair from cb)"""
_cbw = "select judge, count(*) as eligible_n, count(*) filter (where pair and a = b) as stable_n, count(*) filter (where pair and a = b and a = 'SAME') as same_n, count(*) filter (where pair and a = b and a = 'OTHER') as other_n, count(*) filter (where pair) as pair_n, count(*) filter (where pair and a <> b) as flip_n, count(*) filter (where a in ('TIE', 'UNKNOWN') or b in ('TIE', 'UNKNOWN')) as abstain_n, count(*) filter (where pair and a = b and hs = 'SAME') as same_stable, count(*) filter (where pair and a = b and hs = 'SAME' and a = 'SAME') as same_agree, count(*) filter (where pair and a = b and hs = 'OTHER') as other_stable, count(*) filter (where pair and a = b and hs = 'OTHER' and a = 'OTHER') as other_agree from cbs group by grouping sets ((), (judge))"
_in_scope = [j for j in JUDGES if "deepseek" not in j]


@query(duck(f"with {_cb}, " + metric_sql(_cbw, ["judge"], E.FAMILY_METRICS, ()).replace("wide as (", "wide as materialized (", 1).replace(" select judge", " , mm as (select judge", 1) + f") select metric_name, judge, value, numerator, denominator from mm union all select 'equal_weight_judge_macro_average', null, case when count(*) = {len(_in_scope)} then sum(same_n / cast(stable_n as double)) / {len(_in_scope)} end, null, count(*) from wide where judge is not null and stable_n > 0"))
def counterbalanced_family(spark, sf_dir):
    from ..functions.text import judge_family, source_family

    df = canonical_passes(spark, sf_dir).where("judge <> 'deepseek/deepseek-chat' and human_label in ('ANSWER_A', 'ANSWER_B')")
    jf, fa, fb = judge_family("judge"), source_family("model_a"), source_family("model_b")
    df = df.where((fa == jf) != (fb == jf))
    mapped = L.cases((F.col("canonical").isin("TIE", "UNKNOWN"), F.col("canonical")), (F.col("canonical").isin(*L.DECISIVE), F.when((F.col("canonical") == "ANSWER_A") == (fa == jf), "SAME").otherwise("OTHER")))
    df = df.select("pair_id", "judge", "presentation", mapped.alias("o"), F.when((F.col("human_label") == "ANSWER_A") == (fa == jf), "SAME").otherwise("OTHER").alias("hs"))
    at = lambda p: F.max(F.when(F.col("presentation") == p, F.col("o")))
    obs = df.groupBy("pair_id", "judge").agg(F.max("hs").alias("human_stratum"), at("AB").alias("pass_ab"), at("BA").alias("pass_ba"))
    return E.counterbalanced_family(obs, _in_scope)


_mf = "case when lower({0}) like '%gpt%' or lower({0}) like '%openai%' then 'gpt' when lower({0}) like '%llama%' or lower({0}) like '%meta%' then 'llama' when lower({0}) like '%deepseek%' then 'deepseek' when lower({0}) like '%claude%' or lower({0}) like '%anthropic%' then 'claude' when lower({0}) like '%vicuna%' then 'vicuna' else split_part(split_part(lower({0}), '/', 1), '-', 1) end"


@query(duck(f"""with d as (select *, {_mf.format('model_a')} = 'gpt' as sa, {_mf.format('model_b')} = 'gpt' as sb, coalesce(winner_id = answer_a_id, false) as wa, coalesce(winner_id = answer_b_id, false) as wb from decisions where judge_model_name = 'gpt-4o-mini' and category <> 'live'),
  g as (select count(*) filter (where sa <> sb) as total_self_matchups, count(*) filter (where (sa and not sb and wa) or (sb and not sa and wb)) as self_wins, count(*) filter (where not sa and not sb) as total_other_matchups, count(*) filter (where not sa and not sb and wa) as other_wins from d)
  select *, self_wins / cast(total_self_matchups as double) as self_win_rate, other_wins / cast(total_other_matchups as double) as baseline_win_rate, (self_wins / cast(total_self_matchups as double)) / (other_wins / cast(total_other_matchups as double)) as self_preference_ratio from g"""))
def self_preference(spark, sf_dir):
    from ..functions.text import model_family

    d = table(spark, sf_dir, "decisions").where((F.col("judge_model_name") == "gpt-4o-mini") & ~F.col("category").isin(*L.SANDBOX))
    return E.self_preference(d, "gpt", model_family("model_a"), model_family("model_b"))


# M1-M6 ----------------------------------------------------------------------------------------
_obs = f"{_duals}, obs as (select d.pair_id, d.judge, human_label, a as dual_ab_label, b as dual_ba_label, baseline_label, {_dual} as dual_label from dual d join baseline using (pair_id, judge))"


def _mitigation(spark, sf_dir):
    return C.mitigation_obs(canonical_passes(spark, sf_dir), table(spark, sf_dir, "baseline"))


@query(duck(f"with {_obs} select * from obs"))
def mitigation_obs(spark, sf_dir):
    return _mitigation(spark, sf_dir)


def _points_sql(label: str, strategy: str) -> str:
    valid = f"{VALID_SQL.format('human_label')} and {VALID_SQL.format(label)}"
    wide = f"select judge, count(*) as eligible_n, {kappa_sql(valid, 'human_label', label)}, count(*) filter (where {VALID_SQL.format(label)}) as label_n, count(*) filter (where {label} = 'TIE') as tie_n, count(*) filter (where not {VALID_SQL.format(label)}) as fail_n, count(*) filter (where {label} in ('ANSWER_A', 'ANSWER_B')) as decisive_n from obs group by grouping sets ((), (judge))"
    return f"select *, '{strategy}' as strategy from (with {metric_sql(wide, ['judge'], C.POINTS, ())})"


_pp = f"({VALID_SQL.format('dual_ab_label')} and {VALID_SQL.format('dual_ba_label')})"
_stab = "select *, 'dual_swap' as strategy from (with " + metric_sql(f"select judge, count(*) as eligible_n, count(*) filter (where {_pp}) as pair_n, count(*) filter (where {_pp} and dual_ab_label <> dual_ba_label) as differ, count(*) filter (where {_pp} and dual_ab_label = dual_ba_label) as same from obs group by grouping sets ((), (judge))", ["judge"], [E.Metric("dual_pass_disagreement", "differ", "pair_n"), E.Metric("dual_pass_stability", "same", "pair_n")], ()) + ")"
_points = f"{_points_sql('baseline_label', 'baseline')} union all {_points_sql('dual_label', 'dual_swap')}"


@query(duck(f"with {_obs} {_points} union all {_stab}"))
def operating_points(spark, sf_dir):
    return C.operating_points(_mitigation(spark, sf_dir))


@query(duck(f"with {_obs}, pts as ({_points}) select judge, metric_name, max(value) filter (where strategy = 'dual_swap') - max(value) filter (where strategy = 'baseline') as delta, case when max(value) filter (where strategy = 'dual_swap') is null or max(value) filter (where strategy = 'baseline') is null then 'NOT_ESTIMABLE' else 'ESTIMABLE' end as status from pts group by 1, 2"))
def strategy_deltas(spark, sf_dir):
    return C.strategy_deltas(C.operating_points(_mitigation(spark, sf_dir)))


_k = f"({VALID_SQL.format('human_label')} and {VALID_SQL.format('baseline_label')} and {VALID_SQL.format('dual_label')})"
_mw = f"select judge, count(*) as eligible_n, count(*) filter (where {_k}) as kept_n, count(*) filter (where {_k} and baseline_label = human_label) as base_ok, count(*) filter (where {_k} and dual_label = human_label) as dual_ok, count(*) filter (where {_k} and baseline_label = human_label and dual_label <> human_label) as base_only, count(*) filter (where {_k} and baseline_label <> human_label and dual_label = human_label) as dual_only, count(*) filter (where {VALID_SQL.format('baseline_label')}) as base_valid, count(*) filter (where {VALID_SQL.format('dual_label')}) as dual_valid from obs group by grouping sets ((), (judge))"


@query(duck(f"with {_obs}, " + metric_sql(_mw, ["judge"], C.MATCHED, ())))
def matched_mitigation(spark, sf_dir):
    return C.matched_mitigation(_mitigation(spark, sf_dir))


# M7-M16 ---------------------------------------------------------------------------------------
_VOTE = "case when outcome = 'TIE' then 'TIE' when outcome not in ('ANSWER_A', 'ANSWER_B') or outcome is null then null when (outcome = 'ANSWER_A') = (presentation = 'AB') then 'ORIGINAL_ANSWER_1' else 'ORIGINAL_ANSWER_2' end"
_ballots = f"ballots as (select pair_id, category, judge, human_label, {_VOTE} as vote from votes)"
_cnt = "cnt as (select pair_id, count(*) filter (where vote = 'ORIGINAL_ANSWER_1') as n0, count(*) filter (where vote = 'ORIGINAL_ANSWER_2') as n1, count(*) filter (where vote = 'TIE') as n2 from ballots group by 1), top as (select *, n0 + n1 + n2 as valid_n, greatest(n0, n1, n2) as t from cnt)"
_win = "case when n0 = t then 'ORIGINAL_ANSWER_1' when n1 = t then 'ORIGINAL_ANSWER_2' else 'TIE' end"
_con = f"{_ballots}, {_cnt}, con as (select pair_id, valid_n, case when valid_n <> 4 then 'OPERATIONAL' when t = 4 then '4-0' when t = 3 then '3-1' when n0 in (0, 2) and n1 in (0, 2) and n2 in (0, 2) then '2-2' else '2-1-1' end as pattern, case when valid_n = 4 and t >= 3 then {_win} end as consensus from top)"
_ref = "ref as (select distinct pair_id, category, case human_label when 'ANSWER_A' then 'ORIGINAL_ANSWER_1' when 'ANSWER_B' then 'ORIGINAL_ANSWER_2' else human_label end as reference from ballots)"


def ballots(spark, sf_dir):
    v = table(spark, sf_dir, "votes")
    ab = F.col("presentation") == "AB"
    a, b = F.when(ab, F.col("answer_a_id")).otherwise(F.col("answer_b_id")), F.when(ab, F.col("answer_b_id")).otherwise(F.col("answer_a_id"))
    return v.select("pair_id", "category", "judge", "human_label", L.map_vote("outcome", a, b, "answer_a_id", "answer_b_id").alias("vote"))


def references(v):
    label = L.cases((F.col("human_label") == "ANSWER_A", "ORIGINAL_ANSWER_1"), (F.col("human_label") == "ANSWER_B", "ORIGINAL_ANSWER_2"), otherwise=F.col("human_label"))
    return v.select("pair_id", "category", label.alias("reference")).distinct()


@query(duck(f"with {_con} select * from con"))
def consensus4(spark, sf_dir):
    return C.consensus4(ballots(spark, sf_dir))


@query(duck(f"with {_ballots}, {_cnt} select pair_id, case t when 3 then '3-0' when 2 then '2-1' else '1-1-1' end as pattern, case when t >= 2 then {_win} end as consensus from top where valid_n = 3"))
def consensus3(spark, sf_dir):
    return C.consensus3(ballots(spark, sf_dir))


@query(duck(f"""with e as (select pair_id, count(*) filter (where outcome = 'ANSWER_A') as n_a, count(*) filter (where outcome = 'ANSWER_B') as n_b, count(*) filter (where outcome = 'TIE') as n_tie, count(*) filter (where outcome in ('UNKNOWN', 'INVALID_RESPONSE')) as n_unknown, count(*) filter (where outcome is null or outcome in ('API_ERROR', 'TIMEOUT', 'REFUSAL')) as n_failed from votes group by 1)
  select *, case when greatest(n_a, n_b, n_tie) = 0 then 'UNKNOWN' when n_a > n_b and n_a > n_tie then 'A' when n_b > n_a and n_b > n_tie then 'B' else 'TIE' end as consensus from e"""))
def ensemble_vote(spark, sf_dir):
    ok = ~F.coalesce(F.col("outcome").isin("API_ERROR", "TIMEOUT", "REFUSAL"), F.lit(True))
    return C.ensemble_vote(table(spark, sf_dir, "votes").select("pair_id", F.replace("outcome", F.lit("ANSWER_"), F.lit("")).alias("verdict"), ok.alias("succeeded")), "pair_id")


_share = lambda a, b: f"case when {b} > 0 then {a} / cast({b} as double) end"


@query(duck(f"with {_con}, g as (select count(*) as planned, count(consensus) as covered, count(*) filter (where pattern in ('2-2', '2-1-1')) as split, count(*) filter (where pattern = 'OPERATIONAL') as operational, count(*) filter (where consensus = 'TIE') as ties, count(*) filter (where pattern = '4-0') as p40, count(*) filter (where pattern = '3-1') as p31, count(*) filter (where pattern = '2-2') as p22, count(*) filter (where pattern = '2-1-1') as p211 from con) select *, {_share('covered', 'planned')} as coverage, {_share('split', 'planned')} as split_rate, {_share('operational', 'planned')} as operational_rate, {_share('(planned - covered)', 'planned')} as abstention_rate, {_share('ties', 'covered')} as tie_share from g"))
def consensus_rates(spark, sf_dir):
    return C.consensus_rates(C.consensus4(ballots(spark, sf_dir)))


_sc = f"{_con}, {_ref}, bj as (select pair_id, " + ", ".join(f"max(vote) filter (where judge = '{j}') as v{i}" for i, j in enumerate(JUDGES)) + " from ballots group by 1), sc as (select con.pair_id, category, pattern, consensus, cast(consensus = reference as int) as ok, " + ", ".join(f"coalesce(cast(v{i} = reference as int), 0) as ok{i}" for i in range(4)) + ", " + " + ".join(f"coalesce(cast(v{i} = reference as int), 0)" for i in range(4)) + " as n_right from con join ref using (pair_id) join bj using (pair_id) where consensus is not null and reference is not null)"


def scored(spark, sf_dir):
    v = ballots(spark, sf_dir)
    return C.scored_pairs(C.consensus4(v), v, references(v), list(JUDGES))


_cvi = [E.Metric("consensus_agreement", "ok_n", "eligible_n"), *(E.Metric(f"judge_agreement:{j}", f"j{i}", "eligible_n") for i, j in enumerate(JUDGES)), E.Metric("equal_weight_agreement", None, "eligible_n", value="case when eligible_n > 0 then all_n / cast(4 * eligible_n as double) end"), E.Metric("consensus_minus_individual", None, "eligible_n", value="case when eligible_n > 0 then (4 * ok_n - all_n) / cast(4 * eligible_n as double) end"), *(E.Metric(f"consensus_minus_judge:{j}", None, "eligible_n", value=f"case when eligible_n > 0 then (ok_n - j{i}) / cast(eligible_n as double) end") for i, j in enumerate(JUDGES))]


@query(duck(f"with {_sc}, " + metric_sql("select category, count(*) as eligible_n, sum(ok) as ok_n, sum(ok0) as j0, sum(ok1) as j1, sum(ok2) as j2, sum(ok3) as j3, sum(n_right) as all_n from sc group by grouping sets ((), (category))", ["category"], _cvi, ())))
def consensus_vs_individual(spark, sf_dir):
    return C.consensus_vs_individual(scored(spark, sf_dir), list(JUDGES))


@query(duck(f"with {_sc} select count(*) filter (where ok = 1 and n_right < 4) as consensus_correct_individual_mean_below_one, count(*) filter (where ok = 0 and n_right > 0) as consensus_incorrect_at_least_one_individual_correct, count(*) filter (where n_right = 4) as all_individuals_correct, count(*) filter (where n_right = 0) as all_individuals_incorrect, count(*) filter (where 4 * ok > n_right) as positive_change, count(*) filter (where 4 * ok < n_right) as negative_change, count(*) filter (where 4 * ok = n_right) as no_change from sc"))
def gain_loss(spark, sf_dir):
    return C.gain_loss(scored(spark, sf_dir), 4)


@query(duck(f"with {_con}, g as (select count(*) as planned, count(*) filter (where valid_n = 4) as four_valid, count(consensus) as covered, count(*) filter (where valid_n = 4 and consensus is null) as split, count(*) filter (where valid_n < 4) as incomplete from con) " + " union all ".join(f"select {i} as step, '{s}' as stage, {s} as n, {s} / cast(planned as double) as share from g" for i, s in enumerate(("planned", "four_valid", "covered", "split", "incomplete")))))
def retention_funnel(spark, sf_dir):
    return C.retention_funnel(C.consensus4(ballots(spark, sf_dir)))


_sens_base = f"{_con}, {_ref}, four as (select pair_id, reference, category, judge, vote from ballots join con using (pair_id) join ref using (pair_id, category) where valid_n = 4 and reference is not null)"
_sens_view = lambda label, where, least, n: f"select {label} as label, category, pair_id, max(reference) as reference, count(*) filter (where vote = 'ORIGINAL_ANSWER_1') as n0, count(*) filter (where vote = 'ORIGINAL_ANSWER_2') as n1, count(*) filter (where vote = 'TIE') as n2, count(*) filter (where vote = reference) * {12 // n} as r, {least} as least, {n} as n from four where {where} group by category, pair_id"


@query(duck(f"with {_sens_base}, vw as ({' union all '.join([_sens_view(repr('PRIMARY'), 'true', 3, 4), _sens_view(repr('UNANIMITY'), 'true', 4, 4), _sens_view(repr('DECISIVE_ONLY'), 'true', 3, 4), _sens_view(repr('STRENGTH_4-0'), 'true', 4, 4), _sens_view(repr('STRENGTH_3-1'), 'true', 3, 4), _sens_view(chr(39) + 'CATEGORY_' + chr(39) + ' || category', 'true', 3, 4), *(_sens_view(repr(f'OMIT_{j}'), f'judge <> {j!r}', 2, 3) for j in JUDGES)])}), dd as (select *, greatest(n0, n1, n2) as t, case when greatest(n0, n1, n2) >= least then case when n0 >= n1 and n0 >= n2 then 'ORIGINAL_ANSWER_1' when n1 >= n2 then 'ORIGINAL_ANSWER_2' else 'TIE' end end as d0 from vw), ee as (select *, case when label = 'DECISIVE_ONLY' and d0 = 'TIE' then null when label = 'STRENGTH_3-1' and t <> 3 then null else d0 end as d from dd), ff as (select label, count(*) as eligible_n, count(d) as retained_n, count(*) filter (where d = reference) as correct_n, coalesce(sum(r) filter (where d is not null), 0) as r12 from ee group by 1) select label, eligible_n, retained_n, correct_n, case when retained_n > 0 then correct_n / cast(retained_n as double) end as agreement, case when retained_n > 0 then r12 / cast(12 * retained_n as double) end as individual_baseline, case when retained_n > 0 then (12 * correct_n - r12) / cast(12 * retained_n as double) end as delta from ff"))
def consensus_sensitivity(spark, sf_dir):
    v = ballots(spark, sf_dir)
    return C.consensus_sensitivity(v, references(v), list(JUDGES))


@query(duck(f"with {_ballots}, corr as (select pair_id, judge, case when pair_id % 3 > 0 then 'TIE' end as vote from ballots where pair_id % 5 = 0) select b.pair_id, b.judge, case when c.pair_id is not null then c.vote else b.vote end as vote, case when c.pair_id is not null then 'CORRECTED' else 'HISTORICAL' end as source from ballots b left join corr c on b.pair_id = c.pair_id and b.judge = c.judge"))
def overlay_votes(spark, sf_dir):
    v = ballots(spark, sf_dir).select("pair_id", "judge", "vote")
    corrected = v.where("pair_id % 5 = 0").withColumn("vote", F.when(F.col("pair_id") % 3 > 0, "TIE"))
    return C.overlay_votes(v, corrected)
