"""Queries of pairs, historical diagnostics, ranking and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails
from ..functions.text import format_type
from ..operators import bootstrap as B
from ..operators import davidson as V
from ..operators import estimators as E
from ..operators import diagnostics as D
from ..operators import pairs as P
from ..operators.estimators import KAPPA
from ..sources.io import settled
from . import core_queries as core
from .catalog import query
from .core_queries import kappa_sql
from .fixtures import duck, once, table

JUDGE = "gpt-4o-mini"
FORMAT = "case when cast(regexp_matches({0}, '(?m)^#{{1,6}}\\s') as int) + cast(regexp_matches({0}, '\\*\\*.*?\\*\\*') as int) + cast(regexp_matches({0}, '(?m)^\\s*[*\\-]\\s') as int) + cast(regexp_matches({0}, '(?m)^\\s*\\d+\\.\\s') as int) + 2 * cast(regexp_matches({0}, '```') as int) >= 2 then 'markdown_heavy' else 'plain_text' end"
WIDE = f"""fmt as (select id, prompt_id, model_name, word_count, {FORMAT.format('text')} as format_type from answers),
  wd as (select d.id, d.prompt_id, d.judge_model_name, d.answer_a_id, d.answer_b_id, d.position_a_id, d.winner_id, p.category, a.model_name as model_a, a.word_count as wc_a, a.format_type as format_a, b.model_name as model_b, b.word_count as wc_b, b.format_type as format_b, w.model_name as winner_model
  from decisions d join prompts p on d.prompt_id = p.id join fmt a on d.answer_a_id = a.id join fmt b on d.answer_b_id = b.id left join fmt w on d.winner_id = w.id),
  hd as (select * from wd where judge_model_name = '{JUDGE}' and category not in ('live', 'live_calibrated', 'ensemble_eval')),
  mp as (select *, least(model_a, model_b) as m1, greatest(model_a, model_b) as m2 from hd)"""


def wide(spark, sf_dir):
    answers = table(spark, sf_dir, "answers").withColumn("format_type", format_type("text")).drop("text")
    return P.decisions_wide(table(spark, sf_dir, "decisions"), table(spark, sf_dir, "prompts"), answers)


def history(spark, sf_dir):
    return P.historical_decisions(wide(spark, sf_dir), JUDGE)


# J1, F1 ---------------------------------------------------------------------------------------
@query(duck(f"with {WIDE} select * from wd"))
def decisions_wide(spark, sf_dir):
    return wide(spark, sf_dir)


_choice = lambda w: f"case when {w} is null then 'TIE' when {w} = answer_a_id then 'ANSWER_A' else 'ANSWER_B' end"
_hj = f"hj as (select h.preference_id, h.prompt_id, h.answer_a_id, h.answer_b_id, d.category, {_choice('h.winner_id').replace('answer_a_id', 'h.answer_a_id')} as human_label, {_choice('d.winner_id').replace('answer_a_id', 'h.answer_a_id')} as judge_label from preferences h join decisions d on h.prompt_id = d.prompt_id and h.answer_a_id = d.answer_a_id and h.answer_b_id = d.answer_b_id where judge_model_name = '{JUDGE}' and category <> 'live')"
_jj = f"jj as (select a.prompt_id, a.answer_a_id, a.answer_b_id, a.category, {_choice('a.winner_id').replace('answer_a_id', 'a.answer_a_id')} as human_label, {_choice('b.winner_id').replace('answer_a_id', 'a.answer_a_id')} as judge_label from decisions a join decisions b on a.prompt_id = b.prompt_id and a.answer_a_id = b.answer_a_id and a.answer_b_id = b.answer_b_id where a.judge_model_name = '{JUDGE}' and b.judge_model_name = 'deepseek/deepseek-chat' and a.category <> 'live' and b.category <> 'live')"


@query(duck(f"with {_hj} select * from hj"))
def human_vs_judge(spark, sf_dir):
    return P.human_vs_judge(table(spark, sf_dir, "preferences"), table(spark, sf_dir, "decisions"), JUDGE)


@query(duck(f"with {_jj} select * from jj"))
def judge_vs_judge(spark, sf_dir):
    return P.judge_vs_judge(table(spark, sf_dir, "decisions"), JUDGE, "deepseek/deepseek-chat")


@query(duck(f"with {_jj}, w as (select {kappa_sql('true', 'human_label', 'judge_label')} from jj) select valid_n as overlap, coalesce({KAPPA}, 0.0) as kappa, coalesce(agree / cast(nullif(valid_n, 0) as double), 0.0) as agreement from w"))
def inter_judge_kappa(spark, sf_dir):
    return D.inter_judge_kappa(judge_vs_judge(spark, sf_dir))


@query(duck(f"with {_hj}, w as (select category, {kappa_sql('true', 'human_label', 'judge_label')} from hj group by 1) select category, valid_n as overlap, case when valid_n > 1 then {KAPPA} end as kappa from w"))
def domain_kappa(spark, sf_dir):
    return D.domain_kappa(human_vs_judge(spark, sf_dir))


# J5-J9, J14 -----------------------------------------------------------------------------------
_lv = "lv as (select pass_id as historical_identity, rq_code, judge, presentation, outcome, 'SOURCE_CORRECT_REUSABLE' as source from ledger where classification = 'SOURCE_CORRECT_REUSABLE' union all select c.historical_identity, c.rq_code, c.judge, c.presentation, case when c.state = 'COMPLETED' then c.final_outcome when r.state = 'COMPLETED' then r.final_outcome end, case when c.state = 'COMPLETED' then 'CORRECTED_ORIGINAL' else 'RECOVERY_REPLACEMENT' end from corrected c left join recovery r on c.planned_pass_id = r.original_planned_pass_id)"


def logical(spark, sf_dir):
    return P.logical_view(table(spark, sf_dir, "ledger"), table(spark, sf_dir, "corrected"), table(spark, sf_dir, "recovery"))


@query(duck(f"with {_lv} select * from lv"))
def logical_view(spark, sf_dir):
    return logical(spark, sf_dir)


@query(duck(f"with {_lv} select * from lv where rq_code = 'RQ3' and source <> 'SOURCE_CORRECT_REUSABLE'"))
def logical_by_question(spark, sf_dir):
    return P.by_rq(logical(spark, sf_dir), "RQ3")


@query(duck("with att as (select pass_id, count(*) as n_attempts, string_agg(state, ',' order by attempt_index) as lineage, max(cast(state = 'COMPLETED' as int)) as done from attempts group by 1), sl as (select pass_id, max_by(state, attempt_index) as state from attempts group by 1) select pass_id, state, n_attempts, lineage from sl join att using (pass_id) where state in ('FAILED', 'AMBIGUOUS') and done = 0"))
def recovery_slots(spark, sf_dir):
    a = table(spark, sf_dir, "attempts")
    return P.recovery_slots(a.groupBy("pass_id").agg(F.max_by("state", "attempt_index").alias("state")), a)


@query(duck("with rc as (select distinct prompt_id, answer_a_id as lo_id, answer_b_id as hi_id, pair_id % 4 > 0 as exact from pairs where pair_id % 7 > 0) select p.pass_id, case when r.lo_id is null then 'HISTORICAL_ONLY_UNALIGNED' when r.exact then 'SOURCE_CORRECT_REUSABLE' else 'CORRECTED_RERUN_REQUIRED' end as classification from passes p left join rc r on p.prompt_id = r.prompt_id and least(p.answer_a_id, p.answer_b_id) = r.lo_id and greatest(p.answer_a_id, p.answer_b_id) = r.hi_id"))
def reuse_ledger(spark, sf_dir):
    r = table(spark, sf_dir, "pairs").where("pair_id % 7 > 0").select("prompt_id", F.col("answer_a_id").alias("lo_id"), F.col("answer_b_id").alias("hi_id"), (F.col("pair_id") % 4 > 0).alias("exact")).distinct()
    return P.reuse_ledger(table(spark, sf_dir, "passes"), r)


@query(duck("with src as (select text, min(question_id) as question_id, max(question_id) as hi from (select 'prompt ' || cast(prompt_id as string) as text, 81 + prompt_id % 80 as question_id from pairs union all select 'prompt ' || cast(prompt_id as string), 7 from pairs where prompt_id % 9 = 0) group by 1 having min(question_id) = max(question_id)) select p.id as prompt_id, s.question_id from prompts p join src s on p.text = s.text"))
def prompt_question_map(spark, sf_dir):
    pairs = table(spark, sf_dir, "pairs")
    text = F.concat(F.lit("prompt "), F.col("prompt_id").cast("string")).alias("text")
    source = pairs.select(text, (81 + F.col("prompt_id") % 80).alias("question_id")).unionByName(pairs.where("prompt_id % 9 = 0").select(text, F.lit(7).cast("long").alias("question_id"))).distinct()
    return P.prompt_question_map(table(spark, sf_dir, "prompts"), source)


@query(duck("with u as (select prompt_id, model_name, case when count(*) = 1 then min(text) end as t from answers group by 1, 2) select p.pair_id, p.prompt_id, p.model_a, p.model_b, a.t as text_a, b.t as text_b, case when a.t is not null and b.t is not null then 'RESOLVED' else 'UNAVAILABLE' end as provenance from pairs p left join u a on p.prompt_id = a.prompt_id and p.model_a = a.model_name left join u b on p.prompt_id = b.prompt_id and p.model_b = b.model_name"))
def enriched_records(spark, sf_dir):
    return P.enrich_records(table(spark, sf_dir, "pairs").select("pair_id", "prompt_id", "model_a", "model_b"), table(spark, sf_dir, "answers"))


@query(duck("select h.preference_id, h.prompt_id, h.answer_a_id, h.answer_b_id, h.winner_id, p.category, a.model_name as model_a, sha256(a.text) as sha_a, b.model_name as model_b, sha256(b.text) as sha_b, case when h.winner_id is null then 'TIE' when h.winner_id = h.answer_a_id then 'ANSWER_A' when h.winner_id = h.answer_b_id then 'ANSWER_B' end as human_label from preferences h join prompts p on h.prompt_id = p.id join answers a on h.answer_a_id = a.id join answers b on h.answer_b_id = b.id"))
def pair_records(spark, sf_dir):
    return P.pair_records(table(spark, sf_dir, "preferences"), table(spark, sf_dir, "prompts"), table(spark, sf_dir, "answers"))


# D1-D8 ----------------------------------------------------------------------------------------
_pg = "pg as (select prompt_id, least(answer_a_id, answer_b_id) as lo_id, greatest(answer_a_id, answer_b_id) as hi_id, count(*) as n_rows, min(coalesce(winner_id, -1)) as w, max(coalesce(winner_id, -1)) as w_hi, min(preference_id) as preference_id from preferences group by 1, 2, 3)"


@query(duck(f"with {_pg} select preference_id, prompt_id, lo_id as answer_a_id, hi_id as answer_b_id, case when w = -1 then 'TIE' when w = lo_id then 'ANSWER_A' when w = hi_id then 'ANSWER_B' end as human_label, n_rows - 1 as collapsed from pg where w = w_hi"))
def freeze_pairs(spark, sf_dir):
    return P.freeze_pairs(table(spark, sf_dir, "preferences"))


@query(duck(f"with {_pg}, j as (select pg.*, w <> w_hi as conflict, coalesce(trim(a.text) = '', true) or coalesce(trim(b.text) = '', true) as empty from pg left join answers a on lo_id = a.id left join answers b on hi_id = b.id) select cast(sum(n_rows) as bigint) as records, count(*) as groups, count(*) filter (where conflict) as conflicts, count(*) filter (where not conflict and empty) as blank, count(*) filter (where not conflict and not empty) as eligible from j"))
def population_funnel(spark, sf_dir):
    return P.population_funnel(table(spark, sf_dir, "preferences"), table(spark, sf_dir, "answers"))


@query(duck("with j as (select question_id, 1 as turn, model_a, 'a' || cast(prompt_id % 3 as string) as text_a, model_b, 'b' as text_b from pairs), r as (select question_id, turn, model_a as model, text_a as text from j union all select question_id, turn, model_b, text_b from j) select question_id, turn, model, min(sha256(text)) as sha, count(distinct text) > 1 as conflict from r group by 1, 2, 3"))
def source_index(spark, sf_dir):
    j = table(spark, sf_dir, "pairs").select("question_id", F.lit(1).alias("turn"), "model_a", F.concat(F.lit("a"), (F.col("prompt_id") % 3).cast("string")).alias("text_a"), "model_b", F.lit("b").alias("text_b"))
    return P.index_source(j)


@query(duck("with r as (select pair_id, judge, pass_id, outcome, row_number() over (partition by pair_id, judge order by pass_id) as n from passes) select pair_id, judge, pass_id, outcome from r where n = 1"))
def first_pass_wins(spark, sf_dir):
    return P.dedup_first(table(spark, sf_dir, "passes").select("pair_id", "judge", "pass_id", "outcome"), ["pair_id", "judge"], ["pass_id"])


@query(duck("with a as (select pair_id, category from pairs where pair_id % 3 > 0), b as (select pair_id, category from pairs where pair_id % 4 > 0) select coalesce(a.category, b.category) as category, count(*) as keys, count(*) filter (where a.pair_id is not null and b.pair_id is not null) as shared, count(*) filter (where b.pair_id is null) as first_only, count(*) filter (where a.pair_id is null) as second_only from a full join b on a.pair_id = b.pair_id group by 1"))
def pair_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").select("pair_id", "category")
    return P.pair_overlap(p.where("pair_id % 3 > 0"), p.where("pair_id % 4 > 0"), "pair_id", "category")


@query(duck("with s as (select pass_id from passes where pair_id % 5 > 0 union all select pass_id from passes where pair_id % 10 = 1 union all select 'x' || pass_id from passes where pair_id % 13 = 0), g as (select pass_id, count(*) as n from s group by 1) select coalesce(p.pass_id, g.pass_id) as pass_id, case when g.pass_id is null then 'missing' when p.pass_id is null then 'extra' else 'duplicate' end as issue from passes p full join g on p.pass_id = g.pass_id where g.pass_id is null or p.pass_id is null or g.n > 1"))
def identity_diff(spark, sf_dir):
    p = table(spark, sf_dir, "passes").select("pass_id", "pair_id")
    stored = p.where("pair_id % 5 > 0").select("pass_id").union(p.where("pair_id % 10 = 1").select("pass_id")).union(p.where("pair_id % 13 = 0").select(F.concat(F.lit("x"), "pass_id")))
    return P.identity_diff(p, stored, "pass_id")


_quarters = " || ':' || ".join(f"cast(sum(cast('0x' || substr(sha256(cast(k as string)), {1 + 15 * i}, 15) as bigint)) as string)" for i in range(4))


@query(duck(f"with g as (select 'pair_id' as key, pair_id as k, count(*) as n from pairs group by 2 union all select 'question_id', question_id, count(*) from pairs group by 2) select key, count(*) as n, count(*) filter (where n > 1) as duplicates, case when count(*) filter (where n > 1) = 0 then {_quarters} end as digest from g group by key"))
def set_digest(spark, sf_dir):
    """One key that is a set and one that repeats, which has no digest."""
    p = table(spark, sf_dir, "pairs")
    one, other = (P.set_digest(p, k).select(F.lit(k).alias("key"), "*") for k in ("pair_id", "question_id"))
    return one.unionByName(other)


# H1-H11, H21 ----------------------------------------------------------------------------------
_pc = "pc as (select category, m1, m2, count(*) filter (where shown = m1) as n_a, count(*) filter (where shown = m2) as n_b, count(*) filter (where shown = m1 and winner_model = m1) as w_a, count(*) filter (where shown = m2 and winner_model = m1) as w_b from (select *, case when position_a_id = answer_a_id then model_a else model_b end as shown from mp) group by 1, 2, 3 having count(*) filter (where shown = m1) > 0 and count(*) filter (where shown = m2) > 0), ps as (select category, m1, m2, n_a, n_b, w_a / cast(n_a as double) as rate_slot_a, w_b / cast(n_b as double) as rate_slot_b, (w_a / cast(n_a as double) > 0.5) <> (w_b / cast(n_b as double) > 0.5) as flip from pc)"
_cw = "cw as (select m1, m2, category, count(*) as total, count(*) filter (where winner_model = m1) as m1_wins from mp group by 1, 2, 3), cr as (select *, round_even(m1_wins / cast(total as double), 3) as m1_win_rate from cw), cwin as (select *, case when m1_win_rate > 0.5 then m1 when m1_win_rate < 0.5 then m2 else 'TIE' end as category_winner from cr), pv as (select m1, m2, count(distinct category_winner) as distinct_winners, count(distinct category_winner) > 1 as specialised from cwin group by 1, 2)"


@query(duck(f"with {WIDE}, {_pc} select * from ps"))
def position_consistency(spark, sf_dir):
    return D.position_consistency(history(spark, sf_dir))


@query(duck(f"with {WIDE}, {_cw} select * from cwin"))
def category_winners(spark, sf_dir):
    return D.category_winners(history(spark, sf_dir))


@query(duck(f"with {WIDE}, {_pc}, {_cw}, a as (select count(*) as swapped, count(*) filter (where flip) as flips from ps), b as (select count(*) as pairs, count(*) filter (where specialised) as special from pv) select swapped, flips, case when swapped > 0 then (swapped - flips) / cast(swapped as double) else 1.0 end as position_consistency, case when pairs > 0 then special / cast(pairs as double) else 0.0 end as specialisation_rate from a, b"))
def consistency_score(spark, sf_dir):
    d = history(spark, sf_dir)
    return D.consistency_score(D.position_consistency(d), D.pair_variety(D.category_winners(d)))


@query(duck(f"with {WIDE}, {_cw} select * from pv order by distinct_winners desc, m1, m2 limit 3"))
def top_varied_pairs(spark, sf_dir):
    return D.top_varied_pairs(D.pair_variety(D.category_winners(history(spark, sf_dir))))


@query(duck(f"with {WIDE}, s as (select category, count(*) filter (where winner_id = position_a_id) as position_a, count(*) filter (where winner_id <> position_a_id) as position_b, count(*) filter (where winner_id is null) as tie from hd group by grouping sets ((), (category))) select *, case when position_a + position_b > 0 then (position_a - position_b) * (position_a - position_b) / cast(position_a + position_b as double) else 0.0 end as chi2 from s"))
def slot_totals(spark, sf_dir):
    return D.slot_totals(history(spark, sf_dir), ((), ("category",)))


#: The tail of a chi-square with one degree of freedom, as a mean over the angles of Craig's integral (DuckDB has no erfc).
_TAIL = "(select avg(exp(-chi2 / 2 / pow(sin(pi() / 2 * (k + 0.5) / 20000), 2))) from range(0, 20000) as a(k))"


@query(duck(f"""with {WIDE}, s as (select category, count(*) filter (where winner_id = position_a_id) as position_a, count(*) filter (where winner_id <> position_a_id) as position_b, count(*) filter (where winner_id is null) as tie from hd group by 1),
  c as (select *, case when position_a + position_b > 0 then (position_a - position_b) * (position_a - position_b) / cast(position_a + position_b as double) else 0.0 end as chi2 from s),
  p as (select *, {_TAIL} as p_value from c), r as (select *, row_number() over (order by p_value, category) as i, count(*) over () as m from p),
  q as (select category, position_a, position_b, tie, chi2, p_value, least(1.0, min(p_value * m / i) over (order by p_value desc, category desc rows unbounded preceding)) as p_adjusted from r)
  select *, p_adjusted < 0.05 as fdr_significant from q"""))
def slot_chi2_adjusted(spark, sf_dir):
    d = D.slot_totals(history(spark, sf_dir), (("category",),)).withColumn("p_value", tails.chi2_p1(F.col("chi2")))
    return D.bh_adjust(d, "p_value", "category")


@query(duck("with g as (select category, count(*) as n, count(*) filter (where human_label = 'TIE') as k from pairs group by 1), p as (select category, k / cast(n as double) as p from g), r as (select *, row_number() over (order by p, category) as i, count(*) over () as m from p), q as (select category, p, least(1.0, min(p * m / i) over (order by p desc, category desc rows unbounded preceding)) as p_adjusted from r) select *, p_adjusted < 0.05 as fdr_significant from q"))
def bh_adjust(spark, sf_dir):
    g = table(spark, sf_dir, "pairs").groupBy("category").agg((F.count_if(F.col("human_label") == "TIE") / F.count("*")).alias("p"))
    return D.bh_adjust(g, "p", "category")


@query(duck(f"with {WIDE} select id, wc_a - wc_b as word_count_diff, case when winner_id is null then 0.5 when winner_id = answer_a_id then 1.0 else 0.0 end::double as llm_verdict from hd"))
def length_points(spark, sf_dir):
    return D.length_points(history(spark, sf_dir))


@query(duck(f"with {WIDE}, u as (select case when winner_id = answer_a_id then format_a else format_b end as f from hd where format_a <> format_b and winner_id is not null), g as (select count(*) filter (where f = 'markdown_heavy') as markdown_chosen, count(*) filter (where f <> 'markdown_heavy') as plain_text_chosen from u) select *, (markdown_chosen - plain_text_chosen) * (markdown_chosen - plain_text_chosen) / cast(nullif(markdown_chosen + plain_text_chosen, 0) as double) as chi2 from g"))
def format_association(spark, sf_dir):
    return D.format_association(history(spark, sf_dir))


@query(duck(f"""with {WIDE}, {_hj}, c as (select hd.id, hj.human_label as h, hj.judge_label as j, wc_a - wc_b as gap, position_a_id, hd.answer_a_id, hd.answer_b_id, model_a || ' vs ' || model_b as model_names from hd join hj using (prompt_id, answer_a_id, answer_b_id))
  select id, bucket, gap as word_count_diff, h as human_winner, j as ai_winner, model_names from (
  select *, 'length' as bucket from c where ((j = 'ANSWER_A' and gap > 50) or (j = 'ANSWER_B' and -gap > 50)) and (h = 'TIE' or (h = 'ANSWER_A' and gap < 0) or (h = 'ANSWER_B' and gap > 0))
  union all select *, 'forced_choice' from c where h = 'TIE' and j <> 'TIE' union all select *, 'slot' from c where (j = 'ANSWER_A' and position_a_id = answer_b_id) or (j = 'ANSWER_B' and position_a_id = answer_a_id) union all select *, 'baseline' from c where h = j)"""))
def case_buckets(spark, sf_dir):
    h = human_vs_judge(spark, sf_dir).drop("preference_id", "category")
    return D.case_buckets(history(spark, sf_dir).join(h, ["prompt_id", "answer_a_id", "answer_b_id"]))


# H12-H20 --------------------------------------------------------------------------------------
_reg = "rg as (select count(*) as n, sum(x)::bigint as sx, sum(y)::bigint as sy, sum(x * x)::bigint as sxx, sum(x * y)::bigint as sxy, sum(y * y)::bigint as syy from (select wc_a - wc_b as x, case when winner_id is null then 1 when winner_id = answer_a_id then 2 else 0 end as y from hd))"


@query(duck(f"with {WIDE}, {_reg} select n, " + ", ".join(f"{e} as {k}" for k, e in D.REGRESSION.items()) + " from rg"))
def length_regression(spark, sf_dir):
    return D.length_regression(D.length_points(history(spark, sf_dir)))


#: Two-sided p of Student's t: Simpson's rule over cos^(df - 1) beyond the angle of t, as a share of the whole quarter turn.
_SIMPSON = "(case when k = 0 or k = 200000 then 1 when k % 2 = 1 then 4 else 2 end)"
_T_P = f"""(select (pi() / 2 - low) * sum({_SIMPSON} * pow(cos(low + (pi() / 2 - low) * k / 200000), df - 1)) / (pi() / 2 * sum({_SIMPSON} * pow(cos(pi() / 2 * k / 200000), df - 1)))
  from (select atan(abs(slope / slope_se) / sqrt(n - 2)) as low, n - 2 as df) as v, range(0, 200001) as a(k) group by low)"""


@query(duck(f"with {WIDE}, {_reg}, l as (select n, " + ", ".join(f"{e} as {k}" for k, e in D.REGRESSION.items()) + f" from rg) select *, round({_T_P}, 9) as p_value from l"))
def length_regression_test(spark, sf_dir):
    r = D.length_regression(D.length_points(history(spark, sf_dir)))
    return r.withColumn("p_value", F.round(tails.t_p(F.col("slope") / F.col("slope_se"), (F.col("n") - 2).cast("double")), 9))


@query(duck(f"with {WIDE}, {_reg}, l as (select " + ", ".join(f"{e} as {k}" for k, e in D.REGRESSION.items()) + " from rg) select x, greatest(0.0, least(1.0, intercept + slope * x)) as y from l, (values (-400), (-100), (0), (100), (400)) as v(x)"))
def trend_points(spark, sf_dir):
    return D.trend_points(D.length_regression(D.length_points(history(spark, sf_dir))), [-400, -100, 0, 100, 400])


_cv = f"""fo as (select id, model_a, model_b, wc_a - wc_b as x, case when winner_id is null then 1 when winner_id = answer_a_id then 2 else 0 end as y2, h('fold:' || cast(id as string)) % 5 as fold from hd),
  fs as (select fold, count(*) as n, sum(x)::bigint as sx, sum(y2)::bigint as sy, sum(x * x)::bigint as sxx, sum(x * y2)::bigint as sxy from fo group by 1),
  tr as (select fold, (sum(n) over () - n)::bigint as n, (sum(sx) over () - sx)::bigint as sx, (sum(sy) over () - sy)::bigint as sy, (sum(sxx) over () - sxx)::bigint as sxx, (sum(sxy) over () - sxy)::bigint as sxy from fs),
  ft as (select fold, {D.REGRESSION['slope']} as slope, {D.REGRESSION['intercept']} as intercept from tr),
  rs as (select id, model_a, model_b, fold, x, y2 / 2.0::double as a_wins, y2 / 2.0::double - intercept - slope * x as residual from fo join ft using (fold))"""


@query(duck(f"with {WIDE}, {_cv} select id, model_a, model_b, fold, x, a_wins, round(residual, 9) as residual from rs"))
def cv_residuals(spark, sf_dir):
    return D.cv_residuals(history(spark, sf_dir)).withColumn("residual", F.round("residual", 9))


@query(duck(f"with {WIDE}, {_cv}, f as (select fold, sum(residual * residual) as ss, var_pop(a_wins) * count(*) as st from rs group by 1) select round((select avg(case when st > 0 then 1 - ss / st else 0.0 end) from f), 7) as mean_cv_r2, round((select corr(residual, x) from rs), 7) as cv_residual_length_corr"))
def cv_metrics(spark, sf_dir):
    m = D.cv_metrics(D.cv_residuals(history(spark, sf_dir)))
    return m.select(*(F.round(c, 7).alias(c) for c in m.columns))


@query(duck(f"with {WIDE}, {_cv}, lo as (select model_a as model, residual as e, cast(a_wins = 1 as int) as won from rs union all select model_b, -residual, cast(a_wins = 0 as int) from rs), g as (select model, count(*) as total_games, sum(won) / cast(count(*) as double) as raw_win_rate, avg(e) as s, stddev_samp(e) as d from lo group by 1), r as (select *, rank() over (order by raw_win_rate desc) as rank_raw, row_number() over (order by s desc, model) as rank_neutralized from g) select model, total_games, raw_win_rate, round(s, 8) as neutralized_score, round(d, 8) as residual_std, rank_raw, rank_neutralized, rank_raw - rank_neutralized as rank_change from r"))
def neutralized_scores(spark, sf_dir):
    n = D.neutralized_scores(D.cv_residuals(history(spark, sf_dir)))
    return n.withColumn("neutralized_score", F.round("neutralized_score", 8)).withColumn("residual_std", F.round("residual_std", 8))


@query(duck(f"with {WIDE}, l as (select model_a as model, coalesce(cast(winner_id = answer_a_id as int), 0) as won, cast(winner_id is not null as int) as game from hd union all select model_b, coalesce(cast(winner_id = answer_b_id as int), 0), cast(winner_id is not null as int) from hd) select model, cast(sum(won) as bigint) as wins, cast(sum(game) as bigint) as games, case when sum(game) > 0 then sum(won) / cast(sum(game) as double) else 0.0 end as win_rate from l group by 1"))
def raw_win_rates(spark, sf_dir):
    return D.raw_win_rates(history(spark, sf_dir))


@query(duck(f"with {WIDE}, o as (select m1, m2, case when winner_id is null then 't' when (winner_id = answer_a_id) = (model_a < model_b) then 'i' else 'j' end as o from mp where model_a <> model_b) select m1, m2, count(*) filter (where o = 'i') as w_ij, count(*) filter (where o = 'j') as w_ji, count(*) filter (where o = 't') as t_ij from o group by 1, 2"))
def pair_edges(spark, sf_dir):
    return D.pair_edges(history(spark, sf_dir))


@query()
def bradley_terry(spark, sf_dir):
    return D.rank_models(V.bradley_terry(D.pair_edges(history(spark, sf_dir))))


_edges = "o as (select m1, m2, case when winner_id is null then 't' when (winner_id = answer_a_id) = (model_a < model_b) then 'i' else 'j' end as o from mp where model_a <> model_b)"


@query(duck(f"with {WIDE}, {_edges}, s as (select m1 as model, case o when 'i' then 1.0 when 't' then 0.5 else 0.0 end as x from o union all select m2, case o when 'j' then 1.0 when 't' then 0.5 else 0.0 end from o) select model, cast(round(sum(x), 3) as double) as expected, cast(sum(x) as double) as won, true as converged from s group by 1"))
def davidson_points(spark, sf_dir):
    """At the maximum the points that the fit expects of a model are those it won: the gradient vanishes."""
    edges = settled(D.pair_edges(history(spark, sf_dir)))
    scores = V.bradley_terry(edges)
    points = V.expected_points(edges, scores).join(scores.select("model", "converged"), "model")
    return points.select("model", F.round("expected", 3).alias("expected"), "won", "converged")


@query()
def leaderboard(spark, sf_dir):
    d = settled(history(spark, sf_dir).select("id", "model_a", "model_b", "wc_a", "wc_b", "winner_id", "answer_a_id", "answer_b_id"))
    return P.leaderboard(D.rank_models(V.bradley_terry(D.pair_edges(d))), D.neutralized_scores(D.cv_residuals(d)))


@query(duck(f"with {WIDE}, p as (select wc_a - wc_b as x, case when winner_id is null then 0.5 when winner_id = answer_a_id then 1.0 else 0.0 end as y from hd), r as (select 2 * rank() over (order by x) + count(*) over (partition by x) - 1 as a, 2 * rank() over (order by y) + count(*) over (partition by y) - 1 as b from p), s as (select cast(count(*) as double) as n, cast(sum(a) as double) as sa, cast(sum(b) as double) as sb, cast(sum(a * a) as double) as saa, cast(sum(b * b) as double) as sbb, cast(sum(a * b) as double) as sab from r) select n, round((n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)), 10) as rho from s"))
def spearman(spark, sf_dir):
    return D.spearman(D.length_points(history(spark, sf_dir)), "word_count_diff", "llm_verdict").withColumn("rho", F.round("rho", 10))


# B1-B7 ----------------------------------------------------------------------------------------
def _correct(spark, sf_dir):
    v = table(spark, sf_dir, "passes").where("presentation = 'AB' and human_label is not null").select("question_id", "judge", "human_label", "outcome")
    v = once(v, "outcome").where("outcome in ('ANSWER_A', 'ANSWER_B', 'TIE')")
    return v.select("question_id", "judge", (F.col("outcome") == F.col("human_label")).cast("int").alias("ok"))


@query()
def bootstrap_by_judge(spark, sf_dir):
    return B.bootstrap_ci(_correct(spark, sf_dir), "ok", ["judge"])


@query()
def bootstrap_interpolated(spark, sf_dir):
    return B.bootstrap_ci(_correct(spark, sf_dir), "ok", ["judge"], interpolate=True)


@query()
def stratified_bootstrap(spark, sf_dir):
    from .fixtures import JUDGES

    return B.stratified_bootstrap(_correct(spark, sf_dir), "ok", "judge", list(JUDGES))


_pw = "case " + " ".join(f"when hh < {t} then {k}" for k, t in enumerate(B.POISSON)) + f" else {len(B.POISSON)} end"
_cl = f"cl as (select question_id, cast(sum(cast(outcome = human_label as int)) as bigint) as s, count(*) as n from passes where presentation = 'AB' and human_label is not null and outcome in ('ANSWER_A', 'ANSWER_B', 'TIE') group by 1), rep as (select question_id, s, n, replicate, h('7:' || cast(question_id as string) || ':' || cast(replicate as string)) as hh from cl, range(0, 10000) as r(replicate)), wt as (select replicate, cast(sum({_pw} * s) as bigint) as ws, cast(sum({_pw} * n) as bigint) as wn from rep group by 1), st as (select replicate, ws, wn, case when wn > 0 then ws / cast(wn as double) end as stat from wt)"


@query(duck(f"with {_cl} select * from st"))
def clustered_bootstrap(spark, sf_dir):
    return B.clustered_bootstrap(_correct(spark, sf_dir), "question_id", "ok", 10_000, 7)


@query(duck(f"with {_cl}, k as (select *, row_number() over (order by stat, replicate) - 1 as k, count(*) over () as n from st where stat is not null) select 'clustered' as group_id, count(*) as replicates, max(stat) filter (where k = cast(floor(0.025 * (n - 1)) as bigint)) as ci_low, max(stat) filter (where k = cast(floor(0.975 * (n - 1)) as bigint)) as ci_high, (select count(*) from st where stat is null) as non_estimable from k"))
def clustered_interval(spark, sf_dir):
    df = _correct(spark, sf_dir)
    return B.clustered_interval(B.clustered_bootstrap(df, "question_id", "ok", 10_000, 7), 80)


@query(duck("with a as (select judge as metric, min(outcome_n) / 100.0::double as lo, max(outcome_n) / 100.0::double as hi from (select judge, category, count(*) - 60 as outcome_n from passes group by 1, 2) group by 1), b as (select metric, lo / 2 as lo2, hi * 2 as hi2 from a) select a.metric, hi - lo as official_width, hi2 - lo2 as clustered_width, hi2 - lo2 - hi + lo as width_difference, lo <= 0 and hi >= 0 as null_inside_official, lo2 <= 0 and hi2 >= 0 as null_inside_clustered, (lo <= 0 and hi >= 0) <> (lo2 <= 0 and hi2 >= 0) as changed from a join b on a.metric = b.metric"))
def interval_comparison(spark, sf_dir):
    n = table(spark, sf_dir, "passes").groupBy("judge", "category").agg((F.count("*") - 60).alias("n"))
    a = n.groupBy(F.col("judge").alias("metric")).agg((F.min("n") / 100.0).alias("ci_low"), (F.max("n") / 100.0).alias("ci_high"))
    return B.compare_intervals(a, a.select("metric", (F.col("ci_low") / 2).alias("ci_low"), (F.col("ci_high") * 2).alias("ci_high")))


# Estimators that are applied anew to resampled clusters ----------------------------------------
def _clustered_sql(rows: str, cluster: str, sums: dict[str, str], statistic: str, iterations: int, seed: int, name: str) -> str:
    """CTEs that end in ``name``: replicate, weighted sums and stat, with hash-Poisson weights."""
    own = ", ".join(f"{e} as {n}" for n, e in sums.items())
    weighted = ", ".join(f"cast(sum({_pw} * {n}) as bigint) as {n}" for n in sums)
    return f"{name}_c as (select {cluster}, {own} from ({rows}) x group by {cluster}), {name}_r as (select *, h('{seed}:' || cast({cluster} as string) || ':' || cast(replicate as string)) as hh from {name}_c, range(0, {iterations}) as r(replicate)), {name}_w as (select replicate, {weighted} from {name}_r group by replicate), {name} as (select *, {statistic} as stat from {name}_w)"


_tab = "select question_id, pair_id, human_label as hl, outcome as jl from passes where presentation = 'AB'"
_LABEL = dict(zip(B.CLASSES, ("ANSWER_A", "ANSWER_B", "TIE"), strict=True))
_cells = {f"n_{h}_{j}": f"count(*) filter (where hl = '{_LABEL[h]}' and jl = '{_LABEL[j]}')" for h in B.CLASSES for j in B.CLASSES}


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "passes").where("presentation = 'AB'").select("question_id", "pair_id", "judge", F.col("human_label").alias("hl"), F.col("outcome").alias("jl"))


@query(duck(f"with {_clustered_sql(_tab, 'question_id', _cells, B.KAPPA, 10_000, 7, 'st')} select * from st"))
def clustered_kappa(spark, sf_dir):
    return B.clustered_statistic(_labels(spark, sf_dir), "question_id", B.table_cells("hl", "jl"), B.KAPPA, 10_000, 7)


@query()
def kappa_intervals(spark, sf_dir):
    return B.table_interval(_labels(spark, sf_dir), "hl", "jl", B.KAPPA, ["judge"])


_dec = "('ANSWER_A', 'ANSWER_B')"
_swap = f"select pair_id, judge, question_id, max({core.CANON}) filter (where presentation = 'AB') as a, max({core.CANON}) filter (where presentation = 'BA') as b from passes group by 1, 2, 3"
_flip = {"decisive": f"count(*) filter (where a in {_dec} and b in {_dec})", "flips": f"count(*) filter (where a in {_dec} and b in {_dec} and a <> b)"}
_RATE = "case when decisive > 0 then flips / cast(decisive as double) end"


@query(duck(f"with {_clustered_sql(_swap, 'question_id', _flip, _RATE, 10_000, 7, 'st')} select * from st"))
def clustered_flip_rate(spark, sf_dir):
    s = E.swap_pairs(core.canonical_passes(spark, sf_dir), ["pair_id", "judge", "question_id"])
    both = F.col("pass_ab").isin("ANSWER_A", "ANSWER_B") & F.col("pass_ba").isin("ANSWER_A", "ANSWER_B")
    return B.clustered_statistic(s, "question_id", [F.count_if(both).alias("decisive"), F.count_if(both & (F.col("pass_ab") != F.col("pass_ba"))).alias("flips")], _RATE, 10_000, 7)


_v = "('ANSWER_A', 'ANSWER_B', 'TIE')"
_cover = f"select d.*, baseline_label from ({_swap}) d join baseline using (pair_id, judge)"
_coverage = {"n": "count(*)", "gain": f"count(*) filter (where a = b and a in {_v}) - count(*) filter (where baseline_label in {_v})"}
_DELTA = "case when n > 0 then gain / cast(n as double) end"


@query(duck(f"with {_clustered_sql(_cover, 'question_id', _coverage, _DELTA, 10_000, 7, 'st')} select * from st"))
def clustered_coverage_delta(spark, sf_dir):
    """Coverage of the stable label of a swap less that of the baseline."""
    s = E.swap_pairs(core.canonical_passes(spark, sf_dir), ["pair_id", "judge", "question_id"]).join(table(spark, sf_dir, "baseline"), ["pair_id", "judge"])
    valid = lambda c: F.col(c).isin("ANSWER_A", "ANSWER_B", "TIE")
    stable = (F.col("pass_ab") == F.col("pass_ba")) & valid("pass_ab")
    return B.clustered_statistic(s, "question_id", [F.count("*").alias("n"), (F.count_if(stable) - F.count_if(valid("baseline_label"))).alias("gain")], _DELTA, 10_000, 7)


_METRICS = {"exact_agreement": B.AGREEMENT, "cohens_kappa": B.KAPPA}


@query()
def interval_changes(spark, sf_dir):
    """Intervals of agreement and kappa over independent passes, and over whole questions."""
    rows = _labels(spark, sf_dir)
    one = lambda m: B.table_interval(rows, "hl", "jl", _METRICS[m]).select(F.lit(m).alias("metric"), "ci_low", "ci_high")
    return B.compare_intervals(one("exact_agreement").unionByName(one("cohens_kappa")), B.clustered_report(rows, "question_id", B.table_cells("hl", "jl"), _METRICS, seed=7))
