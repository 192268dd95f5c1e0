"""Accounting over slots and attempts, reconciliations, and data-quality jobs.

Money is in integer micro-dollars or decimals, so sums do not hang on row order. Validation
jobs return violations ``rule, key, detail``; an empty table passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import VALID, cases
from ..sources.io import dealt, settled
from .metrics import by_groups, n_if


# Accounting -----------------------------------------------------------------------------------
def complete_cases(logical: DataFrame, repetitions: DataFrame) -> DataFrame:
    """Planned and complete units: single observations, five repetitions, both orders."""
    known = F.col("outcome").isNotNull()
    grouped = lambda df, keys, *ok: df.groupBy(*keys).agg(*ok, F.count("*").alias("n"), n_if(known).alias("known"))
    row = lambda name, planned, complete: F.struct(F.lit(name).alias("population"), planned.alias("planned"), complete.alias("complete"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    five = grouped(repetitions, ["group_key"]).agg(F.count("*").alias("planned"), n_if((F.col("n") == 5) & (F.col("known") == 5)).alias("complete")).select(F.lit("five_repetitions").alias("population"), "planned", "complete")
    # units are single observations grouped: one reading gives both
    units = grouped(logical, ["pair_id", "judge"], F.count_distinct("presentation").alias("orders"))
    both = units.agg(total("n").alias("n"), total("known").alias("known"), F.count("*").alias("units"), n_if((F.col("orders") == 2) & (F.col("known") == F.col("n"))).alias("whole"))
    return both.select(F.inline(F.array(row("observations", F.col("n"), F.col("known")), row("both_orders", F.col("units"), F.col("whole"))))).unionByName(five)


#: What makes a linked unit complete, by question: its size, and the key that links its passes.
LINKED = {"RQ1": 1, "RQ2": 5, "RQ3": 2, "RQ4": 2, "RQ5": 2, "RQ7_PRIMARY": 3}


def linked_populations(logical: DataFrame) -> DataFrame:
    """Planned and complete units of each question in one pass, each linked by its own key.

    RQ1 counts single observations; RQ2 cells of five repetitions of one pairing, judge, condition, temperature and top_p; RQ3 units with an
    AB and a BA pass; RQ4 and RQ5 matched pairs of a unit; RQ7_PRIMARY triplets of a pairing and judge. A unit is complete if it has
    exactly its size and no outcome is missing; RQ3 asks for both orders instead of a size. Questions without rows have zeros; others are left out.
    """
    q = F.col("rq_code")
    text = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    unit = cases((q == "RQ2", text("pairing_key", "judge", "condition_code", "temperature", "top_p")), (q.isin("RQ3", "RQ4", "RQ5"), text("unit_id")), (q == "RQ7_PRIMARY", text("pairing_key", "judge")))
    p, known = F.col("presentation"), F.col("outcome").isNotNull()
    g = logical.where(q.isin(*LINKED)).groupBy("rq_code", unit.alias("unit")).agg(F.count("*").alias("n"), n_if(known).alias("known"), n_if(p == "AB").alias("ab"), n_if(p == "BA").alias("ba"))
    size = cases(*((q == k, F.lit(n)) for k, n in LINKED.items()))
    both = (F.col("ab") > 0) & (F.col("ba") > 0) & (F.col("ab") + F.col("ba") == F.col("n"))
    whole = (F.col("known") == F.col("n")) & F.when(q == "RQ3", both).otherwise(F.col("n") == size)
    one = q == "RQ1"
    counts = g.groupBy("rq_code").agg(F.sum(F.when(one, F.col("n")).otherwise(1)).alias("planned"), F.sum(F.when(one, F.col("known")).otherwise(whole.cast("long"))).alias("complete"))
    every = logical.sparkSession.createDataFrame([(k,) for k in LINKED], "rq_code string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, "rq_code", "left").select("rq_code", zero("planned"), zero("complete"))


def lineage_counts(logical: DataFrame) -> DataFrame:
    return logical.groupBy("rq_code", "source").agg(F.count("*").alias("n"), n_if(F.col("outcome").isNull()).alias("terminal_missing"))


def pass_accounting(passes: DataFrame) -> DataFrame:
    """Units and slots by state; ``balanced`` says that the parts add up to the whole.

    A unit is a (pair, judge): succeeded with two answers, partly valid, failed or pending.
    """
    o = F.col("outcome")
    answered = F.coalesce(o.isin(*VALID, "UNKNOWN"), F.lit(False))
    u = passes.groupBy("pair_id", "judge").agg(F.count("*").alias("n"), n_if(answered).alias("ok"), n_if(o.isNull()).alias("open"), n_if(o == "API_ERROR").alias("api"), n_if(o == "INVALID_RESPONSE").alias("invalid"), n_if(o.isin("TIMEOUT", "REFUSAL")).alias("other"))
    whole = F.col("ok") == F.col("n")
    g = u.agg(F.count("*").alias("planned_units"), n_if(whole).alias("succeeded_units"), n_if(~whole & (F.col("open") > 0)).alias("pending_units"), n_if(~whole & (F.col("open") == 0)).alias("failed_units"), F.sum("n").alias("planned_slots"), F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("valid_slots"), F.sum("api").alias("provider_error_slots"), F.sum("invalid").alias("invalid_response_slots"), F.sum(F.col("other") + F.col("open")).alias("other_slots"), F.sum(F.when(whole, 0).otherwise(F.col("ok"))).alias("excluded_valid_slots"))
    parts = F.col("valid_slots") + F.col("provider_error_slots") + F.col("invalid_response_slots") + F.col("other_slots") + F.col("excluded_valid_slots")
    return g.withColumn("balanced", parts == F.col("planned_slots"))


def failure_table(logical: DataFrame) -> DataFrame:
    """Planned, valid, failed and missing passes of each question and in total."""
    o = F.col("outcome")
    return logical.rollup("rq_code").agg(F.count("*").alias("planned"), n_if(o.isin(*VALID)).alias("valid"), n_if(o.isNotNull() & ~o.isin(*VALID)).alias("failed"), n_if(o.isNull()).alias("missing"))


def failure_categories(attempts: DataFrame) -> DataFrame:
    return attempts.where("failure_category is not null").groupBy("failure_category").agg(F.count("*").alias("attempts"), F.count_distinct("pass_id").alias("slots"))


def ledger_status(attempts: DataFrame) -> DataFrame:
    """Slots by final state, attempts, retries and spend of each judge, provider and overall."""
    slot = attempts.groupBy("provider", "judge", "pass_id").agg(F.max_by("state", "attempt_index").alias("state"), F.count("*").alias("n"), F.sum("actual_micro_usd").alias("actual"), F.sum(F.when(F.col("actual_micro_usd").isNull(), F.col("reserved_micro_usd"))).alias("reserved"))
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by_groups(slot, ((), ("provider",), ("provider", "judge")), F.count("*").alias("slots"), n_if(F.col("state") == "COMPLETED").alias("completed"), n_if(F.col("state") == "FAILED").alias("failed"), n_if(F.col("state") == "AMBIGUOUS").alias("ambiguous"), F.sum("n").alias("attempts"), (F.sum("n") - F.count("*")).alias("retries"), money("actual").alias("actual_micro_usd"), money("reserved").alias("reserved_micro_usd"), (money("actual") + money("reserved")).alias("total_micro_usd"))


def cost_ledger(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("judge").agg(F.sum("actual_micro_usd").cast("long").alias("actual_micro_usd"), F.sum("reserved_micro_usd").cast("long").alias("reserved_micro_usd"), n_if(F.col("actual_micro_usd").isNull()).alias("unreported"))


def budget_forecast(plan: DataFrame, by: str, cost: str) -> DataFrame:
    """Expected cost, P90 envelope (the ceil(0.9 n)-th smallest cost times n), with 15 % on top and three tries.

    The order statistic comes from counts of distinct costs, so no group is sorted row by row.
    """
    g = plan.groupBy(by, cost).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    ranked = g.withColumn("upto", F.sum("c").over(w.orderBy(cost))).withColumn("n", F.sum("c").over(w))
    need = F.floor((9 * F.col("n") + 9) / 10)
    out = ranked.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col(cost)).cast("long").alias("expected"), F.min(F.when(F.col("upto") >= need, F.col(cost))).alias("p90"))
    return out.select(by, "n", "expected", (F.col("p90") * F.col("n")).alias("p90_total"), (F.col("p90") * F.col("n") * 115 / 100).alias("with_margin"), (3 * F.col("p90") * F.col("n")).alias("retry_envelope"))


def cost_preflight(plan: DataFrame) -> DataFrame:
    """Units, tokens and reserved cost of each judge and in total."""
    return plan.rollup("judge").agg(F.count("*").alias("units"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("reserved_micro_usd").cast("long").alias("reserved_micro_usd"))


def precision_benchmark(units: DataFrame) -> DataFrame:
    """Half-width in percent points of a 95 % interval at p = 0.5."""
    return units.rollup("judge").agg(F.count("*").alias("n")).withColumn("half_width", 100 * 1.96 * F.sqrt(F.lit(0.25) / F.col("n")))


def coverage_proxy(passes: DataFrame) -> DataFrame:
    """Semantic response rate and its square, an estimate of two-pass coverage."""
    rate = n_if(F.col("outcome").isin(*VALID)) / F.count("*")
    return passes.groupBy("judge").agg(F.count("*").alias("n"), rate.alias("rate")).withColumn("paired_rate", F.col("rate") * F.col("rate"))


def reuse_audit(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Counts of legacy decisions by judge: ties, winners that are neither answer, repeats, sandbox rows."""
    w = F.col("winner_id")
    d = decisions.groupBy("judge_model_name", "prompt_id", "answer_a_id", "answer_b_id").agg(F.count("*").alias("n"), n_if(w.isNull()).alias("ties"), n_if(w.isNotNull() & (w != F.col("answer_a_id")) & (w != F.col("answer_b_id"))).alias("bad"), n_if(F.col("category") == "live").alias("live"))
    g = d.groupBy("judge_model_name").agg(F.sum("n").alias("decisions"), F.sum("ties").alias("ties"), F.sum("bad").alias("invalid_winners"), n_if(F.col("n") > 1).alias("repeated_pairs"), F.sum("live").alias("live"))
    return g.crossJoin(F.broadcast(answers.agg(n_if(F.trim("text") == "").alias("empty_answers"))))


def cross_judge_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each judge and a column for each of a fixed list of metrics."""
    return metrics.where("judge is not null").groupBy("judge").pivot("metric_name", names).agg(F.max("value"))


def reconcile_metrics(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Metrics that are missing on one side or differ by more than the tolerance."""
    key = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    j = a.select(*key, F.col("value").alias("left"), F.lit(1).alias("l")).join(b.select(*key, F.col("value").alias("right"), F.lit(1).alias("r")), keys, "full_outer")
    differ = ~F.coalesce((F.abs(F.col("left") - F.col("right")) <= tolerance) | (F.col("left").isNull() & F.col("right").isNull()), F.lit(False))
    issue = cases((F.col("r").isNull(), "left_only"), (F.col("l").isNull(), "right_only"), (differ, "differs"))
    return j.withColumn("issue", issue).where("issue is not null").select(*keys, "left", "right", "issue")


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each metric and whether its sign against 0.5 changed."""
    key = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]
    j = old.select(*key, F.col("value").alias("old")).join(new.select(*key, F.col("value").alias("new")), keys)
    side = lambda c: F.signum(F.col(c) - 0.5)
    return j.select(*keys, "old", "new", F.abs(F.col("new") - F.col("old")).alias("change"), (side("old") != side("new")).alias("direction_changed"))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, rows)


def build_report(records: DataFrame) -> DataFrame:
    return records.agg(F.count_distinct("question_id").alias("questions"), F.min("question_id").alias("first_question"), F.max("question_id").alias("last_question"), F.count("*").alias("records"), F.count_distinct("prompt_id").alias("prompts"), (F.count_distinct("answer_a_id") + F.count_distinct("answer_b_id")).alias("answers"))


def batch_complete(slots: DataFrame) -> DataFrame:
    s = F.col("state")
    return slots.agg(F.count("*").alias("slots"), n_if(s.isin("PENDING", "RUNNING")).alias("pending"), n_if(s.isin("COMPLETED", "FAILED", "AMBIGUOUS")).alias("terminal")).withColumn("complete", (F.col("pending") == 0) & (F.col("terminal") == F.col("slots")))


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ids 1..n in key order: ranks within range partitions plus the sizes of those before, so no task sorts all.

    The partitions are settled first, as their bounds come from a sample that another run would draw anew.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = settled(df.select(*keys).distinct().repartitionByRange(parts, *keys).withColumn("_b", F.spark_partition_id()))
    sizes = b.groupBy("_b").agg(F.count("*").alias("c"))
    starts = sizes.select("_b", (F.sum("c").over(Window.orderBy("_b")) - F.col("c")).alias("_start"))  # a row for each partition
    return b.join(F.broadcast(starts), "_b").withColumn(name, F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) + F.col("_start")).drop("_b", "_start")


def vote_accounting(slots: DataFrame) -> DataFrame:
    """Planned, completed, failed and ambiguous slots, valid votes, ties and non-votes by judge and by category."""
    s, v = F.col("state"), F.col("vote")
    done = s == "COMPLETED"
    return by_groups(slots, (("judge",), ("category",)), F.count("*").alias("planned"), n_if(done).alias("completed"), n_if(s == "FAILED").alias("failed"), n_if(s == "AMBIGUOUS").alias("ambiguous"), n_if(done & v.isNotNull()).alias("valid_votes"), n_if(done & (v == "TIE")).alias("ties"), n_if(done & v.isNull()).alias("non_votes"))


#: Bits of what keeps a slot from being a vote.
NON_VOTE, FAILURE, AMBIGUITY = 1, 2, 4


def pair_causes(slots: DataFrame, votes: int = 4) -> DataFrame:
    """Pairs by what their slots lack, overall and by category: a mask of causes folded by pair, counted once.

    A pair counts under each cause that it has. ``four_valid`` pairs have ``votes`` valid votes and go into the primary analysis, those with one less into its
    sensitivity; ``incomplete`` are all that have fewer. A slot that is neither completed, failed nor ambiguous is open: it makes a pair incomplete without a cause.
    """
    s, v = F.col("state"), F.col("vote")
    done = F.coalesce(s == "COMPLETED", F.lit(False))
    cause = cases((done & v.isNull(), NON_VOTE), (s == "FAILED", FAILURE), (s == "AMBIGUOUS", AMBIGUITY), otherwise=0)
    pairs = slots.groupBy("category", "pair_id").agg(F.bit_or(cause).alias("mask"), n_if(done & v.isNotNull()).alias("valid"))
    has = lambda bit: n_if(F.col("mask").bitwiseAND(bit) > 0)
    return by_groups(
        pairs, ((), ("category",)), F.count("*").alias("planned_pairs"), n_if(F.col("valid") == votes).alias("four_valid_pairs"), n_if(F.col("valid") == votes - 1).alias("exactly_three_valid_pairs"),
        n_if(F.col("valid") < votes).alias("incomplete_pairs"), has(NON_VOTE).alias("non_vote_pairs"), has(FAILURE).alias("terminal_failure_pairs"), has(AMBIGUITY).alias("ambiguous_pairs"), n_if((F.col("valid") < votes) & (F.col("mask") == 0)).alias("open_pairs"),
    )


# Validation -----------------------------------------------------------------------------------
def broken(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def several(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Broken rules of a row (``rule: (condition, detail)``) in one reading."""
    row = lambda name, detail: F.struct(F.lit(name).alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))
    return df.select(F.inline(F.array_compact(F.array(*(F.when(wrong, row(name, detail)) for name, (wrong, detail) in rules.items())))))


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return broken(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), rule, F.concat_ws(":", *(F.col(k).cast("string") for k in keys)), F.col("_n"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def validate_units(units: DataFrame, allocation: DataFrame | None = None) -> DataFrame:
    """Broken rules of planned units: ids, answers, configuration, variants, swaps, slots, strategies and (with ``allocation``: ``judge, provider``) models.

    Rules about columns that ``units`` lacks are left out.
    """
    u, has = F.col("unit_id"), lambda *c: set(c) <= set(units.columns)
    wrong = lambda condition, rule: broken(units.where(F.coalesce(condition, F.lit(True))), rule, u)  # noqa: E731  an unknown is an error
    rq, passes = F.col("rq_code"), F.col("pass_count")
    found = [repeated(units, ["unit_id"], "duplicate_unit_id")]
    if has("answer_a_id", "answer_b_id"):
        found.append(wrong((F.col("answer_a_id") <= 0) | (F.col("answer_b_id") <= 0) | (F.col("answer_a_id") == F.col("answer_b_id")), "invalid_answer_identity"))
    if has("repetition_index"):
        found.append(wrong((F.col("repetition_index") < 0) | (passes < 1) | (F.col("condition") == ""), "missing_or_invalid_configuration"))
    if has("variant_checksum"):
        found.append(broken(units.where(rq.isin("RQ4", "RQ5") & (F.coalesce("variant_checksum", F.lit("")) == "")), "invalid_variant_linkage", u))
    if allocation is not None:
        found.append(broken(units.join(allocation, ["judge", "provider"], "left_anti"), "inconsistent_model_allocation", u))
    found.append(broken(units.where(rq.isin("RQ3", "RQ4", "RQ5") & ((F.col("presentation_order") != "AB_BA") | (passes != 2))), "incomplete_swap_pair", u))
    found.append(broken(units.where((rq == "RQ7") & (F.col("condition") == "DUAL_SWAP") & (passes != 2)), "incomplete_mitigation_swap", u))
    slots = units.where("rq_code = 'RQ6'").groupBy("judge").agg((n_if(F.col("presentation_order") == "SELF_A") - n_if(F.col("presentation_order") == "SELF_B")).alias("gap")).where("abs(gap) > 1")
    known = F.col("condition").isin("BASELINE_STANDARD", "DUAL_SWAP")
    pairs = units.where("rq_code = 'RQ7'").groupBy("pair_key", "judge").agg(n_if(F.col("condition") == "BASELINE_STANDARD").alias("b"), n_if(F.col("condition") == "DUAL_SWAP").alias("d"), n_if(~F.coalesce(known, F.lit(False))).alias("x")).where("b = 0 or d = 0 or x > 0")
    return together(*found, broken(slots, "unbalanced_rq6_slots", F.col("judge"), F.col("gap")), broken(pairs, "unmatched_rq7_strategy", F.concat_ws(":", "pair_key", "judge")))


def validate_counterbalance(units: DataFrame, passes: DataFrame | None = None) -> DataFrame:
    """Broken rules of a counterbalanced design.

    ``units``: ``pair_id, judge, other_family, category, stratum``. ``passes`` (``pair_id, judge,
    presentation, displayed_a, displayed_b, answer_a_id, answer_b_id, same_id``) adds the schedule: AB and BA of
    each unit, displayed answers that reverse, and the same family as often in A as in B.
    """
    gap = n_if(F.col("stratum") == "SAME") - n_if(F.col("stratum") == "OTHER")
    cells = units.groupBy("judge", "other_family", "category").agg(gap.alias("gap")).where("gap <> 0")
    judges = units.groupBy("judge").agg(gap.alias("gap")).where("gap <> 0")
    found = [
        repeated(units, ["pair_id", "judge"], "duplicate_unit"),
        broken(judges, "unequal_strata_of_judge", F.col("judge"), F.col("gap")),
        broken(cells, "unequal_strata", F.concat_ws(":", "judge", "other_family", "category"), F.col("gap")),
    ]
    if passes is not None:
        key, ab = F.concat_ws(":", "pair_id", "judge"), F.col("presentation") == "AB"
        both = passes.groupBy("pair_id", "judge").agg(n_if(ab).alias("ab"), n_if(F.col("presentation") == "BA").alias("ba"), F.count("*").alias("n"))
        both = units.select("pair_id", "judge").distinct().join(both, ["pair_id", "judge"], "left").where("n is null or ab <> 1 or ba <> 1 or n <> 2")
        first, second = F.when(ab, F.col("answer_a_id")).otherwise(F.col("answer_b_id")), F.when(ab, F.col("answer_b_id")).otherwise(F.col("answer_a_id"))
        turned = passes.where((F.col("displayed_a") != first) | (F.col("displayed_b") != second))
        in_a, in_b = F.col("displayed_a") == F.col("same_id"), F.col("displayed_b") == F.col("same_id")
        sides = passes.groupBy("judge").agg(n_if(in_a).alias("a"), n_if(in_b).alias("b"), n_if(~in_a & ~in_b).alias("none"))
        found += [
            broken(both, "missing_ab_ba_schedule", key),
            broken(turned, "irreversible_answer_mapping", F.concat_ws(":", "pair_id", "judge", "presentation")),
            broken(sides.where("none > 0"), "same_family_answer_missing", F.col("judge"), F.col("none")),
            broken(sides.where("a <> b"), "presentation_not_counterbalanced", F.col("judge"), F.col("a") - F.col("b")),
        ]
    return together(*found)


def validate_schedule(schedule: DataFrame, judges: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs without exactly one pass for each judge, half of them AB; repeated keys; with ``pairs``, displayed ids that do not follow the presentation."""
    rows = schedule.count()
    g = schedule.groupBy("pair_id").agg(F.count_distinct("judge").alias("j"), n_if(F.col("presentation") == "AB").alias("ab"), F.count("*").alias("n"))
    wrong = {"judge_population": ((F.col("j") != judges) | (F.col("n") != judges), F.col("j")), "unbalanced_presentation": (2 * F.col("ab") != F.col("n"), F.col("ab"))}
    found = [several(g, F.col("pair_id"), wrong), repeated(dealt(schedule.select("idempotency_key"), rows, "idempotency_key"), ["idempotency_key"], "duplicate_key")]
    if pairs is not None:
        s = schedule.join(pairs.select("pair_id", F.least("answer_a_id", "answer_b_id").alias("lo"), F.greatest("answer_a_id", "answer_b_id").alias("hi")), "pair_id", "left")
        ab = F.col("presentation") == "AB"
        drift = (F.col("displayed_a") != F.when(ab, F.col("lo")).otherwise(F.col("hi"))) | (F.col("displayed_b") != F.when(ab, F.col("hi")).otherwise(F.col("lo")))
        found.append(broken(s.where(F.coalesce(drift, F.lit(True))), "displayed_answer_drift", F.concat_ws(":", "pair_id", "judge")))
    return together(*found)


#: Attempt numbers of a slot that have a counter of their own in ``validate_ledger``, and copies of a row that one array holds.
NUMBERS, COPIES = range(4), 1000


def validate_ledger(slots: DataFrame, attempts: DataFrame) -> DataFrame:
    """Orphan attempts, repeated attempts, counts that differ from the slot's, attempts after completion, and (with ``started_at`` and ``completed_at``) completion before the start.

    Attempts are folded by slot before they are sent, with a counter for each number in ``NUMBERS``, and meet the slots once for all rules; other numbers are grouped as they are.
    """
    p, i, n, last = F.col("pass_id"), F.col("attempt_index"), F.col("n"), F.col("last")
    g = attempts.groupBy("pass_id").agg(F.count("*").alias("n"), F.max(i).alias("last"), F.min(F.when(F.col("state") == "COMPLETED", i)).alias("done"), *(n_if(i == k).alias(f"at_{k}") for k in NUMBERS))
    # a slot that is listed twice is judged twice, its repeated attempts are named once
    j = g.join(slots.select("pass_id", "attempt_count", F.row_number().over(Window.partitionBy("pass_id").orderBy("attempt_count")).alias("slot")), "pass_id", "left")
    orphan, first = F.col("slot").isNull(), F.coalesce("slot", F.lit(1)) == 1
    row = lambda rule, key, detail, times=F.lit(1): F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"), times.cast("long").alias("times"))
    found = [(orphan, row("orphan_attempt", p, F.lit(""), n)), (F.col("attempt_count") != n, row("attempt_count", p, n)), (~orphan & (F.col("done") < last), row("replay_after_terminal", p, last))]
    found += [(first & (F.col(f"at_{k}") > 1), row("duplicate_attempt", F.concat_ws(":", p.cast("string"), F.lit(k)), F.col(f"at_{k}"))) for k in NUMBERS]
    rows = j.where(reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c, _ in found))).select(F.inline(F.array_compact(F.array(*(F.when(c, r) for c, r in found)))))
    blocks = rows.select("rule", "key", "detail", "times", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPIES))).alias("block"))
    named = blocks.select("rule", "key", "detail", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("times") - COPIES * F.col("block"))))).drop("col")
    late = [broken(attempts.where("completed_at < started_at"), "completed_before_start", F.concat_ws(":", "pass_id", "attempt_index"))] if {"started_at", "completed_at"} <= set(attempts.columns) else []
    return together(*late, named, repeated(attempts.where(~F.coalesce(i.isin(*NUMBERS), F.lit(False))), ["pass_id", "attempt_index"], "duplicate_attempt"))


def validate_triplets(rows: DataFrame) -> DataFrame:
    """(pair, judge) groups without one baseline, one AB and one BA, or with several human labels."""
    g = dealt(rows, rows.count(), "pair_id", "judge").groupBy("pair_id", "judge").agg(n_if(F.col("condition") == "BASELINE").alias("b"), n_if((F.col("condition") == "DUAL") & (F.col("presentation") == "AB")).alias("ab"), n_if((F.col("condition") == "DUAL") & (F.col("presentation") == "BA")).alias("ba"), F.count_distinct(F.coalesce("human_label", F.lit("None"))).alias("labels"))
    return several(g, F.concat_ws(":", "pair_id", "judge"), {"linked_structure": (F.expr("b <> 1 or ab <> 1 or ba <> 1"), None), "label_drift": (F.col("labels") > 1, F.col("labels"))})


def validate_rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule; a rule that is null counts as broken. One scan for all rules."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.explode(failed).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def compare_canonical(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counts of equal, changed, missing and extra rows."""
    side = lambda df, s: df.select(key, F.struct(*fields).alias(s))
    j = side(a, "l").join(side(b, "r"), key, "full_outer")
    named = cases((F.col("r").isNull(), "missing"), (F.col("l").isNull(), "extra"), (F.col("l").eqNullSafe(F.col("r")), "equal"), otherwise="changed")
    return j.groupBy(named.alias("status")).agg(F.count("*").alias("n"))
