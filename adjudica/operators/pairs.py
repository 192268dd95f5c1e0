"""Joins, freezing of reference pairs, deduplication and set comparisons.

Keys are ids or digests; text columns are dropped before any shuffle that does not need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import SANDBOX, cases, winner_id_to_label
from ..functions.text import trimmed
from .metrics import n_if


def pair_columns(prompt: str = "prompt_id", a: str = "answer_a_id", b: str = "answer_b_id") -> list[Column]:
    return [F.col(prompt).alias("prompt_id"), F.least(a, b).alias("lo_id"), F.greatest(a, b).alias("hi_id")]


# Joins ----------------------------------------------------------------------------------------
def decisions_wide(decisions: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions with category and, for both answers and the winner, model, words and format; texts stay out.

    Rows without a prompt or an answer go (inner joins); a tie has no winner model (left join).
    """
    facts = answers.select("id", "model_name", "word_count", "format_type")
    side = lambda s: facts.select(F.col("id").alias(f"answer_{s}_id"), F.col("model_name").alias(f"model_{s}"), F.col("word_count").alias(f"wc_{s}"), F.col("format_type").alias(f"format_{s}"))
    base = decisions.select("id", "prompt_id", "judge_model_name", "answer_a_id", "answer_b_id", "position_a_id", "winner_id")
    d = base.join(prompts.select(F.col("id").alias("prompt_id"), F.col("category")), "prompt_id").join(side("a"), "answer_a_id").join(side("b"), "answer_b_id")
    # The winner is one of the two answers in all but broken rows: no third shuffle of answers.
    return d.withColumn("winner_model", cases((F.col("winner_id") == F.col("answer_a_id"), F.col("model_a")), (F.col("winner_id") == F.col("answer_b_id"), F.col("model_b"))))


def historical_decisions(wide: DataFrame, judge: str) -> DataFrame:
    """One judge's decisions outside the sandbox categories and without anonymous answers."""
    return wide.where((F.col("judge_model_name") == judge) & ~F.col("category").isin(*SANDBOX) & ~F.col("model_a").isin("answer_a", "answer_b") & ~F.col("model_b").isin("answer_a", "answer_b"))


def human_vs_judge(preferences: DataFrame, decisions: DataFrame, judge: str) -> DataFrame:
    """Human and judge choice on orientation-exact pairs of a judge; null winners are ties."""
    keys = ["prompt_id", "answer_a_id", "answer_b_id"]
    choice = lambda w: cases((F.col(w).isNull(), "TIE"), (F.col(w) == F.col("answer_a_id"), "ANSWER_A"), otherwise="ANSWER_B")
    d = decisions.where((F.col("judge_model_name") == judge) & ~F.col("category").isin(*SANDBOX)).select(*keys, "category", F.col("winner_id").alias("judge_winner_id"))
    joined = preferences.select("preference_id", *keys, F.col("winner_id").alias("human_winner_id")).join(d, keys)
    return joined.select("preference_id", *keys, "category", choice("human_winner_id").alias("human_label"), choice("judge_winner_id").alias("judge_label"))


def judge_vs_judge(decisions: DataFrame, first: str, second: str) -> DataFrame:
    """Choices of two judges on identical pairs; each side is filtered before the join, repeats multiply."""
    keys = ["prompt_id", "answer_a_id", "answer_b_id"]
    choice = cases((F.col("winner_id").isNull(), "TIE"), (F.col("winner_id") == F.col("answer_a_id"), "ANSWER_A"), otherwise="ANSWER_B")
    side = lambda j, name, *more: decisions.where((F.col("judge_model_name") == j) & ~F.col("category").isin(*SANDBOX)).select(*keys, *more, choice.alias(name))
    return side(first, "human_label", "category").join(side(second, "judge_label"), keys)


def controlled_passes(passes: DataFrame, runs: DataFrame, units: DataFrame, manifests: DataFrame) -> DataFrame:
    """Passes of controlled runs with their unit and manifest."""
    return passes.join(runs.where("evidence_class = 'CONTROLLED'"), "run_id").join(units, "unit_id").join(manifests, "manifest_id")


def logical_view(ledger: DataFrame, corrected: DataFrame, recovery: DataFrame) -> DataFrame:
    """One row for each historical pass: reusable ones, and corrected ones with recovery precedence.

    A corrected slot that did not complete is replaced by its recovery slot; if that did not
    complete or is missing, the outcome is null. ``source`` says where the row comes from.
    """
    reusable = ledger.where("classification = 'SOURCE_CORRECT_REUSABLE'").select(F.col("pass_id").alias("historical_identity"), "rq_code", "judge", "presentation", "outcome", F.lit("SOURCE_CORRECT_REUSABLE").alias("source"))
    r = recovery.select(F.col("original_planned_pass_id").alias("planned_pass_id"), F.col("state").alias("r_state"), F.col("final_outcome").alias("r_outcome"))
    done = F.col("state") == "COMPLETED"
    outcome = cases((done, F.col("final_outcome")), (F.col("r_state") == "COMPLETED", F.col("r_outcome")))
    fixed = corrected.join(r, "planned_pass_id", "left").select("historical_identity", "rq_code", "judge", "presentation", outcome.alias("outcome"), F.when(done, "CORRECTED_ORIGINAL").otherwise("RECOVERY_REPLACEMENT").alias("source"))
    return reusable.unionByName(fixed)


def by_rq(logical: DataFrame, rq: str, manifests: DataFrame | None = None, include_reusable: bool = False) -> DataFrame:
    """Rows of a question (and of given manifests); reusable rows only on request."""
    df = logical.where(F.col("rq_code") == rq)
    df = df if include_reusable else df.where("source <> 'SOURCE_CORRECT_REUSABLE'")
    return df if manifests is None else df.join(manifests, "manifest_id", "left_semi")


def require_controlled(df: DataFrame, evidence: str = "evidence_class", unit: str = "unit_id") -> DataFrame:
    """``df`` if all its evidence is controlled; else an error that names some units. Runs one bounded look-up."""
    bad = rejected_evidence(df, evidence).select(unit).limit(5).collect()
    if bad:
        raise ValueError(f"controlled evidence only; rejected {[r[0] for r in bad]}")
    return df


def rejected_evidence(df: DataFrame, evidence: str = "evidence_class") -> DataFrame:
    """The rows that the gate does not let through; a missing class is not controlled."""
    return df.where(~F.coalesce(F.col(evidence) == "CONTROLLED", F.lit(False)))


def search_records(df: DataFrame, text: str, columns: tuple[str, ...] = ("prompt_id", "model_names", "reasoning_text")) -> DataFrame:
    """Rows that hold ``text`` in one of the columns, whatever the case; all rows for a blank one."""
    if not text.strip():
        return df
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return df.where(found)


def recovery_slots(slots: DataFrame, attempts: DataFrame) -> DataFrame:
    """Failed or ambiguous slots that never completed, with their attempts in order."""
    lineage = attempts.groupBy("pass_id").agg(F.sort_array(F.collect_list(F.struct("attempt_index", "state"))).alias("attempts"), F.max((F.col("state") == "COMPLETED").cast("int")).alias("completed"))
    return slots.where(F.col("state").isin("FAILED", "AMBIGUOUS")).join(lineage, "pass_id").where("completed = 0").select("pass_id", "state", F.size("attempts").alias("n_attempts"), F.array_join(F.transform("attempts", lambda x: x["state"]), ",").alias("lineage"))


def reuse_ledger(passes: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Class of each historical pass by the reconciliation of its order-free pair."""
    keys = ["prompt_id", "lo_id", "hi_id"]
    r = reconciliation.select(*keys, "exact", F.lit(True).alias("known"))
    named = cases((F.col("known").isNull(), "HISTORICAL_ONLY_UNALIGNED"), (F.col("exact"), "SOURCE_CORRECT_REUSABLE"), otherwise="CORRECTED_RERUN_REQUIRED")
    return passes.select("pass_id", *pair_columns()).join(r, keys, "left").select("pass_id", named.alias("classification"))


def prompt_question_map(prompts: DataFrame, source: DataFrame) -> DataFrame:
    """Question of a prompt by its text, only where that text names one question."""
    one = source.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("question_id").alias("question_id"), F.max("question_id").alias("hi")).where("question_id = hi")
    return prompts.select(F.col("id").alias("prompt_id"), F.sha2("text", 256).alias("sha")).join(one, "sha").select("prompt_id", "question_id")


def enrich_records(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer text of (prompt, model) where exactly one answer fits, else UNAVAILABLE."""
    unique = answers.groupBy("prompt_id", "model_name").agg(F.count("*").alias("n"), F.min("text").alias("t"))
    side = lambda s: unique.select("prompt_id", F.col("model_name").alias(f"model_{s}"), F.when(F.col("n") == 1, F.col("t")).alias(f"text_{s}"))
    out = records.join(side("a"), ["prompt_id", "model_a"], "left").join(side("b"), ["prompt_id", "model_b"], "left")
    return out.withColumn("provenance", F.when(F.col("text_a").isNotNull() & F.col("text_b").isNotNull(), "RESOLVED").otherwise("UNAVAILABLE"))


def leaderboard(ranking: DataFrame, neutral: DataFrame) -> DataFrame:
    """Ranking with neutralised scores; missing ones are 0.0."""
    return ranking.join(neutral.select("model", "neutralized_score"), "model", "left").withColumn("neutralized_score", F.coalesce("neutralized_score", F.lit(0.0))).orderBy(F.desc("score"), "model")


def pair_records(preferences: DataFrame, prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Preferences with category, models and label."""
    side = lambda s: answers.select(F.col("id").alias(f"answer_{s}_id"), F.col("model_name").alias(f"model_{s}"), F.sha2("text", 256).alias(f"sha_{s}"))
    df = preferences.join(prompts.select(F.col("id").alias("prompt_id"), "category"), "prompt_id")
    return df.join(side("a"), "answer_a_id").join(side("b"), "answer_b_id").withColumn("human_label", winner_id_to_label("winner_id", "answer_a_id", "answer_b_id"))


# Freezing and deduplication -------------------------------------------------------------------
def _groups(preferences: DataFrame) -> DataFrame:
    winner = F.coalesce(F.col("winner_id"), F.lit(-1))
    return preferences.groupBy(*pair_columns()).agg(F.count("*").alias("n_rows"), F.min(winner).alias("w"), F.max(winner).alias("w_hi"), F.min("preference_id").alias("preference_id"))


def freeze_pairs(preferences: DataFrame) -> DataFrame:
    """One row, in id order, for each unordered pair with one outcome; contradictory pairs are left out."""
    g = _groups(preferences).where("w = w_hi")
    label = cases((F.col("w") == -1, "TIE"), (F.col("w") == F.col("lo_id"), "ANSWER_A"), (F.col("w") == F.col("hi_id"), "ANSWER_B"))
    return g.select("preference_id", "prompt_id", F.col("lo_id").alias("answer_a_id"), F.col("hi_id").alias("answer_b_id"), label.alias("human_label"), (F.col("n_rows") - 1).alias("collapsed"))


def population_funnel(preferences: DataFrame, answers: DataFrame) -> DataFrame:
    """Records, groups, conflicts, groups with a blank answer and eligible groups."""
    blank = answers.select("id", (trimmed("text") == "").alias("blank"))
    g = _groups(preferences).join(blank.select(F.col("id").alias("lo_id"), F.col("blank").alias("b1")), "lo_id", "left").join(blank.select(F.col("id").alias("hi_id"), F.col("blank").alias("b2")), "hi_id", "left")
    conflict, empty = F.col("w") != F.col("w_hi"), F.coalesce("b1", F.lit(True)) | F.coalesce("b2", F.lit(True))
    return g.agg(F.sum("n_rows").alias("records"), F.count("*").alias("groups"), n_if(conflict).alias("conflicts"), n_if(~conflict & empty).alias("blank"), n_if(~conflict & ~empty).alias("eligible"))


def index_source(judgments: DataFrame) -> DataFrame:
    """First text of each (question, turn, model) and whether another one contradicts it."""
    sides = F.array(F.struct(F.col("model_a").alias("model"), F.col("text_a").alias("text")), F.struct(F.col("model_b").alias("model"), F.col("text_b").alias("text")))
    rows = judgments.select("question_id", "turn", F.inline(sides))
    return rows.groupBy("question_id", "turn", "model").agg(F.min(F.sha2("text", 256)).alias("sha"), (F.count_distinct(F.sha2("text", 256)) > 1).alias("conflict"))


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in a deterministic order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pair_overlap(first: DataFrame, second: DataFrame, key: str, by: str) -> DataFrame:
    """Keys of both, of the first only and of the second only, by category."""
    a, b = first.select(key, by).distinct().withColumn("a", F.lit(1)), second.select(key, by).distinct().withColumn("b", F.lit(1))
    return a.join(b, [key, by], "full_outer").groupBy(by).agg(F.count("*").alias("keys"), n_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), n_if(F.col("b").isNull()).alias("first_only"), n_if(F.col("a").isNull()).alias("second_only"))


def identity_diff(plan: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Identities that are missing from, extra in or repeated in the stored table."""
    p, s = plan.groupBy(key).agg(F.count("*").alias("p")), stored.groupBy(key).agg(F.count("*").alias("s"))
    j = p.join(s, key, "full_outer")
    issue = cases((F.col("s").isNull(), "missing"), (F.col("p").isNull(), "extra"), (F.col("s") > 1, "duplicate"))
    return j.withColumn("issue", issue).where("issue is not null").select(key, "issue")


def set_digest(df: DataFrame, key: str) -> DataFrame:
    """Order-free digest of a large set: count, duplicates, and the sums of the four 60-bit quarters of each member's SHA-256.

    Equal changes add up in a sum where they cancel in an xor; only partial aggregates leave a task. A
    set with duplicates has no digest.
    """
    k = F.col(key).cast("string")
    g = df.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    part = lambda i: F.sum(F.conv(F.substring(F.sha2("k", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return g.agg(F.count("*").alias("n"), n_if(F.col("n") > 1).alias("duplicates"), F.concat_ws(":", *map(part, range(4))).alias("sums")).select("n", "duplicates", F.when(F.col("duplicates") == 0, F.col("sums")).alias("digest"))


def long_sides(df: DataFrame, value: str = "residual") -> DataFrame:
    """Both sides of each decision in one scan: A with +value, B with -value."""
    v = F.col(value)
    sides = F.array(F.struct(F.col("model_a").alias("model"), v.alias(value)), F.struct(F.col("model_b").alias("model"), (-v).alias(value)))
    return df.select(F.inline(sides))
