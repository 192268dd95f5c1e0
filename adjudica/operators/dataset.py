"""Canonical dataset: validation and reconciliation of records against the raw source, and its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import cases, winner_to_label
from ..functions.text import turn_answer, turn_prompt
from .ledger import dense_ids


def source_rows(judgments: DataFrame) -> DataFrame:
    """Raw judgements as rows of question, turn, models, digests of prompt and answers, and label."""
    side = lambda s: F.sha2(turn_answer(f"conversation_{s}", "turn"), 256).alias(f"sha_{s}")
    return judgments.select("question_id", "turn", "model_a", "model_b", F.sha2(turn_prompt("conversation_a", "turn"), 256).alias("prompt_sha"), side("a"), side("b"), winner_to_label("winner").alias("label"))


def _reversed(label: str) -> Column:
    return cases((F.col(label) == "ANSWER_A", "ANSWER_B"), (F.col(label) == "ANSWER_B", "ANSWER_A"), otherwise=F.col(label))


def validate_canonical(records: DataFrame, source: DataFrame) -> DataFrame:
    """An error code (or OK) for each record: prompt digest, distinct answers, answer digests, label row direct or reversed.

    ``records`` and ``source`` have the columns of ``source_rows``; records add ``record_id``.
    """
    prompts = source.select("question_id", "turn", "prompt_sha").distinct().withColumn("p", F.lit(True))
    answer = source.select("question_id", "turn", F.inline(F.array(F.struct(F.col("model_a").alias("model"), F.col("sha_a").alias("sha")), F.struct(F.col("model_b").alias("model"), F.col("sha_b").alias("sha"))))).distinct()
    side = lambda s: answer.select("question_id", "turn", F.col("model").alias(f"model_{s}"), F.col("sha").alias(f"sha_{s}"), F.lit(True).alias(f"found_{s}"))
    direct = source.select("question_id", "turn", "model_a", "model_b", "label")
    turned = source.select("question_id", "turn", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), _reversed("label").alias("label"))
    labels = direct.union(turned).distinct().withColumn("l", F.lit(True))
    j = records.join(prompts, ["question_id", "turn", "prompt_sha"], "left").join(side("a"), ["question_id", "turn", "model_a", "sha_a"], "left").join(side("b"), ["question_id", "turn", "model_b", "sha_b"], "left").join(labels, ["question_id", "turn", "model_a", "model_b", "label"], "left")
    code = cases((F.col("p").isNull(), "PROMPT_MISMATCH"), (F.col("model_a") == F.col("model_b"), "SAME_ANSWER"), (F.col("found_a").isNull() | F.col("found_b").isNull(), "ANSWER_MISMATCH"), (F.col("l").isNull(), "LABEL_ROW_MISSING"), otherwise="OK")
    return j.select("record_id", code.alias("code"))


def reconcile(records: DataFrame, source: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Turn of each record by its prompt digest, met with the turns of its label rows; provenance and root cause.

    ``records``: ``record_id, question_id, prompt_sha, model_a, model_b, label, turn``. ``overrides``
    (``question_id, turn``) decides where both turns remain.
    """
    by_text = source.groupBy("question_id", "prompt_sha").agg(F.sort_array(F.collect_set("turn")).alias("text_turns"))
    direct = source.select("question_id", "model_a", "model_b", "label", "turn")
    turned = source.select("question_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), _reversed("label").alias("label"), "turn")
    by_label = direct.union(turned).groupBy("question_id", "model_a", "model_b", "label").agg(F.sort_array(F.collect_set("turn")).alias("label_turns"))
    j = records.join(by_text, ["question_id", "prompt_sha"], "left").join(by_label, ["question_id", "model_a", "model_b", "label"], "left")
    if overrides is not None:
        j = j.join(overrides.select("question_id", F.col("turn").alias("override")), "question_id", "left")
    else:
        j = j.withColumn("override", F.lit(None).cast("int"))
    empty = F.array().cast("array<int>")
    t, lab = F.coalesce("text_turns", empty), F.coalesce("label_turns", empty)
    both = F.array_intersect(t, lab)
    found = cases((F.size(both) == 1, both[0]), (F.col("override").isNotNull(), F.col("override")), ((F.size(both) == 0) & (F.size(t) == 1), t[0]))
    how = cases((F.size(both) == 1, "TEXT_AND_LABEL"), (F.col("override").isNotNull(), "OVERRIDE"), ((F.size(both) == 0) & (F.size(t) == 1), "TEXT_ONLY"), otherwise="UNRESOLVED")
    j = j.withColumn("resolved_turn", found).withColumn("provenance", how)
    cause = cases((F.col("resolved_turn").isNull(), "UNRESOLVED"), (F.col("resolved_turn") == F.col("turn"), "ALIGNED"), otherwise="WRONG_TURN")
    return j.select("record_id", "resolved_turn", "provenance", cause.alias("root_cause"))


def build_dataset(source: DataFrame) -> dict[str, DataFrame]:
    """Prompts, answers and preferences with dense ids in the order of their identities."""
    prompts = dense_ids(source, ["question_id", "turn"], "prompt_id")
    sides = source.select("question_id", "turn", F.inline(F.array(F.struct(F.col("model_a").alias("model"), F.col("sha_a").alias("sha")), F.struct(F.col("model_b").alias("model"), F.col("sha_b").alias("sha")))))
    first = sides.groupBy("question_id", "turn", "model").agg(F.min("sha").alias("sha"))
    answers = dense_ids(first, ["question_id", "turn", "model"], "answer_id").join(first, ["question_id", "turn", "model"])
    side = lambda s: answers.select("question_id", "turn", F.col("model").alias(f"model_{s}"), F.col("answer_id").alias(f"answer_{s}_id"))
    prefs = source.where("label is not null").join(prompts, ["question_id", "turn"]).join(side("a"), ["question_id", "turn", "model_a"]).join(side("b"), ["question_id", "turn", "model_b"])
    winner = cases((F.col("label") == "ANSWER_A", F.col("answer_a_id")), (F.col("label") == "ANSWER_B", F.col("answer_b_id")))
    return {"prompts": prompts, "answers": answers.join(prompts, ["question_id", "turn"]), "preferences": prefs.select("prompt_id", "answer_a_id", "answer_b_id", winner.alias("winner_id"))}
