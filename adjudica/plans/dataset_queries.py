"""Queries of the canonical dataset and of controlled passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import dataset as S
from ..operators import pairs as P
from .catalog import query
from .fixtures import duck, table

_src = "src as (select distinct question_id, 1 + prompt_id % 2 as turn, model_a, model_b, sha256('q' || cast(question_id as string) || cast(prompt_id % 2 as string)) as prompt_sha, sha256(model_a || cast(question_id as string)) as sha_a, sha256(model_b || cast(question_id as string)) as sha_b, human_label as label from pairs where human_label is not null)"
_rec = "rec as (select pair_id as record_id, question_id, 1 + (case when pair_id % 10 = 0 then prompt_id + 1 else prompt_id end) % 2 as turn, model_a, case when pair_id % 13 = 0 then model_a else model_b end as model_b, sha256('q' || cast(question_id as string) || cast(prompt_id % 2 as string)) as prompt_sha, sha256(model_a || cast(question_id as string)) as sha_a, sha256(model_b || case when pair_id % 11 = 0 then 'x' else cast(question_id as string) end) as sha_b, case when pair_id % 7 = 0 and human_label = 'ANSWER_A' then 'ANSWER_B' when pair_id % 7 = 0 and human_label = 'ANSWER_B' then 'ANSWER_A' else human_label end as label from pairs where human_label is not null)"
_turned = "case label when 'ANSWER_A' then 'ANSWER_B' when 'ANSWER_B' then 'ANSWER_A' else label end"


def _sha(*parts):
    return F.sha2(F.concat(*(p.cast("string") for p in parts)), 256)


def source(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").where("human_label is not null")
    q, t = F.col("question_id"), F.col("prompt_id") % 2
    return p.select("question_id", (1 + t).cast("int").alias("turn"), "model_a", "model_b", _sha(F.lit("q"), q, t).alias("prompt_sha"), _sha(F.col("model_a"), q).alias("sha_a"), _sha(F.col("model_b"), q).alias("sha_b"), F.col("human_label").alias("label")).distinct()


def records(spark, sf_dir):
    p = table(spark, sf_dir, "pairs").where("human_label is not null")
    q, k, h = F.col("question_id"), F.col("pair_id"), F.col("human_label")
    turn = 1 + (F.when(k % 10 == 0, F.col("prompt_id") + 1).otherwise(F.col("prompt_id"))) % 2
    label = L.cases(((k % 7 == 0) & (h == "ANSWER_A"), "ANSWER_B"), ((k % 7 == 0) & (h == "ANSWER_B"), "ANSWER_A"), otherwise=h)
    return p.select(k.alias("record_id"), "question_id", turn.cast("int").alias("turn"), "model_a", F.when(k % 13 == 0, F.col("model_a")).otherwise(F.col("model_b")).alias("model_b"), _sha(F.lit("q"), q, F.col("prompt_id") % 2).alias("prompt_sha"), _sha(F.col("model_a"), q).alias("sha_a"), _sha(F.col("model_b"), F.when(k % 11 == 0, "x").otherwise(q.cast("string"))).alias("sha_b"), label.alias("label"))


@query(duck(f"""with {_src}, {_rec}, an as (select question_id, turn, model_a as model, sha_a as sha from src union select question_id, turn, model_b, sha_b from src), lb as (select question_id, turn, model_a, model_b, label from src union select question_id, turn, model_b, model_a, {_turned} from src)
  select record_id, case when not exists (select 1 from src s where s.question_id = rec.question_id and s.turn = rec.turn and s.prompt_sha = rec.prompt_sha) then 'PROMPT_MISMATCH' when model_a = model_b then 'SAME_ANSWER'
  when not exists (select 1 from an where an.question_id = rec.question_id and an.turn = rec.turn and an.model = rec.model_a and an.sha = rec.sha_a) or not exists (select 1 from an where an.question_id = rec.question_id and an.turn = rec.turn and an.model = rec.model_b and an.sha = rec.sha_b) then 'ANSWER_MISMATCH'
  when not exists (select 1 from lb where lb.question_id = rec.question_id and lb.turn = rec.turn and lb.model_a = rec.model_a and lb.model_b = rec.model_b and lb.label = rec.label) then 'LABEL_ROW_MISSING' else 'OK' end as code from rec"""))
def canonical_validation(spark, sf_dir):
    return S.validate_canonical(records(spark, sf_dir), source(spark, sf_dir))


@query(duck(f"""with {_src}, {_rec}, lb as (select question_id, turn, model_a, model_b, label from src union select question_id, turn, model_b, model_a, {_turned} from src), tt as (select distinct question_id, prompt_sha, turn from src),
  x as (select rec.record_id, rec.question_id, rec.turn, list(distinct tt.turn) filter (where tt.turn is not null) as t, list(distinct tt.turn) filter (where tt.turn = lb.turn) as b from rec left join tt on tt.question_id = rec.question_id and tt.prompt_sha = rec.prompt_sha left join lb on lb.question_id = rec.question_id and lb.model_a = rec.model_a and lb.model_b = rec.model_b and lb.label = rec.label group by 1, 2, 3),
  y as (select *, case when len(b) = 1 then b[1] when question_id = 85 then 2 when coalesce(len(b), 0) = 0 and len(t) = 1 then t[1] end as resolved_turn, case when len(b) = 1 then 'TEXT_AND_LABEL' when question_id = 85 then 'OVERRIDE' when coalesce(len(b), 0) = 0 and len(t) = 1 then 'TEXT_ONLY' else 'UNRESOLVED' end as provenance from x)
  select record_id, resolved_turn, provenance, case when resolved_turn is null then 'UNRESOLVED' when resolved_turn = turn then 'ALIGNED' else 'WRONG_TURN' end as root_cause from y"""))
def source_reconciliation(spark, sf_dir):
    overrides = spark.createDataFrame([(85, 2)], "question_id long, turn int")
    return S.reconcile(records(spark, sf_dir), source(spark, sf_dir), overrides)


@query(duck(f"with {_src}, p as (select question_id, turn, row_number() over (order by question_id, turn) as prompt_id from (select distinct question_id, turn from src)), a as (select question_id, turn, model, row_number() over (order by question_id, turn, model) as answer_id from (select question_id, turn, model_a as model from src union select question_id, turn, model_b from src)) select prompt_id, a.answer_id as answer_a_id, b.answer_id as answer_b_id, case label when 'ANSWER_A' then a.answer_id when 'ANSWER_B' then b.answer_id end as winner_id from src join p using (question_id, turn) join a on a.question_id = src.question_id and a.turn = src.turn and a.model = model_a join a b on b.question_id = src.question_id and b.turn = src.turn and b.model = model_b"))
def canonical_dataset(spark, sf_dir):
    return S.build_dataset(source(spark, sf_dir))["preferences"]


@query(duck("select pass_id, s || ':' || judge as unit_id, s || ':' || judge as run_id, case when pair_id % 2 = 0 then 'RQ1' else 'RQ3' end as rq_code, outcome from passes where pair_id % 5 > 0"))
def controlled_passes(spark, sf_dir):
    p = table(spark, sf_dir, "passes").withColumn("run_id", F.concat_ws(":", "s", "judge"))
    runs = p.groupBy("run_id").agg(F.min("pair_id").alias("k")).select("run_id", F.col("run_id").alias("unit_id"), F.when(F.col("k") % 5 > 0, "CONTROLLED").otherwise("LEGACY").alias("evidence_class"))
    units = p.select(F.col("run_id").alias("unit_id"), (F.col("pair_id") % 2).alias("manifest_id")).distinct()
    manifests = spark.createDataFrame([(0, "RQ1"), (1, "RQ3")], "manifest_id long, rq_code string")
    return P.controlled_passes(p.select("pass_id", "run_id", "outcome"), runs, units, manifests).select("pass_id", "unit_id", "run_id", "rq_code", "outcome")
