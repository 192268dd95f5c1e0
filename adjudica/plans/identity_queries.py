"""Queries of unit and payload identities, of the judgement reader and of exact-provenance classes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity as I
from ..functions import labels as L
from .catalog import query
from .fixtures import duck, table

_GOOD = '"criteria_scores":{"correctness":1,"relevance":2,"completeness":3,"clarity":4,"safety":5},"confidence":0.5,"explanation":"because"'
_BAD = "INVALID_RESPONSE"


def _with(old: str, new: str) -> str:
    return '{"verdict":"ANSWER_A",' + _GOOD.replace(old, new) + "}"


#: Answers of judges and what a strict reader makes of them, worked out by hand.
ANSWERS: list[tuple[str | None, str]] = [
    ('{"verdict":"ANSWER_A",' + _GOOD + "}", "ANSWER_A"),
    ('{"verdict":"ANSWER_B",' + _GOOD + "}", "ANSWER_B"),
    ('{"verdict":"TIE",' + _GOOD + "}", "TIE"),
    ('{"verdict":"UNKNOWN",' + _GOOD + "}", "UNKNOWN"),
    ('```json\n{"verdict":"ANSWER_B",' + _GOOD + "}\n```", "ANSWER_B"),
    ('  Here it is: {"verdict":"TIE",' + _GOOD + "} I hope it helps.", "TIE"),
    ('```\nSure.\n{"verdict":"ANSWER_A",' + _GOOD + "}\n```\nmore", "ANSWER_A"),
    ('{"verdict":"ANSWER_A","verdict":"TIE",' + _GOOD + "}", "TIE"),
    (_with('"correctness":1', '"correctness":9,"correctness":1'), "ANSWER_A"),
    (_with('"confidence":0.5', '"confidence":1'), "ANSWER_A"),
    (_with('"confidence":0.5', '"confidence":1e-1'), "ANSWER_A"),
    (_with('"because"', '" "'), "ANSWER_A"),
    (_with('"because"', '"a \\"quoted\\" {brace} \\u00e9"'), "ANSWER_A"),
    ('{"verdict":"A",' + _GOOD + "}", _BAD),
    ('{"verdict":"answer_a",' + _GOOD + "}", _BAD),
    ('{"verdict":null,' + _GOOD + "}", _BAD),
    (_with('"correctness":1', '"correctness":"1"'), _BAD),
    (_with('"correctness":1', '"correctness":1.0'), _BAD),
    (_with('"correctness":1', '"correctness":true'), _BAD),
    (_with('"correctness":1', '"correctness":0'), _BAD),
    (_with('"safety":5', '"safety":6'), _BAD),
    (_with(',"safety":5', ""), _BAD),
    (_with('"safety":5', '"safety":5,"style":3'), _BAD),
    (_with('"correctness":1', '"correctness":1,"correctness":9'), _BAD),
    (_with('"confidence":0.5', '"confidence":"0.5"'), _BAD),
    (_with('"confidence":0.5', '"confidence":1.01'), _BAD),
    (_with('"confidence":0.5', '"confidence":-0.1'), _BAD),
    (_with('"confidence":0.5', '"confidence":NaN'), _BAD),
    (_with('"confidence":0.5', '"confidence":true'), _BAD),
    (_with('"because"', '""'), _BAD),
    (_with('"because"', "7"), _BAD),
    (_with('"because"', '"because","extra":1'), _BAD),
    (_with(',"explanation":"because"', ""), _BAD),
    (_with('{"correctness":1,"relevance":2,"completeness":3,"clarity":4,"safety":5}', "[1,2,3,4,5]"), _BAD),
    ('{"verdict":"ANSWER_A",' + _GOOD + '} {"verdict":"TIE"}', _BAD),
    ('[{"verdict":"ANSWER_A",' + _GOOD + '},{"verdict":"TIE",' + _GOOD + "}]", _BAD),
    ('{"verdict":"ANSWER_A",' + _GOOD + ",}", _BAD),
    ("{'verdict':'ANSWER_A'," + _GOOD.replace('"', "'") + "}", _BAD),
    ('```{"verdict":"ANSWER_A",' + _GOOD + "}```", _BAD),
    ("I prefer answer A", _BAD),
    ("", _BAD),
    (None, _BAD),
]

_number = f"h('jp:' || s) % {len(ANSWERS)}"
_want = "case n " + " ".join(f"when {i} then '{o}'" for i, (_, o) in enumerate(ANSWERS)) + " end"


@query(duck(f"with p as (select pair_id, {_number} as n from pairs) select pair_id, {_want} as outcome, case when {_want} <> '{_BAD}' then 5 end as safety, case when {_want} <> '{_BAD}' then case n when 9 then 1.0 when 10 then 0.1 else 0.5 end end as confidence from p"))
def judgement_json(spark, sf_dir):
    """Every pair gets one of the answers; its outcome, a score and the confidence."""
    number = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("jp:"), "s"), 256), 1, 8), 16, 10).cast("long"), F.lit(len(ANSWERS)))
    text = L.cases(*((number == i, F.lit(a).cast("string")) for i, (a, _) in enumerate(ANSWERS)))
    j = table(spark, sf_dir, "pairs").select("pair_id", I.judgement(text).alias("j"))
    return j.select("pair_id", "j.outcome", F.col("j.scores.safety").alias("safety"), "j.confidence")


_FIELDS = {
    "experiment_id": "'e' || cast(pair_id % 3 as string)", "manifest_id": "'m1'", "dataset_checksum": "case when pair_id % 2 = 0 then 'd' end", "condition_code": "'CONTROL'", "prompt_id": "prompt_id", "answer_a_id": "answer_a_id",
    "answer_b_id": "answer_b_id", "repetition_index": "0", "presentation_order": "'AB'", "judge_model": "'gpt-4o-mini'", "provider": "'openai'", "provider_model": "'gpt-4o-mini-2024-07-18'", "prompt_template_version": "'v1'",
    "temperature": "cast(pair_id % 4 * 0.25 as decimal(5,4))", "top_p": "cast(1 as decimal(5,4))", "seed": "case when pair_id % 3 = 0 then 7 end", "variant_checksum": "cast(null as string)",
}
_joined = " || '|' || ".join(f"coalesce(cast({e} as string), 'None')" for e in _FIELDS.values())
_nested = "{'answers': [{'id': answer_a_id, 'words': wc_a}, {'id': answer_b_id, 'words': wc_b}], 'label': human_label, 'note': 'say \"' || category || '\"' || chr(10) || chr(9) || 'é\\', 'share': wc_a % 8 / 8.0}"


@query(duck(f"select pair_id, sha256({_joined}) as fingerprint, sha256(to_json({_nested})) as stable from pairs"))
def unit_fingerprints(spark, sf_dir):
    """Digest of the 17 configuration fields of a unit, and the canonical digest of a nested value."""
    p = table(spark, sf_dir, "pairs")
    side = lambda s: F.struct(F.col(f"wc_{s}").alias("words"), F.col(f"answer_{s}_id").alias("id"))
    note = F.concat(F.lit('say "'), "category", F.lit('"\n\té\\'))
    p = p.withColumn("value", F.struct((F.col("wc_a") % 8 / F.lit(8.0)).alias("share"), note.alias("note"), F.col("human_label").alias("label"), F.array(side("a"), side("b")).alias("answers")))
    fields = p.select("pair_id", *(F.expr(e).alias(n) for n, e in _FIELDS.items()), I.stable_sha("value", p.schema["value"].dataType).alias("stable"))
    return fields.select("pair_id", I.unit_fingerprint().alias("fingerprint"), "stable")


_cut = lambda i: repr(I.USER_PARTS[i]).replace("\\n", "' || chr(10) || '")
_sides = "case when presentation = 'AB' then a.text else b.text end as x, case when presentation = 'AB' then b.text else a.text end as y"
_PAYLOAD = f"""with t as (select pass_id, pair_id, p.judge, presentation, q.text as question, {_sides} from passes p join prompts q on p.prompt_id = q.id join answers a on p.answer_a_id = a.id join answers b on p.answer_b_id = b.id),
  u as (select *, {_cut(0)} || question || {_cut(1)} || x || {_cut(2)} || y || {_cut(3)} as content from t where trim(x) <> '' and trim(y) <> '')
  select t.pass_id, case when u.pass_id is not null then sha256(to_json({{'judge': u.judge, 'messages': [{{'content': '{I.SYSTEM_TEXT}', 'role': 'system'}}, {{'content': u.content, 'role': 'user'}}], 'presentation': u.presentation, 'seed': cast(null as integer)}})) end as payload_sha,
  ({len(I.SYSTEM_TEXT)} + length(u.content) + 3) // 4 as tokens, case when t.pair_id % 11 = 0 then 'REUSE_AS_EXPLORATORY' when t.pair_id % 9 in (0, 1) or t.pair_id % 10 = 0 then 'REUSE_AS_EXPLORATORY' else 'FINAL_CONTROLLED_CANDIDATE' end as reuse_class,
  case when t.pair_id % 11 = 0 then 'LIVE_SANDBOX' when t.pair_id % 10 = 0 then '{','.join((*I.HISTORICAL_REASONS, 'MISSING_PASS_LEVEL_DATA'))}' when t.pair_id % 9 in (0, 1) then '{','.join(I.HISTORICAL_REASONS)}' else '' end as reasons
  from t left join u using (pass_id)"""


@query(duck(_PAYLOAD))
def payloads_and_reuse(spark, sf_dir):
    """Rendered payload of each pass with its digest and tokens (null where a text is blank), and the reuse class of its history."""
    a = table(spark, sf_dir, "answers")
    text = lambda s: a.select(F.col("id").alias(f"answer_{s}_id"), F.col("text").alias(s))
    p = table(spark, sf_dir, "passes").select("pass_id", "pair_id", "judge", "presentation", "prompt_id", "answer_a_id", "answer_b_id")
    # judges are shown the same texts: these are joined and written once for each answer pair and order
    case = ["prompt_id", "answer_a_id", "answer_b_id", "presentation"]
    shown = p.select(*case).distinct().join(table(spark, sf_dir, "prompts").select(F.col("id").alias("prompt_id"), F.col("text").alias("question")), "prompt_id").join(text("a"), "answer_a_id").join(text("b"), "answer_b_id")
    shown = shown.withColumn("messages", I.judge_messages("question", *I.displayed("a", "b", "presentation")))
    shown = shown.select(*case, I.message_tokens("messages").alias("tokens"), I.let(F.get("messages", F.lit(1))["content"], I.json_string).alias("user"))
    string = T.StringType()
    sha = I.judge_payload_sha("user", {"judge": (F.col("judge"), string), "presentation": (F.col("presentation"), string), "seed": (F.lit(None).cast("int"), T.IntegerType())})
    p = p.join(shown, case)
    k = F.col("pair_id")
    known = {d: F.lit("x") for d in I.FROZEN_DIMENSIONS} | {"seed": F.when(k % 9 != 0, F.lit("7")), "provider": F.when(k % 9 == 1, "").otherwise("x")}
    p = p.withColumns(known).withColumn("r", I.classify_reuse(k % 10 == 0, k % 11 == 0))
    return p.select("pass_id", sha.alias("payload_sha"), "tokens", "r.reuse_class", F.array_join("r.reasons", ",").alias("reasons"))
