"""Judgements, canonical JSON, unit identity and reuse classes against Python's own JSON and values worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudica.functions import identity as I
from adjudica.plans.identity_queries import ANSWERS


def test_judgements_by_hand(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string").select("i", I.judgement("a").alias("j")).collect()
    for r in rows:
        assert r.j.outcome == ANSWERS[r.i][1], ANSWERS[r.i][0]
        assert (r.j.scores is None) == (r.j.outcome == "INVALID_RESPONSE") == (r.j.explanation is None)
    by = {r.i: r.j for r in rows}
    assert tuple(by[8].scores) == (1, 2, 3, 4, 5) and by[10].confidence == 0.1 and by[12].explanation == 'a "quoted" {brace} é'


def nested():
    yield from ({}, {"z": 1, "a": None}, {"t": 'q"\\/\n\r\t\b\f\x00\x1f\x7f é \u2028 😀'}, {"b": True, "c": False}, {"l": []}, {"l": [3, None, -5]})
    yield from ({"n": {"y": {"k": "v"}, "x": ["", "a,b"]}}, {"l": [{"b": 1, "a": "x"}, {"b": None, "a": None}]}, {"B": 1, "a": 2, "_": 3, "é": 4})
    for x in (0.0, -0.0, 1.0, 0.1, 1e-4, 1e-5, 123456789.125, 1e15, 1e16, 1.5e300, 5e-324, 2.0**-44, 1 / 3, 100.0, float("nan"), float("inf"), -float("inf")):
        yield {"x": x, "l": [x]}


def kind_of(v):
    if isinstance(v, bool) or v is None:
        return T.BooleanType() if v is not None else T.StringType()
    if isinstance(v, (int, float)):
        return T.LongType() if isinstance(v, int) else T.DoubleType()
    if isinstance(v, str):
        return T.StringType()
    if isinstance(v, list):
        return T.ArrayType(kind_of(v[0]) if v else T.StringType())
    return T.StructType([T.StructField(k, kind_of(x)) for k, x in v.items()])


@pytest.mark.parametrize("value", list(nested()), ids=str)
def test_canonical_json(spark, value):
    kind = T.StructType([T.StructField("v", kind_of(value))])
    df = spark.createDataFrame([(value,)], kind) if value else spark.range(1).select(F.struct().alias("v"))
    want = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    got = df.select(I.canonical_json("v", df.schema["v"].dataType), I.stable_sha("v", df.schema["v"].dataType)).first()
    assert tuple(got) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_canonical_maps_and_nulls(spark):
    m = {"b": [1, 2], "a": None, "é": [], "Z": [3]}
    df = spark.createDataFrame([(m,), (None,)], "m map<string,array<int>>")
    got = [r[0] for r in df.select(I.canonical_json("m", df.schema["m"].dataType)).collect()]
    assert got == [json.dumps(m, ensure_ascii=False, sort_keys=True, separators=(",", ":")), "null"]
    with pytest.raises(TypeError, match="cast it first"):
        I.canonical_json("d", T.DecimalType(5, 4))


def test_unit_fingerprint_by_hand(spark):
    values = ("e", "m", None, "CONTROL", 5, 11, 12, 0, "AB", "j", "p", "pm", "v1", "0.7000", "1.0000", None, None)
    assert len(values) == len(I.UNIT_FIELDS) == 17
    row = dict(zip(I.UNIT_FIELDS, values, strict=True))
    df = spark.range(1).select(*(F.lit(v).cast("decimal(5,4)" if k in ("temperature", "top_p") else "string").alias(k) for k, v in row.items()))
    text = "e|m|None|CONTROL|5|11|12|0|AB|j|p|pm|v1|0.7000|1.0000|None|None"
    assert df.select(I.unit_fingerprint()).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def test_messages_and_payload(spark):
    rows = [("q?", "one", "two"), ("q?", " \n", "two"), (None, "one", "two"), ("q?", "one", "\u3000")]
    df = spark.createDataFrame(rows, "q string, a string, b string").select(I.judge_messages("q", "a", "b").alias("m"))
    got = df.select("m", I.message_tokens("m").alias("n"), I.payload_sha("m", {"judge": (F.lit("j"), T.StringType())}).alias("sha")).collect()
    user = "Question:\nq?\n\nAnswer A:\none\n\nAnswer B:\ntwo\n\nReturn the required JSON object only."
    messages = [{"role": "system", "content": I.SYSTEM_TEXT}, {"role": "user", "content": user}]
    text = json.dumps({"messages": messages, "judge": "j"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert [m.asDict() for m in got[0].m] == messages and got[0].n == -(-(len(I.SYSTEM_TEXT) + len(user)) // 4)
    assert got[0].sha == hashlib.sha256(text.encode()).hexdigest()
    assert [tuple(r) for r in got[1:]] == [(None, None, None)] * 3
    material = json.dumps({"version": I.TEMPLATE_VERSION, "system": I.SYSTEM_TEXT, "criteria": I.CRITERIA}, sort_keys=True, separators=(",", ":"))
    assert spark.range(1).select(I.prompt_hash()).first()[0] == hashlib.sha256(material.encode()).hexdigest()


def test_judges_share_a_written_message(spark):
    rows = [("q \x01\t?", 'one "1"\\', "two\x1f"), ("q?", " \n", "two")]
    df = spark.createDataFrame(rows, "q string, a string, b string").select(I.judge_messages("q", "a", "b").alias("m"))
    df = df.withColumn("user", I.let(F.get("m", F.lit(1))["content"], I.json_string))
    fields = {"judge": (F.lit('j"'), T.StringType()), "zeal": (F.lit(None).cast("int"), T.IntegerType())}
    got = df.select("m", I.payload_sha("m", fields).alias("whole"), I.judge_payload_sha("user", fields).alias("shared")).collect()
    text = json.dumps({"messages": [m.asDict() for m in got[0].m], "judge": 'j"', "zeal": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[0].whole == got[0].shared == hashlib.sha256(text.encode()).hexdigest() and (got[1].whole, got[1].shared) == (None, None)


def test_reuse_classes(spark):
    full = {d: "x" for d in I.FROZEN_DIMENSIONS}
    cases = [(full, False, False), (full, True, False), (full, False, True), (full | {"seed": None}, False, False), (full | {"top_p": ""}, False, False), (full | {"seed": None}, True, False), (full, None, None)]
    schema = ", ".join(f"{d} string" for d in full) + ", cal boolean, live boolean"
    df = spark.createDataFrame([(*d.values(), c, s) for d, c, s in cases], schema)
    got = [tuple(r[0]) for r in df.select(I.classify_reuse("cal", "live")).collect()]
    history = list(I.HISTORICAL_REASONS)
    late = ("REUSE_AS_EXPLORATORY", [*history, "MISSING_PASS_LEVEL_DATA"])
    good = ("FINAL_CONTROLLED_CANDIDATE", [])
    assert got == [good, late, ("REUSE_AS_EXPLORATORY", ["LIVE_SANDBOX"]), ("REUSE_AS_EXPLORATORY", history), ("REUSE_AS_EXPLORATORY", history), late, good]
