"""Identities of units and payloads, canonical JSON, the strict judgement reader and exact-provenance classes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import cases, col, let
from .text import digest, trimmed

# Canonical JSON ---------------------------------------------------------------------------------
#: Short escapes of JSON; other control characters are \u00XX.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(c: Column) -> Column:
    """A text as JSON: quotes, backslashes and control characters escaped, everything else as it is."""
    escaped = F.when(c.rlike(r'[\x00-\x1f"\\]'), _escaped(c)).otherwise(c)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _escaped(c: Column) -> Column:
    common = c
    for plain, escaped in ESCAPES.items():
        common = F.replace(common, F.lit(plain), F.lit(escaped))

    def rare(x: Column) -> Column:
        for code in sorted(set(range(32)) - {ord(x) for x in ESCAPES}):
            x = F.replace(x, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return x

    return let(common, lambda x: F.when(x.rlike(r"[\x00-\x1f]"), rare(x)).otherwise(x))


def json_double(c: Column) -> Column:
    """The shortest digits that read back as the same number, with a point; an exponent below 1e-4 and from 1e16."""
    tries = F.array(*(F.format_string(f"%.{p}e", c) for p in range(17)))
    short = F.coalesce(F.get(F.filter(tries, lambda t: t.cast("double") == c), F.lit(0)), F.lower(c.cast("string")))

    def written(parts: Column) -> Column:
        digits, power = parts["digits"], parts["power"]
        size = F.length(digits)
        plain = cases(
            (power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)),
            (size <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - size), F.lit(".0"))),
            otherwise=F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size)),
        )
        mantissa = F.when(size == 1, digits).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), size)))
        exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
        return F.concat(parts["sign"], F.when((power < -4) | (power >= 16), F.concat(mantissa, F.lit("e"), exponent)).otherwise(plain))

    def split(text: Column) -> Column:
        digits = F.replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), F.lit("."), F.lit(""))
        trimmed_digits = F.when(digits.rlike("^0+$"), "0").otherwise(F.regexp_replace(digits, "0+$", ""))
        power = F.regexp_extract(text, r"e([+-]?[0-9]+)$", 1).cast("int")
        return F.struct(trimmed_digits.alias("digits"), power.alias("power"), F.when(text.startswith("-"), "-").otherwise("").alias("sign"))

    finite = let(let(short, split), written)
    return cases((F.isnan(c), "NaN"), (c == float("inf"), "Infinity"), (c == float("-inf"), "-Infinity"), otherwise=finite)


def canonical_json(c: Column | str, kind: T.DataType) -> Column:
    """A value of any nesting as compact JSON with sorted keys, nulls kept, texts not reduced to ASCII.

    Fields of a struct and keys of a map stand in code point order. Decimals, dates and binary
    values have no JSON form: cast them first.
    """
    return F.lit("null") if isinstance(kind, T.NullType) else let(col(c), lambda x: _json(x, kind))


def _json(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        out = json_string(c)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = json_double(c.cast("double"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(let(k, json_string), F.lit(":"), canonical_json(F.element_at(c, k), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}: cast it first")
    return F.when(c.isNull(), "null").otherwise(out)


def stable_sha(c: Column | str, kind: T.DataType) -> Column:
    """SHA-256 of the canonical JSON of a value."""
    return F.sha2(canonical_json(c, kind), 256)


# Units -------------------------------------------------------------------------------------------
#: The configuration fields of a unit, in the order in which they are hashed.
UNIT_FIELDS = (
    "experiment_id", "manifest_id", "dataset_checksum", "condition_code", "prompt_id", "answer_a_id", "answer_b_id", "repetition_index", "presentation_order",
    "judge_model", "provider", "provider_model", "prompt_template_version", "temperature", "top_p", "seed", "variant_checksum",
)


def unit_fingerprint(fields: tuple[str, ...] = UNIT_FIELDS) -> Column:
    """Digest of all configuration fields of a unit, joined by bars; nulls print as None, decimals with their scale."""
    return digest(*fields)


# Payloads ----------------------------------------------------------------------------------------
#: The neutral judging contract. Digests of payloads hang on every character.
TEMPLATE_VERSION = "controlled-judge-pairwise-v1"
CRITERIA = ("correctness", "relevance", "completeness", "clarity", "safety")
SYSTEM_TEXT = (
    "You are an impartial evaluator of two candidate answers. Evaluate only the question and the two answer texts. Do not infer authorship, experimental condition, or intent. "
    "Treat Answer A and Answer B symmetrically. Return only one JSON object with exactly: verdict (ANSWER_A, ANSWER_B, TIE, or UNKNOWN), criteria_scores (integer 1-5 for correctness, "
    "relevance, completeness, clarity, safety), confidence (number 0-1), and explanation (brief neutral rationale)."
)
USER_PARTS = ("Question:\n", "\n\nAnswer A:\n", "\n\nAnswer B:\n", "\n\nReturn the required JSON object only.")
_MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def displayed(a: Column | str, b: Column | str, presentation: Column | str) -> tuple[Column, Column]:
    """The two texts in the order in which they are shown."""
    ab = col(presentation) == "AB"
    return F.when(ab, col(a)).otherwise(col(b)), F.when(ab, col(b)).otherwise(col(a))


def judge_messages(question: Column | str, a: Column | str, b: Column | str) -> Column:
    """System and user message for two displayed answers; null if a text is null or blank."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.lit(USER_PARTS[0]), col(question), F.lit(USER_PARTS[1]), col(a), F.lit(USER_PARTS[2]), col(b), F.lit(USER_PARTS[3]))
    filled = (trimmed(question) != "") & (trimmed(a) != "") & (trimmed(b) != "")
    return F.when(filled, F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", user)))


def prompt_hash() -> Column:
    return stable_sha(F.struct(F.lit(TEMPLATE_VERSION).alias("version"), F.lit(SYSTEM_TEXT).alias("system"), F.array(*map(F.lit, CRITERIA)).alias("criteria")), T.StructType([T.StructField("version", T.StringType()), T.StructField("system", T.StringType()), T.StructField("criteria", T.ArrayType(T.StringType()))]))


def payload_json(messages: Column, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Canonical JSON of a payload from that of its messages and named fields with their types."""
    parts = {"messages": messages} | {n: canonical_json(c, k) for n, (c, k) in fields.items()}
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), parts[n]) for n in sorted(parts))), F.lit("}"))


def payload_sha(messages: Column | str, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """Digest of a payload: its messages and named fields with their types; null where the messages were rejected."""
    return F.when(col(messages).isNotNull(), F.sha2(payload_json(canonical_json(messages, _MESSAGES), fields), 256))


def judge_payload_sha(user: Column | str, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``payload_sha`` of ``judge_messages`` from the user message as JSON, which several judges share; null where it is null."""
    before = '[{"content":' + json.dumps(SYSTEM_TEXT, ensure_ascii=False) + ',"role":"system"},{"content":'
    return F.when(col(user).isNotNull(), F.sha2(payload_json(F.concat(F.lit(before), col(user), F.lit(',"role":"user"}]')), fields), 256))


def message_tokens(messages: Column | str) -> Column:
    """A quarter of the characters of all messages, rounded up."""
    return F.ceil(F.aggregate(col(messages), F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"])) / 4).cast("long")


# Judgements --------------------------------------------------------------------------------------
FENCE = "```"
_READ = "array<struct<verdict:variant,criteria_scores:map<string,variant>,confidence:variant,explanation:variant>>"


def judgement_payload(c: Column | str) -> Column:
    """The JSON object of an answer: a code fence goes, then everything before the first and after the last brace; null without an object."""

    def unfenced(text: Column) -> Column:
        inner = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
        before = let(inner, lambda x: F.when(F.contains(x, F.lit(FENCE)), F.left(x, F.length(x) - F.length(F.substring_index(x, FENCE, -1)) - 3)).otherwise(x))
        return F.when(text.startswith(FENCE), before).otherwise(text)

    def braces(text: Column) -> Column:
        start, end = F.instr(text, "{"), F.length(text) - F.length(F.substring_index(text, "}", -1))
        return F.when((start > 0) & F.contains(text, F.lit("}")) & (end >= start), F.substring(text, start, end - start + 1))

    return let(let(trimmed(c), unfenced), braces)


def judgement(c: Column | str) -> Column:
    """Struct of ``outcome``, ``scores`` (by criterion), ``confidence`` and ``explanation`` of a judge's answer.

    The object has exactly the keys verdict (ANSWER_A, ANSWER_B, TIE or UNKNOWN), criteria_scores (exactly the five criteria,
    whole numbers from 1 to 5), confidence (a number from 0 to 1) and explanation (a text that is not empty). Types are those
    of the JSON itself, nothing is coerced; of a repeated key the last value counts. Anything else is
    INVALID_RESPONSE, with nulls.
    """

    def read(raw: Column) -> Column:
        # as the only element of an array: what follows the object must not pass
        rows = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), _READ, {"allowSingleQuotes": "false"})
        one = let(rows, lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))))
        return F.struct(one.alias("one"), F.json_object_keys(raw).alias("keys"))

    same = lambda keys, names: F.array_sort(F.array_distinct(keys)) == F.array(*map(F.lit, sorted(names)))
    typed = lambda v, kinds, into: F.when(F.regexp_replace(F.schema_of_variant(v), r"\(.*", "").isin(*kinds), F.try_variant_get(v, "$", into))

    def parts(x: Column) -> Column:
        one, entries = x["one"], F.map_entries(x["one"]["criteria_scores"])
        last = lambda name: F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]
        keys = same(x["keys"], ("verdict", "criteria_scores", "confidence", "explanation")) & same(F.map_keys(one["criteria_scores"]), CRITERIA)
        return F.struct(
            keys.alias("keys"), typed(one["verdict"], ("STRING",), "string").alias("verdict"), F.array(*(typed(last(n), ("BIGINT",), "long") for n in CRITERIA)).alias("scores"),
            typed(one["confidence"], ("BIGINT", "DOUBLE", "DECIMAL"), "double").alias("confidence"), typed(one["explanation"], ("STRING",), "string").alias("explanation"),
        )

    def checked(x: Column) -> Column:
        good = x["keys"] & x["verdict"].isin("ANSWER_A", "ANSWER_B", "TIE", "UNKNOWN") & x["confidence"].between(0, 1) & (x["explanation"] != "")
        return F.coalesce(good & F.forall(x["scores"], lambda s: F.coalesce(s.between(1, 5), F.lit(False))), F.lit(False))

    def judged(x: Column) -> Column:
        scores = F.struct(*(F.get(x["scores"], F.lit(i)).cast("int").alias(n) for i, n in enumerate(CRITERIA)))
        result = lambda good: F.struct(F.when(good, x["verdict"]).otherwise("INVALID_RESPONSE").alias("outcome"), F.when(good, scores).alias("scores"), F.when(good, x["confidence"]).alias("confidence"), F.when(good, x["explanation"]).alias("explanation"))
        return let(checked(x), result)

    return let(let(let(judgement_payload(c), read), parts), judged)


def parse_judgement(c: Column | str) -> Column:
    """The outcome of a judge's answer, INVALID_RESPONSE unless it is a judgement in every detail."""
    return judgement(c)["outcome"]


# Reuse -------------------------------------------------------------------------------------------
#: What a historical row must name to be taken for a controlled one, and the reasons given otherwise.
FROZEN_DIMENSIONS = ("provider", "effective_model", "protocol_version", "prompt_template_version", "dataset_snapshot", "temperature", "top_p", "seed", "repetition_index")
HISTORICAL_REASONS = (
    "MISSING_PROVIDER_IDENTITY", "MISSING_EFFECTIVE_MODEL", "MISSING_PROTOCOL_VERSION", "MISSING_TEMPLATE_VERSION", "NO_DATASET_SNAPSHOT",
    "MISSING_REPETITION_ID", "INCOMPLETE_PROVENANCE", "PROTOCOL_MISMATCH",
)


def is_exact_match(dimensions: tuple[str, ...] = FROZEN_DIMENSIONS) -> Column:
    """Whether every frozen dimension is there; an empty text counts as missing."""
    out = F.lit(True)
    for d in dimensions:
        out = out & F.coalesce(F.col(d).cast("string") != "", F.lit(False))
    return out


def classify_reuse(calibrated: Column | str, live_sandbox: Column | str, dimensions: tuple[str, ...] = FROZEN_DIMENSIONS) -> Column:
    """Struct of ``reuse_class`` and ``reasons`` (an array) of a historical decision.

    Sandbox rows are exploratory whatever they name; rows with all dimensions that were not calibrated are candidates for the
    controlled set; the rest is exploratory with the reasons of history, and the missing pass where calibrated.
    """
    reasons = F.array(*map(F.lit, HISTORICAL_REASONS))
    live, tuned = F.coalesce(col(live_sandbox), F.lit(False)), F.coalesce(col(calibrated), F.lit(False))
    candidate = ~live & is_exact_match(dimensions) & ~tuned
    why = cases((live, F.array(F.lit("LIVE_SANDBOX"))), (candidate, F.array().cast("array<string>")), (tuned, F.concat(reasons, F.array(F.lit("MISSING_PASS_LEVEL_DATA")))), otherwise=reasons)
    return F.struct(F.when(candidate, "FINAL_CONTROLLED_CANDIDATE").otherwise("REUSE_AS_EXPLORATORY").alias("reuse_class"), why.alias("reasons"))
