"""Column functions over text, names, identities and money."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import cases, col, let

#: Model and judge vocabularies of the study.
SOURCE_FAMILIES = {"gpt-3.5-turbo": "OPENAI", "gpt-4": "OPENAI", "claude-v1": "ANTHROPIC", "llama-13b": "META_LLAMA", "alpaca-13b": "ALPACA", "vicuna-13b": "VICUNA"}
JUDGE_FAMILIES = {"gpt-4o-mini": "OPENAI", "anthropic/claude-3-haiku": "ANTHROPIC", "meta-llama/llama-3.3-70b-instruct": "META_LLAMA"}
MODEL_ALIASES = {"vicuna-13b-v1.2": "vicuna-13b"}
JUDGE_ALIASES = {
    "gpt-4o-mini": ["gpt-4", "gpt4", "gpt-4o", "gpt-4o-mini"],
    "deepseek/deepseek-chat": ["deepseek", "deepseek-chat", "deepseek/deepseek-chat"],
    "meta-llama/llama-3.3-70b-instruct": ["llama3", "llama-13b", "llama-3.3-70b", "llama-3.3-70b-instruct", "meta-llama/llama-3.3-70b-instruct"],
    "anthropic/claude-3-haiku": ["claude", "claude-3-haiku", "claude-3.5-haiku", "anthropic/claude-3-haiku"],
}
ROUTE_ALIASES = {
    "amazon-bedrock": ["amazon bedrock", "amazon-bedrock", "amazonbedrock", "bedrock"],
    "streamlake": ["streamlake", "stream lake", "stream-lake", "stream_lake"],
    "deepinfra": ["deepinfra", "deep infra", "deep-infra", "deep_infra"],
    "deepinfra/turbo": ["deepinfra/turbo", "deepinfra/turbo-instruct", "deepinfra/llama-3.3-70b-instruct"],
}
FAMILY_WORDS = [("gpt", ["gpt", "openai"]), ("llama", ["llama", "meta"]), ("deepseek", ["deepseek"]), ("claude", ["claude", "anthropic"]), ("vicuna", ["vicuna"]), ("mistral", ["mistral", "mixtral"]), ("google", ["palm", "gemini", "bison"])]
#: The patterns that decide what counts as markdown (lines end with a line feed alone), as a verdict and as list syntax.
MARKDOWN = [(r"(?md)^#{1,6}[\t\n\f\r ]", 1), (r"(?d)\*\*.*?\*\*", 1), (r"(?md)^[\t\n\f\r ]*[*\-][\t\n\f\r ]", 1), (r"(?md)^[\t\n\f\r ]*\d+\.[\t\n\f\r ]", 1), (r"```", 2)]
VERDICT = r"(?i)(?:WINNER|VERDICT)\s*:\s*(?:\*\*)?\s*(?:CANDIDATE|ANSWER)?\s*(A|B|TIE)\b"
BOLD_VERDICT = r"(?i)\bWINNER\s*:\s*\**\s*(A|B|TIE)\b"
CHOICE = r"(?i)(?:prefer|choose|select|winner is)\s+(?:candidate|answer)?\s*\**\s*(A|B|TIE)\b"
LIST_SYNTAX = r"^\s*(?:[-*+] |\d+[.)] |#{1,6}\s+)"


#: What counts as white space in a text, and what ends a line of it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[{WHITE}]+"
_OTHERS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space but for a lone blank; the look ahead passes over printable ASCII at once.
UNFOLDED = rf"(?![!-~])(?:[{_OTHERS}][ {_OTHERS}]*| [ {_OTHERS}]+)"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def text_lines(c: Column | str) -> Column:
    """Lines without their ends; an end at the end of the text opens no further line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(col(c), LINE_END), whole)


def looked_up(c: Column | str, table: dict[str, str]) -> Column:
    return cases(*((col(c) == k, v) for k, v in table.items()))


def by_alias(c: Column, aliases: dict[str, list[str]]) -> Column:
    return cases(*((c.isin(names), name) for name, names in aliases.items()))


def source_family(c: Column | str) -> Column:
    return looked_up(c, SOURCE_FAMILIES)


def judge_family(c: Column | str) -> Column:
    return looked_up(c, JUDGE_FAMILIES)


def canonical_model(c: Column | str) -> Column:
    return F.coalesce(looked_up(c, MODEL_ALIASES), col(c))


def normalize_model_id(c: Column | str, default: str = "gpt-4o-mini") -> Column:
    """By alias, then by the last path segment's alias, else trimmed; null and empty are the default."""
    t = trimmed(c)
    return cases((F.coalesce(col(c), F.lit("")) == "", default), otherwise=F.coalesce(by_alias(t, JUDGE_ALIASES), by_alias(F.element_at(F.split(t, "/"), -1), JUDGE_ALIASES), t))


def model_family(c: Column | str) -> Column:
    n = trimmed(F.lower(col(c)))
    hit = lambda words: reduce(or_, (n.contains(w) for w in words))
    return cases((F.coalesce(n, F.lit("")) == "", "unknown"), *((hit(words), name) for name, words in FAMILY_WORDS), otherwise=F.element_at(F.split(F.element_at(F.split(n, "/"), 1), "-"), 1))


def word_count(c: Column | str) -> Column:
    """White-space tokens; null and empty have none."""
    return F.size(F.array_remove(F.split(F.coalesce(col(c), F.lit("")), SPACES), ""))


def token_estimate(c: Column | str) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(F.coalesce(col(c), F.lit(""))) / 4).cast("long")


def reserve_tokens(q: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.floor((F.length(col(q)) + F.length(col(a)) + F.length(col(b)) + 603) / 4).cast("long")


def sha_text(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def digest(*cols: Column | str) -> Column:
    """SHA-256 of the parts joined by bars; nulls print as None."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("None")) for c in cols)), 256)


def pair_digest(prompt: str, a: str, b: str) -> Column:
    return digest(F.lit("pair"), F.col(prompt), F.least(a, b), F.greatest(a, b))


def verbosity_variant(c: Column | str) -> Column:
    """The text twice, a blank line between; null for a blank text."""
    return F.when(trimmed(c) != "", F.concat(col(c), F.lit("\n\n"), col(c)))


def validate_verbosity(original: Column | str, variant: Column | str) -> Column:
    """Whether it is the variant, which has twice the words of a text that is not blank: so it has more of them."""
    return F.coalesce(col(variant) == verbosity_variant(original), F.lit(False))


def format_variant(c: Column | str) -> Column:
    """A list prefix before each line that is not blank; null for a blank text."""
    lines = F.transform(text_lines(c), lambda x: F.when(trimmed(x) != "", F.concat(F.lit("- "), x)).otherwise(x))
    return F.when(trimmed(c) != "", F.array_join(lines, "\n"))


def strip_formatting(c: Column | str) -> Column:
    return F.array_join(F.transform(text_lines(c), lambda x: F.regexp_replace(x, LIST_SYNTAX, "")), "\n")


def folded(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), UNFOLDED, " ")))


def validate_format(original: Column | str, variant: Column | str) -> Column:
    """Whether both texts are not blank and alike without list syntax, case and white space; texts that are equal need no folding."""
    original = col(original)
    alike = lambda bare: (bare == original) | (folded(original) == folded(bare))
    checked = lambda v: (trimmed(original) != "") & (trimmed(v) != "") & let(strip_formatting(v), alike)
    return F.coalesce(let(col(variant), checked), F.lit(False))


def format_type(c: Column | str) -> Column:
    score = sum(col(c).rlike(p).cast("int") * w for p, w in MARKDOWN)
    return F.when(score >= 2, "markdown_heavy").otherwise("plain_text")


def parse_winner(c: Column | str) -> Column:
    """Last stated verdict, else a choice phrase, else UNKNOWN."""
    found = F.regexp_extract_all(col(c), F.lit(VERDICT), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    once = lambda p: F.nullif(F.regexp_extract(col(c), p, 1), F.lit(""))
    return F.coalesce(F.upper(last), F.upper(once(BOLD_VERDICT)), F.upper(once(CHOICE)), F.lit("UNKNOWN"))


def normalize_route(c: Column | str) -> Column:
    t = F.lower(trimmed(c))
    return F.coalesce(by_alias(t, ROUTE_ALIASES), t)


def check_route(expected: Column | str, observed: Column | str, fallback: Column | str) -> Column:
    """Verification of an observed route against the configured one."""
    e, o = col(expected), normalize_route(observed)
    family = lambda x: F.element_at(F.split(x, "/"), 1)
    return cases(
        (o.isNull() | (o == ""), "MISSING_ROUTE"),
        (col(fallback), "FALLBACK_SEEN"),
        ((o == e) & e.contains("/"), "RESPONSE_CONFIRMED_EXACT_ENDPOINT"),
        (o == e, "RESPONSE_CONFIRMED_EXACT_PROVIDER"),
        (e.contains("/") & (family(o) == family(e)), "REQUEST_ENFORCED_EXACT_ENDPOINT_RESPONSE_CONFIRMED_FAMILY"),
        otherwise="MISMATCH",
    )


def attempt_cost(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """Provider-reported cost, else tokens times rates (per million); a tiny price table is broadcast by its size."""
    df = attempts.join(prices, "judge", "left")
    rate = lambda t, r: F.col(t).cast("decimal(12,0)") * F.col(r).cast("decimal(12,6)")
    estimated = ((rate("input_tokens", "input_per_million") + rate("output_tokens", "output_per_million")) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,12)")
    df = df.withColumn("estimated_usd", estimated)
    return df.withColumn("cost_usd", F.coalesce("actual_usd", "estimated_usd")).withColumn("cost_source", F.when(F.col("actual_usd").isNotNull(), "PROVIDER_REPORTED").otherwise("TOKEN_ESTIMATE"))


def turn_prompt(conversation: Column | str, turn: Column | str) -> Column:
    """Prompt of turn 1, or both questions for turn 2 (messages alternate user, assistant)."""
    at = lambda i: F.get(col(conversation), F.lit(i))["content"]
    return cases((col(turn) == 1, at(0)), (col(turn) == 2, F.concat(at(0), F.lit("\n\n"), at(2))))


def turn_answer(conversation: Column | str, turn: Column | str) -> Column:
    return F.get(col(conversation), (2 * col(turn) - 1).cast("int"))["content"]
