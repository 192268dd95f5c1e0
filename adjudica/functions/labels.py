"""Column functions over verdict labels. TIE is a class; an undefined label is null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label vocabulary.
VALID = ("ANSWER_A", "ANSWER_B", "TIE")
DECISIVE = ("ANSWER_A", "ANSWER_B")
FAILURES = ("UNKNOWN", "INVALID_RESPONSE", "API_ERROR", "TIMEOUT", "REFUSAL", "AMBIGUOUS", "MISSING_PASS")
COUNTED_FAILURES = ("API_ERROR", "TIMEOUT", "REFUSAL", "AMBIGUOUS")
VOTES = ("ORIGINAL_ANSWER_1", "ORIGINAL_ANSWER_2", "TIE")
SANDBOX = ("live", "live_calibrated", "ensemble_eval")
#: Outcomes that a scheduler may try again.
RETRYABLE = ("API_ERROR", "TIMEOUT")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used: nested uses keep the expression linear in size."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """First match wins; without a match the result is ``otherwise``."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = reduce(lambda acc, p: acc.when(p[0], value(p[1])), pairs[1:], F.when(pairs[0][0], value(pairs[0][1])))
    return chain.otherwise(value(otherwise))


def is_valid(c: Column | str) -> Column:
    """True or false, never null."""
    return F.coalesce(col(c).isin(*VALID), F.lit(False))


def winner_to_label(c: Column | str) -> Column:
    """Upstream winner to label; anything else is null, to be counted as an error row."""
    c = col(c)
    return cases((c == "model_a", "ANSWER_A"), (c == "model_b", "ANSWER_B"), (c == "tie", "TIE"))


def winner_id_to_label(winner: Column | str, a: Column | str, b: Column | str) -> Column:
    """Null is a tie; an id of neither answer is null."""
    w = col(winner)
    return cases((w.isNull(), "TIE"), (w == col(a), "ANSWER_A"), (w == col(b), "ANSWER_B"))


def win_value(winner: Column | str, a: Column | str, b: Column | str) -> Column:
    """1, 0 or 0.5 for A, B or anything else."""
    w = col(winner)
    return cases((w == col(a), 1.0), (w == col(b), 0.0), otherwise=0.5)


def to_canonical(outcome: Column | str, presentation: Column | str) -> Column:
    """Displayed outcome to the original answer: A and B change places in BA; an unknown order gives null."""
    o, p = col(outcome), col(presentation)
    swapped = cases((o == "ANSWER_A", "ANSWER_B"), (o == "ANSWER_B", "ANSWER_A"), otherwise=o)
    return cases((p == "AB", o), (p == "BA", swapped))


def map_by_winner(outcome: Column | str, winner: Column | str, a: Column | str, b: Column | str) -> Column:
    """A decisive outcome by its winner's id; an id of neither answer is INVALID_RESPONSE."""
    o, w = col(outcome), col(winner)
    return cases((~F.coalesce(o.isin(*DECISIVE), F.lit(False)), o), (w == col(a), "ANSWER_A"), (w == col(b), "ANSWER_B"), otherwise="INVALID_RESPONSE")


def map_vote(outcome: Column | str, shown_a: Column | str, shown_b: Column | str, first: Column | str, second: Column | str) -> Column:
    """Slot verdict to ORIGINAL_ANSWER_1/2 or TIE; everything else is null."""
    o, shown = col(outcome), cases((col(outcome) == "ANSWER_A", col(shown_a)), (col(outcome) == "ANSWER_B", col(shown_b)))
    return cases((o == "TIE", "TIE"), (shown == col(first), "ORIGINAL_ANSWER_1"), (shown == col(second), "ORIGINAL_ANSWER_2"))


def variant_outcome(outcome: Column | str, presentation: Column | str) -> Column:
    """VARIANT, ORIGINAL or TIE; the variant stands in slot B of AB and in slot A of BA."""
    o, p = col(outcome), col(presentation)
    slot = cases((p == "AB", "ANSWER_B"), (p == "BA", "ANSWER_A"))
    return cases((o == "TIE", "TIE"), (o == slot, "VARIANT"), (o.isin(*DECISIVE), "ORIGINAL"))


def pass_outcome(outcome: Column | str, raw: Column | str, parse: Column | str) -> Column:
    """Outcome, else a usable raw verdict, else one by parse status."""
    o, r, p = F.nullif(col(outcome), F.lit("")), col(raw), col(parse)
    by_status = cases((p == "PROVIDER_ERROR", "API_ERROR"), (p.isin("TIMEOUT", "REFUSAL"), p), otherwise="INVALID_RESPONSE")
    return F.coalesce(o, F.when(r.isin(*VALID, "UNKNOWN"), r), by_status)


def outcome_semantics(outcome: Column | str) -> Column:
    """Struct: valid, in_denominator, retryable, excluded_reason; null reads as MISSING_PASS."""
    o = F.coalesce(col(outcome), F.lit("MISSING_PASS"))
    ok = o.isin(*VALID)
    return F.struct(ok.alias("valid"), ok.alias("in_denominator"), o.isin(*RETRYABLE).alias("retryable"), F.when(~ok, o).alias("excluded_reason"))


def storage_status(outcome: Column | str) -> Column:
    """Struct of raw verdict, parse status and run status as stored; outcomes without a storage form are null."""
    o = col(outcome)
    answered = o.isin(*VALID, "UNKNOWN")
    raw = cases((answered, o), (o.isin("INVALID_RESPONSE", "API_ERROR", "TIMEOUT", "REFUSAL"), "ERROR"))
    parse = cases((o.isin(*VALID), "PARSED"), (o == "UNKNOWN", "MISSING_RESPONSE"), (o == "INVALID_RESPONSE", "INVALID"), (o == "API_ERROR", "PROVIDER_ERROR"), (o.isin("TIMEOUT", "REFUSAL"), o))
    run = cases((answered, "SUCCEEDED"), (o.isNotNull(), "FAILED"))
    return F.struct(raw.alias("raw_verdict"), parse.alias("parse_status"), run.alias("run_status"))


def dual_swap_label(ab: Column | str, ba: Column | str) -> Column:
    """Equal valid labels stand; a null beats a failure, a failure is API_ERROR, the rest MISSING_PASS."""
    a, b = col(ab), col(ba)
    return cases(((a == b) & a.isin(*VALID), a), (a.isNull() | b.isNull(), None), (a.isin(*FAILURES) | b.isin(*FAILURES), "API_ERROR"), otherwise="MISSING_PASS")


def dual_pass_decision(ab: Column | str, ba: Column | str) -> Column:
    """Decision of two mapped passes; nulls leave it partial."""
    a, b = (F.coalesce(col(c), F.lit("")) for c in (ab, ba))
    both = a.isin(*DECISIVE) & b.isin(*DECISIVE)
    return cases((both & (a == b), "CONSISTENT"), (both, "DISAGREEMENT"), ((a == "TIE") & (b == "TIE"), "CONSISTENT_TIE"), ((a == "UNKNOWN") & (b == "UNKNOWN"), "CONSISTENT_UNKNOWN"), otherwise="PARTIAL_OR_NONDECISIVE")


def stored_decision(decision: Column | str) -> Column:
    """The stored class of a dual-pass decision."""
    d = col(decision)
    return cases((d == "CONSISTENT", "SAME_DECISIVE_WINNER"), (d == "DISAGREEMENT", "DECISIVE_FLIP"), (d.isin("CONSISTENT_TIE", "CONSISTENT_UNKNOWN"), d), (d == "PARTIAL_OR_NONDECISIVE", "PARTIAL_EXECUTION"))


def sandbox_dual(first: Column | str, second: Column | str) -> Column:
    """Struct: equal verdicts stand, others are a tie with ``position_bias_detected``."""
    same = F.coalesce(col(first) == col(second), F.lit(False))
    return F.struct(F.when(same, col(first)).otherwise("TIE").alias("verdict"), (~same).alias("position_bias_detected"))


def evidence_class(category: Column | str) -> Column:
    return F.when(col(category).isin(*SANDBOX), "LIVE_SANDBOX").otherwise("LEGACY_EXPLORATORY")


def quality_tier(score: Column | str) -> Column:
    s = col(score)
    return cases((s >= 0.5, "Top Tier"), (s >= 0, "Competitive"), (s >= -1, "Below Average"), (s < -1, "Weak"))
