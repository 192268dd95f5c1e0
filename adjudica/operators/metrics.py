"""Metric rows: one long table for all estimators.

A wide aggregate holds counts for each group; ``metric_rows`` turns it into rows of
``metric_name, value, numerator, denominator, eligible_n, analyzed_n, status`` and the label
counters. An undefined metric is null with a status, never zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import COUNTED_FAILURES, col

COUNTERS = ("tie_count", "unknown_count", "invalid_count", "failure_count", "refusal_count", "missing_count")
FIELDS = ("metric_name", "value", "numerator", "denominator", "eligible_n", "analyzed_n", "status")


class Metric(NamedTuple):
    """A rate of two count columns, or ``value`` (its SQL twin in ``sql``) over ``denominator``."""

    name: str
    numerator: str | None
    denominator: str
    empty: str = "NO_DATA"
    value: str | None = None


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def label_counters(*labels: Column | str) -> list[Column]:
    """Counters over all rows and all given label columns."""
    tests = {
        "tie_count": lambda c: c == "TIE",
        "unknown_count": lambda c: c == "UNKNOWN",
        "invalid_count": lambda c: c == "INVALID_RESPONSE",
        "failure_count": lambda c: c.isin(*COUNTED_FAILURES),
        "refusal_count": lambda c: c == "REFUSAL",
        "missing_count": lambda c: c.isNull() | (c == "MISSING_PASS"),
    }
    out = []
    for name, test in tests.items():
        total = n_if(test(col(labels[0])))
        for other in labels[1:]:
            total = total + n_if(test(col(other)))
        out.append(total.alias(name))
    return out


def by_groups(df: DataFrame, groups: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Aggregates of several grouping sets in one pass, with partial aggregation."""
    keys = list(dict.fromkeys(k for g in groups for k in g))
    if not keys:
        return df.agg(*aggregates)
    return df.groupingSets([[F.col(k) for k in g] for g in groups], *keys).agg(*aggregates)


def metric_rows(wide: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    counters = [c for c in COUNTERS if c in wide.columns]
    rows = []
    for m in metrics:
        num, den = (F.col(m.numerator).cast("long") if m.numerator else F.lit(None).cast("long")), F.col(m.denominator).cast("long")
        value = F.expr(m.value) if m.value else F.when(den > 0, num / den)
        known = value.isNotNull()
        status = F.when(known, "ESTIMABLE").when(den > 0, "NOT_ESTIMABLE").otherwise(m.empty)
        rows.append(F.struct(F.lit(m.name).alias("metric_name"), value.cast("double").alias("value"), F.when(known, num).alias("numerator"), F.when(known, den).alias("denominator"), F.col("eligible_n").cast("long").alias("eligible_n"), den.alias("analyzed_n"), status.alias("status")))
    return wide.select(*keys, *counters, F.inline(F.array(*rows)))


def metric_sql(wide: str, keys: Sequence[str], metrics: Sequence[Metric], counters: Sequence[str] = COUNTERS) -> str:
    """The same rows for DuckDB, from a query of the wide aggregate."""
    out = []
    for m in metrics:
        num = f"cast({m.numerator} as bigint)" if m.numerator else "cast(null as bigint)"
        value = m.value or f"case when {m.denominator} > 0 then {m.numerator} / cast({m.denominator} as double) end"
        out.append(
            f"select {', '.join([*keys, *counters])}, '{m.name}' as metric_name, cast({value} as double) as value, case when ({value}) is not null then {num} end as numerator, "
            f"case when ({value}) is not null then cast({m.denominator} as bigint) end as denominator, cast(eligible_n as bigint) as eligible_n, cast({m.denominator} as bigint) as analyzed_n, "
            f"case when ({value}) is not null then 'ESTIMABLE' when {m.denominator} > 0 then 'NOT_ESTIMABLE' else '{m.empty}' end as status from wide"
        )
    return f"wide as ({wide}) " + " union all ".join(out)


def counters_sql(*labels: str) -> str:
    tests = {"tie_count": "{} = 'TIE'", "unknown_count": "{} = 'UNKNOWN'", "invalid_count": "{} = 'INVALID_RESPONSE'", "failure_count": "{} in ('API_ERROR', 'TIMEOUT', 'REFUSAL', 'AMBIGUOUS')", "refusal_count": "{} = 'REFUSAL'", "missing_count": "{0} is null or {0} = 'MISSING_PASS'"}
    return ", ".join(" + ".join(f"count(*) filter (where {t.format(x)})" for x in labels) + f" as {name}" for name, t in tests.items())
