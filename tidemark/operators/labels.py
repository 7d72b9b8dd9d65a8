"""Outcome labels from several sources, as boolean expressions over one row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import months_between_days

# Funding types that mean a later round, in order of precedence, and how they are called; equity types of a later round.
REASONS = {
    "series b": "Series B", "series c": "Series C", "series d": "Series D", "series e": "Series E", "series f": "Series F", "series g": "Series G",
    "ipo": "IPO", "late stage": "Late Stage", "growth": "Growth", "private equity": "Private Equity", "venture - series unknown": "Venture (series unknown)",
}
UNKNOWN = "Venture (series unknown)"
LATER_EQUITY = ["Series B", "Series C", "Series D", "Series E", "Series F", "Series G", "Series H"]


@dataclass(frozen=True)
class Rules:
    """Least gap and growth of a follow-on: calendar months and multiple of the audit, counted months, least amount and multiple
    of the primary label, months of the strict one."""

    months: int = 6
    multiple: float = 1.5
    levels: tuple[tuple[float, str], ...] = ((3.0, "HIGH"), (2.0, "MEDIUM"))
    least_amount: float = 7e6
    growth: float = 2.0
    strict_months: float = 36.0


def _text(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def funding_reason(last_type: str, equity_type: str) -> Column:
    """The first keyword that the last type holds, else that the equity type does; empty if neither."""

    def first(c: str) -> Column:
        s, out = _text(c), None
        for key, name in REASONS.items():
            out = F.when(F.contains(s, F.lit(key)), name) if out is None else out.when(F.contains(s, F.lit(key)), name)
        return out

    return F.coalesce(first(last_type), first(equity_type), F.lit(""))


def series_unknown(*types: str) -> Column:
    """Whether any of the types is a venture round of unknown series."""
    out = F.lit(False)
    for c in types:
        out = out | (F.contains(_text(c), F.lit("venture")) & F.contains(_text(c), F.lit("series unknown")))
    return out


def with_labels(
    df: DataFrame, anchor: str, amount: str, last_type: str, equity_type: str, last_date: str, last_amount: str, equity_amount: str, total_equity: str,
    later_source: str | None = None, later_date: str | None = None, rules: Rules = Rules(),
) -> DataFrame:
    """df plus reason, confidence, label_audit, the four sources of label_primary, label_primary, label_legacy, label_sensitivity,
    months_to and label_strict.

    amounts are in USD and dates are dates; NULL amounts count as 0, and NULL dates satisfy no gap. A row whose last type is of
    unknown series is judged by that alone, whatever its equity type. months_to is NULL unless the audit label holds; a dated
    later round counts if it isn't before the anchor, else the last round's date.
    """
    a, total, eq = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (amount, total_equity, equity_amount))
    gap = months_between_days(last_date, anchor)
    far = F.coalesce(gap >= rules.months, F.lit(False))
    reason = funding_reason(last_type, equity_type)
    usd = F.col(last_amount).cast("double")
    ratio = usd / F.when(a > 0, a)
    grown = F.coalesce((F.col(last_date) >= F.add_months(anchor, rules.months)) & (ratio >= rules.multiple), F.lit(False))
    level = F.lit("LOW")
    for least, name in reversed(rules.levels):
        level = F.when(ratio >= least, name).otherwise(level)
    df = df.withColumn("_reason", reason)
    unknown, known = F.col("_reason") == UNKNOWN, (F.col("_reason") != "") & (F.col("_reason") != UNKNOWN)
    df = df.withColumns(
        {
            "label_audit": F.when(unknown, grown).otherwise(known).cast("int"),
            "reason": F.when(unknown & ~grown & F.col(anchor).isNotNull(), "").otherwise(F.col("_reason")),
            "confidence": F.when(unknown & grown, level).otherwise(""),
        }
    ).drop("_reason")
    later = F.coalesce(F.col(later_source) == "formd", F.lit(False)) if later_source else F.lit(False)
    typed = F.coalesce(F.col(equity_type).isin(*LATER_EQUITY), F.lit(False))
    stepped = F.contains(_text(equity_type), F.lit("venture")) & ~typed & far & ((eq > a) | (eq >= rules.least_amount))
    df = df.withColumns({"by_type": typed.cast("int"), "by_filing": later.cast("int"), "by_unknown": stepped.cast("int")})
    none = (F.col("by_type") + F.col("by_filing") + F.col("by_unknown")) == 0
    df = df.withColumn("by_equity", ((a > 0) & (total > rules.growth * a) & far & none).cast("int"))
    when = F.col(last_date)
    if later_date:
        when = F.when(F.col(later_date) >= F.col(anchor), F.col(later_date)).otherwise(when)
    df = df.withColumn("label_primary", F.greatest("by_type", "by_filing", "by_unknown", "by_equity"))
    months = F.when(F.col("label_audit") == 1, F.bround(months_between_days(when, anchor), 0).cast("int"))
    return df.withColumns(
        {
            "label_legacy": F.greatest("label_audit", ((a > 0) & (total >= 2 * a)).cast("int")),
            "label_sensitivity": F.greatest("label_audit", ((a > 0) & (total >= 1.5 * a)).cast("int")),
            "months_to": months,
            "label_strict": ((F.col("label_primary") == 1) & F.coalesce(gap <= rules.strict_months, F.lit(False))).cast("int"),
        }
    )


def label_sources(labelled: DataFrame) -> DataFrame:
    """One row: how many rows each source makes positive that none before it does, how many are positive, and of how many."""
    new, before = [], F.lit(0)
    for c in ("by_type", "by_filing", "by_unknown", "by_equity"):
        new.append(F.count_if((F.col(c) == 1) & (before == 0)).alias(c))
        before = F.greatest(before, F.col(c))
    return labelled.agg(*new, F.coalesce(F.sum("label_primary"), F.lit(0)).alias("positive"), F.count(F.lit(1)).alias("n"))
