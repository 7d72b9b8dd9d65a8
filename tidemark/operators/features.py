"""Feature expressions over merged tables: imputation, composites, splits, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_count(cols: Sequence[str], most: int | None = None) -> Column:
    """How many of the columns are above 0; text numbers count, others don't."""
    total = sum((F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) > 0).cast("int") for c in cols)
    return total if most is None else F.least(total, F.lit(most))


# Beginnings of columns in which no value means that no signal was found.
ZERO_PREFIXES = [
    "has_", "patent_count", "wikipedia_before", "backlinks_", "hn_comments", "github_before", "pkg_releases_count", "pkg_before", "pkg_registry_count",
    "pkg_update", "pkg_version", "pkg_major", "pkg_maintainer", "pkg_ecosystem", "openalex_works_count", "openalex_has_papers", "hn_launch", "hn_is_show",
    "hn_mention_count", "hn_before", "ph_launch", "ph_featured", "ph_before", "ph_launches", "founder_", "wayback_", "nlp_", "fed_grants", "fed_contracts",
    "fed_awards", "yc_alumni", "yc_months", "ct_trials", "ct_before", "ct_min_phase", "ct_max_phase", "edgar_filings", "edgar_has", "gdelt_mentions",
    "gdelt_has", "formd_directors", "formd_investor", "formd_prior", "wayback_acceleration", "gdelt_acceleration", "log_patent", "log_hn", "log_wayback",
    "log_edgar", "log_gdelt", "directors_x_patent", "directors_per_round",
]


def impute(df: DataFrame, zero: Sequence[str], median: Sequence[str]) -> DataFrame:
    """NULLs of some columns become 0, of others the median (0 where all are NULL); all medians come from one subquery."""
    if median:
        one = df.agg(F.struct(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(median)]).alias("m")).scalar()
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), one[f"m{i}"]) for i, c in enumerate(median)})
    return df.fillna(0, subset=list(zero)) if zero else df


def impute_by_name(df: DataFrame, cols: Sequence[str], prefixes: Sequence[str] = ZERO_PREFIXES) -> DataFrame:
    """NULLs become 0 in columns whose names begin so, else the median, or 0 where all are NULL."""
    zero = [c for c in cols if any(c.startswith(p) for p in prefixes)]
    return impute(df, zero, [c for c in cols if c not in zero])


def missing_category(c: str) -> Column:
    """A category as text, MISSING for none."""
    t = F.trim(F.col(c).cast("string"))
    return F.when(t.isNull() | t.isin("", "nan"), "MISSING").otherwise(t)


def any_positive(*cols: str) -> Column:
    """1 if any of the columns is above 0."""
    return (active_count(cols) > 0).cast("int")


def interaction(a: str, b: str) -> Column:
    """1 if both columns are above 0."""
    return (active_count([a, b]) == 2).cast("int")


def founder_credentials(cols: Sequence[str], deeptech: str) -> tuple[Column, Column]:
    """How many credentials there are, and that number times the deeptech score."""
    n = active_count(cols)
    return n, n * F.coalesce(F.col(deeptech).try_cast("double"), F.lit(0.0))


def temporal_split(df: DataFrame, year: str, share: float = 0.8, fallback: float = 0.7, least: float = 0.1) -> DataFrame:
    """df plus split: train before the year at a percentile, else test; a lower percentile if test would be too small.

    Percentiles and the share of late rows are subqueries of the plan; nothing runs until it does.
    """
    y = F.col(year)
    p = df.agg(F.struct(F.percentile(year, F.lit(share)).cast("int").alias("hi"), F.percentile(year, F.lit(fallback)).cast("int").alias("lo")).alias("p")).scalar()
    late = df.agg(F.avg(F.coalesce(y >= p["hi"], F.lit(True)).cast("double"))).scalar()
    return df.withColumn("split", F.when(y < F.when(late < least, p["lo"]).otherwise(p["hi"]), "train").otherwise("test"))


def bin_rates(df: DataFrame, value: str, label: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n, rate) over half-open bins between the edges; values outside belong to none."""
    b = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (F.col(value) >= lo) & (F.col(value) < hi)
        b = F.when(cond, i) if b is None else b.when(cond, i)
    return df.withColumn("bin", b).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate")
    )


def drop_rare(df: DataFrame, cols: Sequence[str], least: int = 3) -> list[str]:
    """The columns that are nonzero in at least some rows, from one aggregate."""
    row = df.agg(*[F.sum((F.coalesce(F.col(c), F.lit(0)) != 0).cast("bigint")).alias(c) for c in cols]).first()
    return [c for c in cols if (row[c] or 0) >= least]
