"""Number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.tables import norm_null


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_float(c: Column | str) -> Column:
    """Number of a text with blanks, thousands commas and a currency sign; NULL for missing texts and NaN."""
    x = F.translate(F.trim(norm_null(_c(c).cast("string"))), "$,", "").try_cast("double")
    return F.when(~F.isnan(x), x)


def coalesce_positive(*cs: Column | str) -> Column:
    return F.coalesce(*[F.when(_c(c) > 0, _c(c)) for c in cs])


def to_millions(c: Column | str) -> Column:
    return F.bround(F.coalesce(_c(c), F.lit(0.0)) / 1e6, 2)


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL (least and greatest alone would skip it)."""
    x = _c(c)
    out = x if low is None else F.greatest(x, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def gaussian(c: Column | str, mean: Column | float, sd: Column | float) -> Column:
    m, s = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, sd))
    z = (_c(c) - m) / F.greatest(F.lit(1e-9), s)
    return F.exp(F.lit(-0.5) * z * z)


def ratio(a: Column | str, b: Column | str, digits: int | None = None, otherwise: float = 0.0) -> Column:
    """a / b where b > 0, else the default."""
    r = F.when(_c(b) > 0, _c(a) / _c(b)).otherwise(otherwise)
    return r if digits is None else F.bround(r, digits)


def log_count(c: Column | str) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), F.coalesce(_c(c).try_cast("double"), F.lit(0.0))))


def months_between_days(later: Column | str, earlier: Column | str) -> Column:
    """Days apart over 30.44, as counted days and not calendar months."""
    return F.datediff(_c(later), _c(earlier)) / 30.44


def years_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_c(later), _c(earlier)) / 365.25


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.year(_c(c)).cast("string"), F.lit("Q"), F.quarter(_c(c)).cast("string"))


def season_date(c: Column | str) -> Column:
    """First day of the month of a label such as Winter 2018 or S19: spring 4, summer 6, fall 9, else 1."""
    s = F.lower(F.trim(_c(c)))
    y = F.regexp_extract(s, r"(\d{4}|\d{2})\s*$", 1).try_cast("int")
    y = F.when(y < 100, y + 2000).otherwise(y)
    m = F.when(s.rlike("^(spring|sp)"), 4).when(s.rlike("^(summer|s|x)"), 6).when(s.rlike("^(fall|f|autumn)"), 9).otherwise(1)
    return F.when(y.isNotNull(), F.make_date(y, m, F.lit(1)))


def int_date(c: Column | str) -> Column:
    """YYYYMMDD of a date."""
    return F.date_format(_c(c), "yyyyMMdd").cast("int")


def from_int_date(c: Column | str) -> Column:
    return F.try_to_date(_c(c).cast("string"), "yyyyMMdd")


def parse_date(c: Column | str, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MMM-yyyy", "MM/dd/yyyy", "yyyyMMdd")) -> Column:
    """The first of several formats that fits; month names in any case."""
    s = F.initcap(F.trim(norm_null(c)))
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])
