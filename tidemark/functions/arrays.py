"""Array, map and fact expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_filter(dates: Column | str, kinds: Column | str, before: Column, wanted: Sequence[str] | None = None, inclusive: bool = False) -> Column:
    """Of two parallel arrays, the pairs dated before an anchor, of wanted kinds."""
    pairs = F.transform(F.arrays_zip(dates, kinds), lambda x: F.struct(x[_n(dates, 0)].alias("date"), x[_n(kinds, 1)].alias("kind")))
    ok = lambda x: ((x["date"] <= before) if inclusive else (x["date"] < before)) & (x["kind"].isin(*wanted) if wanted else F.lit(True))
    return F.filter(pairs, ok)


def _n(c: Column | str, i: int) -> str:
    return c if isinstance(c, str) else str(i)


def release_dates(releases: Column | str, without: Sequence[str] = ("created", "modified")) -> Column:
    """Sorted upload dates of a map from versions to dates, control keys left out."""
    kept = F.map_filter(releases, lambda k, v: ~k.isin(*without) & v.isNotNull())
    return F.array_sort(F.map_values(kept))


def up_to(dates: Column | str, anchor: Column) -> Column:
    return F.size(F.filter(dates, lambda d: d <= anchor))


def verified_facts(facts: Column | str, text: Column | str, least: int = 8, empty: Sequence[str] = ("", "unknown", "n/a", "none")) -> Column:
    """The facts (structs of value and quote) whose quote occurs literally in the text and whose value says something."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    quote = lambda x: F.lower(F.trim(x["quote"]))
    said = lambda x: x["value"].isNotNull() & ~F.lower(F.trim(x["value"])).isin(*empty)
    return F.filter(facts, lambda x: said(x) & (F.length(quote(x)) >= least) & F.contains(t, quote(x)))


def tier(values: Column | str, tiers: Mapping[int, Sequence[str]]) -> Column:
    """The highest tier that any of the texts belongs to by one of its aliases, else 0."""
    out = F.lit(0)
    for t, aliases in sorted(tiers.items()):
        out = F.when(F.exists(values, _among(aliases)), t).otherwise(out)
    return out


def _among(aliases: Sequence[str]):
    return lambda v: F.lower(F.trim(v)).isin(*aliases)


def ordinal_range(labels: Column | str, order: Mapping[str, float]) -> tuple[Column, Column]:
    """Least and greatest of mapped ordinal labels; unknown ones don't count."""
    m = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    known = F.filter(F.transform(labels, lambda p: F.try_element_at(m, p)), lambda x: x.isNotNull())
    return F.array_min(known), F.array_max(known)
