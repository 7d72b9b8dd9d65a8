"""Declared features and pluggable verifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FeatureSpec:
    """A column of the final table: its group, how NULLs are filled (zero, median or keep) and whether it leaks the outcome."""

    name: str
    group: str
    fill: str = "zero"
    leaks: bool = False


def select_features(df: DataFrame, specs: Sequence[FeatureSpec], keep: Sequence[str] = ()) -> DataFrame:
    """The declared columns that are present, in declared order; raises if one of them leaks."""
    bad = [s.name for s in specs if s.leaks and s.name in df.columns]
    if bad:
        raise ValueError(f"columns that tell the outcome: {', '.join(bad)}")
    names = [c for c in keep if c in df.columns] + [s.name for s in specs if s.name in df.columns and s.name not in keep]
    return df.select(*names)


_VERIFIERS: dict[str, tuple[Callable, bool, bool]] = {}


def register_verifier(name: str, fn: Callable[[str, str], bool] | None, on_missing: bool, on_error: bool) -> None:
    """A predicate over (claim, evidence); what to answer without a function, and when it raises."""
    _VERIFIERS[name] = (fn, on_missing, on_error)


# What each source's verifier answers without a client, and when it fails.
VERIFIER_DEFAULTS = {
    "wikipedia": (False, False), "code_host": (True, True), "packages": (True, True), "forum": (True, True), "launch_site": (True, True),
    "trials_sponsor": (True, False), "awards_recipient": (False, False), "patents_assignee": (True, True), "accelerator": (False, False), "second_papers": (False, False),
}
for _name, (_missing, _error) in VERIFIER_DEFAULTS.items():
    register_verifier(_name, None, _missing, _error)


def verify(df: DataFrame, name: str, claim: str, evidence: str, out: str = "accepted") -> DataFrame:
    """df plus the verdict. Each distinct (claim, evidence) is judged once and joined back."""
    fn, on_missing, on_error = _VERIFIERS[name]
    if fn is None:
        return df.withColumn(out, F.lit(on_missing))

    @F.pandas_udf(T.BooleanType())
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return bool(fn(x, y))
            except Exception:  # noqa: BLE001 - the verifier's own default says what an error means
                return on_error

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)

    asked = df.select(F.col(claim).alias("_c"), F.col(evidence).alias("_e")).distinct().withColumn(out, judge("_c", "_e"))
    on = F.col(claim).eqNullSafe(F.col("_c")) & F.col(evidence).eqNullSafe(F.col("_e"))
    return df.join(asked, on, "left").drop("_c", "_e")
