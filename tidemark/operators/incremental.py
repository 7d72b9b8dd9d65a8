"""Incremental work: runs and their ledgers, resuming, merging generations of columns, caches of fetched records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns that exist in that order, each once, then all others."""
    head = list(dict.fromkeys(c for c in first if c in df.columns))
    return df.select(*[F.col(f"`{c}`") for c in head], *[F.col(f"`{c}`") for c in df.columns if c not in head])


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in that order, each once."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names) if c in df.columns])


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the named columns; those that it lacks are no error."""
    return df.drop(*names)


def reconcile(df: DataFrame, old: str = "_x", new: str = "_y") -> DataFrame:
    """Columns that a merge left twice, by their suffixes, as one: the newer value where there is one."""
    stems = [c[: -len(old)] for c in df.columns if c.endswith(old) and c[: -len(old)] + new in df.columns]
    return df.withColumns({s: F.coalesce(f"`{s}{new}`", f"`{s}{old}`") for s in stems}).drop(*[s + x for s in stems for x in (old, new)])


def _unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, by a maximum that combines map-side."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")) if rest else df.distinct()
    return got.select(*key, *[F.col("_r")[c].alias(c) for c in rest]) if rest else got


def replace_then_merge(df: DataFrame, new: DataFrame, key: Sequence[str], fill: object = 0) -> DataFrame:
    """df with new's columns in place of its own of those names, filled where new has no row for a key."""
    cols = [c for c in new.columns if c not in key]
    return df.drop(*cols).join(_unique(new, key), list(key), "left").withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in cols})


def merge_newer(df: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """df plus new's columns; where both have a column, new's value where it isn't NULL. One row of new per key."""
    both = [c for c in new.columns if c not in key and c in df.columns]
    got = df.join(_unique(new, key).withColumnsRenamed({c: f"_new_{c}" for c in both}), list(key), "left")
    return got.withColumns({c: F.coalesce(f"_new_{c}", c) for c in both}).drop(*[f"_new_{c}" for c in both])


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, vetoed): rows that break no rule, and the others with the name of the first rule that they break. A rule that is NULL for a row
    is broken: what can't be judged isn't let through."""
    broken = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        broken = F.when(bad, name) if broken is None else broken.when(bad, name)
    marked = df.withColumn("veto", broken)
    return marked.where("veto IS NULL").drop("veto"), marked.where("veto IS NOT NULL")


# --- runs ------------------------------------------------------------------------------------------------------

def latest_run(runs: DataFrame, done: DataFrame, run: str = "run_id") -> DataFrame:
    """(run): the newest run that the next stage hasn't done."""
    return runs.select(run).distinct().join(done.select(run).distinct(), run, "left_anti").agg(F.max(run).alias(run)).where(F.col(run).isNotNull())


def run_status(ledger: DataFrame, run: str, entity: str, state: str, at: str) -> DataFrame:
    """(run, n, entities, first_state, last_state), newest run first."""
    g = ledger.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("entities"), F.min_by(state, at).alias("first_state"), F.max_by(state, at).alias("last_state"))
    return g.orderBy(F.desc(run))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n): how many keys both have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def resume(cohort: DataFrame, done: DataFrame, key: str, marker: str) -> tuple[DataFrame, DataFrame]:
    """(finished, to_do): rows of the cohort that a checkpoint has with its marker, with the checkpoint's columns, and the rest."""
    have = _unique(done.where(F.col(marker).isNotNull() & (F.col(marker).cast("string") != "")), [key])
    new = [c for c in have.columns if c == key or c not in cohort.columns]
    return cohort.join(have.select(*new), key), cohort.join(have.select(key), key, "left_anti")


def prefiltered(cohort: DataFrame, keep: Column, done: DataFrame, key: str, n: int) -> DataFrame:
    """The next n survivors of a filter that no batch has had yet, in order of key: the limit is the batch."""
    return cohort.where(keep).join(done.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


# --- fetching ----------------------------------------------------------------------------------------------------

def fetch(todo: DataFrame, key: str, call: Callable[[str], str | None], partitions: int, per_second: float = 0.0, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(key, text, note): what call gives for each key. At most `partitions` calls run at once, each task paced to per_second calls; an
    error is tried again after a pause that doubles, and all of a task's calls wait as long (so a limit reached is honoured);
    what fails at last is noted and doesn't end the run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            rows = []
            for k in pdf[key]:
                text, note = None, "ok"
                for i in range(tries):
                    if per_second:
                        time.sleep(1 / per_second)
                    try:
                        text, note = call(k), "ok"
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is a row's note
                        note = f"error: {type(e).__name__}: {e}"[:200]
                        time.sleep(pause * 2**i if i + 1 < tries else 0)
                rows.append((k, text, note))
            yield pd.DataFrame(rows, columns=[key, "text", "note"])

    kind = dict(todo.dtypes)[key]
    return todo.select(key).distinct().repartition(partitions, key).mapInPandas(run, f"{key} {kind}, text string, note string")


def cached(todo: DataFrame, cache: DataFrame, key: str, least: int = 50, honour_misses: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a page cache (key, text, is_miss): a hit needs a text of some length; known misses aren't asked for again
    if they are honoured."""
    hit = F.length("text") > least
    have = _unique(cache.where(hit).select(key, "text"), [key])
    known = cache.where(hit | (F.col("is_miss") if honour_misses else F.lit(False))).select(key).distinct()
    return todo.join(have, key), todo.join(known, key, "left_anti")
