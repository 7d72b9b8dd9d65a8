"""Attributes as known at event time, from snapshots plus change logs.

A version of an attribute counts from the moment at which it is both valid and known; from then on the
state is the version with the latest (valid_from, known_at). Time is cut into periods. For every period
of a key that has changes, the state at its end is materialised (a running maximum over the
periods' maxima: one small row per key and period, not one per change); the changes within the period
are the log. Both are written to the shared folder once (see snapshot_store) and serve any number of event tables. An event takes the snapshot of its period and replays only the changes of that period that
came before it, as a running maximum over (key, period). A key that holds a third of all rows is thus
spread over its periods, and no window ever spans a whole key's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

PERIOD_DAYS = 30


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _period(t: Column, days: int) -> Column:
    return F.floor(t / (days * 86_400_000_000))


def snapshot_store(
    history: DataFrame, key: Sequence[str], value: str = "value", valid_from: str = "valid_from", known_at: str = "known_at", tie: str | None = None,
    period_days: int = PERIOD_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(snapshots, changes), both written: the state of each key at the end of each period in which it changed, and the changes by period."""
    keys = [f"_k{i}" for i in range(len(key))]
    col = lambda c: F.col(f"`{c}`")
    order = col(tie) if tie else F.lit(None).cast("string")
    version = F.struct(_micros(col(valid_from)).alias("v"), _micros(col(known_at)).alias("k"), order.alias("tie"), col(value).cast("string").alias("value"))
    changes = history.select(*[col(k).alias(a) for k, a in zip(key, keys)], version.alias("state")).where(
        " AND ".join([*(f"{k} IS NOT NULL" for k in keys), "state.v IS NOT NULL", "state.k IS NOT NULL"])
    )
    changes = changes.withColumn("_t", F.greatest("state.v", "state.k")).withColumn("_p", _period(F.col("_t"), period_days))
    changes = materialize(changes, "changes")
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    snapshots = changes.groupBy(*keys, "_p").agg(F.max("state").alias("state")).select(*keys, "_p", F.max("state").over(upto).alias("state"))
    return materialize(snapshots, "snapshots"), changes


def as_known_at(
    events: DataFrame,
    history: DataFrame,
    key: Sequence[str],
    event_time: str,
    value: str = "value",
    valid_from: str = "valid_from",
    known_at: str = "known_at",
    tie: str | None = None,
    period_days: int = PERIOD_DAYS,
    store: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """events plus known_value, known_valid_from and known_known_at: the version known at event_time.

    event_time, valid_from and known_at are timestamps. Among versions with both times not after the
    event, the latest valid_from wins, then the latest known_at, then the greatest tie (a column of
    history; NULL lowest), then the greatest value. A version whose value is NULL is a withdrawal and
    yields NULL. Events with a NULL key or time, and events before any version, get NULLs; versions with
    a NULL key or time are never known. Rows of events repeat as they come; empty inputs are allowed.
    Columns of history other than those named are not read; columns of events that bear the result's names
    are replaced. store: what snapshot_store gave for this history, to use it again.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    col = lambda c: F.col(f"`{c}`")
    stored, changes = store or snapshot_store(history, key, value, valid_from, known_at, tie, period_days)
    asked = events.select(
        *[col(k).alias(a) for k, a in zip(key, keys)], F.struct(*[col(c) for c in events.columns]).alias("_row"),
        _micros(col(event_time)).alias("_t"),
    ).withColumn("_p", _period(F.col("_t"), period_days))
    whole = asked.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_t"]))

    # The snapshot before the period of each event: the last one stored, as a running maximum over snapshots and asked periods.
    asked_for = whole.select(*keys, "_p").distinct().withColumn("_asked", F.lit(True))
    both = stored.unionByName(asked_for, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    snapshots = both.withColumn("snapshot", F.max("state").over(before)).where("_asked").select(*keys, "_p", "snapshot")

    # Replay: the log of a period and its events in one order of time, changes first.
    log = changes.select(*keys, "_p", "_t", "state", F.lit(0).alias("_is_event"))
    both = log.unionByName(
        whole.select(*keys, "_p", "_t", F.lit(1).alias("_is_event"), "_row"), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*keys, "_p").orderBy("_t", "_is_event").rowsBetween(Window.unboundedPreceding, 0)
    replayed = both.withColumn("replay", F.max("state").over(so_far)).where("_is_event = 1").drop("state")
    known = replayed.join(snapshots, [*keys, "_p"], "left").withColumn("s", F.greatest("replay", "snapshot"))
    time = lambda c: F.timestamp_micros(c)
    found = lambda s: [
        s["value"].alias("known_value"), time(s["v"]).alias("known_valid_from"), time(s["k"]).alias("known_known_at")
    ]
    unknown = asked.where(" OR ".join(f"{c} IS NULL" for c in [*keys, "_t"])).withColumn(
        "s", F.lit(None).cast(dict(known.dtypes)["s"])
    )
    kept = [F.col(f"_row.`{c}`") for c in events.columns if c not in ("known_value", "known_valid_from", "known_known_at")]
    return known.select("_row", "s").unionByName(unknown.select("_row", "s")).select(*kept, *found(F.col("s")))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal, NULL being a value like any other."""
    return a.eqNullSafe(b)
