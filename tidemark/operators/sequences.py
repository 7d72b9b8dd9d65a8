"""Operators on each entity's dated events: anchored clusters, picks, deduplication, as-of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchored_clusters(events: DataFrame, entity: str, day: str, span: int = 120) -> DataFrame:
    """events plus cluster_start: an event opens a cluster if it lies more than span days after the start of the last.

    The fold runs over an entity's distinct days, of which a calendar holds few, however many events it
    has; so the array is bounded by the calendar and not by the rows. Events without a day get NULL.
    """
    days = events.where(F.col(day).isNotNull()).select(entity, F.col(day).alias("_d")).distinct()
    folded = days.groupBy(entity).agg(F.array_sort(F.collect_list("_d")).alias("_ds"))
    start = F.array().cast("array<struct<d:date,s:date>>")
    step = lambda acc, d: F.concat(
        acc,
        F.array(
            F.struct(
                d.alias("d"),
                F.when((F.size(acc) > 0) & (F.datediff(d, F.try_element_at(acc, F.lit(-1))["s"]) <= span), F.try_element_at(acc, F.lit(-1))["s"])
                .otherwise(d).alias("s"),
            )
        ),
    )
    starts = folded.select(entity, F.explode(F.aggregate("_ds", start, step)).alias("x")).select(
        F.col(entity).alias("_e"), F.col("x.d").alias("_d"), F.col("x.s").alias("cluster_start")
    )
    return events.join(starts, (F.col(entity) == F.col("_e")) & (F.col(day) == F.col("_d")), "left").drop("_e", "_d")


def keep(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. Tasks keep one row per key before the shuffle, so no group is sorted whole."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_before(
    left: DataFrame, right: DataFrame, key: str, at: str, time: str, prefer: Column | None = None, inclusive: bool = True
) -> DataFrame:
    """left plus found: the struct of right's row with the latest time not after at (and, with prefer, among those preferred first).

    An equi-join on the key with the inequality inside an aggregate, over the distinct keys and times of left, so equal rows of
    left stay apart; of right only the greatest row per task, key and time is shuffled. NULL where there is none. Made for few
    times per key in left, such as an entity's anchors; for many, as_known_at keeps a state instead of comparing them all.
    """
    cols = [c for c in right.columns if c not in (key, time)]
    row = F.struct((prefer.cast("int") if prefer is not None else F.lit(0)).alias("preferred"), F.col(time), *cols)
    per = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(time).alias("_t")).agg(F.max(row).alias("_r"))
    asked = left.select(F.col(key).alias("_k"), F.col(at).alias("_a")).where("_k IS NOT NULL AND _a IS NOT NULL").distinct()
    ok = F.col("_t") <= F.col("_a") if inclusive else F.col("_t") < F.col("_a")
    best = asked.join(per, "_k").where(ok).groupBy("_k", "_a").agg(F.max("_r").alias("found"))
    return left.join(best, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_a")), "left").drop("_k", "_a")


def window_counts(anchors: DataFrame, signals: DataFrame, key: str, anchor: str, day: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """anchors plus a count per span: signals with anchor - a <= day <= anchor - b days, spans name -> (a, b).

    Signals are counted per key and day before the join, so a hot key brings at most one row per day.
    """
    per_day = signals.where(F.col(day).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(day).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    gap = F.datediff(F.col(anchor), F.col("_d"))
    widest = max(a for a, _ in spans.values())
    nearest = min(b for _, b in spans.values())
    joined = anchors.join(per_day, (F.col(key) == F.col("_k")) & gap.between(nearest, widest), "left")
    return joined.groupBy(*anchors.columns).agg(
        *[F.coalesce(F.sum(F.when(gap.between(b, a), F.col("_n"))), F.lit(0)).alias(n) for n, (a, b) in spans.items()]
    )


def stack_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The union of two generations, the later row of each key kept; columns that one lacks are NULL."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return keep(both, key, [F.desc("_gen"), *order]).drop("_gen")


def merge_fragments(base: DataFrame, fragments: Sequence[DataFrame], key: str, defaults: dict[str, object]) -> DataFrame:
    """Left joins of signal fragments on one key: only new columns are taken, one row per key, defaults filled in."""
    out = base
    for f in fragments:
        new = [c for c in f.columns if c == key or c not in out.columns]
        rest = [c for c in new if c != key]
        one = f.groupBy(key).agg(F.max(F.struct(*rest)).alias("_f")).select(key, *[F.col("_f")[c].alias(c) for c in rest]) if rest else f.select(key).distinct()
        out = out.join(one, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in out.columns})


def next_batch(cohort: DataFrame, done: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    """The next n entities that the ledger doesn't hold."""
    return cohort.join(done.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)
