"""Structured Streaming twins of the rolling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import append_ledger


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A directory of parquet files as a stream, one file per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, span: str = "14 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n, total): counts and sums per sliding window; rows later than the watermark are dropped in streams."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.window(time, span, step).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), kind, "n", "total"
    )


CLUSTERED = "entity string, day date, cluster_start date, n bigint"


def stream_clusters(events: DataFrame, entity: str, day: str, span: int = 120, keep_days: int = 400) -> DataFrame:
    """The streaming twin of anchored_clusters: (entity, day, cluster_start, n) for each new event, n being its place in the cluster.

    The state of an entity is its clusters' starts and sizes; those that end more than keep_days before its latest event are
    forgotten, so it stays small however long the stream runs. Within a trigger events are taken in order of their days. An
    event earlier than what is kept opens no new cluster and is given the cluster it would have joined, or its own day.
    """
    from collections.abc import Iterator
    from datetime import timedelta

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, sizes = state.get if state.exists else ([], [])
        starts, sizes, rows = list(starts), list(sizes), []
        days = sorted(d for b in batches for d in b["day"] if d is not None)
        for d in days:
            k = max((i for i, s in enumerate(starts) if s <= d), default=-1)
            if k >= 0 and (d - starts[k]).days <= span:
                sizes[k] += 1
            elif k == len(starts) - 1:
                starts.append(d)
                sizes.append(1)
                k = len(starts) - 1
            rows.append((key[0], d, starts[k] if k >= 0 else d, sizes[k] if k >= 0 else 1))
        if starts:
            old = starts[-1] - timedelta(days=keep_days)
            kept = [i for i, s in enumerate(starts) if s >= old or i == len(starts) - 1]
            state.update(([starts[i] for i in kept], [sizes[i] for i in kept]))
        yield pd.DataFrame(rows, columns=["entity", "day", "cluster_start", "n"])

    e = events.select(F.col(entity).cast("string").alias("entity"), F.col(day).cast("date").alias("day")).where("entity IS NOT NULL AND day IS NOT NULL")
    return e.groupBy("entity").applyInPandasWithState(run, CLUSTERED, "starts array<date>, sizes array<bigint>", "append", GroupStateTimeout.NoTimeout)


def upsert_ledger(path: str, key: str):
    """A foreachBatch writer that appends only keys that the ledger lacks; an error of reading it ends the batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_ledger(batch, path, key)

    return write
