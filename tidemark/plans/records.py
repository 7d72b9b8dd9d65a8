"""Queries over the project's tables for the operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asknown import as_known_at
from tidemark.operators.timestamps import normalise_timestamps
from tidemark.session import materialize
from tidemark.sources.tables import load, norm_null

SIGNALS = ["patent_earliest_date_preA", "wayback_snapshots_12m_preA", "gdelt_mentions_3m_preA"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    feeds = load(spark, d, "feeds")
    final = normalise_timestamps(
        load(spark, d, "final_dataset"),
        {"seriesA_date": "seriesA_date", "pkg_first_release_date": "pkg_first_release_date"}, "final_id", feeds,
    )
    patents = normalise_timestamps(load(spark, d, "patent_assignees"), {"first_filing": "first_filing"}, "assignee_row_id", feeds)
    return final.withColumn("table_name", F.lit("final_dataset")).unionByName(
        patents.withColumn("table_name", F.lit("patent_assignees"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The one day or instant that each dated value fixes."""
    return _readings(spark, d).where("fixed").select("table_name", "row_id", "field", "norm")


def p2_formats(spark: SparkSession, d: str) -> DataFrame:
    """How many values were read in each format, and how many of them fix one day or instant."""
    return _readings(spark, d).groupBy("table_name", "field", "fmt").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("fixed").cast("bigint")).alias("n_fixed")
    )


def _stored_and_known(spark: SparkSession, d: str) -> DataFrame:
    final = load(spark, d, "final_dataset")
    dates = normalise_timestamps(final, {"seriesA_date": "seriesA_date"}, "final_id", load(spark, d, "feeds"))
    when = F.when(F.length("norm") == 10, F.concat("norm", F.lit("T00:00:00Z"))).otherwise(F.col("norm"))
    dates = dates.where("fixed").select(F.col("row_id").alias("final_id"), F.to_timestamp(when).alias("event_time"))
    stored = final.select(
        "final_id", "org_id",
        F.explode(F.create_map(*[x for s in SIGNALS for x in (F.lit(s), F.col(s).cast("string"))])).alias("signal", "stored_value"),
    )
    history = load(spark, d, "signal_history").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("valid_from", "known_at")}
    )
    return as_known_at(stored.join(dates, "final_id"), history, ["org_id", "signal"], "event_time", tie="obs_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Signals whose stored value is not the one known at the event."""
    stored, known = norm_null("stored_value"), norm_null("known_value")
    return _stored_and_known(spark, d).where(~stored.eqNullSafe(known)).select("final_id", "signal")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every event's signals as known at its time."""
    return _stored_and_known(spark, d).select("final_id", "signal", "known_value")


def p4_updates(spark: SparkSession, d: str) -> DataFrame:
    """The three signals of each company as known when its row was updated: plain times, so that SQL can say the same."""
    asked = load(spark, d, "companies").where("updated_at IS NOT NULL").select("org_id", "updated_at", F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("signal"))
    got = as_known_at(asked, load(spark, d, "signal_history"), ["org_id", "signal"], "updated_at", tie="obs_id")
    return got.select("org_id", "signal", "known_value")


QUERIES = {"p2_found": p2_found, "p2_formats": p2_formats, "p4_found": p4_found, "p4_values": p4_values, "p4_updates": p4_updates}
SQL: dict[str, str] = {
    "p4_updates": """WITH q AS (SELECT org_id, updated_at, unnest(['patent_earliest_date_preA', 'wayback_snapshots_12m_preA', 'gdelt_mentions_3m_preA']) AS signal FROM companies WHERE updated_at IS NOT NULL),
j AS (SELECT q.*, value, obs_id, row_number() OVER (PARTITION BY q.org_id, q.signal ORDER BY valid_from DESC NULLS LAST, known_at DESC NULLS LAST, obs_id DESC NULLS LAST) k
  FROM q LEFT JOIN signal_history h ON h.org_id = q.org_id AND h.signal = q.signal AND valid_from <= updated_at AND known_at <= updated_at)
SELECT org_id, signal, value AS known_value FROM j WHERE k = 1"""
}
