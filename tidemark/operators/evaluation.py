"""Evaluation of feature sets, labels and sources by cross-validated models, and the verdicts drawn from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics, models
from tidemark.session import materialize


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """The numeric columns but for some."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def stratified_split(df: DataFrame, label: str, order: Column, share: float = 0.2) -> DataFrame:
    """df plus split: of each label the first share of its rows, in a given order, is test, the rest train."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(order))
    return df.withColumn("split", F.when(rank <= F.round(F.count(F.lit(1)).over(w) * share), "test").otherwise("train"))


def scores_of(df: DataFrame, features: Sequence[str], kind: str, folds: int = 5) -> DataFrame:
    """(auc, sd, ap): pooled out-of-fold AUC, its deviation over folds, and average precision, as one row."""
    oof = models.cross_validated(df, features, kind, folds)
    per = metrics.roc_auc(oof, "score", "label", ["fold"]).agg(F.stddev_pop("auc").alias("sd"))
    return metrics.roc_auc(oof, "score", "label").withColumns({"sd": per.scalar(), "ap": metrics.average_precision(oof, "score", "label").scalar()})


def compare_sets(df: DataFrame, sets: dict[str, Sequence[str]], kind: str = "logistic_l2", folds: int = 5, least: float = 0.01) -> DataFrame:
    """(features, n, auc, sd, ap, delta, verdict): each set against the first one; a difference below least says nothing."""
    out = None
    for name, cols in sets.items():
        one = scores_of(df, cols, kind, folds).withColumns({"features": F.lit(name), "n": F.lit(len(cols))})
        out = one if out is None else out.unionByName(one)
    out = materialize(out, "sets")  # read twice, and a row per set
    first = out.where(F.col("features") == next(iter(sets))).agg(F.max("auc")).scalar()
    out = out.withColumn("delta", F.col("auc") - first)
    return out.withColumn("verdict", F.when(F.col("delta") >= least, "better").when(F.col("delta") <= -least, "worse").otherwise("same"))


def compare_labels(df: DataFrame, labels: Sequence[str], features: Sequence[str], kind: str = "logistic_l2", folds: int = 5) -> DataFrame:
    """(label, rate, auc, sd, ap): the same features for several labels, folds stratified by each."""
    out = None
    for name in labels:
        x = df.where(F.col(name).isNotNull()).withColumn("label", F.col(name).cast("double"))
        x = metrics.stratified_folds(x.drop("fold"), "label", F.struct(F.md5(F.col("row_id").cast("string")), "row_id"), folds)
        one = scores_of(x, features, kind, folds).withColumns({"rate": x.agg(F.avg("label")).scalar(), "label": F.lit(name)})
        out = one if out is None else out.unionByName(one)
    return out


def progressive(results: DataFrame, step: str, order: str, score: str = "auc") -> DataFrame:
    """results plus gain: what each step adds to the one before, the first to chance. One row per step."""
    return results.withColumn("gain", F.col(score) - F.coalesce(F.lag(score).over(Window.orderBy(order)), F.lit(0.5)))


def best_of(results: DataFrame, name: str, score: str = "auc") -> DataFrame:
    """The row with the greatest score, the first name among equals."""
    rest = [c for c in results.columns if c not in (name, score)]
    return results.where(F.col(score).isNotNull()).groupBy().agg(F.min(F.struct((-F.col(score)).alias("_s"), name, *rest)).alias("x")).where("x IS NOT NULL").select(f"x.{name}", (-F.col("x._s")).alias(score), *[f"x.{c}" for c in rest])


def importances(spark: SparkSession, fitted, features: Sequence[str], top: int = 15) -> DataFrame:
    """(feature, importance): the greatest importances of a fitted pipeline's model, coefficients' sizes for linear ones."""
    m = fitted.stages[-1]
    vals = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def rank_all(fitted, df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, score, rank): every row scored by a fitted pipeline, ranked over range partitions and not in one task."""
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(df).select(row_id, vector_to_array("probability")[1].alias("score"))
    return metrics.running_sums(scored, [F.desc("score"), F.col(row_id)], {"rank": F.lit(1)})


def tiers(audit: DataFrame, strong: float = 0.55, weak: float = 0.52) -> DataFrame:
    """audit (feature, auc, ...) plus tier: useful, marginal or useless; unknown where there is no AUC."""
    return audit.withColumn("tier", F.when(F.col("auc").isNull(), "unknown").when(F.col("auc") > strong, "useful").when(F.col("auc") > weak, "marginal").otherwise("useless"))


def correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, corr): each feature's correlation with a column, NULLs as 0, in one aggregate."""
    one = df.agg(*[F.corr(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.col(target).cast("double")).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr")) for f in features])).alias("x")).select("x.feature", "x.corr")


def proxies(df: DataFrame, features: Sequence[str], amount: str, most: float = 0.7) -> DataFrame:
    """(feature, corr, proxy): whether a feature is but another form of an amount."""
    return correlations(df, features, amount).withColumn("proxy", F.coalesce(F.abs("corr") > most, F.lit(False)))


def suspicious(df: DataFrame, features: Sequence[str], label: str, most: float = 0.3, top: int = 10) -> DataFrame:
    """(feature, corr, suspicious): the features that go with the label most, those too well flagged."""
    c = correlations(df, features, label).withColumn("suspicious", F.coalesce(F.abs("corr") > most, F.lit(False)))
    return c.orderBy(F.desc_nulls_last(F.abs("corr")), "feature").limit(top)


def drop_and_retest(df: DataFrame, features: Sequence[str], dropped: Sequence[str], kind: str = "logistic_l2", folds: int = 5, least: float = 0.015) -> DataFrame:
    """(features, n, auc, sd, ap, delta, verdict): with all features, without some, and with these alone."""
    rest = [f for f in features if f not in dropped]
    return compare_sets(df, {"all": features, "without": rest, "alone": [f for f in features if f in dropped]}, kind, folds, least)


def follow_on_gap(df: DataFrame, label: str, months: str, most: float = 36.0) -> DataFrame:
    """(dated, median_months, share_within): the gap to the follow-on of dated positives, and the share within some months."""
    ok = df.where((F.col(label) == 1) & F.col(months).isNotNull())
    return ok.agg(F.count(F.lit(1)).alias("dated"), F.median(months).alias("median_months"), F.avg((F.col(months) <= most).cast("double")).alias("share_within"))
