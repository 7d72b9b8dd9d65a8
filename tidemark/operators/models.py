"""Classifiers, cross-validation and ablation on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def model(kind: str, rows: int):
    """A classifier by name; the penalties are given per row as 1 / (C n)."""
    common = {"featuresCol": "scaled", "labelCol": "label", "weightCol": "w"}
    if kind in ("logistic_l2", "logistic_l1"):
        l1 = kind.endswith("l1")
        return LogisticRegression(elasticNetParam=float(l1), regParam=1 / ((0.05 if l1 else 0.1) * max(1, rows)), **common)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=500, maxDepth=3, minInstancesPerNode=2, seed=42, **common)
    return GBTClassifier(maxIter=100, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=42, **common)


def pipeline(features: Sequence[str], kind: str, rows: int, categories: Sequence[str] = ()) -> Pipeline:
    """Categories one-hot (unseen ones as none of them), numbers scaled, then the classifier; fitted as one, so nothing leaks out of a fold."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_at", handleInvalid="keep") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}_at" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep")] if categories else []
    return Pipeline(
        stages=[
            *stages, VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="numbers", withMean=True),
            VectorAssembler(inputCols=["numbers", *[f"{c}_hot" for c in categories]], outputCol="scaled"), model(kind, rows),
        ]
    )


def prepared(df: DataFrame, features: Sequence[str], label: str = "label", categories: Sequence[str] = ()) -> DataFrame:
    """row_id, fold (where there is one), label and the features as models take them: numbers without NULL, categories as texts."""
    have = [c for c in ("row_id", "fold") if c in df.columns]
    return df.select(
        *have, F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        *[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("MISSING")).alias(c) for c in categories],
    )


def weighted(fit: DataFrame) -> tuple[DataFrame, int]:
    """fit plus w: positives weigh as much as negatives; and the number of rows."""
    row = fit.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    weight = (row.n - row.p) / row.p if row.p else 1.0
    return fit.withColumn("w", F.when(F.col("label") == 1, weight).otherwise(1.0)), row.n


def fitted(df: DataFrame, features: Sequence[str], kind: str, label: str = "label", categories: Sequence[str] = ()):
    """A pipeline fitted to all rows."""
    fit, n = weighted(prepared(df, features, label, categories))
    return pipeline(features, kind, n, categories).fit(fit)


def cross_validated(df: DataFrame, features: Sequence[str], kind: str, folds: int, label: str = "label", categories: Sequence[str] = ()) -> DataFrame:
    """(row_id, fold, label, score): out-of-fold scores; df has row_id, label, fold; scaling, categories and weights are fitted inside each fold."""
    base = materialize(prepared(df, features, label, categories), "features")
    out = None
    for k in range(folds):
        fit, n = weighted(base.where(F.col("fold") != k))
        done = pipeline(features, kind, n, categories).fit(fit).transform(base.where(F.col("fold") == k))
        part = done.select("row_id", "fold", "label", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
