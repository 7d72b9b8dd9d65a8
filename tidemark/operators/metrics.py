"""Exact ranking metrics, folds and audits as joins and windows over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df plus inclusive running sums over a total order, without one task holding all rows.

    Rows are range-partitioned and written once; windows run inside the ranges and are shifted by the sums
    of the ranges before, one row per range.
    """
    d = df.repartitionByRange(*order).withColumns({"_b": F.spark_partition_id()} | {f"_x{n}": c for n, c in sums.items()})
    d = materialize(d, "ranges")
    total = d.groupBy("_b").agg(*[F.sum(f"_x{n}").alias(f"_t{n}") for n in sums])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("_b", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_o{n}") for n in sums])
    here = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(total), "_b").withColumns({n: F.sum(f"_x{n}").over(here) + F.col(f"_o{n}") for n in sums})
    return out.drop("_b", *[f"_x{n}" for n in sums], *[f"_o{n}" for n in sums])


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Counts per distinct score: windows then run over scores and not over rows."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return ok.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("_p"), F.count(F.lit(1)).alias("_n"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): the rank-sum AUC with mid-ranks; NULL where one class is missing."""
    s = _by_score(df, score, label, by)
    if by:
        w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    else:
        s = running_sums(s, [F.col(score)], {"_upto": F.col("_n")}).withColumn("_below", F.col("_upto") - F.col("_n"))
    s = s.withColumn("_rank", F.col("_p") * (F.col("_below") + (F.col("_n") + 1) / 2))
    g = s.groupBy(*by) if by else s.groupBy()
    t = g.agg(F.sum("_rank").alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    q = F.col("n") - F.col("p")
    auc = F.when((F.col("p") > 0) & (q > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q))
    return t.select(*by, auc.alias("auc"))


def curve_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision): a point per distinct score."""
    s = _by_score(df, score, label, [])
    s = running_sums(s, [F.desc(score)], {"tp": F.col("_p"), "fp": F.col("_n") - F.col("_p")})
    total = s.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("n")).alias("t")).scalar()
    p, n = total["p"], total["n"]
    return s.select(
        F.col(score).alias("threshold"), "tp", "fp", F.when(p > 0, F.col("tp") / p).alias("tpr"), F.when(n > 0, F.col("fp") / n).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """(ap): the sum of precision times the step of recall over distinct scores."""
    s = _by_score(df, score, label, [])
    s = running_sums(s, [F.desc(score)], {"_tp": F.col("_p"), "_all": F.col("_n")})
    return s.agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("x"), F.sum("_p").alias("p")).select(
        F.when(F.col("p") > 0, F.col("x") / F.col("p")).alias("ap")
    )


def precision_at(df: DataFrame, score: str, label: str, tie: str, shares: Sequence[float]) -> DataFrame:
    """(q, k, hits, precision) of the top shares by score; ties in order of another column."""
    ks = [F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(float(q))).cast("int")).alias("k")) for q in shares]
    ranked = running_sums(df.select(score, tie, F.col(label).cast("bigint").alias("y")), [F.desc(score), F.col(tie)], {"rn": F.lit(1)})
    ranked = ranked.withColumn("_all", df.agg(F.count(F.lit(1))).scalar())
    top = ranked.select("y", F.explode(F.filter(F.array(*ks), lambda x: x["k"] >= F.col("rn"))).alias("x"))
    return top.groupBy("x.q", "x.k").agg(F.sum("y").alias("hits")).withColumn("precision", F.col("hits") / F.col("k"))


def stratified_folds(df: DataFrame, label: str, order: Column, k: int = 5) -> DataFrame:
    """df plus fold: rows of each label dealt in the given order."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1) % k)


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, mean_score, rate) over equal bins of [0, 1]."""
    b = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")
    )


def univariate_audit(df: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """(feature, auc, coverage, corr): each feature's mean AUC over folds, in one job over unpivoted features.

    A feature is turned round in a fold if it falls with the label in the other folds; NULLs count as 0; a feature that never
    varies has no AUC.
    """
    long = df.select(label, fold, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x"))
    long = long.select(F.col(label).cast("double").alias("_y"), F.col(label), fold, "x.feature", F.coalesce("x.v", F.lit(0.0)).alias("v"))
    auc = roc_auc(long, "v", label, ["feature", fold])
    part = long.groupBy("feature", fold).agg(*[F.sum(c).alias(n) for n, c in {"n": F.lit(1.0), "x": F.col("v"), "y": F.col("_y"), "xy": F.col("v") * F.col("_y")}.items()])
    whole = Window.partitionBy("feature")
    other = lambda c: F.sum(c).over(whole) - F.col(c)
    part = part.select("feature", fold, (other("n") * other("xy") < other("x") * other("y")).alias("falls"))
    auc = auc.join(part, ["feature", fold]).groupBy("feature").agg(F.avg(F.when(F.col("falls"), 1 - F.col("auc")).otherwise(F.col("auc"))).alias("auc"))
    rest = long.groupBy("feature").agg(
        F.avg((F.col("v") != 0).cast("double")).alias("coverage"), F.corr("v", "_y").alias("corr"), (F.min("v") < F.max("v")).alias("varies")
    )
    return auc.join(rest, "feature").withColumn("auc", F.when(F.col("varies"), F.col("auc"))).drop("varies")


def bootstrap_auc(df: DataFrame, score: str, label: str, row_id: str, replicates: int = 1000) -> DataFrame:
    """(lo, hi): the middle 95 % of the AUC over resamples by Poisson weights drawn from a hash of row and replicate."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("-", F.col(row_id).cast("string"), F.col("_r").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    # cumulative Poisson(1): 0.3679, 0.7358, 0.9197, 0.9810, 0.9963
    w = sum((u > x).cast("int") for x in (0.36788, 0.73576, 0.9197, 0.98101, 0.99634))
    r = df.select(F.col(row_id), F.col(score), F.col(label), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")).withColumn("_w", w)
    s = r.groupBy("_r", score).agg(F.sum(F.col("_w") * F.col(label)).alias("_p"), F.sum("_w").alias("_n"))
    win = Window.partitionBy("_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_rank", F.col("_p") * (F.coalesce(F.sum("_n").over(win), F.lit(0)) + (F.col("_n") + 1) / 2))
    t = s.groupBy("_r").agg(F.sum("_rank").alias("r"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    q = F.col("n") - F.col("p")
    t = t.where((F.col("p") > 0) & (q > 0)).select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("auc"))
    return t.agg(F.percentile("auc", F.lit(0.025)).alias("lo"), F.percentile("auc", F.lit(0.975)).alias("hi"))
