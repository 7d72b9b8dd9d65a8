from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.operators.registry import FeatureSpec, register_verifier, select_features, verify
from tidemark.sources import sinks


def test_generations_and_ledger(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    root = str(tmp_path / "stack")
    first = sinks.upsert_generation(a, root, "n1", ["k"], [F.col("v")])
    second = sinks.upsert_generation(b, root, "n2", ["k"], [F.col("v")])
    assert sorted(map(tuple, spark.read.parquet(second).collect())) == [(1, "x"), (2, "z")]
    assert spark.read.parquet(first).count() == 2
    for _ in range(2):
        sinks.append_ledger(a, str(tmp_path / "ledger"), "k")
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    sinks.write_stage(a, str(tmp_path / "stage"), ["v"])
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2
    assert "| 1 | x |" in sinks.markdown_table(a.orderBy("k")) and '"y"' in sinks.manifest("y", ["a"])


def test_arrays(spark):
    df = spark.createDataFrame(
        [([date(2020, 1, 1), date(2021, 1, 1)], ["10-K", "D"], {"1.0": date(2020, 5, 1), "created": date(2019, 1, 1)}, [("MIT", "studied at MIT"), ("unknown", "studied at MIT"), ("X", "made up")], "She studied at MIT.")],
        "ds array<date>, ks array<string>, m map<string,date>, f array<struct<value:string,quote:string>>, t string",
    )
    r = df.select(
        F.size(A.zip_filter("ds", "ks", F.lit("2021-01-01").cast("date"))).alias("strict"), A.release_dates("m").alias("rel"),
        F.size(A.verified_facts("f", "t")).alias("facts"), A.tier("ks", {1: ["d"], 3: ["10-k"]}).alias("tier"), A.up_to("ds", F.lit("2021-01-01").cast("date")).alias("upto"),
        A.ordinal_range("ks", {"D": 1.0, "10-K": 2.0})[1].alias("hi"),
    ).first()
    assert (r.strict, r.rel, r.facts, r.tier, r.upto, r.hi) == (1, [date(2020, 5, 1)], 1, 3, 2, 2.0)


def test_registry(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, a int, outcome int")
    assert select_features(df, [FeatureSpec("a", "x"), FeatureSpec("zz", "x")], ["id"]).columns == ["id", "a"]
    with pytest.raises(ValueError):
        select_features(df, [FeatureSpec("outcome", "y", leaks=True)])
    t = spark.createDataFrame([("a", "abc"), ("q", "abc"), (None, "abc")], "c string, e string")
    register_verifier("inside", lambda c, e: c in e, on_missing=True, on_error=False)
    assert sorted((r.c or "", r.accepted) for r in verify(t, "inside", "c", "e").collect()) == [("", False), ("a", True), ("q", False)]
    register_verifier("none", None, on_missing=True, on_error=False)
    assert verify(t, "none", "c", "e").where("accepted").count() == 3
