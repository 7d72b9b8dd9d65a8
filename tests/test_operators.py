from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.keys import accession, cik10, domain_norm
from tidemark.operators import matching, metrics, sequences
from tidemark.sources.tables import resolve, with_defaults


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_keys(spark):
    for v, want in [("CIK0000917365", "0000917365"), ("917365.0", "0000917365"), (" 0000917365", "0000917365"), ("nan", None), (None, None), ("abc", None)]:
        assert one(spark, cik10("v"), v=v) == want
    for v in (" 0001600000-09-000029", "000160000009000029"):
        assert one(spark, accession("v"), v=v) == "0001600000-09-000029"
    for v, want in [("https://www.Acme.example/home?x=1", "acme.example"), ("acme.example/", "acme.example"), ("http://u@acme.example:80", "acme.example"), ("NaT", None)]:
        assert one(spark, domain_norm("v"), v=v) == want


def test_text(spark):
    assert one(spark, X.company_tokens("v"), v="The Acme-Foo, Inc. Foo") == ["the", "acme", "foo"]
    assert one(spark, X.word_count("v"), v="  ") == 0
    assert one(spark, X.surnames("v"), v="Ann O'Neil, Bob de la Cruz-X, J") == ["CRUZ-X", "O'NEIL"]
    html = "<html><script>x</script><nav>menu</nav><p>a&nbsp;&amp; b</p><style>y</style></html>"
    assert one(spark, X.html_to_text("v"), v=html) == "a & b"
    assert one(spark, X.quote_verified("v", "q"), v="We sold Big Things.", q=" big things ") is True
    assert one(spark, X.quote_verified("v", "q"), v="abc", q="abc") is False


def test_numbers(spark):
    assert one(spark, N.safe_float("v"), v=" $1,000,000 ") == 1e6
    assert one(spark, N.safe_float("v"), v="NaN") is None
    assert one(spark, N.ratio("a", "b"), a=1.0, b=0.0) == 0
    assert one(spark, N.season_date("v"), v="Winter 2018") == date(2018, 1, 1)
    assert one(spark, N.parse_date("v"), v="01-OCT-2008") == date(2008, 10, 1)
    assert one(spark, N.clip("a", 0, 1), a=7.0) == 1.0


def test_clusters(spark):
    d0 = date(2020, 1, 1)
    rows = [("a", d0 + timedelta(days=x)) for x in (0, 100, 200, 300, 330, 330)] + [("b", d0), ("b", d0 + timedelta(days=120)), ("b", d0 + timedelta(days=121)), ("c", None)]
    got = sequences.anchored_clusters(spark.createDataFrame(rows, "e string, d date"), "e", "d")
    out = sorted((r.e, (r.d - d0).days if r.d else -1, (r.cluster_start - d0).days if r.cluster_start else -1) for r in got.collect())
    assert out == [("a", 0, 0), ("a", 100, 0), ("a", 200, 200), ("a", 300, 200), ("a", 330, 330), ("a", 330, 330), ("b", 0, 0), ("b", 120, 0), ("b", 121, 121), ("c", -1, -1)]


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = sequences.stack_upsert(a, b, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sequences.stack_upsert(once, b, ["k"], [F.col("v")]).collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_later_rows_change_no_signal(spark):
    """What comes after the anchor never changes a count before it."""
    a = spark.createDataFrame([(1, date(2020, 5, 1))], "k int, anchor date")
    s = [(1, date(2020, 4, 20)), (1, date(2020, 5, 1)), (1, date(2019, 1, 1))]
    later = [(1, date(2020, 5, 2)), (1, date(2021, 1, 1))]
    f = lambda rows: sequences.window_counts(a, spark.createDataFrame(rows, "k2 int, day date").withColumnRenamed("k2", "k"), "k", "anchor", "day", {"n": (90, 0)}).first().n
    assert f(s) == f(s + later) == 2


def test_auc(spark):
    rows = [(i, float(i % 4), int(i % 3 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "s", "y").first().auc == pytest.approx(want)
    assert metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc == pytest.approx(1 - want)
    assert metrics.roc_auc(df.where("y = 1"), "s", "y").first().auc is None


def test_plans_without_nested_loops(spark):
    t = spark.createDataFrame([("ACME",)], "target string")
    v = spark.createDataFrame([("ACME INC",), ("ACMEX INC",), ("ACME",), ("ACME, LLC",)], "value string")
    j = matching.prefix_join(t, v, "target", "value", [" INC", ","])
    assert sorted(r.value for r in j.collect()) == ["ACME", "ACME INC", "ACME, LLC"]
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tables(spark):
    df = spark.createDataFrame([("1", "x")], "A string, b string")
    from pyspark.sql import types as T

    assert resolve(df, {"n": (["zz", "a"], T.IntegerType()), "m": (["q"], T.DateType())}).first().asDict() == {"n": 1, "m": None}
    assert with_defaults(df, {"c": 0}).first().c == 0


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.windows import read_events, upsert_ledger, windowed_counts

    src = spark.range(50).selectExpr("timestamp_seconds(id * 86400 + 1700000000) ts", "'a' event_type", "cast(id as double) value", "id % 7 as key")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = read_events(spark, str(tmp_path / "in"), src.schema)
    q = windowed_counts(stream, "ts", "event_type", "3 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, windowed_counts(src, "ts", "event_type", "3 days", "1 day").collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == want
    write = upsert_ledger(str(tmp_path / "ledger"), "key")
    write(src.select("key"), 0)
    write(src.select("key"), 1)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 7


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p4_found"} <= set(e.queries())


def test_evaluation_has_the_listed_size(spark, monkeypatch):
    from inspect import signature

    from tidemark.operators import metrics, models
    from tidemark.plans import analytics

    forest, boosted = models.model("random_forest", 9), models.model("boosted_trees", 9)
    assert forest.getNumTrees() == 500 and (boosted.getMaxIter(), boosted.getStepSize()) == (100, 0.05)
    assert signature(metrics.bootstrap_auc).parameters["replicates"].default == 1000
    rows = [(i, "x", *[float(i % 7)] * len(analytics.MODEL_FEATURES), int(i % 4 == 0)) for i in range(60)]
    names = {"s": "edgar_filings_preA", "w": "wayback_snapshots_12m_preA", "founders": "`Number of Founders`"}
    cols = ", ".join(f"{names.get(c, c)} double" for c in analytics.MODEL_FEATURES)
    df = spark.createDataFrame(rows, f"final_id bigint, Organization_Name string, {cols}, label int")
    monkeypatch.setattr(analytics, "load", lambda *a: df)
    x = analytics._model_input(spark, "")
    assert {r.fold: (r.n, r.p) for r in x.groupBy("fold").agg(F.count("row_id").alias("n"), F.sum("label").alias("p")).collect()} == {k: (12, 3) for k in range(5)}
    assert set(analytics.MODEL_FEATURES) <= set(x.columns) and len(analytics.MODEL_FEATURES) == 10
    sets = {(g, how): use for g, how, use in analytics.ablation_sets()}
    assert len(sets) == 24 and sets["Packages", "cumulative"] == analytics.MODEL_FEATURES and sets["Form D", "without"] == analytics.MODEL_FEATURES[1:]
