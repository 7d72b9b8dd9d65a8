import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import evaluation, features, incremental, models
from tidemark.operators import registry as R
from tidemark.operators.sequences import latest_before
from tidemark.sources import sinks, tables


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, None, 4)], "a int, b int, c_x int, c_y int")
    assert incremental.ordered(df, ["b", "zz", "b"]).columns == ["b", "a", "c_x", "c_y"] and incremental.only(df, ["zz", "b"]).columns == ["b"]
    assert incremental.without(df, ["a", "zz"]).columns == ["b", "c_x", "c_y"]
    assert incremental.reconcile(df).first().asDict() == {"a": 1, "b": 2, "c": 4}
    new = spark.createDataFrame([(1, 9), (1, 8), (7, None)], "a int, b int")
    assert incremental.merge_newer(df.select("a", "b"), new, ["a"]).first().b == 9 and incremental.replace_then_merge(df.select("a", "b"), new.where("a = 7"), ["a"]).first().b == 0
    assert evaluation.numeric_columns(df.withColumn("s", F.lit("x")), ["a"]) == ["b", "c_x", "c_y"]


def test_runs_and_resume(spark):
    runs, done = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string"), spark.createDataFrame([("r3",)], "run_id string")
    assert incremental.latest_run(runs, done).first().run_id == "r2" and incremental.latest_run(runs, runs).count() == 0
    assert incremental.common(runs, done, "run_id").first().n == 1
    cohort = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    have = spark.createDataFrame([("a", "ok", 5), ("b", "", 6), ("b", None, 7)], "k string, marker string, w int")
    fin, rest = incremental.resume(cohort, have, "k", "marker")
    assert [tuple(r) for r in fin.collect()] == [("a", 1, "ok", 5)] and {r.k for r in rest.collect()} == {"b", "c"}
    assert [r.k for r in incremental.prefiltered(cohort, F.col("v") > 1, spark.createDataFrame([("b",)], "k string"), "k", 5).collect()] == ["c"]


def test_fetch_notes_errors(spark):
    def call(k):
        if k == "bad":
            raise OSError("429")
        return k.upper()

    todo = spark.createDataFrame([("x",), ("bad",), ("x",)], "k string")
    got = {r.k: (r.text, r.note) for r in incremental.fetch(todo, "k", call, 2, tries=2, pause=0.01).collect()}
    assert got["x"] == ("X", "ok") and got["bad"][0] is None and got["bad"][1].startswith("error: OSError")
    cache = spark.createDataFrame([("x", "t" * 60, False), ("y", "", True), ("z", "short", False)], "k string, text string, is_miss boolean")
    ask = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    hits, misses = incremental.cached(ask, cache, "k")
    assert [r.k for r in hits.collect()] == ["x"] and [r.k for r in misses.collect()] == ["z"]
    assert incremental.cached(ask, cache, "k", honour_misses=False)[1].count() == 2


def test_files(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text('a;b\n1;x\nbad;row\n2;"y;z"\n')
    schema = T.StructType().add("a", "integer").add("b", "string")
    assert [tuple(r) for r in tables.read_vendor_csv(spark, str(p), schema).collect()] == [(1, "x"), (2, "y;z")]
    q = tmp_path / "h.csv"
    q.write_text('a,b\n1,"two\nlines"\n2,"say \\"hi\\""\n')
    assert [r.b for r in tables.read_hardened_csv(spark, str(q), schema).collect()] == ["two\nlines", 'say "hi"']
    j = tmp_path / "d.json"
    j.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert tables.read_dataset(spark, str(j), schema, least=1).count() == 2
    try:
        tables.read_dataset(spark, str(j), schema, least=5)
    except ValueError as e:
        assert "2 rows" in str(e)
    else:
        raise AssertionError
    df = tables.read_json_records(spark, str(j), schema)
    assert json.loads(sinks.as_json(df))[0] == {"a": 1, "b": "x"}
    js, md = sinks.report({"m": df})
    assert json.loads(js)["m"][1]["a"] == 2 and "| a | b |" in md
    sinks.write_csv(df, str(tmp_path / "audit"))
    moved = sinks.archive(spark, [str(tmp_path / "audit"), str(tmp_path / "none")], str(tmp_path / "old"))
    assert len(moved) == 1 and spark.read.csv(moved[0], header=True).count() == 2
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert tables.columns_of(spark, str(tmp_path)) == {"t": ["a", "b"]}
    assert tables.in_list(df, "a", df.where("a = 1")).count() == 1 and tables.setting(spark, "nothing_such", "d") == "d"


def test_latest_before_keeps_equal_rows(spark):
    left = spark.createDataFrame([(1, 5), (1, 5), (1, 0), (None, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 6, "c"), (None, 1, "d")], "k int, t int, v string")
    got = sorted((r.k or 0, r["at"], r.found.v if r.found else "") for r in latest_before(left, right, "k", "at", "t").collect())
    assert got == [(0, 5, ""), (1, 0, ""), (1, 5, "b"), (1, 5, "b")]
    assert [r.found.v for r in latest_before(left.limit(1), right, "k", "at", "t", inclusive=False).collect()] == ["a"]
    assert [r.found.v for r in latest_before(left.limit(1), right, "k", "at", "t", prefer=F.col("v") == "a").collect()] == ["a"]


def test_models_and_verdicts(spark):
    rows = [(i, i % 5, float(i % 10 >= 5), float(i % 10) + (i % 3), float(i % 7), "abc"[i % 3] if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, fold int, label double, good double, noise double, cat string")
    got = {r.features: r for r in evaluation.compare_sets(df, {"all": ["good", "noise"], "noise": ["noise"]}).collect()}
    assert got["all"].auc > 0.85 and got["noise"].verdict == "worse" and got["all"].sd >= 0
    retest = {r.features: r for r in evaluation.drop_and_retest(df, ["good", "noise"], ["good"]).collect()}
    assert retest["without"].verdict == "worse" and retest["alone"].auc > 0.8
    lab = {r.label: r.rate for r in evaluation.compare_labels(df.withColumn("other", (F.col("noise") > 3).cast("int")), ["label", "other"], ["good", "noise"]).collect()}
    assert lab["label"] == 0.5 and abs(lab["other"] - 126 / 300) < 0.01
    fit = models.fitted(df, ["good", "noise"], "logistic_l2", categories=["cat"])
    top = evaluation.importances(spark, fit, ["good", "noise"]).first()
    assert top.feature == "good"
    ranked = evaluation.rank_all(fit, models.prepared(df, ["good", "noise"], categories=["cat"]))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 301))
    steps = evaluation.progressive(spark.createDataFrame([(1, 0.6), (2, 0.7)], "o int, auc double"), "o", "o").collect()
    assert [round(r.gain, 3) for r in steps] == [0.1, 0.1]
    best = evaluation.best_of(spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", None)], "m string, auc double"), "m").first()
    assert best.m == "a"
    gap = evaluation.follow_on_gap(spark.createDataFrame([(1, 10), (1, 50), (0, 5), (1, None)], "y int, m int"), "y", "m").first()
    assert (gap.dated, gap.median_months, gap.share_within) == (2, 30.0, 0.5)


def test_imputation_by_name(spark):
    df = spark.createDataFrame([(None, None, None, "nan"), (2, 4.0, None, "x"), (4, 8.0, None, None)], "gdelt_mentions int, age double, none double, c string")
    got = features.impute_by_name(df, ["gdelt_mentions", "age", "none"]).orderBy("age").collect()
    assert got[0].gdelt_mentions in (0, 2) and sorted(r.age for r in got) == [4.0, 6.0, 8.0] and all(r.none == 0 for r in got)
    assert [r.m for r in df.select(features.missing_category("c").alias("m")).collect()] == ["MISSING", "x", "MISSING"]
    assert R.select_features(df, [R.FeatureSpec("age", "x")]).columns == ["age"]


def test_quarantine_and_verifiers(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    kept, vetoed = incremental.quarantine(df, {"known": F.col("v").isNotNull(), "positive": F.col("v") > 0})
    assert [r.k for r in kept.collect()] == [1] and sorted((r.k, r.veto) for r in vetoed.collect()) == [(2, "known"), (3, "positive")]
    assert len(R.VERIFIER_DEFAULTS) == 10
    x = spark.createDataFrame([("a", "b")], "c string, e string")
    assert R.verify(x, "wikipedia", "c", "e").first().accepted is False and R.verify(x, "packages", "c", "e").first().accepted is True


def test_stream_clusters_equal_batch(spark, tmp_path):
    from tidemark.operators.sequences import anchored_clusters
    from tidemark.streaming.windows import stream_clusters

    rows = [("a", f"2020-01-{d:02}") for d in (1, 5, 20)] + [("a", "2020-06-01"), ("a", "2020-06-01"), ("b", "2020-03-01"), (None, "2020-01-01")]
    schema = "e string, d string"
    for i in range(2):  # in order of days, over two triggers
        part = [r for r in rows if (r[1] >= "2020-02") == bool(i)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_clusters(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "e", "d").writeStream.format("parquet")
        q = q.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted((r.entity, r.day, r.cluster_start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = anchored_clusters(spark.createDataFrame(rows, schema).where("e IS NOT NULL").withColumn("d", F.to_date("d")), "e", "d")
    assert got == sorted((r.e, r.d, r.cluster_start) for r in batch.collect())
