from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import filings, issuers, labels, matching

D = date(2018, 1, 1)
EVENT = "cik string, accession string, event_date date, amount double, sold double, offered double, security string"


def ev(cik, days, amount, security="Equity"):
    return (cik, f"{cik}-{days}", D + timedelta(days=days), float(amount), float(amount), float(amount), security)


def test_security_class(spark):
    rows = [("Convertible Note", None, "Debt"), ("SAFE", None, "Convertible"), ("Preferred shares", None, "Equity"), ("Mineral rights", None, "Other"), (" ", "true", "Equity"), (None, "no", "Unknown")]
    df = spark.createDataFrame(rows, "t string, e string, want string")
    got = df.select(filings.security_class("t", "e", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"), "want")
    assert all(r.c == r.want for r in got.collect())


def test_anchor_and_later_round(spark):
    e = spark.createDataFrame([ev("1", 0, 3e6), ev("1", 30, 1e6, "Debt"), ev("1", 500, 9e6), ev("1", 520, 2e6), ev("1", 1300, 3e7), ev("2", 0, 1e5), ev("3", 0, 2e8), ev("3", 10, 0)], EVENT)
    who = spark.createDataFrame([("1", date(2017, 1, 1), "SAAS"), ("2", None, "SAAS"), ("3", date(2008, 1, 1), "BIO")], "cik string, founded date, sector string")
    picked = filings.anchor_features(filings.pick_anchor(filings.rounds(e).join(who, "cik")))
    got = {r.cik: r for r in picked.collect()}
    assert set(got) == {"1"} and got["1"].start == D + timedelta(days=500) and got["1"].n == 2 and got["1"].quarter == "2019Q2" and got["1"].age_flag == "OK"
    later = filings.pick_later(e, picked.join(who.select("cik", "sector"), "cik").select("cik", "start", "sector")).first()
    assert (later.later_start, later.later_amount) == (D + timedelta(days=1300), 3e7)
    assert filings.raised_before(e, picked).first().raised == 4e6
    assert filings.describe_events(e, most=2).where("cik = '1'").first().summary == "2018-01-01 Equity $3.00M; 2018-01-31 Debt $1.00M (+3 more)"
    assert filings.pick_anchor(filings.rounds(e.where("false")).join(who, "cik")).count() == 0


def test_gates(spark):
    df = spark.createDataFrame([(D, "ok", "MED"), (D, " suspect", "MED"), (D, None, None), (None, "ok", "MED"), (D, "ok", "low")], "a date, age_flag string, confidence string")
    assert filings.gate_anchors(df, "a").count() == 2
    assert filings.horizon(df, "a", "2017-12-31").count() == 1
    assert filings.horizon_if(df, F.col("confidence") == "MED", F.col("a"), "2017-12-31").count() == 3
    b = spark.createDataFrame([(D, D - timedelta(1), 5), (D, D, 6), (D, None, None)], "a date, b date, v int")
    assert sorted((r.v or 0, r.note or "") for r in filings.invalidate_before(b, "b", "a", "v").collect()) == [(0, ""), (0, "error_later_before_anchor"), (6, "")]


def test_labels(spark):
    cols = "id int, anchor date, amount double, lt string, et string, ld date, la double, ea double, te double, src string"
    far, near = D + timedelta(days=400), D + timedelta(days=100)
    rows = [
        (1, D, 5e6, "Series B", None, far, None, None, None, None), (2, D, 5e6, "Venture - Series Unknown", "Series C", near, 9e6, 9e6, 9e6, None),
        (3, D, 5e6, "Venture - Series Unknown", "Venture - Series Unknown", far, 16e6, 16e6, 1e6, None), (4, D, 5e6, "Seed", "Seed", far, 1.0, 1.0, 11e6, None),
        (5, D, 5e6, "Seed", "Seed", near, 1.0, 1.0, 11e6, "formd"), (6, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.id: r for r in labels.with_labels(spark.createDataFrame(rows, cols), "anchor", "amount", "lt", "et", "ld", "la", "ea", "te", "src").collect()}
    assert [got[k].label_audit for k in range(1, 7)] == [1, 0, 1, 0, 0, 0] and [got[k].label_primary for k in range(1, 7)] == [0, 1, 1, 1, 1, 0]
    assert (got[3].confidence, got[1].months_to, got[4].by_equity, got[5].by_filing, got[4].label_legacy, got[5].label_strict) == ("HIGH", 13, 1, 1, 1, 1)


def test_best_issuer(spark):
    c = spark.createDataFrame([(1, "Acme Robotics Inc", "Rome", "Ohio", "10001", "Ann Lee, Bo Xu"), (2, "Solo", "Rome", "", "", "Cy Day"), (3, "Big Acme", "Bari", "", "", None), (4, None, None, None, None, None)], "org_id int, name string, city string, state string, postal string, founders string")
    i = spark.createDataFrame([(1, "c1", "ACME ROBOTICS", "Oslo", "", ""), (2, "c2", "Acme Robotics LLC", "Rome", "OH", "10001-7"), (3, "c3", "Solo Corp", "Pisa", "", ""), (4, "c4", "Big Acme Foods", "Bari", "", ""), (5, None, "Solo", "", "", "")], "row int, cik string, name string, city string, state string, postal string")
    p = spark.createDataFrame([("c1", "LEE"), ("c1", "Xu, Jr."), ("c2", "Lee PhD"), ("c3", "NIGHT"), (None, "LEE")], "cik string, surname string")
    got = {r.org_id: r for r in issuers.best_issuer(c, i, p).collect()}
    assert (got[1].cik, got[1].overlap, got[1].ratio) == ("c1", 2, 1.0) and got[2].cik is None and got[3].cik is None and 4 not in got


def test_containing_names_lose_nothing(spark):
    import itertools
    import random

    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 7))).strip() or "a" for _ in range(60)})
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {(r.i, r.j) for r in matching.containing_names(df, df.withColumnsRenamed({"i": "j", "n": "m"}), "n", "m").collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2) if a in b or b in a}


def test_containing_names_never_broadcasts_grams(spark, tmp_path):
    """Exploded grams are estimated far below their size: on the driver they would fill its memory. Long names are as whole as short ones."""
    import itertools
    import random
    import re

    rnd = random.Random(4)
    names = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 14))) for _ in range(120)]
    names = sorted({*names, "", "abcdef", "xabcdefy", "abcde", "\U0001f600bcdef", "x\U0001f600bcdef"})
    spark.createDataFrame([*enumerate(names), (-1, None)], "i int, n string").write.parquet(f"{tmp_path}/n")
    df = spark.read.parquet(f"{tmp_path}/n")  # a file has a size to estimate from
    pairs = matching.containing_names(df, df.withColumnsRenamed({"i": "j", "n": "m"}), "n", "m")
    joins = re.findall(r"(\w+Join) \[g#\d+\], \[g#\d+\], (\w+)", pairs._jdf.queryExecution().sparkPlan().toString())
    assert joins and {how for kind, how in joins if kind == "BroadcastHashJoin"} <= {"LeftSemi"}
    got = {(r.i, r.j) for r in pairs.collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.product(enumerate(names), repeat=2) if a == b or (a and b and (a in b or b in a))}
    assert {(i, j) for i, j in got if names[i] and names[j]} == {(i, j) for i, j in want if names[i] and names[j]}
