from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as M
from tidemark.operators import pages, signals

A = date(2020, 6, 1)
COHORT = "org int, name string, domain string, industries string, sector string, founded date, anchor date, name_distinctive int"


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.createDataFrame(
        [
            (1, "Acme Robotics", "acme.example", "Medical", "HARD", date(2016, 1, 1), A, 1), (2, "Zed", "zed.example", "SaaS", "SAAS", date(2019, 1, 1), A, 0),
            (3, "Old News Inc", None, None, None, None, date(2016, 1, 1), None), (4, None, "", "pharma", "BIO", None, None, 1),
        ],
        COHORT,
    )


def rows(df, key="org"):
    return {r[key]: r for r in df.collect()}


def test_papers_and_second_papers(spark, cohort):
    inst = spark.createDataFrame([("I1", "https://www.acme.example/x"), ("I2", "http://acme.example"), ("I3", None)], "institution string, homepage string")
    works = spark.createDataFrame([("I1", date(2019, 1, 1)), ("I1", A), ("I1", date(2021, 1, 1)), ("I1", None), ("I2", A)], "institution string, day date")
    got = rows(signals.papers_signal(cohort, inst, works, "org"))
    assert (got[1].works, got[1].has_works, got[2].note, got[4].works) == (2, 1, "no_institution", 0)
    papers = spark.createDataFrame([(1, 2019, 5, None), (1, 2020, None, None), (1, 2021, 9, None), (2, 2018, 1, None), (3, 2010, 20_000, None)], "org int, year int, citations int, verified boolean")
    got = rows(signals.second_papers_signal(cohort, papers, "org"))
    assert (got[1].papers, got[1].citations, got[2].note, got[3].note) == (2, 5, "skipped_short_single_word", "rejected")


def test_trials_compare_dates_as_text(spark, cohort):
    t = spark.createDataFrame(
        [("t1", "Acme Robotics Holdings", "2020-05", ["PHASE1", "PHASE2"], None), ("t2", "The Acme Robotics Group", "2019-01-01", ["PHASE3"], None), ("t3", "ACME Robotics, Inc", "2020-07", ["PHASE4"], None), ("t4", "acme robotics", None, None, None), ("t5", None, "2019", None, True)],
        "trial string, sponsor string, start string, phases array<string>, verified boolean",
    )
    got = rows(signals.trials_signal(cohort, t, "org"))
    assert (got[1].trials, got[1].least_phase, got[1].greatest_phase) == (1, 1.0, 2.0) and got[2].note == "skipped_non_medical" and got[4].trials == 0


def test_launches_of_siblings(spark, cohort):
    p = spark.createDataFrame(
        [("https://x.example/posts/acme-robotics-3", date(2020, 1, 1), True, True), ("https://x.example/products/acme-robotics", date(2020, 2, 1), None, True), ("https://x.example/posts/acme-robotics", date(2019, 1, 1), True, False), ("https://x.example/posts/acme-robotics-2", date(2021, 1, 1), True, True), (None, A, True, True)],
        "url string, day date, featured boolean, verified boolean",
    )
    got = rows(signals.launch_signal(cohort, p, "org"))
    assert (got[1].launches, got[1].first_launch, got[1].featured, got[2].launches) == (2, date(2020, 1, 1), 1, 0)


def test_patents(spark, cohort):
    g = spark.createDataFrame(
        [("p1", "ACME ROBOTICS INC", date(2018, 1, 1), "b"), ("p2", "Acme Robotics, LLC", date(2019, 1, 1), "a"), ("p2", "ACME ROBOTICS INC", date(2019, 1, 1), "a"), ("p3", "ACME ROBOTICS", date(2001, 1, 1), "c"), ("p4", "ACME ROBOTICSX", date(2018, 1, 1), "d"), ("p5", "ACME ROBOTICS INC", date(2021, 1, 1), "e"), ("p6", None, None, None)],
        "publication string, assignee string, filed date, title string",
    )
    got = rows(signals.patent_signal(cohort, g, "org"))
    assert (got[1].patents, got[1].first_day, got[1].assignees, got[1].titles) == (3, date(2018, 1, 1), "ACME ROBOTICS INC | ACME ROBOTICS, LLC", ["a", "b"])
    assert got[2].note == "none" and got[4].patents == 0
    one = spark.createDataFrame([(1, "acme robotics, llc")], "org int, assignee string")
    assert rows(signals.patent_signal(cohort, g, "org", one))[1].patents == 1
    assert signals.patent_signal(cohort, g.where("false"), "org").count() == 4


def test_alumni_priorities(spark, cohort):
    a = spark.createDataFrame(
        [("s1", "acme.example", "Other", None, "Winter 2018", None), ("s2", "x.example", "Zed", ["Y"], "S19", None), ("s3", "y.example", "Zed, Inc", None, "S19", None), ("s4", "z.example", "Q", ["Old News"], "Winter 2009", None)],
        "slug string, domain string, name string, former array<string>, batch string, verified boolean",
    )
    got = rows(signals.alumni_signal(cohort, a, "org"))
    assert (got[1].alumnus, got[1].how, got[1].months) == (1, "domain", 29.0)
    assert got[2].alumnus == 0 and (got[3].how, got[3].note) == ("former", "found") and got[4].note == "none"


def test_gates_and_news(spark, cohort):
    m = spark.createDataFrame([(1, A), (1, date(2020, 5, 31)), (1, date(2020, 3, 3)), (1, date(2020, 3, 2)), (1, date(2019, 6, 1)), (2, date(2020, 5, 1)), (3, date(2015, 6, 1)), (None, A)], "org int, day date")
    got = rows(signals.news_signal(cohort, m, "org", "day"))
    assert (got[1].n_12m, got[1].n_3m, got[1].has_press) == (3, 2, 1)
    assert [got[k].note for k in (2, 3, 4)] == ["skipped_non_distinctive", "before_coverage", "no_name"]
    assert rows(signals.news_signal(cohort, m, "org", "day", cap=3))[1].note == "noise_cap"


def test_registered_signals_merge(spark, cohort):
    signals.register_signal("unit", lambda c, t: t["unit"], {"unit": 7})
    try:
        got = rows(signals.run_signals(cohort.select("org"), {"unit": spark.createDataFrame([(1, 2), (1, 3), (2, None)], "org int, unit int")}, ["unit"], "org"))
    finally:
        del signals._SIGNALS["unit"]
    assert {k: r.unit for k, r in got.items()} == {1: 3, 2: 7, 3: 7, 4: 7}


def test_classifier_answers(spark):
    r = spark.createDataFrame([(1, '```json\n{"deeptech_score": 14, "startup_sector": "Space", "name_distinctive": 0}\n```'), (2, "no idea"), (3, None), (4, 'x {"startup_sector": "devtools"} y')], "org int, text string")
    got = rows(signals.classify_responses(r, "org", "text"))
    assert (got[1].score, got[1].sector, got[1].name_distinctive) == (10, "other", 0)
    assert [got[k].note for k in (2, 3)] == ["json_parse_error"] * 2 and (got[4].sector, got[4].score) == ("devtools", 0)


def test_pages(spark):
    c = spark.createDataFrame([("a", "20200101000000", "http://a.example/team/", "text/html"), ("a", "20200301000000", "http://a.example/about", "image/png"), ("a", "20210101000000", "http://a.example/about", "text/html"), ("b", "bad", None, None)], "k string, t string, url string, mime string")
    c = c.withColumn("ts", pages.from_stamp("t"))
    anchors = spark.createDataFrame([("a", datetime(2020, 6, 1)), ("b", None)], "k string, anchor timestamp")
    got = pages.latest_capture(anchors, c, "k", "anchor", "ts", "url", "mime").collect()
    assert [(r.k, r.url) for r in got] == [("a", "http://a.example/team/")]
    per = pages.latest_per_path(c.where("k = 'a'"), "k", "ts", "url")
    assert per.count() == 2 and pages.first_of(per, "k").first().path == "/about"
    t = spark.createDataFrame([("x" * 50 + " Series A " + "y" * 50,), (None,), ("",)], "t string")
    assert [r.s and len(r.s) for r in t.select(pages.snippets("t", "series a", 10).alias("s")).collect()] == [28, None, None]
    both = t.select(pages.combine({"About": F.lit(" we "), "Home": F.lit(None).cast("string")}, F.lit("Ann")).alias("c")).first().c
    assert both == "[About]\nwe\n\nFounders: Ann"
    assert t.select(pages.names_in(F.lit("by ANN Lee"), F.array(F.lit("ann"), F.lit("bob"))).alias("n")).first().n


def test_names(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    s = F.lit
    assert one(M.patent_name(s("Acme Foo, Inc."))) == "ACME FOO," and one(M.alumni_name(s("The Acme-Foo Co."))) == "acmefoo"
    assert one(M.registrable_domain(s("https://www.a.b.co.uk/x?y"))) == "b.co.uk" and one(M.domain_slug(s("http://www.big-co.io/p"))) == "bigco" and one(M.domain_label(s("http://www.x.io"))) == "www"
    assert one(M.core_word_count(s("Acme AI Labs"))) == 1 and one(M.core_word_count(s(""))) == 1 and one(M.core_word_count(s("Happiest Baby"))) == 2
    assert one(M.has_word(s("Big Robotics"), M.TECH_WORDS)) == 1 and one(M.has_word(s("Bigrobotics"), M.TECH_WORDS)) == 0
    assert one(M.surname_clean(s("o'Neil Jr., PhD"))) == "O'NEIL" and one(M.surname_clean(s("SMITH MD"))) == "SMITH"
    assert one(M.founder_cell(s("Ann Lee; Bo  Xu, ann lee,x"))) == ["ann lee", "bo xu"]
    assert one(M.founder_in_name(s("Miller Labs Inc"), s("Ann Miller"))) == 1 and one(M.founder_in_name(s("Millers"), s("Ann Miller"))) == 0
    assert [one(M.usd_text(s(float(v)))) for v in (2.5e9, 1.25e6, 30_400, 7, 0)] == ["$2.50B", "$1.25M", "$30k", "$7", ""]
    got = one(M.founder_signals(s("Our founder, Dr Lee, PhD, sold two firms"), ["founder"], ["phd"], ["serial"], ["sold"]))
    assert (got.named, got.doctorate, got.serial, got.exits) == (1, 1, 0, 1)
