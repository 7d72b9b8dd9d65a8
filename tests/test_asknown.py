import random
from datetime import datetime, timedelta

from tidemark.operators.asknown import as_known_at

T0 = datetime(2020, 1, 1)
SCHEMA = "obs bigint, k bigint, value string, valid_from timestamp, known_at timestamp, known_value string"


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    when = lambda: T0 + timedelta(hours=rnd.randrange(0, 24 * 200, 7))
    hist = [(i, 1 if rnd.random() < 0.4 else rnd.randrange(5), rnd.choice([None, "a", "b", "c"]), when(), when(), "x") for i in range(400)]
    hist += hist[:20] + [(900, None, "z", T0, T0, "x"), (901, 1, "z", None, T0, "x"), (902, 1, "z", T0, None, "x")]
    ev = [(i, rnd.choice([0, 1, 1, 2, 9, None]), None if i % 17 == 0 else when(), "old") for i in range(150)]
    ev += ev[:3]
    got = as_known_at(spark.createDataFrame(ev, "id bigint, k bigint, at timestamp, known_value string"), spark.createDataFrame(hist, SCHEMA), ["k"], "at", tie="obs")
    assert got.columns.count("known_value") == 1

    def known(k, at):
        ok = [h for h in hist if at and k is not None and h[1] == k and h[3] and h[4] and h[3] <= at and h[4] <= at]
        return max(ok, key=lambda h: (h[3], h[4], h[0]))[2] if ok else None

    assert sorted((r.id, r.known_value or "") for r in got.collect()) == sorted((e[0], known(e[1], e[2]) or "") for e in ev)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    ev = spark.createDataFrame([(1, 1, T0)], "id bigint, k bigint, at timestamp")
    assert as_known_at(ev, none, ["k"], "at").collect()[0].known_value is None
    assert as_known_at(ev.where("false"), none, ["k"], "at").count() == 0
