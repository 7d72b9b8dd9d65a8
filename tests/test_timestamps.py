import itertools
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import timestamps as TS
from tidemark.operators.timestamps import normalise_timestamps

CASES = [
    ("us", "2019-03-05", "2019-03-05"), ("us", " 2019/3/5\t", "2019-03-05"), ("us", "20190305", "2019-03-05"), ("us", "3/5/2019", "2019-03-05"),
    ("de", "3/5/2019", "2019-05-03"), ("us", "13/5/2019", None), ("de", "13.5.19", "2019-05-13"), ("us", "Mar 5, 2019", "2019-03-05"),
    ("us", "5-MAR-2019", "2019-03-05"), ("de", "5. März 2019", "2019-03-05"), ("de", "5 de mayo de 2019", "2019-05-05"), ("us", "1er août 2019", "2019-08-01"),
    ("us", "2019-02-30", None), ("us", "2019-02", None), ("us", "2019", None), ("us", "Q4 2019", None), ("us", "TBD", None), ("us", "NaT", None), ("us", None, None), ("us", "", None),
    ("us", "2019-03-05T10:11:12Z", "2019-03-05T10:11:12Z"), ("us", "2019-03-05T10:11:12.999+05:30", "2019-03-05T04:41:12Z"),
    ("us", "2019-01-05 10:11:12", "2019-01-05T15:11:12Z"), ("us", "2019-07-05 10:11", "2019-07-05T14:11:00Z"),
    ("us", "2019-07-05 10:11:12 EST", "2019-07-05T15:11:12Z"), ("de", "2019-07-05T10:11:12[America/New_York]", "2019-07-05T14:11:12Z"),
    ("de", "2019-07-05T10:11:12 America/Chicago", "2019-07-05T15:11:12Z"),
    ("us", "Jul 5, 2019 1:05 AM PDT", "2019-07-05T08:05:00Z"), ("us", "7/5/2019 12:30 PM", "2019-07-05T16:30:00Z"), ("us", "7/5/2019 13:30 PM", None),
    ("us", "Sat, 28 Mar 2020 19:03:37 -0400", "2020-03-28T23:03:37Z"), ("us", "1622571031", "2021-06-01T18:10:31Z"), ("us", "1445803999169", "2015-10-25T20:13:19Z"),
    ("us", "20180710214314", "2018-07-11T01:43:14Z"), ("us", "2016-11-06T01:07", None), ("us", "2021-03-14T02:08", None), ("de", "2019-10-27T02:26:52", None),
    ("us", "2016-11-06T01:07-04:00", "2016-11-06T05:07:00Z"), ("none", "3/5/2019", None), ("none", "5/5/2019", "2019-05-05"), ("none", "2019-03-05 10:00", None), ("us", "x" * 40_000, None),
]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("us", "America/New_York", "MDY", 1), ("de", "Europe/Berlin", "DMY", 2)], "feed string, zone string, date_order string, value int")


def test_values(spark, feeds):
    rows = [(i, f, v, "clash") for i, (f, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id bigint, feed string, v string, norm string")
    got = {r.row_id: r.norm for r in normalise_timestamps(df, {"v": "v"}, "id", feeds).where("fixed").collect()}
    assert {i: c[2] for i, c in enumerate(CASES) if c[2]} == got


def test_empty_and_repeated(spark, feeds):
    df = spark.createDataFrame([], "id bigint, feed string, v string")
    assert normalise_timestamps(df, {"v": "v"}, "id", feeds).count() == 0
    twice = spark.createDataFrame([(1, "us", "2019-01-02"), (1, "us", "2019-01-02"), (None, "us", "2019-01-02"), (2, None, "2019-01-02")], df.schema)
    assert sorted(r.row_id for r in normalise_timestamps(twice, {"v": "v"}, "id", feeds).collect()) == [1, 1, 2]


def test_blocks_equal_brute_force():
    """Joined blocks give the cost of the best path through each reading, but for a constant per record."""
    rnd = random.Random(4)
    for _ in range(30):
        seqs = [[{"norm": str(k), "t": rnd.randrange(10**9), "fmt": rnd.choice("ab"), "cost": float(rnd.randrange(3))} for k in range(rnd.randint(1, 3))] for _ in range(7)]
        one = [x[0] if len(x) == 1 else None for x in seqs]
        pdf = pd.DataFrame({"source": 1, "block": [i // 3 for i in range(7)], "seq": [f"{i:02}" for i in range(7)], "rid": range(7),
                            "cands": [None if o else x for o, x in zip(one, seqs)], "t": [x[0]["t"] for x in seqs], "fmt": [x[0]["fmt"] for x in seqs]})
        blocks = pd.concat([TS.block_costs(g) for _, g in pdf.groupby("block")], ignore_index=True)
        blocks["chain"] = blocks["block"] // 2
        chains = TS.join_blocks(pd.concat([TS.merge_blocks(g) for _, g in blocks.groupby("chain")]))
        sides = blocks.merge(chains.rename(columns={"block": "chain"})[["chain", "before", "after"]], on="chain")
        ends = pd.concat([TS.join_blocks(g) for _, g in sides.groupby("chain")])
        got = pd.concat([TS.trace_block(g.merge(ends, on=["source", "block"])) for _, g in pdf.groupby("block")]).set_index("rid")

        def cost(path):
            return sum(c["cost"] for c in path) + sum(TS.moves([a], [b])[0, 0] for a, b in zip(path, path[1:]))

        for k, x in enumerate(seqs):
            if len(x) > 1:
                through = [min(cost(p) for p in itertools.product(*seqs[:k], [c], *seqs[k + 1 :])) for c in x]
                best = int(np.argmin(through))
                assert got.at[k, "margin"] == pytest.approx(min(v for i, v in enumerate(through) if i != best) - through[best])
                assert through[int(got.at[k, "norm"])] == pytest.approx(through[best])


def test_record_order_settles_what_nobody_declared(spark, feeds):
    """Without the path these rows would stay open: the records around them show their source's order."""
    dmy = ["14/5/2019", "15/5/2019", "6/5/2019", "17/5/2019", "18/5/2019"]
    mdy = ["5/14/2019", "5/15/2019", "5/6/2019", "5/17/2019", "5/18/2019"]
    rows = [(i, "dmy", v) for i, v in enumerate(dmy)] + [(10 + i, "mdy", v) for i, v in enumerate(mdy)] + [(20, "alone", "6/5/2019"), (30, "us", "6/5/2019")]
    df = spark.createDataFrame(rows + [(40 + i, "us", v) for i, v in enumerate(dmy)], "id bigint, feed string, v string")
    got = {r.row_id: r.norm for r in normalise_timestamps(df, {"v": "v"}, "id", feeds).where("fixed").collect()}
    assert got[2] == "2019-05-06" and got[12] == "2019-05-06" and 20 not in got
    assert got[30] == "2019-06-05" and got[42] == "2019-06-05" and 41 not in got  # a declared order holds against the records around
