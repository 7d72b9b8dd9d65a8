import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexicon, linkage, names, variants

LEX = names.Lexicon(("capitaltools", "logistics", "payments"), {"capitaltools": "capitaltools", "captls": "capitaltools", "logistics": "logistics", "payments": "payments"})


def _many_names(spark, lines=("Labs", "Cloud", "Energy", "Capital Tools"), n=100):
    """Firms of several lines of business, some written twice, the second time shortened."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)).title()
    short = {"Labs": "Laboratories", "Cloud": "Cld", "Energy": "NRG", "Capital Tools": "Cap Tls"}
    rows = []
    for line in lines:
        for i in range(n):
            x = f"{word()} {word()}"
            rows += [f"{x} {line}", *([f"{x} {short[line]}, Inc."] if i % 34 == 0 else []), *([x] if i % 9 == 0 else [])]
    return spark.createDataFrame([(r,) for r in rows + [None, "", "Solo"]], "name string")


def test_lines_of_business_are_learnt(spark):
    got = lexicon.learn(_many_names(spark))
    assert set(got.lines) == {"labs", "cloud", "energy", "capitaltools"}
    want = {"laboratories": "labs", "cld": "cloud", "nrg": "energy", "captls": "capitaltools"}
    assert {k: v for k, v in got.forms.items() if k not in got.lines} == want
    assert names.org_form("Kodu Tibika NRG", got) == names.org_form("TIBIKA ENERGY, KODU LLC", got)
    assert lexicon.learn(_many_names(spark).where("false")) == names.NO_LINES


def test_forms():
    a = names.org_form("KODU TIBIKA CAP. TLS CO", LEX)
    for other in ("Tibika Kodu Capital Tools Llc", "The Kodu Tibika Capital Tools Company", "TIBIKA CAPITAL TOOLS, KODU INC [US]", "Capital Tools by Kodu Tibika", "kodu-tibika (Capital Tools)"):
        assert names.org_form(other, LEX) == a
    assert names.org_form("Kodu Tibika Logistics", LEX) != a and names.org_form(None, LEX) is None
    same = [("Bob Denugult", "Robert Denugult"), ("R Denugult", "Robert Denugult"), ("Gotilt Christopher", "Kit Gotilt"), ("- Náfilt, Guillermo", "Memo Nafilt"), ("Zachary Fubuck", "Zach Fubuck-Tufu"), ("Michael H. O'Nógeck", "MICHAEL O'NOGECK, PhD")]
    for x, y in same:
        assert names.person_agreement(names.person_form(x), names.person_form(y)) > 0.4, (x, y)
    for x, y in [("Bob Denugult", "Robert Kapult"), ("Susan Maris", "Omar Maris")]:
        assert names.person_agreement(names.person_form(x), names.person_form(y)) == 0


def test_edits():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(6))) for _ in "xy")
        assert (names.edits(a, b, 1) <= 1) == names.within_one(a, b)


def _upgma(ids, sims, least):
    """One merge at a time, the greatest average first."""
    groups = [{i} for i in ids]
    while True:
        best = max(((sum(sims.get((min(x, y), max(x, y)), 0) for x in a for y in b) / len(a) / len(b), -min(min(a), min(b)), -max(min(a), min(b)), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)), default=(0,))
        if best[0] < least:
            return {frozenset(g) for g in groups}
        i, j = best[3], best[4]
        groups[i] |= groups[j]
        del groups[j]


def test_average_linkage_equals_one_merge_at_a_time(spark):
    rnd = random.Random(11)
    sims = {(a, b): round(rnd.uniform(0.3, 1), 3) for a, b in itertools.combinations(range(14), 2) if rnd.random() < 0.35}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a bigint, b bigint, s double")
    got: dict = {}
    for r in variants.average_linkage(df, 0.5).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    ids = {x for p in sims for x in p}
    assert {frozenset(g) for g in got.values()} == _upgma(ids, sims, 0.5)
    assert variants.average_linkage(df.where("false")).count() == 0


def test_variants(spark):
    rows = [("org", "", n, "clash") for n in ("Kodu Tibika Labs", "KODU TIBIKA LABS INC", "Tibika Kodu Labs", "Kodu Tibka Labs LLC", "Kodu Tibika", "Kodu Tibika Labs", "Mena Sovali Labs", "Vuto Ranike Cloud", "Vuto Ranike Energy", "Vuto Ranike", None, "", "x" * 5000)]
    rows += [("who", "c1", n, "clash") for n in ("Bob Denugult", "Robert Denugult", "R Denugult", "Susan Maris", "N/A Foo Fund LP", None)] + [("who", "c2", "Robert Denugult", "clash")]
    df = spark.createDataFrame(rows, "field string, scope string, name string, cluster string")
    got = {frozenset((r.name_a, r.name_b)) for r in variants.pairs(variants.link_variants(df, F.col("field") == "who", _many_names(spark))).collect()}
    want = set()
    for g in (["Kodu Tibika Labs", "KODU TIBIKA LABS INC", "Tibika Kodu Labs", "Kodu Tibka Labs LLC", "Kodu Tibika"], ["Bob Denugult", "Robert Denugult", "R Denugult"]):
        want |= {frozenset(p) for p in itertools.combinations(g, 2)}
    assert got == want
    assert variants.link_variants(df.where("false"), F.lit(False)).count() == 0


def test_slips_are_all_found(spark):
    """Against every pair of cores by edit distance, where slips leave few grams or none in common."""
    rnd = random.Random(9)
    cores = ["puxarosafe", "pularoasfe", "mreodumaro", "merodmuaro"]
    for n in (3, 7, 8, 9, 10, 12, 22, 23, 24, 25, 26, 40, 90):
        for _ in range(6):
            base = "".join(rnd.choice("abdefgiklmnoprstuvxz") for _ in range(n))
            for _ in range(3):
                t = list(base)
                for _ in range(2):
                    i = rnd.randrange(len(t) - 1)
                    kind = rnd.randrange(4)
                    t[i : i + 2] = [[t[i + 1], t[i]], [t[i]], ["q", t[i + 1]], [t[i], "q", t[i + 1]]][kind]
                cores.append("".join(t))
            cores.append(base)
    cores = sorted(set(cores))
    df = spark.createDataFrame([(i, 1, "f", "o", t, variants.grams(t, 4)) for i, t in enumerate(cores)], "id bigint, space bigint, field string, kind string, text string, grams array<string>")
    got = {(r.a, r.b) for r in variants.similar(df).where(F.col("s") >= variants.LINK).collect()}
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(cores), 2):
        most = 2 if min(len(a), len(b)) >= 8 else 1
        if min(len(a), len(b)) >= 4 and names.edits(a, b, most) <= most:
            want.add((i, j))
    assert len(want) > 150 and want <= got
    assert {(cores[i], cores[j]) for i, j in want} >= {("pularoasfe", "puxarosafe"), ("merodmuaro", "mreodumaro")}


def test_pairs_of_hot_keys_in_cells(spark):
    df = spark.createDataFrame([("hot", i) for i in range(97)] + [("cold", 3), ("cold", 1), ("alone", 5), (None, 1), (None, 2)], "k string, id int")
    got = [tuple(r) for r in variants.self_pairs(df, ["k"], "id", cell=10).collect()]
    assert len(got) == len(set(got)) and set(got) == {("hot", i, j) for i in range(97) for j in range(i + 1, 97)} | {("cold", 1, 3)}


def test_no_pair_of_persons_at_or_above_low_is_lost(spark):
    """Against the cosine of every pair, computed here from the same weights."""
    import math

    rnd = random.Random(12)
    base = [f"{a} {b}" for a in ("maria", "robert", "yusuf", "chloe") for b in ("denugult", "kamenov", "oliveira", "tanaka")]
    texts = sorted({"".join(c if rnd.random() > 0.08 else rnd.choice("aeioubdk") for c in rnd.choice(base)) for _ in range(120)})
    rows = [(i, 1, "f", "p", t, variants.grams(t, 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, space bigint, field string, kind string, text string, grams array<string>")
    got = {(r.a, r.b) for r in variants.similar(df).collect()}
    count = {}
    for r in rows:
        for g in r[5]:
            count[g] = count.get(g, 0) + 1
    w = [{g: math.log(1 + len(rows) / count[g]) for g in r[5]} for r in rows]
    cos = lambda x, y: sum(v * y.get(g, 0) for g, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if cos(w[i], w[j]) >= variants.LOW + 1e-9 and names.person_agreement(tuple(texts[i].split()), tuple(texts[j].split())) > 0}
    assert len(want) > 50 and want == got


def test_em_recovers_classes():
    rnd = random.Random(4)
    rows = []
    for _ in range(4000):
        m = rnd.random() < 0.2
        rows.append(tuple(int(rnd.random() < (p if m else q)) for p, q in ((0.9, 0.05), (0.8, 0.1), (0.85, 0.02))) + (m,))
    p = pd.DataFrame(rows, columns=["a", "b", "c", "m"]).groupby(["a", "b", "c"]).agg(n=("m", "size"), true=("m", "mean")).reset_index()
    start = {k: {1: (0.7, 0.2), 0: (0.3, 0.8)} for k in "abc"}
    got = linkage.em(p, ["a", "b", "c"], start)
    assert ((got["posterior"] - p["true"]).abs() * p["n"]).sum() / p["n"].sum() < 0.02


def test_blocks_split_where_hot(spark):
    a = spark.createDataFrame([(i, "hot", str(i % 4)) for i in range(60)] + [(99, "cold", "z")], "ida int, key string, fine string")
    b = a.withColumnRenamed("ida", "idb")
    hot, linkage.HOT = linkage.HOT, 1000
    try:
        got = {tuple(r) for r in linkage.blocked(a, b).collect()}
    finally:
        linkage.HOT = hot
    assert got == {(i, j) for i in range(60) for j in range(60)} | {(99, 99)}


def test_short_names_have_keys(spark):
    """Names of any length meet their equals, and those of fewer than eight letters also what is one slip away."""
    rnd = random.Random(8)
    names_ = sorted({"".join(rnd.choice("abcde") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7) for _ in range(12)})
    df = spark.createDataFrame(list(enumerate(names_)), "id bigint, core string")
    got = {tuple(r) for r in linkage.blocked(linkage._keys(df, "id", "ida", "core"), linkage._keys(df, "id", "idb", "core")).collect()}
    want = {(i, j) for i, x in enumerate(names_) for j, y in enumerate(names_) if names.edits(x, y, 1) <= 1}
    assert want <= got and all((i, i) in got for i in range(len(names_)))
    assert linkage._keys(spark.createDataFrame([(1, None), (2, "")], "id bigint, core string"), "id", "ida", "core").count() == 0


def test_short_forms_of_several_names():
    assert set(linkage.person_keys("Ted Maris")) & set(linkage.person_keys("Theodore Maris")) and set(linkage.person_keys("Charlie Maris")) & set(linkage.person_keys("Charles Maris"))
    assert linkage.person_keys("Maris") == [] and linkage.person_keys("") == []


def test_hot_blocks_keep_every_pair(spark):
    a = spark.createDataFrame([(i, "hot") for i in range(60)] + [(1, "warm"), (99, "cold"), (98, None)], "ida int, key string")
    b = spark.createDataFrame([(i, "hot") for i in range(70)] + [(i, "warm") for i in range(100, 170)] + [(99, "cold"), (98, None)], "idb int, key string")
    hot, linkage.HOT = linkage.HOT, 50
    try:
        got = [tuple(r) for r in linkage.blocked(a, b).collect()]
    finally:
        linkage.HOT = hot
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(70)} | {(1, j) for j in range(100, 170)} | {(99, 99)}


def test_firms_in_hot_blocks_are_found(spark):
    """Rows without a postal code and assignees without a line keep their pairs where all keys are hot."""
    c = [(1, "Kodu Tibika Labs", None, "Rome, Ohio, United States", None, "Omar Maris", None)]
    i = [("0000000001", "acc1", "KODU TIBIKA LABS INC", "Rome", "OH", "10001", None), ("0000000001", "acc2", "KODU TIBIKA LABS INC", "Rome", "OH", "20001", None)]
    t = _tables(spark, (c, i, [("acc1", "Omar Maris")], [(7, "Kodu Tibika", None)]))
    hot, linkage.HOT = linkage.HOT, 0.5
    try:
        got = {(r.org_id, r.source, r.source_key) for r in linkage.link_organisations(*t, _many_names(spark)).collect()}
    finally:
        linkage.HOT = hot
    assert got == {(1, "issuers", "0000000001"), (1, "patent_assignees", "7")}


def _tables(spark, rows):
    c, i, p, a = rows
    return (
        spark.createDataFrame(c, "org_id bigint, name string, domain string, hq string, postal string, founders string, founded date").withColumn("subject", F.lit(None).cast("array<bigint>")),
        spark.createDataFrame(i, "cik string, accession string, name string, city string, state string, zip string, seen date"),
        spark.createDataFrame(p, "accession string, name string"), spark.createDataFrame(a, "row bigint, name string, filed date").withColumn("subject", F.lit(None).cast("array<bigint>")),
    )


def test_organisations(spark):
    rnd = random.Random(6)
    syl = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda n: "".join(rnd.choice(syl) for _ in range(n)).title()
    c, i, p, a, want = [], [], [], [], set()
    for k in range(150):
        x, y, line = word(2), word(3), rnd.choice(["Labs", "Energy", "Cloud", "Genomics"])
        who = [f"{rnd.choice(['Robert', 'Susan', 'Omar'])} {word(3)}" for _ in range(2)]
        zip_, cik = f"{10000 + k}", f"{k:010}"
        trade = (word(2), word(3)) if k % 10 == 0 else (x, y)
        c.append((k, f"{trade[0]} {trade[1]} {line}", None if k % 3 else f"{x}{y}.example".lower(), f"Town{k}, Ohio, United States", zip_, ", ".join(who).replace("Robert", "Bob"), pd.Timestamp("2012-01-01").date()))
        i.append((cik, f"acc{k}", f"{x} {y} {line}, Inc.".upper(), f"Town{k}", "OH", zip_, pd.Timestamp("2013-05-01").date()))
        p += [(f"acc{k}", w) for w in who]
        a += [(k, f"{y.upper()} {line.upper()}, {x.upper()} LLC", pd.Timestamp("2015-01-01").date()), (1000 + k, f"{x} {y} Aerospace", None)]
        want |= {(k, "issuers", cik), (k, "patent_assignees", str(k))}
    c += [(900, None, None, None, None, None, None), (901, "", "", "", "", "", None)]
    i += [(None, "acc1", "Nobody Inc", None, None, None, None), ("0000000999", None, None, None, None, None, None), i[0]]
    a += [(2000, None, None), (2001, "z" * 9000, None)]
    t = _tables(spark, (c, i, p + [(None, "x y"), ("acc1", None)], a))
    got = {(r.org_id, r.source, r.source_key) for r in linkage.link_organisations(*t).where(F.col("confidence") >= linkage.ACCEPT).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    assert linkage.link_organisations(*[x.where("false") for x in t]).count() == 0


@pytest.mark.parametrize("d,want", [("getsamipevoke.example", ("samipevoke", "")), ("vifa-hq.example", ("vifa", "")), ("situpakipupayments.example", ("situpakipu", "payments")), (None, ("", ""))])
def test_domains(d, want):
    assert linkage.domain_form(d, LEX) == want


def test_chance_pairs_are_counted_and_not_written(spark):
    """Names that share but an end are compared and counted; only pairs with evidence are written, in rounds, and no result changes."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(1)
    names = ["".join(rnd.choice("bcdfghjklmnprstvwz") for _ in range(5)) + "nikelo" for _ in range(70)]
    name = names.__getitem__
    c = spark.createDataFrame([(i, name(i), None, None, None, None, None, None) for i in range(40)], "org_id bigint, name string, domain string, hq string, postal string, founders string, founded date, subject array<bigint>")
    i = spark.createDataFrame([(f"{k:010d}", f"A{k}", name(k), None, None, None, None) for k in range(20, 60)], "cik string, accession string, name string, city string, state string, zip string, seen date")
    p = spark.createDataFrame([], "accession string, name string")
    a = spark.createDataFrame([(k, name(k), None, None) for k in range(30, 70)], "row bigint, name string, filed date, subject array<bigint>")
    compared = linkage.link_organisations(c, i, p, a)
    written, made, few, append = [], [], linkage.ROUND, linkage.materialize_rounds

    def spy(s, step, n, called="step"):
        out = append(s, step, n, called)
        made.append(n)
        written.append((out.count(), out.agg(F.sum("n")).first()[0]))
        return out

    linkage.ROUND, linkage.materialize_rounds = 800, spy
    try:
        got = linkage.link_organisations(c, i, p, a, least=linkage.ACCEPT)
        got = {tuple(r)[:3]: round(r.confidence, 9) for r in got.where(F.col("confidence") >= linkage.ACCEPT).collect()}
    finally:
        linkage.ROUND, linkage.materialize_rounds = few, append
    assert all(n > 1 for n in made) and all(4 * rows < pairs for rows, pairs in written) and len(written) >= 2
    want = {tuple(r)[:3]: round(r.confidence, 9) for r in compared.where(F.col("confidence") >= linkage.ACCEPT).collect()}
    assert got == want and compared.count() >= 1600
