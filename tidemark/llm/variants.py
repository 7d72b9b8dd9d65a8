"""Spellings of one name: joins that miss no pair of like forms, grouped by average linkage.

Names become normal forms (see names.py); equal forms are one node, however many spellings and rows they
have. A node's vector holds its form's character n-grams, weighted by inverse document frequency. Two
persons of a scope whose cosine reaches LOW must share a gram among the rarest ones of both, those before
which the rest of the vector is shorter than LOW (grams ordered by frequency); only those are joined on,
so no pair at or above LOW is missed and no partner list is capped. Slips leave two organisations' cores
few grams or none in common, so these are joined on what a pair within EDITS edits always shares (see
slip_keys), and the cosine only adds to their score. The candidates' cosines are computed from the whole
vectors, and only pairs of persons whose cosine reaches LOW are compared further. Links are grouped by average linkage, absent pairs counting 0, in rounds that merge all mutually
nearest clusters at once; average linkage is reducible, so the result is that of merging one pair at a
time. No group is ever collected, and pairs of a hot gram or of a large cluster are made in cells (see self_pairs).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.lexicon import learn
from tidemark.llm.names import Lexicon, edits, is_org, org_form, person_agreement, person_form
from tidemark.session import discard, materialize, ship

ship(sys.modules[__name__])

LOW, LINK, ORG_GRAM, PERSON_GRAM = 0.25, 0.5, 4, 3
#: Most edits of organisations' cores, from how many letters on; cores below SHORT letters need LOW too; above LONG they are cut into segments.
EDITS, TWICE, SHORT, LONG = 2, 8, 4, 24
#: Rows of one key that are paired in one group.
CELL = 2000
FORM = "field string, scope string, name string, kind string, line string, text string, grams array<string>"


def grams(text: str, n: int) -> list[str]:
    """Distinct n-grams of each marked word; words shorter than n count whole."""
    out = []
    for w in text.split():
        m = f"^{w}$"
        out += [m[i : i + n] for i in range(max(1, len(m) - n + 1))]
    return list(dict.fromkeys(out))


def forms(lex: Lexicon):
    """field, scope, name, person -> FORM."""

    def run(batches):
        for pdf in batches:
            rows = []
            for f, s, name, person in zip(pdf["field"], pdf["scope"], pdf["name"], pdf["person"]):
                if person and not is_org(name):
                    t = person_form(name)
                    if t and sum(len(w) > 1 for w in t):
                        text = " ".join(t)
                        rows.append((f, s, name, "p", "", text, grams(" ".join(w.replace("-", " ") for w in t), PERSON_GRAM)))
                else:
                    bare = name.replace("N/A", " ").replace("None", " ") if person else name
                    o = org_form(bare, lex)
                    if o and o[0]:
                        rows.append((f, s, name, "o", o[1], o[0], grams(o[0], ORG_GRAM)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FORM.split(", ")])

    return run


@F.pandas_udf(T.DoubleType())
def agreement(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact check of a candidate pair, 0 where the names can't be one."""
    out = []
    for k, x, y in zip(kind, a, b):
        if k == "p":
            out.append(person_agreement(tuple(x.split()), tuple(y.split())))
        else:
            most = EDITS if min(len(x), len(y)) >= TWICE else 1
            d = edits(x, y, most)
            out.append(0.0 if d > most else 1 - d / 5)
    return pd.Series(out, dtype="float64")


def deletions(text: str) -> set[str]:
    """text with up to as many letters left out as it may have edits: two cores that the exact check accepts share one, swaps included."""
    out = last = {text}
    for _ in range(EDITS if len(text) >= TWICE else 1):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def segments(text: str) -> tuple[set[str], set[str]]:
    """(own, sought): one of two cores within EDITS edits seeks an own segment of the other, as the edits touch two of its segments each at most."""
    n = 2 * EDITS + 1
    cut = lambda size, j, by: (j * size // n + by, (j + 1) * size // n + by)
    own, sought, size = set(), set(), len(text)
    for j in range(n):
        a, b = cut(size, j, 0)
        own.add(f"{size} {j} {text[a:b]}")
        for other in range(size - EDITS, size + EDITS + 1):
            for by in range(-EDITS, EDITS + 1):
                a, b = cut(other, j, by)
                if 0 <= a and b <= size:
                    sought.add(f"{other} {j} {text[a:b]}")
    return own, sought


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("both", "own", "sought")]))
def slip_keys(text: pd.Series) -> pd.DataFrame:
    """Keys of organisations' cores: two within the allowed edits share one of both, or one's own is the other's sought."""
    out = []
    for t in text:
        own, sought = segments(t) if len(t) > LONG - EDITS else ((), ())
        out.append((list(deletions(t)) if len(t) <= LONG else [], list(own), list(sought)))
    return pd.DataFrame(out, columns=["both", "own", "sought"])


def slipped(orgs: DataFrame) -> DataFrame:
    """(a, b, ta, tb), a < b, some more than once: every pair of orgs (id, space, text) of one space within the allowed edits, among others."""
    keyed = orgs.select("id", "space", "text", slip_keys("text").alias("k"))
    keyed = materialize(
        keyed.select("id", "text", F.transform("k.both", lambda x: F.xxhash64("space", x)).alias("both"), F.transform("k.own", lambda x: F.xxhash64("space", x)).alias("own"), F.transform("k.sought", lambda x: F.xxhash64("space", x)).alias("sought")),
        "slips",
    )
    side = lambda keys, c, t: keyed.select(F.col("id").alias(c), F.col("text").alias(t), F.explode(keys).alias("key"))
    short = side("both", "a", "ta").join(side("both", "b", "tb"), "key").where("a < b")
    long = side("own", "a", "ta").join(side("sought", "b", "tb"), "key").where("a <> b")
    turned = F.col("a") > F.col("b")
    long = long.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("tb")).otherwise(F.col("ta")).alias("ta"), F.when(turned, F.col("ta")).otherwise(F.col("tb")).alias("tb")
    )
    return short.select("a", "b", "ta", "tb").unionByName(long).where(F.levenshtein("ta", "tb", 2 * EDITS) >= 0)  # a swap counts twice here


def self_pairs(df: DataFrame, key: Sequence[str], id_: str, cell: int = CELL) -> DataFrame:
    """(key..., a, b), a < b: the pairs of different ids of rows with one key, a pair once per key.

    A key with more than cell rows is cut into cells of about that many; each pair of cells is a group of its own, so no task
    holds a hot key, and none of its pairs is left out. Only rows whose first key column is that frequent are counted by all.
    """
    big = df.groupBy(key[0]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell).select(key[0])
    n = df.join(big, key[0], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell).select(*key, F.ceil(F.col("_n") / cell).alias("_p"))
    at = df.select(*key, id_).join(n, list(key), "left").withColumn("_c", F.pmod(F.xxhash64(id_), F.coalesce("_p", F.lit(1))))
    last = F.coalesce(F.col("_p"), F.lit(1)) - 1
    left = at.select(*key, F.col(id_).alias("_a"), F.col("_c").alias("_i"), F.explode(F.sequence(F.col("_c"), last)).alias("_j"))
    right = at.select(*key, F.col(id_).alias("_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c"))).alias("_i"), F.col("_c").alias("_j"))
    both = left.join(right, [*key, "_i", "_j"]).where((F.col("_a") < F.col("_b")) | ((F.col("_i") < F.col("_j")) & (F.col("_a") > F.col("_b"))))
    return both.select(*key, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def similar(nodes: DataFrame) -> DataFrame:
    """(a, b, s): pairs of nodes (id, space, kind, text, grams) of one space that may be one name, a < b."""
    g = nodes.select("id", "space", "field", "kind", F.explode("grams").alias("gram"))
    df = g.groupBy("field", "kind", "gram").agg(F.count(F.lit(1)).alias("df"))
    total = nodes.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))  # a row per field
    weighted = g.join(df, ["field", "kind", "gram"]).join(F.broadcast(total), ["field", "kind"]).withColumn("w", F.log(1 + F.col("n") / F.col("df")))
    # what is alone in its space has no partner; it counts in the frequencies all the same
    met = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("space")
    weighted = weighted.join(met, "space", "left_semi")
    vec = weighted.groupBy("id", "space", "kind").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "w"))).alias("v"))
    vec = vec.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    # how many of the rarest grams to index: until what is left is shorter than LOW
    left = F.aggregate(
        "v", F.struct(F.lit(1.0).alias("rest"), F.lit(0).alias("k")),
        lambda a, x: F.struct(
            (a["rest"] - x["w"] * x["w"] / (F.col("norm") * F.col("norm"))).alias("rest"),
            (a["k"] + F.when(a["rest"] >= LOW * LOW, 1).otherwise(0)).alias("k"),
        ),
    )["k"]
    vec = vec.withColumn("k", left)
    vec = vec.join(nodes.select("id", "text"), "id").select(
        "id", "space", "kind", "text", "k", F.transform("v", lambda x: x["gram"]).alias("gs"),
        F.map_from_entries(F.transform("v", lambda x: F.struct(x["gram"], x["w"] / F.col("norm")))).alias("vec"),
    )
    vec = materialize(vec, "vectors")
    key = vec.where("kind = 'p'").select("id", "space", F.explode(F.slice("gs", F.lit(1), F.greatest(F.col("k"), F.lit(1)))).alias("gram"))
    persons = self_pairs(key, ["space", "gram"], "id").select("a", "b").distinct()
    orgs = slipped(vec.where("kind = 'o'").select("id", "space", "text")).select("a", "b").distinct()
    cand = persons.withColumn("kind", F.lit("p")).unionByName(orgs.withColumn("kind", F.lit("o")))
    side = lambda c: vec.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}"), F.col("text").alias(f"t{c}"))
    dot = F.aggregate(F.map_keys("va"), F.lit(0.0), lambda s, x: s + F.coalesce(F.col("va")[x] * F.col("vb")[x], F.lit(0.0)))
    # cores within the allowed edits link by themselves, whatever grams the slips leave them
    sure = (F.col("kind") == "o") & (F.least(F.length("ta"), F.length("tb")) >= SHORT)
    cand = cand.join(side("a"), "a").join(side("b"), "b").select("a", "b", "kind", "ta", "tb", dot.alias("cos"), sure.alias("sure")).where((F.col("cos") >= LOW) | F.col("sure"))
    cand = cand.withColumn("agree", agreement("kind", "ta", "tb")).where("agree > 0")
    by_edits = F.col("agree") + (1 - F.col("agree")) * F.col("cos")
    return cand.select("a", "b", F.when(F.col("sure"), by_edits).otherwise(F.lit(0.4) * F.col("cos") + F.lit(0.6) * F.col("agree")).alias("s"))


def average_linkage(edges: DataFrame, least: float = LINK) -> DataFrame:
    """(id, cluster) for every node of edges (a, b, s), a < b: clusters of average linkage, absent pairs counting 0."""
    spark = edges.sparkSession
    edges = materialize(edges.select("a", "b", F.col("s").alias("w")), "links")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    member = materialize(ids.select("id", F.col("id").alias("cluster"), F.lit(1).cast("bigint").alias("n")), "clusters")
    sizes = member.select("cluster", "n")
    while True:
        scored = (
            edges.join(sizes.withColumnsRenamed({"cluster": "a", "n": "na"}), "a")
            .join(sizes.withColumnsRenamed({"cluster": "b", "n": "nb"}), "b")
            .withColumn("avg", F.col("w") / (F.col("na") * F.col("nb")))
            .where(F.col("avg") >= least)
        )
        rank = F.struct(F.col("avg"), -F.col("a"), -F.col("b"), F.col("a"), F.col("b"))
        best = scored.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r"))
        merge = best.groupBy("r.a", "r.b").agg(F.count(F.lit(1)).alias("m")).where("m = 2").select("a", "b")
        merge = materialize(merge, "merges")
        if merge.isEmpty():
            break
        to = merge.select(F.col("b").alias("old"), F.col("a").alias("new"))
        move = lambda df, c: df.join(to, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        moved = move(move(edges, "a"), "b").where("a <> b")
        old = edges, member, merge
        edges = materialize(
            moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "links"
        )
        member = materialize(move(member, "cluster"), "clusters")
        discard(*old)  # what a round made is read by the next one only
        sizes = member.groupBy("cluster").agg(F.sum("n").alias("n"))
    return member.select("id", "cluster")


def link_variants(rows: DataFrame, person: Column, more_names: DataFrame | None = None) -> DataFrame:
    """(field, scope, name, cluster): the spellings that have a normal form, with their name's cluster.

    rows: field, scope, name; person tells which fields hold persons (organisations among them are
    recognised); more_names (name) are organisations' names that only help to learn lines of business. NULL, empty and placeholder names get no row; repeated rows count once. Only names of
    one field and scope can share a cluster, and organisations only where their line of business is the
    same; an organisation written without one joins the only one of that name, if there is just one.
    """
    distinct = rows.where("name IS NOT NULL AND trim(name) <> ''").select("field", "scope", "name", person.alias("person")).distinct()
    known = distinct.where("NOT person").select("name")
    lex = learn(known if more_names is None else known.unionByName(more_names.select("name")))
    made = materialize(distinct.mapInPandas(forms(lex), FORM), "forms")
    id_ = F.xxhash64("field", "scope", "kind", "line", "text")
    made = made.withColumn("id", id_)
    nodes = made.groupBy("id").agg(
        F.first("field").alias("field"), F.first("kind").alias("kind"), F.first("line").alias("line"), F.first("text").alias("text"),
        F.first("grams").alias("grams"), F.first(F.xxhash64("field", "scope", "kind", "line")).alias("space"),
        F.first(F.xxhash64("field", "scope", "kind")).alias("wide"),
    )
    groups = average_linkage(similar(nodes))
    node = materialize(nodes.drop("grams").join(groups, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")), "nodes")
    # firms without a line of business: the only cluster with one of their cores, if it is the only one
    lined = node.where("kind = 'o' AND line <> ''").select("wide", "text", F.col("cluster").alias("target")).distinct()
    bare = node.where("kind = 'o' AND line = ''").select("wide", "text", "cluster")
    goes = bare.join(lined, ["wide", "text"]).groupBy("cluster").agg(F.min("target").alias("t"), F.max("target").alias("u")).where("t = u").select("cluster", "t")
    node = node.join(goes, "cluster", "left").select("id", F.coalesce("t", "cluster").alias("cluster"))
    return made.join(node, "id").select("field", "scope", "name", "cluster")


def pairs(clustered: DataFrame) -> DataFrame:
    """All pairs of different spellings of a cluster, name_a < name_b by code points: the edge at which membership is written out."""
    got = self_pairs(clustered.distinct(), ["cluster", "field", "scope"], "name")
    return got.select("field", "scope", F.col("a").alias("name_a"), F.col("b").alias("name_b"))
