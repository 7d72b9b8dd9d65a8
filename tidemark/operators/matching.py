"""Candidate matching by token blocking, prefixes and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import company_tokens, jaccard


def token_candidates(left: DataFrame, right: DataFrame, lid: str, lname: str, rid: str, rname: str, tokens: int = 4, most: int | None = None, least: int = 2) -> DataFrame:
    """(lid, rid): pairs in which right's name holds all of the first few tokens of left's that have at least some letters.

    An equi-join on exploded tokens: only the rarest of a left name's tokens is joined on, and the others
    are checked on the pair; a frequent token is never the one that makes pairs unless a name has no other.
    """
    l = left.select(F.col(lid), F.slice(F.filter(company_tokens(lname), lambda t: F.length(t) >= least), 1, tokens).alias("_lt")).where(F.size("_lt") > 0)  # noqa: E741
    r = right.select(F.col(rid), company_tokens(rname).alias("_rt"))
    posted = r.select(rid, "_rt", F.explode("_rt").alias("_t"))
    df = posted.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    keyed = l.select(lid, "_lt", F.explode("_lt").alias("_t")).join(df, "_t", "left")
    rare = keyed.groupBy(lid, "_lt").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_t").alias("t"))).alias("_r"))
    pairs = rare.select(lid, "_lt", F.col("_r.t").alias("_t")).join(posted, "_t")
    pairs = pairs.where(F.size(F.array_except("_lt", "_rt")) == 0).select(lid, rid, jaccard(F.col("_lt"), F.col("_rt")).alias("score"), F.size("_lt").alias("n_tokens"))
    if most is None:
        return pairs
    w = Window.partitionBy(lid).orderBy(F.desc("score"), rid)
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def location_score(base: Column, zip_hit: Column, city_hit: Column, state_hit: Column, vague: Column) -> Column:
    """A name score of .5 or more raised by .25 for the zip, .15 for the city, .10 for the state; vague names without a zip hit stay at .5."""
    bonus = F.lit(0.25) * zip_hit.cast("int") + F.lit(0.15) * city_hit.cast("int") + F.lit(0.10) * state_hit.cast("int")
    full = F.when(base < 0.5, base).otherwise(F.least(F.lit(1.0), base + bonus))
    return F.when(vague & ~zip_hit, F.least(full, F.lit(0.5))).otherwise(full)


def prefix_join(targets: DataFrame, rows: DataFrame, target: str, value: str, suffixes: list[str]) -> DataFrame:
    """targets x rows where value is target, or target followed by one of the suffix patterns (LIKE).

    The theta condition alone would plan as a nested loop; value's first word is an equi-key, LIKE the rest.
    """
    first = lambda c: F.split(F.regexp_replace(F.upper(c), ",", " "), " ")[0]
    like = F.col(value) == F.col(target)
    for s in suffixes:
        like = like | F.startswith(F.col(value), F.concat(F.col(target), F.lit(s)))
    return targets.withColumn("_k", first(F.col(target))).join(rows.withColumn("_k", first(F.col(value))), "_k").where(like).drop("_k")


def name_tier(a: Column, b: Column) -> Column:
    """2 equal or one begins the other at a word's end, 1 one contains the other, 0 none."""
    begins = lambda x, y: F.startswith(x, F.concat(y, F.lit(" "))) | F.startswith(x, F.concat(y, F.lit(",")))
    return F.when((a == b) | begins(a, b) | begins(b, a), 2).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(0)


def containing_names(left: DataFrame, right: DataFrame, lname: str, rname: str, gram: int = 3) -> DataFrame:
    """left x right plus tier (see name_tier), where it isn't 0: no pair in which one name contains the other is lost.

    Whatever contains a name holds all of its grams; so the shorter side is joined on the rarest of its grams, in both directions,
    on distinct names: of twice gram letters for names as long as that, else of gram letters, or those that the name has.
    Exploded grams are far larger than Catalyst's estimate of them, so they are merged and never broadcast; broadcast are
    only the distinct grams of the names below twice gram letters, at most as many as the alphabet to the power gram.
    """
    def cut(n: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(n) - size + 1)), lambda i: F.substring(n, i, F.lit(size)))

    a, b = left.select(F.col(lname).alias("_n")).distinct(), right.select(F.col(rname).alias("_n")).distinct()

    def anchored(small: DataFrame, big: DataFrame, size: int, sizes: range, few: bool) -> DataFrame:
        """(s, b): the names of big that contain a name of small, by small's grams of size letters among big's of sizes."""
        asked = small.select(F.col("_n").alias("s"), F.explode(F.array_distinct(cut(F.col("_n"), size))).alias("g"))
        posted = big.select(F.col("_n").alias("b"), F.explode(F.array_distinct(F.concat(*[cut(F.col("_n"), k) for k in sizes]))).alias("g"))
        if few:
            posted = posted.join(F.broadcast(asked.select("g").distinct()), "g", "left_semi")
        df = posted.groupBy("g").agg(F.count(F.lit(1)).alias("_f"))
        asked = asked.hint("merge").join(df, "g", "left")
        rare = asked.groupBy("s").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "g")).alias("r")).where("r.f > 0").select("s", F.col("r.g").alias("g"))
        return rare.join(posted.hint("merge"), "g").where(F.contains("b", F.col("s"))).select("s", "b")

    def contained(small: DataFrame, big: DataFrame) -> DataFrame:
        long = F.length("_n") >= 2 * gram
        return anchored(small.where(long), big.where(long), 2 * gram, range(2 * gram, 2 * gram + 1), False).union(
            anchored(small.where(~long), big, gram, range(1, gram + 1), True)
        )

    pairs = contained(a, b).select(F.col("s").alias(lname), F.col("b").alias(rname)).union(contained(b, a).select("b", "s")).distinct()
    return left.join(pairs, lname).join(right, rname).withColumn("tier", name_tier(F.col(lname), F.col(rname))).where("tier > 0")


def priority_match(passes: list[DataFrame], key: str, other: str) -> DataFrame:
    """The match of the first pass that has one for a key, with its pass and its number of rivals."""
    all_ = None
    for i, p in enumerate(passes):
        p = p.select(key, other).distinct().withColumn("pass", F.lit(i + 1))
        all_ = p if all_ is None else all_.unionByName(p)
    best = all_.groupBy(key).agg(F.min("pass").alias("pass"))
    return all_.join(best, [key, "pass"]).groupBy(key, "pass").agg(F.min(other).alias(other), F.count(F.lit(1)).alias("rivals"))
