"""Registrants for companies by name, place and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import surname_clean
from tidemark.functions.text import ambiguous, company_tokens, jaccard, norm_postal, norm_text, surnames
from tidemark.operators.matching import location_score, token_candidates


def _within(part: Column, whole: Column) -> Column:
    return F.coalesce((part != "") & F.contains(whole, part), F.lit(False))


def candidate_issuers(companies: DataFrame, issuers: DataFrame, tokens: int = 4, top: int | None = 10) -> DataFrame:
    """(org_id, cik, issuer_name, score, zip_hit, city_hit, state_hit): for each company the best registrants that hold its first words.

    companies: org_id, name, city, state, postal. issuers: row, cik, name, city, state, postal. Rows of one registrant with the
    same name and place count once. Ties in score go to the least row. top None keeps all.
    """
    rows = issuers.groupBy("cik", "name", "city", "state", "postal").agg(F.min("row").alias("row")).where("name IS NOT NULL")
    pairs = token_candidates(companies.select("org_id", "name"), rows.select("row", F.col("name").alias("rname")), "org_id", "name", "row", "rname", tokens=tokens, least=3)
    both = pairs.select("org_id", "row").join(companies, "org_id").join(rows.select("row", "cik", *[F.col(c).alias(f"i_{c}") for c in ("name", "city", "state", "postal")]), "row")
    base = jaccard(company_tokens("name"), company_tokens("i_name"))
    mine, theirs = norm_postal("postal"), norm_postal("i_postal")
    both = both.withColumns(
        {
            "zip_hit": F.coalesce((mine != "") & (mine == theirs), F.lit(False)),
            "city_hit": _within(norm_text("city"), norm_text("i_city")), "state_hit": _within(norm_text("state"), norm_text("i_state")),
        }
    )
    score = location_score(base, F.col("zip_hit"), F.col("city_hit"), F.col("state_hit"), ambiguous(company_tokens("name")))
    out = both.select("org_id", "row", "cik", F.col("i_name").alias("issuer_name"), score.alias("score"), "zip_hit", "city_hit", "state_hit")
    if top is None:
        return out
    w = Window.partitionBy("org_id").orderBy(F.desc("score"), "row")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")


def founder_overlap(pairs: DataFrame, companies: DataFrame, persons: DataFrame) -> DataFrame:
    """pairs (org_id, cik, ...) plus overlap and ratio: how many of a company's founders' surnames are among the registrant's.

    companies: org_id, founders. persons: cik, surname. A join on surnames: no registrant's list is ever collected.
    """
    own = companies.select("org_id", F.explode(surnames("founders")).alias("s")).select("org_id", surname_clean("s").alias("s")).where("s <> ''").distinct()
    n = own.groupBy("org_id").agg(F.count(F.lit(1)).alias("_n"))
    theirs = persons.select("cik", surname_clean("surname").alias("s")).where("s <> '' AND cik IS NOT NULL").distinct()
    hits = pairs.select("org_id", "cik").distinct().join(own, "org_id").join(theirs, ["cik", "s"]).groupBy("org_id", "cik").agg(F.count(F.lit(1)).alias("overlap"))
    out = pairs.join(hits, ["org_id", "cik"], "left").join(n, "org_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return out.withColumn("ratio", F.col("overlap") / F.greatest(F.lit(1), F.coalesce("_n", F.lit(0)))).drop("_n")


def best_issuer(companies: DataFrame, issuers: DataFrame, persons: DataFrame, top: int = 10) -> DataFrame:
    """(org_id, cik, issuer_name, score, overlap, ratio): each company's registrant, cik NULL where only a doubtful one was found.

    Accepted are a shared surname with a score of .5 or more, and without one a score of 1 with a hit in city or postal code; the
    greatest overlap wins, then the score, then the least row. Companies without any candidate give no row.
    """
    c = founder_overlap(candidate_issuers(companies, issuers, top=top).where("cik IS NOT NULL"), companies, persons)
    ok = ((F.col("overlap") >= 1) & (F.col("score") >= 0.5)) | ((F.col("overlap") == 0) & (F.col("score") == 1) & (F.col("city_hit") | F.col("zip_hit")))
    rank = F.struct(ok.alias("ok"), F.when(ok, F.col("overlap")).otherwise(0).alias("ov"), "score", (-F.col("row")).alias("r"), "cik", "issuer_name", "ratio")
    x = c.groupBy("org_id").agg(F.max(rank).alias("x"))
    return x.select(
        "org_id", F.when(F.col("x.ok"), F.col("x.cik")).alias("cik"), "x.issuer_name", "x.score", F.col("x.ov").alias("overlap"),
        F.when(F.col("x.ok"), F.col("x.ratio")).otherwise(0.0).alias("ratio"),
    )
