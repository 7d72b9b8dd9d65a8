"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import accession, cik10, domain_norm
from tidemark.llm import abuse, fusion, leakage, linkage, packing, residue, variants
from tidemark.session import materialize
from tidemark.sources.tables import load, norm_null

ISSUER_FIELDS = ["ENTITYNAME", "CITY", "STATEORCOUNTRY", "ZIPCODE"]


def _claims(spark: SparkSession, d: str) -> DataFrame:
    keys = [("accession", accession("ACCESSIONNUMBER")), ("cik", cik10("CIK"))]
    return fusion.claims(load(spark, d, "issuers"), keys, ISSUER_FIELDS, "feed", "received_at", "issuer_row_id")


def _trust(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "feeds").select(F.col("feed").alias("source"), "trust_rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each filing delivered more than once, field by field."""
    return fusion.survivors(_claims(spark, d), ["accession", "cik"], _trust(spark, d)).select("accession", "cik", "field", "value")


def p6_voted(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record by the votes alone, with the posterior of each value."""
    got = fusion.fuse(_claims(spark, d), ["accession", "cik"], _trust(spark, d), prior="none")
    return got.select("accession", "cik", "field", "value", F.round("posterior", 6).alias("posterior"))


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    """Estimated accuracy of each source, and of its dependences the greatest."""
    base = _claims(spark, d).withColumn("key", fusion._key())
    accuracy, copies = fusion.estimate(base, ["accession", "cik"])
    return accuracy.join(copies, "source", "left").select("source", F.col("_acc").alias("accuracy"), F.array_max(F.map_values("_dep")).alias("most_dependent"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that reproduce at least two fifths of an evaluation item."""
    docs, items = load(spark, d, "documents"), load(spark, d, "eval_items")
    return leakage.find_leaks(docs, items).select("doc_id", "item_id")


_MODELS: dict = {}


def _fitted(what: str, fit, *tables: DataFrame):
    """What fit gives, fitted once per session and set of files: the queries of one model share it."""
    key = (what, tables[0].sparkSession.sparkContext.applicationId, *(f for t in tables for f in sorted(t.inputFiles())))
    if key not in _MODELS:
        _MODELS[key] = fit(*tables)
    return _MODELS[key]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text is template residue, filler, an error or a script notice."""
    pages = load(spark, d, "wayback_pages")
    return residue.score_pages(pages, _fitted("residue", residue.train, pages)).where("residue").select("page_id")


def p3_unseen_hosts(spark: SparkSession, d: str) -> DataFrame:
    """How well the decisions agree with the weak labels, on hosts that the classifier was fitted to and on unseen ones."""
    pages = load(spark, d, "wayback_pages")
    return residue.validate(residue.score_pages(pages, _fitted("residue", residue.train, pages), weak=True))


def _abuse_scores(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    docs = load(spark, d, "documents")
    net, threshold, _ = _fitted("abuse", abuse.train, docs, load(spark, d, "doc_labels"))
    return abuse.score(docs, net), threshold


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    scores, threshold = _abuse_scores(spark, d)
    return scores.where(F.col("score") >= threshold).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _abuse_scores(spark, d)[0].select("doc_id", "score")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and the share of them with such content, per source."""
    scores, threshold = _abuse_scores(spark, d)
    hit = (F.col("score") >= threshold).cast("bigint")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("n_abusive"), F.avg(hit).alias("rate"))


def filing_ciks(spark: SparkSession, d: str) -> DataFrame:
    """(accession, cik), each once."""
    i = load(spark, d, "issuers").select(accession("ACCESSIONNUMBER").alias("accession"), cik10("CIK").alias("cik"))
    return i.where("accession IS NOT NULL AND cik IS NOT NULL").distinct()


def _written_names(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: load(spark, d, t).select(F.lit(c).alias("field"), F.lit("").alias("scope"), F.col(c).alias("name")).distinct()
    full = F.concat_ws(" ", F.coalesce("FIRSTNAME", F.lit("")), F.coalesce("LASTNAME", F.lit("")))
    person = load(spark, d, "relatedpersons").where("FIRSTNAME IS NOT NULL AND LASTNAME IS NOT NULL")
    person = person.select(accession("ACCESSIONNUMBER").alias("accession"), full.alias("name")).distinct()
    person = person.join(filing_ciks(spark, d), "accession").select(F.lit("LASTNAME").alias("field"), F.col("cik").alias("scope"), "name")
    return one("patent_assignees", "assignee_name").unionByName(one("companies", "Organization_Name")).unionByName(person.distinct())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one organisation or person."""
    more = load(spark, d, "issuers").select(F.col("ENTITYNAME").alias("name"))
    return variants.pairs(variants.link_variants(_written_names(spark, d), F.col("field") == "LASTNAME", more))


def _organisations(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    return linkage.link_organisations(
        load(spark, d, "companies").select(
            "org_id", norm_null("Organization_Name").alias("name"), domain_norm("domain_clean").alias("domain"),
            norm_null("Headquarters Location").alias("hq"), norm_null("Postal Code").alias("postal"), norm_null("Founders").alias("founders"),
            F.col("Founded Date").alias("founded"), linkage.subject_words("Industries", "Description", "`Full Description`").alias("subject"),
        ),
        load(spark, d, "issuers").select(
            cik10("CIK").alias("cik"), accession("ACCESSIONNUMBER").alias("accession"), norm_null("ENTITYNAME").alias("name"),
            norm_null("CITY").alias("city"), norm_null("STATEORCOUNTRY").alias("state"), norm_null("ZIPCODE").alias("zip"),
            F.col("received_at").cast("date").alias("seen"),
        ),
        load(spark, d, "relatedpersons").select(
            accession("ACCESSIONNUMBER").alias("accession"), F.concat_ws(" ", norm_null("FIRSTNAME"), norm_null("LASTNAME")).alias("name")
        ),
        load(spark, d, "patent_assignees").select(
            F.col("assignee_row_id").alias("row"), norm_null("assignee_name").alias("name"),
            F.to_date(F.col("last_filing").cast("string"), "yyyyMMdd").alias("filed"), linkage.subject_words("sample_titles").alias("subject"),
        ),
        least=least,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of issuers and patent_assignees of the same organisation as a companies row."""
    return _organisations(spark, d, linkage.ACCEPT).where(F.col("confidence") >= linkage.ACCEPT).select("org_id", "source", "source_key")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All compared pairs that aren't ruled out, with their confidence."""
    return _organisations(spark, d)


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    capacities = {r.capacity_id: r.capacity_tokens for r in load(spark, d, "pack_capacity").collect()}  # three rows
    return packing.pack(packing.count_tokens(load(spark, d, "documents")), capacities)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Container and position of each text or piece, for each capacity."""
    return _packed(spark, d)[0].select("capacity_id", F.col("id").alias("doc_id"), "piece", "start", "size", "container", "position")


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Containers used for each capacity, the certified least number, and the gap between them as a share of it."""
    gap = F.round(F.col("containers") / F.col("least") - 1, 6)
    return _packed(spark, d)[1].select("capacity_id", "containers", "least", "tokens", gap.alias("gap"))


QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs,
    "p3_found": p3_found, "p3_unseen_hosts": p3_unseen_hosts, "p5_found": p5_found, "p6_found": p6_found, "p6_voted": p6_voted, "p6_sources": p6_sources,
    "p7_packed": p7_packed, "p7_bounds": p7_bounds, "p8_found": p8_found, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}


SQL = {
    "p6_found": """
WITH i AS (
  SELECT regexp_replace(ACCESSIONNUMBER, '[^0-9]', '', 'g') a,
         regexp_extract(trim(CIK), '^(?i:cik)?[\\s:#-]*0*([0-9]{1,10})(\\.0*)?$', 1) c, *
  FROM issuers),
k AS (
  SELECT substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13, 6) accession, lpad(c, 10, '0') cik,
         feed, received_at, issuer_row_id, ENTITYNAME, CITY, STATEORCOUNTRY, ZIPCODE
  FROM i WHERE length(a) = 18 AND c <> ''),
g AS (SELECT *, count(*) OVER (PARTITION BY accession, cik) n FROM k),
u AS (
  SELECT accession, cik, feed, received_at, issuer_row_id, f AS field,
         CASE f WHEN 'ENTITYNAME' THEN ENTITYNAME WHEN 'CITY' THEN CITY WHEN 'STATEORCOUNTRY' THEN STATEORCOUNTRY ELSE ZIPCODE END AS value
  FROM g CROSS JOIN (VALUES ('ENTITYNAME'), ('CITY'), ('STATEORCOUNTRY'), ('ZIPCODE')) t(f) WHERE n >= 2),
r AS (
  SELECT u.*, row_number() OVER (PARTITION BY accession, cik, field
    ORDER BY coalesce(trust_rank, 1000000), received_at DESC NULLS LAST, issuer_row_id DESC) rn
  FROM u LEFT JOIN feeds USING (feed)
  WHERE value IS NOT NULL AND trim(value) NOT IN ('', 'nan', 'None', 'NaT'))
SELECT accession, cik, field, value FROM r WHERE rn = 1""",
}
