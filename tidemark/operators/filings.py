"""Filings as dated events of registrants: building, clustering, scoring and picking the anchor and a later round."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.keys import accession, cik10
from tidemark.functions.names import usd_text
from tidemark.operators.sequences import anchored_clusters

# Words that tell a security's class, looked for in this order; classes of events that count.
SECURITY = [
    ("Debt", ["debt", "note", "bond", "loan", "promissory", "debenture"]),
    ("Convertible", ["convertible", "safe", "simple agreement", "warrant", "option"]),
    ("Equity", ["equity", "common", "preferred", "stock", "shares", "membership interest"]),
]
COUNTED = ["Equity", "Convertible", "Unknown"]


@dataclass(frozen=True)
class Bands:
    """Typical amounts of a round: median by year and multiplier by sector, and the factors that make a band of them."""

    # Medians in USD, sector multipliers.
    base: float = 9_000_000
    by_year: dict = field(default_factory=lambda: {2015: 5_000_000, 2016: 7_000_000, 2017: 7_000_000, 2018: 7_500_000, 2019: 7_000_000, 2020: 8_000_000, 2021: 12_000_000, 2022: 12_500_000})
    sector: dict = field(default_factory=lambda: {"SAAS": 1.0, "FIN": 1.0, "HARD": 1.0, "BIO": 1.55, "INFRA": 0.85})
    low: float = 0.25
    high: float = 2.5
    mega: float = 5.0
    seed: float = 2_000_000
    seed_share: float = 0.4
    late: float = 100_000_000
    late_age: float = 5.0
    oldest: float = 12.0


@dataclass(frozen=True)
class LaterBand:
    """The band of a later round: share of the median times the sector's multiplier, within a floor and a ceiling."""

    base: float = 27_000_000
    low: float = 0.25
    high: float = 1.5
    floor: float = 10_000_000
    ceiling: float = 200_000_000


def security_class(raw: Column | str, equity: Column | str, debt: Column | str, option: Column | str, other: Column | str) -> Column:
    """The class that the text tells, else the one that is flagged, else Unknown."""
    t = X.norm_text(raw)
    out = None
    for name, words in SECURITY:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    flags = F.when(X.truthy(equity), "Equity").when(X.truthy(debt), "Debt").when(X.truthy(option), "Convertible").when(X.truthy(other), "Other").otherwise("Unknown")
    blank = F.coalesce(F.trim(F.col(raw) if isinstance(raw, str) else raw), F.lit("")) == ""
    return F.when(blank, flags).otherwise(out.otherwise("Other"))


def build_events(issuers: DataFrame, submissions: DataFrame, offerings: DataFrame) -> DataFrame:
    """A row per registrant and filing that has a date: (cik, accession, event_date, filing_date, first_sale, amount, sold, offered,
    invested, amended, security, amount_confidence).

    Submissions and offerings are reduced per filing before they meet, so repeated rows on both sides never multiply. An
    offering's event date is its first sale, else the earliest filing; the class is that of the offering that isn't an
    amendment, then of the earliest, then of the first name. Filings without any date, and keys that can't be read, give no row.
    """
    filed = submissions.select(accession("ACCESSIONNUMBER").alias("accession"), N.parse_date("FILING_DATE").alias("d"))
    filed = filed.where("accession IS NOT NULL").groupBy("accession").agg(F.min("d").alias("filing_date"))
    one = offerings.select(
        accession("ACCESSIONNUMBER").alias("accession"), N.parse_date("SALE_DATE").alias("sale"), N.safe_float("TOTALAMOUNTSOLD").alias("sold"),
        N.safe_float("TOTALOFFERINGAMOUNT").alias("offered"), F.coalesce(F.col("TOTALNUMBERALREADYINVESTED").cast("int"), F.lit(0)).alias("invested"),
        F.coalesce(X.truthy("ISAMENDMENT"), F.lit(False)).cast("int").alias("amended"),
        security_class("TYPESOFSECURITIESOFFERED", "ISEQUITYTYPE", "ISDEBTTYPE", "ISOPTIONTOACQUIRETYPE", "ISOTHERSECURITYTYPE").alias("security"),
    ).where("accession IS NOT NULL")
    named = issuers.select(accession("ACCESSIONNUMBER").alias("accession"), cik10("CIK").alias("cik")).where("accession IS NOT NULL AND cik IS NOT NULL").distinct()
    rows = named.select("accession").distinct().join(filed, "accession", "left").join(one, "accession", "left").withColumn("event_date", F.coalesce("sale", "filing_date"))
    rows = rows.where("event_date IS NOT NULL").withColumn("amount", N.coalesce_positive("sold", "offered"))
    per = rows.groupBy("accession").agg(
        F.min("event_date").alias("event_date"), F.min("filing_date").alias("filing_date"), F.min("sale").alias("first_sale"),
        F.max(F.coalesce("amount", F.lit(0.0))).alias("amount"), F.max(F.coalesce("sold", F.lit(0.0))).alias("sold"), F.max(F.coalesce("offered", F.lit(0.0))).alias("offered"),
        F.max(F.coalesce("invested", F.lit(0))).alias("invested"), F.max(F.coalesce("amended", F.lit(0))).alias("amended"),
        F.min(F.struct(F.coalesce("amended", F.lit(0)).alias("a"), "event_date", F.coalesce("security", F.lit("Unknown")).alias("s")))["s"].alias("security"),
    )
    sure = F.when(F.col("sold") > 0, "HIGH").when(F.col("offered") > 0, "MED").otherwise("LOW")
    return named.join(per.withColumn("amount_confidence", sure), "accession")


def counted(events: DataFrame) -> DataFrame:
    """The events that may belong to a round: of a class that counts, with an amount and a date."""
    return events.where(F.col("security").isin(*COUNTED) & (F.col("amount") > 0) & F.col("event_date").isNotNull())


def rounds(events: DataFrame, key: str = "cik", span: int = 120) -> DataFrame:
    """(key, start, amount, n): clusters of the counted events of each key."""
    c = anchored_clusters(counted(events), key, "event_date", span)
    return c.groupBy(key, F.col("cluster_start").alias("start")).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def _lookup(pairs: dict, key: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, float(v))]), key), F.lit(float(otherwise)))


def amount_score(amount: Column, sector: Column, year: Column, b: Bands = Bands()) -> Column:
    """How typical an amount is of its year and sector: 0 below the seed floor, nearly 0 far above, else a bell over the band."""
    mult = _lookup(b.sector, sector, 1.0)
    median = _lookup(b.by_year, year, b.base) * mult
    mid, half = median * (b.low + b.high) / 2, median * (b.high - b.low) / 2
    return F.when(amount < b.seed, 0.0).when(amount > F.greatest(F.lit(b.late), b.mega * b.base * mult), 0.05).otherwise(N.gaussian(amount, mid, half))


# Factors by age in years and by growth over the round before.
def age_factor(age: Column) -> Column:
    """How typical an age is of the anchor: highest from two to four years, unknown ages aren't held against it."""
    return F.when(age.isNull() | ((age >= 2) & (age <= 4)), 1.0).when(age < 1.5, 0.4).when(age < 2, 0.7).when(age <= 6, 0.8).otherwise(0.5)


def step_factor(step: Column) -> Column:
    """How much a round's growth speaks for it."""
    return F.when(step >= 3, 1.5).when(step >= 2, 1.2).when(step < 0.5, 0.6).otherwise(1.0)


def pick_anchor(rounds_: DataFrame, key: str = "cik", b: Bands = Bands()) -> DataFrame:
    """(key, start, amount, n, age, score, overridden): each key's anchor round, from (key, start, amount, n, founded, sector).

    Rounds that look like a seed, a late stage or an old firm's are left out. The best score wins, the earlier among equals; a
    later round at a typical age replaces it if it comes close enough, the first such in order of score. Keys without any round left give no row.
    """
    r = rounds_.where("amount > 0").withColumn("age", N.years_between("start", "founded"))
    year = F.year("start")
    floor = F.greatest(F.lit(b.seed), b.seed_share * _lookup(b.by_year, year, b.base) * _lookup(b.sector, F.col("sector"), 1.0))
    seed = (F.col("amount") < floor) & (F.col("age").isNull() | (F.col("age") < 2))
    late = (F.col("amount") >= b.late) & F.coalesce(F.col("age") >= b.late_age, F.lit(False))
    r = r.where(~seed & ~late & ~F.coalesce(F.col("age") > b.oldest, F.lit(False)))
    w = Window.partitionBy(key)
    step = F.coalesce(F.col("amount") / F.greatest(F.lag("amount").over(w.orderBy("start")), F.lit(1.0)), F.lit(1.0))
    score = amount_score(F.col("amount"), F.col("sector"), year, b) * age_factor(F.col("age")) * step_factor(F.col("step"))
    r = r.withColumn("step", step).withColumn("score", F.round(score, 9))
    first = w.orderBy(F.desc("score"), "start")
    r = r.withColumn("rn", F.row_number().over(first))
    r = r.withColumns({c: F.first(v).over(first) for c, v in {"b_start": "start", "b_score": "score", "b_age": "age"}.items()})
    close = F.when(F.coalesce(F.col("b_age") < 2, F.lit(False)), 0.4).otherwise(0.7) * F.col("b_score")
    over = (F.col("rn") > 1) & (F.col("start") > F.col("b_start")) & F.coalesce(F.col("age").between(1.5, 6), F.lit(False)) & (F.col("score") >= close)
    rank = F.struct(F.when(over, 1).when(F.col("rn") == 1, 0).otherwise(-1).alias("o"), (-F.col("rn")).alias("r"), "start", "amount", "n", "age", "score")
    return r.groupBy(key).agg(F.max(rank).alias("x")).select(key, "x.start", "x.amount", "x.n", "x.age", "x.score", (F.col("x.o") == 1).alias("overridden"))


def pick_later(events: DataFrame, anchors: DataFrame, key: str = "cik", band: LaterBand = LaterBand(), sectors: dict | None = None) -> DataFrame:
    """(key, later_start, later_amount): the earliest round after the anchor (key, start, sector) whose amount is in the band.
    The events after the anchor are clustered anew."""
    after = events.join(anchors.select(key, F.col("start").alias("_a"), "sector"), key).where("event_date > _a")
    mult = _lookup(sectors or Bands().sector, F.col("sector"), 1.0)
    low, high = F.greatest(F.lit(band.floor), band.low * band.base * mult), F.least(F.lit(band.ceiling), band.high * band.base * mult)
    r = rounds(after, key).join(anchors.select(key, "sector"), key).where((F.col("amount") >= low) & (F.col("amount") <= high))
    return r.groupBy(key).agg(F.min(F.struct("start", "amount")).alias("x")).select(key, F.col("x.start").alias("later_start"), F.col("x.amount").alias("later_amount"))


def anchor_features(picked: DataFrame, match_score: Column | float = 1.0, suspect_age: float = 6.0) -> DataFrame:
    """picked plus quarter, amount as text, age in years to two digits, age_flag (OK, SUSPECT or UNKNOWN) and confidence."""
    score = match_score if isinstance(match_score, Column) else F.lit(match_score)
    flag = F.when(F.col("age").isNull(), "UNKNOWN").when(F.col("age") >= suspect_age, "SUSPECT").otherwise("OK")
    return picked.withColumns(
        {
            "quarter": N.quarter_label("start"), "amount_text": usd_text("amount"), "age_years": F.bround("age", 2), "age_flag": flag,
            "confidence": F.when((score >= 0.5) & (flag != "SUSPECT"), "MED").otherwise("LOW"),
        }
    )


def vendor_anchor(df: DataFrame, last_type: str, equity_type: str, last_date: str, equity_amount: str, last_amount: str) -> DataFrame:
    """df plus vendor_date, vendor_amount and vendor_confidence: the vendor's own round, where its last type is the first series."""
    is_a = F.lower(F.coalesce(F.col(last_type), F.lit(""))).contains("series a") | F.lower(F.coalesce(F.col(equity_type), F.lit(""))).contains("series a")
    amount = F.coalesce(N.coalesce_positive(equity_amount, last_amount), F.lit(0.0))
    dated = is_a & F.col(last_date).isNotNull()
    return df.withColumns(
        {
            "vendor_date": F.when(is_a, F.col(last_date)), "vendor_amount": F.when(dated, amount),
            "vendor_confidence": F.when(dated & (amount > 0), "MED").when(is_a, "LOW"),
        }
    )


def vendor_later(df: DataFrame, last_type: str, equity_type: str, last_date: str, equity_amount: str, last_amount: str) -> DataFrame:
    """df plus vendor_later_date and vendor_later_amount: the vendor's later round, if it has a date and an amount."""
    from tidemark.operators.labels import funding_reason

    amount = N.coalesce_positive(equity_amount, last_amount)
    ok = (funding_reason(last_type, equity_type) != "") & F.col(last_date).isNotNull() & amount.isNotNull()
    return df.withColumns({"vendor_later_date": F.when(ok, F.col(last_date)), "vendor_later_amount": F.when(ok, amount)})


def invalidate_before(df: DataFrame, later: str, anchor: str, *cleared: str, note: str = "note") -> DataFrame:
    """df with later and the cleared columns NULL, and a note, where later is before the anchor."""
    wrong = F.coalesce(F.col(later) < F.col(anchor), F.lit(False))
    told = F.when(wrong, "error_later_before_anchor").otherwise(F.col(note) if note in df.columns else F.lit(None).cast("string"))
    return df.withColumn("_wrong", wrong).withColumn(note, told).withColumns({c: F.when(~F.col("_wrong"), F.col(c)) for c in (later, *cleared)}).drop("_wrong")


def gate_anchors(df: DataFrame, anchor: str, flag: str = "age_flag", confidence: str = "confidence") -> DataFrame:
    """Rows that have an anchor, aren't of a suspect age and aren't of low confidence; a NULL flag or confidence passes."""
    plain = lambda c: F.coalesce(F.upper(F.trim(F.col(c))), F.lit(""))
    return df.where((F.coalesce(F.trim(F.col(anchor).cast("string")), F.lit("")) != "") & (plain(flag) != "SUSPECT") & (plain(confidence) != "LOW"))


def horizon(df: DataFrame, anchor: str, latest: str) -> DataFrame:
    """Rows whose anchor is unknown or not after a day."""
    return df.where(F.col(anchor).isNull() | (F.col(anchor) <= F.lit(latest).cast("date")))


def horizon_if(df: DataFrame, when: Column, date: Column, latest: str) -> DataFrame:
    """Rows to which a condition doesn't apply, or whose date is unknown or not after a day."""
    return df.where(~F.coalesce(when, F.lit(False)) | date.isNull() | (date <= F.lit(latest).cast("date")))


def raised_before(events: DataFrame, anchors: DataFrame, key: str = "cik", share: float = 0.6, cap: float = 0.25, mega: float = 45_000_000) -> DataFrame:
    """(key, raised): what the events before the anchor (key, start) sold, or a share of what they offered, each capped."""
    e = events.join(anchors.select(key, F.col("start").alias("_a")), key).where("event_date < _a")
    one = F.least(F.when(F.col("sold") > 0, F.col("sold")).otherwise(share * F.col("offered")), F.lit(cap * mega))
    return e.groupBy(key).agg(F.sum(one).alias("raised"))


def describe_events(events: DataFrame, key: str = "cik", most: int = 12) -> DataFrame:
    """(key, n, summary): the first events of each key as a text, and how many more there are. Only these are collected."""
    count = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    first = events.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("event_date", "accession"))).where(F.col("_rn") <= most)
    line = F.concat_ws(" ", F.col("event_date").cast("string"), "security", usd_text("amount"))
    lines = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", line.alias("t")))), lambda x: x["t"]), "; ").alias("t"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" (+"), (F.col("n") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return count.join(lines, key).select(key, "n", F.concat("t", more).alias("summary"))
