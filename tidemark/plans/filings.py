"""Queries over filings, registrants and labels on the project's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names as M
from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.keys import accession, cik10
from tidemark.operators import filings, issuers, labels
from tidemark.plans.analytics import _bucket_sql
from tidemark.sources.tables import load, norm_null

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts ---------------------------------------------------------------------------------------------

def _null(x: str) -> str:
    return f"CASE WHEN trim({x}) NOT IN ('', 'nan', 'None', 'NaT') THEN {x} END"


def _acc(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 18 THEN substr({d}, 1, 10) || '-' || substr({d}, 11, 2) || '-' || substr({d}, 13, 6) END"


def _cik(x: str) -> str:
    return f"lpad(nullif(regexp_extract(trim({x}), '^(?i:cik)?[\\s:#-]*0*([0-9]{{1,10}})(\\.0*)?$', 1), ''), 10, '0')"


def _day(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(trim({x}), '{f}')" for f in ("%Y-%m-%d", "%d-%b-%Y", "%m/%d/%Y", "%Y%m%d")) + ")::DATE"


def _num(x: str) -> str:
    return f"CASE WHEN NOT isnan(TRY_CAST(replace(replace(trim({x}), ',', ''), '$', '') AS DOUBLE)) THEN TRY_CAST(replace(replace(trim({x}), ',', ''), '$', '') AS DOUBLE) END"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _true(x: str) -> str:
    return f"coalesce(lower(trim({x})) IN ('1', 'true', 't', 'yes', 'y'), false)"


def _security() -> str:
    t = _norm("TYPESOFSECURITIESOFFERED")
    words = " ".join("WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in filings.SECURITY)
    flags = f"CASE WHEN {_true('ISEQUITYTYPE')} THEN 'Equity' WHEN {_true('ISDEBTTYPE')} THEN 'Debt' WHEN {_true('ISOPTIONTOACQUIRETYPE')} THEN 'Convertible' WHEN {_true('ISOTHERSECURITYTYPE')} THEN 'Other' ELSE 'Unknown' END"
    return f"CASE WHEN coalesce(trim(TYPESOFSECURITIESOFFERED), '') = '' THEN {flags} {words} ELSE 'Other' END"


EVENTS = f"""f AS (SELECT {_acc('ACCESSIONNUMBER')} acc, min({_day('FILING_DATE')}) fd FROM formdsubmission GROUP BY 1),
o AS (SELECT {_acc('ACCESSIONNUMBER')} acc, {_day('SALE_DATE')} sale, {_num('TOTALAMOUNTSOLD')} sold, {_num('TOTALOFFERINGAMOUNT')} offered,
  coalesce(TOTALNUMBERALREADYINVESTED::INT, 0) invested, {_true('ISAMENDMENT')}::INT amended, {_security()} sec FROM offering),
i AS (SELECT DISTINCT {_acc('ACCESSIONNUMBER')} acc, {_cik('CIK')} cik FROM issuers WHERE {_acc('ACCESSIONNUMBER')} IS NOT NULL AND {_cik('CIK')} IS NOT NULL),
j AS (SELECT cik, i.acc, coalesce(sale, fd) d, fd, sale, sold, offered, CASE WHEN sold > 0 THEN sold WHEN offered > 0 THEN offered END amount,
  coalesce(invested, 0) invested, coalesce(amended, 0) amended, coalesce(sec, 'Unknown') sec FROM i LEFT JOIN f ON f.acc = i.acc LEFT JOIN o ON o.acc = i.acc),
e AS (SELECT cik, acc AS accession, min(d) AS event_date, max(coalesce(amount, 0)) AS amount, max(invested) AS invested, max(amended) AS amended,
  max(coalesce(sold, 0)) sold, max(coalesce(offered, 0)) offered, min({{'a': amended, 'd': d, 's': sec}}).s AS security FROM j WHERE d IS NOT NULL GROUP BY 1, 2)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return filings.build_events(load(spark, d, "issuers"), load(spark, d, "formdsubmission"), load(spark, d, "offering"))


@query(f"""WITH {EVENTS} SELECT cik, accession, event_date, amount, invested, amended, security,
  CASE WHEN sold > 0 THEN 'HIGH' WHEN offered > 0 THEN 'MED' ELSE 'LOW' END AS amount_confidence FROM e""")
def event_build(spark, d):
    """One row per registrant and filing: earliest date, largest amounts, any amendment, class and confidence."""
    return _events(spark, d).select("cik", "accession", "event_date", "amount", "invested", "amended", "security", "amount_confidence")


ROUNDS = f"""WITH RECURSIVE {EVENTS},
x AS (SELECT * FROM e WHERE security IN ('Equity', 'Convertible', 'Unknown') AND amount > 0),
r AS (SELECT cik, min(event_date) s FROM x GROUP BY 1 UNION ALL SELECT r.cik, min(x.event_date) FROM r JOIN x ON x.cik = r.cik AND x.event_date > r.s + 120 GROUP BY r.cik, r.s),
g AS (SELECT cik, (SELECT max(s) FROM r WHERE r.cik = x.cik AND s <= event_date) AS start, sum(amount) amount, count(*) n FROM x GROUP BY 1, 2)"""


@query(ROUNDS + " SELECT cik, start, amount, n FROM g")
def filing_rounds(spark, d):
    """Clusters of at most 120 days of each registrant's counted filings."""
    return filings.rounds(_events(spark, d))


FOUNDED = f"""k AS (SELECT cik, (abs(hash_) % 5)::INT sector FROM (SELECT DISTINCT cik, CAST(right(cik, 4) AS INT) hash_ FROM i)),
fo AS (SELECT cik, min(event_date) - (CAST(right(cik, 3) AS INT) * 3) founded FROM e GROUP BY 1)"""
_MED = "CASE year(start) WHEN 2015 THEN 5e6 WHEN 2016 THEN 7e6 WHEN 2017 THEN 7e6 WHEN 2018 THEN 7.5e6 WHEN 2019 THEN 7e6 WHEN 2020 THEN 8e6 WHEN 2021 THEN 12e6 WHEN 2022 THEN 12.5e6 ELSE 9e6 END"
_MULT = "CASE sector WHEN 'BIO' THEN 1.55 WHEN 'INFRA' THEN 0.85 ELSE 1.0 END"
SECTORS = ["SAAS", "FIN", "HARD", "BIO", "INFRA"]
PICKED = ROUNDS + f""", {FOUNDED},
q AS (SELECT g.*, fo.founded, ['SAAS', 'FIN', 'HARD', 'BIO', 'INFRA'][k.sector + 1] sector, date_diff('day', fo.founded, start) / 365.25 age FROM g JOIN k USING (cik) JOIN fo USING (cik)),
m AS (SELECT *, {_MED} * {_MULT} med, {_MULT} mult FROM q),
l AS (SELECT * FROM m WHERE NOT (amount < greatest(2e6, 0.4 * med) AND (age IS NULL OR age < 2)) AND NOT (amount >= 1e8 AND coalesce(age >= 5, false)) AND NOT coalesce(age > 12, false)),
st AS (SELECT *, coalesce(amount / greatest(lag(amount) OVER (PARTITION BY cik ORDER BY start), 1), 1) step FROM l),
sc AS (SELECT *, round(CASE WHEN amount < 2e6 THEN 0 WHEN amount > greatest(1e8, 45e6 * mult) THEN 0.05 ELSE exp(-0.5 * power((amount - 1.375 * med) / greatest(1e-9, 1.125 * med), 2)) END
  * CASE WHEN age IS NULL THEN 1.0 WHEN age < 1.5 THEN 0.4 WHEN age < 2 THEN 0.7 WHEN age <= 4 THEN 1.0 WHEN age <= 6 THEN 0.8 ELSE 0.5 END
  * CASE WHEN step >= 3 THEN 1.5 WHEN step >= 2 THEN 1.2 WHEN step < 0.5 THEN 0.6 ELSE 1.0 END, 9) score FROM st),
rk AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY score DESC, start) rn FROM sc),
ov AS (SELECT c.*, row_number() OVER (PARTITION BY c.cik ORDER BY c.rn) pos FROM rk b JOIN rk c ON c.cik = b.cik AND b.rn = 1 AND c.rn > 1 AND c.start > b.start AND c.age BETWEEN 1.5 AND 6
  AND c.score >= CASE WHEN b.age < 2 THEN 0.4 ELSE 0.7 END * b.score),
pk AS (SELECT b.cik, coalesce(o.start, b.start) AS start, coalesce(o.amount, b.amount) AS amount, coalesce(o.n, b.n) AS n, coalesce(o.age, b.age) age, o.cik IS NOT NULL AS overridden
  FROM rk b LEFT JOIN ov o ON o.cik = b.cik AND o.pos = 1 WHERE b.rn = 1)"""


def _picked(spark, d):
    """Each registrant's anchor; as no table says when and in which line a registrant was founded, both are made of its number."""
    e = _events(spark, d)
    sector = F.get(F.array(*[F.lit(s) for s in SECTORS]), (F.substring("cik", -4, 4).cast("int") % 5).cast("int"))
    founded = e.groupBy("cik").agg(F.min("event_date").alias("_f")).select("cik", sector.alias("sector"), F.date_sub("_f", F.substring("cik", -3, 3).cast("int") * 3).alias("founded"))
    return e, founded, filings.pick_anchor(filings.rounds(e).join(founded, "cik"))


@query(PICKED + """ SELECT cik, start, amount, n, overridden, year(start) || 'Q' || quarter(start) AS quarter,
  CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age >= 6 THEN 'SUSPECT' ELSE 'OK' END AS age_flag, CASE WHEN age >= 6 THEN 'LOW' ELSE 'MED' END AS confidence FROM pk""")
def anchor_pick(spark, d):
    """Each registrant's anchor round with its features: best-scored cluster, or a later one that comes close enough."""
    return filings.anchor_features(_picked(spark, d)[2]).select("cik", "start", "amount", "n", "overridden", "quarter", "age_flag", "confidence")


@query(PICKED + """, xa AS (SELECT x.* FROM x JOIN pk ON pk.cik = x.cik AND x.event_date > pk.start),
ra AS (SELECT cik, min(event_date) s FROM xa GROUP BY 1 UNION ALL SELECT ra.cik, min(xa.event_date) FROM ra JOIN xa ON xa.cik = ra.cik AND xa.event_date > ra.s + 120 GROUP BY ra.cik, ra.s),
ga AS (SELECT cik, (SELECT max(s) FROM ra WHERE ra.cik = xa.cik AND s <= event_date) AS start, sum(amount) amount FROM xa GROUP BY 1, 2),
ba AS (SELECT ga.*, """ + _MULT + """ * 27e6 base FROM (SELECT ga.*, ['SAAS', 'FIN', 'HARD', 'BIO', 'INFRA'][k.sector + 1] sector FROM ga JOIN k USING (cik)) ga)
SELECT cik, min(start) AS later_start, arg_min(amount, start) AS later_amount FROM ba WHERE amount >= greatest(1e7, 0.25 * base) AND amount <= least(2e8, 1.5 * base) GROUP BY 1""")
def series_b_pick(spark, d):
    """The first later round within its sector's band."""
    e, founded, picked = _picked(spark, d)
    return filings.pick_later(e, picked.join(founded, "cik").select("cik", "start", "sector"))


@query(PICKED + """ SELECT cik, round(sum(least(CASE WHEN sold > 0 THEN sold ELSE 0.6 * offered END, 11.25e6)), 2) AS raised FROM e JOIN pk USING (cik) WHERE event_date < start GROUP BY 1""")
def raised_before(spark, d):
    """What each registrant raised before its anchor, estimated."""
    e, _, picked = _picked(spark, d)
    return filings.raised_before(e, picked).select("cik", F.round("raised", 2).alias("raised"))


# --- registrants ---------------------------------------------------------------------------------------------

_TOK = "list_filter(string_split({}, ' '), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(f"'{s}'" for s in X.LEGAL_SUFFIXES) + "))"
_LAST = "regexp_replace(regexp_replace(trim(split_part(upper(trim({})), ',', 1)), '\\s+(?:" + "|".join(M.SURNAME_SUFFIXES) + ")\\b\\.?', '', 'g'), '[^A-Z''-]', '', 'g')"
_ZIP = "regexp_extract(replace({}, ' ', ''), '^([A-Za-z0-9]+)', 1)"
ISSUER_SQL = f"""WITH c AS (SELECT org_id, n, {_TOK.format(_norm('n'))} t, {_norm("trim(split_part(hq, ',', 1))")} city, {_norm("trim(split_part(hq, ',', 2))")} state, {_ZIP.format('zip')} zip, f
  FROM (SELECT org_id, {_null('Organization_Name')} n, {_null('"Headquarters Location"')} hq, {_null('"Postal Code"')} zip, {_null('Founders')} f FROM companies)),
i AS (SELECT min(issuer_row_id) r, {_cik('CIK')} cik, {_null('ENTITYNAME')} n, {_null('CITY')} ct, {_null('STATEORCOUNTRY')} st, {_null('ZIPCODE')} zp FROM issuers GROUP BY ALL),
j AS (SELECT *, list_distinct({_TOK.format(_norm('n'))}) t, {_norm('ct')} city, {_norm('st')} state, {_ZIP.format('zp')} zip FROM i WHERE n IS NOT NULL),
p AS (SELECT org_id, r, cik, j.n AS issuer_name, list_distinct(c.t) a, j.t b, coalesce(c.zip <> '' AND c.zip = j.zip, false) zh, coalesce(c.city <> '' AND contains(j.city, c.city), false) ch,
  coalesce(c.state <> '' AND contains(j.state, c.state), false) sh FROM (SELECT *, list_filter(t, lambda x, i: length(x) >= 3 AND list_position(t, x) = i)[1:4] k FROM c WHERE n IS NOT NULL) c JOIN j ON len(k) > 0 AND len(list_intersect(k, j.t)) = len(k)),
s AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END base FROM p),
u AS (SELECT *, CASE WHEN base < 0.5 THEN base ELSE least(1.0, base + (0.25::DOUBLE * zh::INT + 0.15::DOUBLE * ch::INT + 0.10::DOUBLE * sh::INT)) END full_ FROM s),
v AS (SELECT *, CASE WHEN len(a) <= 1 AND NOT zh THEN least(full_, 0.5) ELSE full_ END score FROM u),
w AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, r) rn FROM v)"""


def _issuer_inputs(spark, d):
    hq = F.split(norm_null("Headquarters Location"), ",")
    part = lambda k: F.coalesce(F.trim(F.get(hq, F.lit(k))), F.lit(""))
    c = load(spark, d, "companies").select(
        "org_id", norm_null("Organization_Name").alias("name"), part(0).alias("city"), part(1).alias("state"), norm_null("Postal Code").alias("postal"), norm_null("Founders").alias("founders")
    )
    i = load(spark, d, "issuers").select(
        F.col("issuer_row_id").alias("row"), cik10("CIK").alias("cik"), norm_null("ENTITYNAME").alias("name"), norm_null("CITY").alias("city"),
        norm_null("STATEORCOUNTRY").alias("state"), norm_null("ZIPCODE").alias("postal"),
    )
    keys = load(spark, d, "issuers").select(accession("ACCESSIONNUMBER").alias("accession"), cik10("CIK").alias("cik")).where("accession IS NOT NULL AND cik IS NOT NULL").distinct()
    p = load(spark, d, "relatedpersons").select(accession("ACCESSIONNUMBER").alias("accession"), norm_null("LASTNAME").alias("surname")).distinct().join(keys, "accession")
    return c, i, p


@query(ISSUER_SQL + " SELECT org_id, cik, issuer_name, score, zh AS zip_hit, ch AS city_hit, sh AS state_hit FROM w WHERE rn <= 10")
def candidate_issuers(spark, d):
    """The ten best registrants for each company by its first words, scored by name and place."""
    c, i, _ = _issuer_inputs(spark, d)
    return issuers.candidate_issuers(c, i).drop("row")


@query(ISSUER_SQL + f""", fo AS (SELECT DISTINCT org_id, {_LAST.format("regexp_replace(upper(list_last(regexp_split_to_array(trim(x), '[ ]+'))), '[^A-Z''-]', '', 'g')")} s
  FROM (SELECT org_id, unnest(string_split(f, ',')) x FROM c WHERE f IS NOT NULL) WHERE length(regexp_replace(upper(list_last(regexp_split_to_array(trim(x), '[ ]+'))), '[^A-Z''-]', '', 'g')) >= 2),
nf AS (SELECT org_id, count(*) n FROM fo WHERE s <> '' GROUP BY 1),
ac AS (SELECT DISTINCT {_acc('ACCESSIONNUMBER')} acc, {_cik('CIK')} cik FROM issuers WHERE {_acc('ACCESSIONNUMBER')} IS NOT NULL AND {_cik('CIK')} IS NOT NULL),
pe AS (SELECT DISTINCT cik, {_LAST.format('LASTNAME')} s FROM (SELECT {_acc('ACCESSIONNUMBER')} acc, {_null('LASTNAME')} LASTNAME FROM relatedpersons) JOIN ac USING (acc)),
oh AS (SELECT org_id, cik, count(*) overlap FROM (SELECT DISTINCT org_id, cik FROM w WHERE rn <= 10) JOIN fo USING (org_id) JOIN pe USING (cik, s) WHERE s <> '' GROUP BY 1, 2),
z AS (SELECT w.*, coalesce(overlap, 0) ov, coalesce(overlap, 0) / greatest(1, coalesce(n, 0)) ratio FROM w LEFT JOIN oh USING (org_id, cik) LEFT JOIN nf USING (org_id) WHERE rn <= 10 AND cik IS NOT NULL),
y AS (SELECT *, (ov >= 1 AND score >= 0.5) OR (ov = 0 AND score = 1 AND (ch OR zh)) ok FROM z),
t AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY ok DESC, CASE WHEN ok THEN ov ELSE 0 END DESC, score DESC, r) k FROM y)
SELECT org_id, CASE WHEN ok THEN cik END AS cik, issuer_name, score, CASE WHEN ok THEN ov ELSE 0 END AS overlap, CASE WHEN ok THEN ratio ELSE 0 END AS ratio FROM t WHERE k = 1""")
def best_issuer(spark, d):
    """Each company's registrant by name, place and founders' surnames."""
    c, i, p = _issuer_inputs(spark, d)
    return issuers.best_issuer(c, i, p)


# --- labels ----------------------------------------------------------------------------------------------------

_T = {"last": 'lower(trim(coalesce("Last Funding Type", \'\')))', "equity": 'lower(trim(coalesce("Last Equity Funding Type", \'\')))'}
_FIRST = {k: "CASE " + " ".join(f"WHEN contains({t}, '{w}') THEN '{n}'" for w, n in labels.REASONS.items()) + " END" for k, t in _T.items()}
LABELS = f"""WITH a AS (SELECT org_id, min(CAST(seriesA_date AS DATE)) anchor, max(seriesA_amount_usd_millions) * 1e6 amount FROM final_dataset
  WHERE regexp_full_match(seriesA_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(seriesA_date AS DATE) IS NOT NULL GROUP BY 1),
b AS (SELECT c.org_id, anchor, coalesce(amount, 0) am, "Last Funding Date" ld, "Last Funding Amount (in USD)" la, coalesce("Last Equity Funding Amount (in USD)", 0) le,
  coalesce("Total Equity Funding Amount (in USD)", 0) te, "Last Equity Funding Type" et, {_T['equity']} etl, coalesce({_FIRST['last']}, {_FIRST['equity']}, '') rs FROM companies c LEFT JOIN a USING (org_id)),
x AS (SELECT *, date_diff('day', anchor, ld) / 30.44 gap, rs = '{labels.UNKNOWN}' vu, coalesce(ld >= anchor + INTERVAL 6 MONTH AND la / nullif(greatest(am, 0), 0) >= 1.5, false) grown FROM b),
y AS (SELECT *, CASE WHEN vu THEN grown::INT ELSE (rs <> '')::INT END audit, coalesce(et IN ({', '.join(f"'{t}'" for t in labels.LATER_EQUITY)}), false)::INT bt FROM x),
z AS (SELECT *, (contains(etl, 'venture') AND bt = 0 AND coalesce(gap >= 6, false) AND (le > am OR le >= 7e6))::INT bu FROM y),
w AS (SELECT *, (am > 0 AND te > 2.0 * am AND coalesce(gap >= 6, false) AND bt + bu = 0)::INT be FROM z)"""


def _labelled(spark, d):
    day = F.when(F.col("seriesA_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("seriesA_date", "yyyy-MM-dd"))
    a = load(spark, d, "final_dataset").withColumn("anchor", day).where("anchor IS NOT NULL").groupBy("org_id").agg(
        F.min("anchor").alias("anchor"), (F.max("seriesA_amount_usd_millions") * 1e6).alias("amount")
    )
    c = load(spark, d, "companies").join(a, "org_id", "left")
    return labels.with_labels(
        c, "anchor", "amount", "Last Funding Type", "Last Equity Funding Type", "Last Funding Date", "Last Funding Amount (in USD)",
        "Last Equity Funding Amount (in USD)", "Total Equity Funding Amount (in USD)",
    )


@query(LABELS + """ SELECT org_id, audit AS label_audit, CASE WHEN vu AND NOT grown AND anchor IS NOT NULL THEN '' ELSE rs END AS reason,
  CASE WHEN vu AND grown THEN CASE WHEN la / am >= 3 THEN 'HIGH' WHEN la / am >= 2 THEN 'MEDIUM' ELSE 'LOW' END ELSE '' END AS confidence,
  greatest(bt, bu, be) AS label_primary, greatest(audit, (am > 0 AND te >= 2 * am)::INT) AS label_legacy, greatest(audit, (am > 0 AND te >= 1.5 * am)::INT) AS label_sensitivity,
  CASE WHEN audit = 1 THEN CAST(round_even(gap, 0) AS INT) END AS months_to, (greatest(bt, bu, be) = 1 AND coalesce(gap <= 36, false))::INT AS label_strict FROM w""")
def label_multi_source(spark, d):
    """All outcome labels of each company."""
    cols = ["org_id", "label_audit", "reason", "confidence", "label_primary", "label_legacy", "label_sensitivity", "months_to", "label_strict"]
    return _labelled(spark, d).select(*cols)


@query(LABELS + """ SELECT sum(bt)::BIGINT AS by_type, 0::BIGINT AS by_filing, count(*) FILTER (WHERE bu = 1 AND bt = 0) AS by_unknown,
  count(*) FILTER (WHERE be = 1 AND bt + bu = 0) AS by_equity, sum(greatest(bt, bu, be))::BIGINT AS positive, count(*) AS n FROM w""")
def label_breakdown(spark, d):
    """How many positives each source adds."""
    return labels.label_sources(_labelled(spark, d))


@query("""SELECT org_id, CASE WHEN contains(lower(coalesce("Last Funding Type", '')), 'series a') OR contains(lower(coalesce("Last Equity Funding Type", '')), 'series a') THEN "Last Funding Date" END AS vendor_date,
  CASE WHEN (contains(lower(coalesce("Last Funding Type", '')), 'series a') OR contains(lower(coalesce("Last Equity Funding Type", '')), 'series a')) AND "Last Funding Date" IS NOT NULL
   THEN coalesce(CASE WHEN "Last Equity Funding Amount (in USD)" > 0 THEN "Last Equity Funding Amount (in USD)" WHEN "Last Funding Amount (in USD)" > 0 THEN "Last Funding Amount (in USD)" END, 0) END AS vendor_amount,
  CASE WHEN """ + f"coalesce({_FIRST['last']}, {_FIRST['equity']}, '') <> ''" + """ AND coalesce(CASE WHEN "Last Equity Funding Amount (in USD)" > 0 THEN 1 END, CASE WHEN "Last Funding Amount (in USD)" > 0 THEN 1 END) = 1
   AND "Last Funding Date" >= coalesce("Founded Date", "Last Funding Date") THEN "Last Funding Date" END AS later_date FROM companies""")
def vendor_rounds(spark, d):
    """The vendor's own first round and later round; a later one before the firm was founded is taken out."""
    cols = ["Last Funding Type", "Last Equity Funding Type", "Last Funding Date", "Last Equity Funding Amount (in USD)", "Last Funding Amount (in USD)"]
    c = filings.vendor_later(filings.vendor_anchor(load(spark, d, "companies"), *cols), *cols)
    c = filings.invalidate_before(c, "vendor_later_date", "Founded Date", "vendor_later_amount")
    return c.select("org_id", "vendor_date", "vendor_amount", F.col("vendor_later_date").alias("later_date"))


# --- names -------------------------------------------------------------------------------------------------------

def _strip(x: str, words: list[str], to: str) -> str:
    """Whole words taken out of a text in SQL, where only ASCII letters make words."""
    body = "|".join(sorted((w.replace(".", "\\.") for w in words), key=lambda w: (-len(w), w)))
    return f"regexp_replace({x}, '\\b(?:{body})\\b\\.?', '{to}', 'gi')"


@query(f"""WITH n AS (SELECT org_id, Organization_Name x, Founders f, "Headquarters Location" hq, "Diversity Spotlight" ds FROM companies),
p AS (SELECT *, {_strip("coalesce(x, '')", M.CORE_SUFFIXES, '')} core, trim(regexp_replace({_strip('lower(trim(x))', M.FOUNDER_NAME_SUFFIXES, '')}, '[^a-z]+', ' ', 'g')) clean FROM n)
SELECT org_id, greatest(1, len(list_filter(regexp_split_to_array(core, '\\s+'), lambda w: length(w) >= 2))) AS core_words,
  coalesce(regexp_matches(lower(x), '\\b(ai|labs?|tech|technologies|systems|robotics|bio|therapeutics|health)\\b'), false)::INT AS tech_word,
  coalesce(regexp_matches(lower(ds), 'women|diverse'), false)::INT AS diverse, coalesce(contains(lower(hq), 'delaware'), false)::INT AS delaware,
  coalesce(len(list_intersect(string_split(clean, ' '), list_filter(regexp_split_to_array(regexp_replace(lower({_null('f')}), '[^a-z]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 4 AND t NOT IN ('prof', 'with', 'from', 'corp')))) > 0, false)::INT AS founder_named,
  {_strip("trim(x)", M.PATENT_SUFFIXES, ' ').join(["upper(regexp_replace(trim(regexp_replace(", ", '\\s+', ' ', 'g')), '[^A-Za-z0-9 &''.,-]', '', 'g'))"])} AS patent_name FROM p""")
def name_features(spark, d):
    """What a company's name, place and founders tell."""
    c = load(spark, d, "companies")
    return c.select(
        "org_id", M.core_word_count("Organization_Name").alias("core_words"), M.has_word("Organization_Name", M.TECH_WORDS).alias("tech_word"),
        M.contains_any("Diversity Spotlight", ["women", "diverse"]).alias("diverse"), M.contains_any("Headquarters Location", ["delaware"]).alias("delaware"),
        M.founder_in_name("Organization_Name", "Founders").alias("founder_named"), M.patent_name("Organization_Name").alias("patent_name"),
    )


_HOST = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '^https?://', ''), '[/?].*$', ''), '^www\\.', ''))"


@query(f"""WITH h AS (SELECT org_id, Website w, {_HOST.format('Website')} h FROM companies WHERE {_null('Website')} IS NOT NULL)
SELECT org_id, h AS host, split_part(regexp_replace(regexp_replace(lower(trim(w)), '^https?://', ''), '/.*$', ''), '.', 1) AS label,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(w)), '^https?://', ''), '/.*$', ''), '^www\\.', ''), '\\.(com|io|ai|co|net|org|tech|app|dev)$', ''), '[^a-z0-9]', '', 'g') AS slug,
  CASE WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS registrable FROM h""")
def domain_forms(spark, d):
    """A website as host, first label, slug and registrable domain."""
    c = load(spark, d, "companies").where(norm_null("Website").isNotNull())
    return c.select("org_id", M.domain_host("Website").alias("host"), M.domain_label("Website").alias("label"), M.domain_slug("Website").alias("slug"), M.registrable_domain("Website").alias("registrable"))


@query(f"SELECT org_id, {_bucket_sql('Industries')} AS sector, regexp_matches(lower(original), '/careers|/jobs|/hiring|/join-us|/join')::INT AS careers, count(*) AS n FROM companies JOIN wayback_pages ON {_HOST.format('domain_clean_')} = {_HOST.format('original')} GROUP BY 1, 2, 3".replace("FROM companies", "FROM (SELECT org_id, Industries, domain_clean domain_clean_ FROM companies)"))
def careers_flag(spark, d):
    """Captured pages per company, those where it seeks people apart."""
    c = load(spark, d, "companies").select("org_id", X.keyword_bucket("Industries").alias("sector"), M.domain_host("domain_clean").alias("h"))
    p = load(spark, d, "wayback_pages").groupBy(M.domain_host("original").alias("h"), M.careers_flag("original").alias("careers")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(p, "h").groupBy("org_id", "sector", "careers").agg(F.sum("n").alias("n"))
