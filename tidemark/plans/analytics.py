"""Queries for the engine's relational, sequence, text and metric operators, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.keys import domain_norm
from tidemark.operators import evaluation, features, incremental, matching, metrics, models, sequences, signals
from tidemark.sources.tables import load, norm_null
from tidemark.streaming.windows import windowed_counts

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


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("e"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("amount"), "o_orderstatus", "o_orderpriority")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Per user the anchor: five days before the last event of all."""
    e = load(spark, d, "events")
    last = e.agg(F.date_sub(F.max(F.col("ts").cast("date")), 5)).scalar()
    return e.select("user_id").distinct().withColumn("anchor", last)


ANCHORS = "a AS (SELECT DISTINCT user_id, (SELECT max(CAST(ts AS DATE)) - 5 FROM events) anchor FROM events)"


# --- events and clusters -------------------------------------------------------------------------------

CLUSTERS = """WITH RECURSIVE x AS (SELECT DISTINCT o_custkey e, CAST(o_orderdate AS DATE) d FROM orders),
r AS (SELECT e, min(d) s FROM x GROUP BY e UNION ALL SELECT r.e, min(x.d) FROM r JOIN x ON x.e = r.e AND x.d > r.s + 120 GROUP BY r.e, r.s),
c AS (SELECT o_custkey e, o_orderkey, o_totalprice amount, CAST(o_orderdate AS DATE) d,
  (SELECT max(s) FROM r WHERE r.e = o_custkey AND r.s <= CAST(o_orderdate AS DATE)) s FROM orders),
g AS (SELECT e, s AS cluster_start, round(sum(amount), 2) AS amount, count(*) AS n FROM c GROUP BY 1, 2)"""


def _clusters(spark, d):
    ev = sequences.anchored_clusters(_orders(spark, d), "e", "day")
    return ev.groupBy("e", "cluster_start").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count(F.lit(1)).alias("n"))


@query(CLUSTERS + " SELECT e, cluster_start, amount, n FROM g")
def anchored_clusters(spark, d):
    """Clusters of at most 120 days from their first event, with amount and size."""
    return _clusters(spark, d)


# --- as-of -----------------------------------------------------------------------------------------------

THIRD = "t AS (SELECT o_custkey e, CAST(o_orderdate AS DATE) anchor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 3)"


def _third(spark, d):
    w = sequences.Window.partitionBy("e").orderBy("day", "o_orderkey")
    return _orders(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 3").select("e", F.col("day").alias("anchor"))


@query(f"WITH {THIRD} SELECT t.e, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < anchor) AS n_before FROM t JOIN orders ON o_custkey = t.e GROUP BY 1")
def prior_rounds_strict(spark, d):
    """Events strictly before the anchor."""
    return _orders(spark, d).join(_third(spark, d), "e").groupBy("e").agg(F.count_if(F.col("day") < F.col("anchor")).alias("n_before"))


@query(f"""WITH {THIRD} SELECT t.e, count(DISTINCT l_suppkey) FILTER (WHERE l_linenumber <= 3) AS n_directors, max(CAST(l_quantity AS INTEGER)) AS most
FROM t JOIN orders ON o_custkey = t.e AND CAST(o_orderdate AS DATE) <= anchor + 90 JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def buffered_directors(spark, d):
    """Distinct persons and the greatest count up to 90 days after the anchor."""
    o = _orders(spark, d).join(_third(spark, d), "e").where(F.col("day") <= F.date_add("anchor", 90))
    li = load(spark, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("e").agg(
        F.count_distinct(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("n_directors"), F.max(F.col("l_quantity").cast("int")).alias("most")
    )


@query(f"""WITH {ANCHORS}, r AS (SELECT a.user_id, event_id, event_type, row_number() OVER (PARTITION BY a.user_id ORDER BY (event_type = 'view') DESC, ts DESC, event_id DESC) rn
FROM a JOIN events e ON e.user_id = a.user_id AND CAST(ts AS DATE) <= anchor) SELECT user_id, event_id, event_type FROM r WHERE rn = 1""")
def asof_latest_snapshot(spark, d):
    """The latest snapshot at or before the anchor, those of a kind preferred."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("date").alias("day"), F.col("ts").alias("at"))
    a = _anchors(spark, d)
    e = e.withColumn("r", F.struct("at", "event_id", "event_type")).select("user_id", "day", "r")
    got = sequences.latest_before(a, e, "user_id", "anchor", "day", prefer=F.col("r.event_type") == "view")
    return got.where("found IS NOT NULL").select("user_id", "found.r.event_id", "found.r.event_type")


WINDOWS = f"""{ANCHORS}, w AS (SELECT a.user_id, count(*) FILTER (WHERE anchor - CAST(ts AS DATE) BETWEEN 0 AND 14) AS n14,
  count(*) FILTER (WHERE anchor - CAST(ts AS DATE) BETWEEN 1 AND 3) AS n3 FROM a LEFT JOIN events e ON e.user_id = a.user_id GROUP BY 1)"""


def _window_counts(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return sequences.window_counts(_anchors(spark, d), e, "user_id", "anchor", "day", {"n14": (14, 0), "n3": (3, 1)})


@query(f"WITH {WINDOWS} SELECT user_id, n14, n3 FROM w")
def window_counts(spark, d):
    """Signals in the 14 days to the anchor, and in the 3 days before it without its own day."""
    return _window_counts(spark, d).select("user_id", "n14", "n3")


@query(f"WITH {WINDOWS} SELECT user_id, CASE WHEN n14 > 0 THEN round_even(4.0 * n3 / n14, 3) ELSE 0 END AS acceleration FROM w")
def acceleration_ratio(spark, d):
    """Recent signals against the whole window, 0 without any."""
    return _window_counts(spark, d).select("user_id", N.ratio(F.lit(4.0) * F.col("n3"), "n14", 3).alias("acceleration"))


@query(f"WITH {ANCHORS} SELECT a.user_id, max(CASE WHEN event_type = 'error' AND CAST(ts AS DATE) <= anchor THEN 1 ELSE 0 END) AS has_error FROM a JOIN events e ON e.user_id = a.user_id GROUP BY 1")
def existence_flag(spark, d):
    """Whether a kind of signal exists up to the anchor."""
    e = load(spark, d, "events").join(_anchors(spark, d), "user_id")
    return e.groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "error") & (F.col("ts").cast("date") <= F.col("anchor")), 1).otherwise(0)).alias("has_error"))


@query("WITH c AS (SELECT user_id, count(*) n FROM events GROUP BY 1) SELECT user_id, CASE WHEN n >= 70 THEN 0 ELSE n END AS n, CASE WHEN n >= 70 THEN 'noisy' ELSE 'ok' END AS note FROM c")
def noise_cap(spark, d):
    """Counts that reach the source's cap say nothing and become 0."""
    c = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", signals.noise_cap(F.col("n"), 70).alias("n"), F.when(F.col("n") >= 70, "noisy").otherwise("ok").alias("note"))


@query("""WITH f AS (SELECT o_custkey e, min(CAST(o_orderdate AS DATE)) founded FROM orders GROUP BY 1)
SELECT o_orderkey, (founded IS NULL OR founded - CAST(l AS DATE) <= 365) AS passes FROM (SELECT o_orderkey, o_custkey, min(l_shipdate) l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) JOIN f ON e = o_custkey + 1""")
def founding_gate(spark, d):
    """Signals that start more than a year before the entity did are not its own."""
    o = _orders(spark, d)
    f = o.groupBy((F.col("e") - 1).alias("e")).agg(F.min("day").alias("founded"))
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("l"))
    passes = signals.founding_gate(F.col("founded"), F.col("l").cast("date"), 365)
    return o.join(li, "o_orderkey").join(f, "e").select("o_orderkey", passes.alias("passes"))


# --- matching --------------------------------------------------------------------------------------------

PARTS = "p AS (SELECT DISTINCT p_name n FROM part)"


@query(f"""WITH {PARTS}, t AS (SELECT n, list_filter(string_split(regexp_replace(lower(n), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda x: length(x) >= 2) l FROM p)
SELECT a.n AS left_name, b.n AS right_name, len(list_intersect(a.l, b.l)) * 1.0 / len(list_distinct(list_concat(a.l, b.l))) AS score
FROM t a JOIN t b ON len(list_intersect(a.l[1:1], b.l)) = 1""")
def token_candidates(spark, d):
    """Names that hold the first token of another, by an inverted index, with their Jaccard similarity."""
    p = load(spark, d, "part").select(F.col("p_name").alias("n")).distinct()
    c = matching.token_candidates(p.select(F.col("n").alias("a"), "n"), p.select(F.col("n").alias("b"), "n"), "a", "n", "b", "n", tokens=1)
    full = X.jaccard(X.company_tokens("a"), X.company_tokens("b"))
    return c.select(F.col("a").alias("left_name"), F.col("b").alias("right_name"), full.alias("score"))


@query("""WITH t AS (SELECT DISTINCT p_name n FROM part), v AS (SELECT upper(n) || s AS value FROM t CROSS JOIN (VALUES (''), (' INC'), (', LLC'), (' COMPANY'), ('X INC')) x(s))
SELECT upper(n) AS target, value FROM t JOIN v ON value = upper(n) OR value LIKE upper(n) || ' INC%' OR value LIKE upper(n) || ' CO%' OR value LIKE upper(n) || ',%'""")
def like_prefix_join(spark, d):
    """Prefix matches of names with legal endings, on an equi-key with LIKE as residual."""
    t = load(spark, d, "part").select(F.upper("p_name").alias("target")).distinct()
    v = t.select(F.explode(F.array(*[F.concat("target", F.lit(s)) for s in ("", " INC", ", LLC", " COMPANY", "X INC")])).alias("value"))
    return matching.prefix_join(t, v, "target", "value", [" INC", " CO", ","])


NAMED = """c AS (SELECT org_id, trim(regexp_replace(regexp_replace(lower(trim(Organization_Name)), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) n FROM companies),
i AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(trim(ENTITYNAME)), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) m FROM issuers WHERE ENTITYNAME IS NOT NULL)"""


@query(f"""WITH {NAMED} SELECT org_id, m AS issuer_name, CASE WHEN n = m THEN 2 WHEN starts_with(m, n || ' ') OR starts_with(n, m || ' ') THEN 2 ELSE 1 END AS tier
FROM c JOIN i ON n <> '' AND m <> '' AND (n = m OR contains(m, n) OR contains(n, m))""")
def name_tier_match(spark, d):
    """Equal, beginning and containing names, whatever their first words."""
    c = load(spark, d, "companies").select("org_id", X.norm_text("Organization_Name").alias("n")).where("n <> ''")
    i = load(spark, d, "issuers").where("ENTITYNAME IS NOT NULL").select(X.norm_text("ENTITYNAME").alias("m")).where("m <> ''").distinct()
    return matching.containing_names(c, i, "n", "m").select("org_id", F.col("m").alias("issuer_name"), "tier")


DOM = "regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^(www\\.)+', '')"


@query(f"SELECT page_id, rtrim({DOM.format('original')}) AS domain, coalesce(nullif(rtrim(regexp_extract(lower(original), '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1), '/'), ''), '/') AS path FROM wayback_pages")
def domain_normalize(spark, d):
    """Domain and path of archived addresses."""
    return load(spark, d, "wayback_pages").select("page_id", domain_norm("original").alias("domain"), X.url_path("original").alias("path"))


@query(f"""WITH c AS (SELECT org_id, {DOM.format('domain_clean')} k FROM companies WHERE domain_clean IS NOT NULL AND trim(domain_clean) NOT IN ('', 'nan', 'None', 'NaT')),
p AS (SELECT page_id, {DOM.format('original')} k FROM wayback_pages)
SELECT org_id, count(*) AS n_pages, count(DISTINCT page_id) AS n_distinct FROM c JOIN p USING (k) GROUP BY 1""")
def domain_join(spark, d):
    """Archived pages per company by normalised domain; pages are counted per domain before the join."""
    c = load(spark, d, "companies").select("org_id", domain_norm("domain_clean").alias("k")).where("k IS NOT NULL")
    p = load(spark, d, "wayback_pages").select("page_id", domain_norm("original").alias("k"))
    per = p.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("m"))
    return c.join(per, "k").groupBy("org_id").agg(F.sum("n").alias("n_pages"), F.sum("m").alias("n_distinct"))


@query("""WITH n AS (SELECT DISTINCT lower(trim(Organization_Name)) k, min(org_id) org FROM companies WHERE Organization_Name IS NOT NULL GROUP BY 1),
a AS (SELECT assignee_row_id, lower(trim(assignee_name)) k FROM patent_assignees),
p1 AS (SELECT assignee_row_id r, org, 1 AS pass FROM a JOIN n USING (k)),
p2 AS (SELECT assignee_row_id r, org, 2 AS pass FROM a JOIN n ON starts_with(a.k, n.k || ' ') AND split_part(a.k, ' ', 1) = split_part(n.k, ' ', 1)),
u AS (SELECT * FROM p1 UNION ALL SELECT DISTINCT * FROM p2), b AS (SELECT r, min(pass) pass FROM u GROUP BY 1)
SELECT r AS row_id, pass, min(org) AS org_id, count(DISTINCT org) AS rivals FROM u JOIN b USING (r, pass) GROUP BY 1, 2""")
def priority_match(spark, d):
    """Equal names first, then names with an ending; the first pass that matches counts."""
    n = load(spark, d, "companies").where("Organization_Name IS NOT NULL").groupBy(F.lower(F.trim("Organization_Name")).alias("k")).agg(F.min("org_id").alias("org_id"))
    a = load(spark, d, "patent_assignees").select(F.col("assignee_row_id").alias("row_id"), F.lower(F.trim("assignee_name")).alias("k"))
    one = a.join(n, "k").select("row_id", "org_id")
    first = lambda df: df.withColumn("f", F.split("k", " ")[0])
    two = first(a).alias("a").join(first(n).alias("n"), (F.col("a.f") == F.col("n.f")) & F.startswith(F.col("a.k"), F.concat("n.k", F.lit(" ")))).select("row_id", "org_id")
    return matching.priority_match([one, two], "row_id", "org_id")


@query("""WITH b AS (SELECT p_partkey k, p_size / 50.0 AS base, p_brand = 'Brand#11' AS z, p_size > 25 AS c, p_type LIKE 'A%' AS s, p_size % 3 = 0 AS v FROM part),
f AS (SELECT *, CASE WHEN base < 0.5 THEN base ELSE least(1.0, base + 0.25 * z::INT + 0.15 * c::INT + 0.10 * s::INT) END full_ FROM b)
SELECT k, CASE WHEN v AND NOT z THEN least(full_, 0.5) ELSE full_ END AS score FROM f""")
def location_score(spark, d):
    """A name score with bonuses for places, vague names held down."""
    p = load(spark, d, "part")
    v = (F.col("p_size") % 3) == 0
    s = matching.location_score(F.col("p_size") / 50.0, F.col("p_brand") == "Brand#11", F.col("p_size") > 25, F.col("p_type").like("A%"), v)
    return p.select(F.col("p_partkey").alias("k"), s.alias("score"))


# --- text ------------------------------------------------------------------------------------------------

@query("""SELECT org_id, len(list_filter(regexp_split_to_array(Organization_Name, '\\s+'), lambda x: x <> '')) AS words,
  left(trim(regexp_replace(lower(Organization_Name), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS slug FROM companies WHERE Organization_Name IS NOT NULL""")
def word_count_features(spark, d):
    """Words and slug of a name."""
    c = load(spark, d, "companies").where("Organization_Name IS NOT NULL")
    return c.select("org_id", X.word_count("Organization_Name").alias("words"), X.slug("Organization_Name").alias("slug"))


@query("""WITH s AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') b, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '-') c FROM part),
l AS (SELECT b, unnest([b, c, b || '-2', b || '-3', c || 'db', c || 'io', c || 'app', c || 'hq', c || 'ai']) AS candidate FROM s) SELECT DISTINCT b AS base, candidate FROM l""")
def slug_candidates(spark, d):
    """Slugs under which a name may be listed."""
    p = load(spark, d, "part").select("p_name").distinct()
    return p.select(X.slug("p_name").alias("base"), F.explode(X.slug_candidates("p_name")).alias("candidate")).distinct()


def _bucket_sql(text: str) -> str:
    norm = f"trim(regexp_replace(regexp_replace(lower(trim({text})), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({norm}, '{w}')" for w in words) + f" THEN '{k}'" for k, words in X.BUCKETS.items()) + f" ELSE '{X.OTHER_BUCKET}' END"


@query(f"SELECT org_id, {_bucket_sql('Industries')} AS bucket FROM companies")
def keyword_bucket(spark, d):
    """The first line of business whose keywords occur."""
    return load(spark, d, "companies").select("org_id", X.keyword_bucket("Industries").alias("bucket"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: length(x) > 20) l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(l) AS sent, unnest(range(1, len(l) + 1)) AS pos FROM s),
h AS (SELECT *, max(CASE WHEN contains(lower(sent), 'round') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) keep FROM e)
SELECT doc_id, count(*) AS n, sum(length(sent)) AS chars FROM h WHERE keep = 1 GROUP BY 1""")
def sentence_window(spark, d):
    """Sentences with an anchor word and the three after them, with their length."""
    s = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sent"))
    w = sequences.Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-3, 0)
    s = s.withColumn("keep", F.max(F.when(F.contains(F.lower("sent"), F.lit("round")), 1).otherwise(0)).over(w)).where("keep = 1")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sent")).alias("chars"))


@query("""WITH p AS (SELECT page_id, lower(full_text) t, length(full_text) n FROM wayback_pages WHERE full_text IS NOT NULL)
SELECT page_id, (n < 600 AND (contains(t, 'not found') OR contains(t, '404'))) AS soft_404,
 (CAST(contains(t, 'cookie') AS INT) + CAST(contains(t, 'consent') AS INT) + CAST(contains(t, 'privacy') AS INT)) >= 2 AND n > 600 AS cookie_wall,
 contains(t, 'lorem ipsum') OR n < 200 AS placeholder FROM p""")
def soft404_filter(spark, d):
    """Plain rules for missing pages, consent walls and placeholder texts."""
    p = load(spark, d, "wayback_pages").where("full_text IS NOT NULL").select("page_id", F.lower("full_text").alias("t"), F.length("full_text").alias("n"))
    has = lambda s: F.contains(F.col("t"), F.lit(s))
    cookies = has("cookie").cast("int") + has("consent").cast("int") + has("privacy").cast("int")
    return p.select(
        "page_id", ((F.col("n") < 600) & (has("not found") | has("404"))).alias("soft_404"), ((cookies >= 2) & (F.col("n") > 600)).alias("cookie_wall"),
        (has("lorem ipsum") | (F.col("n") < 200)).alias("placeholder"),
    )


@query("""SELECT org_id, contains(lower("Full Description"), lower(trim(Organization_Name))) AND length(trim(Organization_Name)) >= 8 AS verified
FROM companies WHERE "Full Description" IS NOT NULL AND Organization_Name IS NOT NULL""")
def quote_verification(spark, d):
    """Whether a quote occurs literally in the text it is said to come from."""
    c = load(spark, d, "companies").where("`Full Description` IS NOT NULL AND Organization_Name IS NOT NULL")
    return c.select("org_id", X.quote_verified("Full Description", "Organization_Name").alias("verified"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_facts(spark, d):
    """Fields of JSON texts."""
    e = load(spark, d, "events").select("event_type", X.json_object("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT person_row_id r, unnest(string_split(LASTNAME, ',')) x FROM relatedpersons WHERE LASTNAME IS NOT NULL),
s AS (SELECT DISTINCT r, regexp_replace(translate(upper(list_last(regexp_split_to_array(trim(x), '[ \\t\\n]+'))), 'ß', ''), '[^A-Z''-]', '', 'g') s FROM p)
SELECT r AS person_row_id, string_agg(s, '|' ORDER BY s) AS surnames FROM s WHERE length(s) >= 2 GROUP BY 1""")
def surname_extract(spark, d):
    """The surnames of each cell, as matching keys."""
    p = load(spark, d, "relatedpersons").select("person_row_id", F.array_join(X.surnames(F.translate("LASTNAME", "ß", "")), "|").alias("surnames"))
    return p.where("surnames <> ''")


# --- arrays, dates, numbers ------------------------------------------------------------------------------

@query(f"""WITH {THIRD}, l AS (SELECT o_custkey e, list(CAST(o_orderdate AS DATE)) ds FROM orders GROUP BY 1)
SELECT t.e, len(list_filter(ds, lambda x: x <= anchor)) AS n_releases, list_min(ds) AS first_release FROM t JOIN l USING (e)""")
def array_gate(spark, d):
    """Array elements up to the anchor, and the earliest; the arrays hold an entity's distinct rows of one table."""
    o = _orders(spark, d).join(_third(spark, d), "e")
    return o.groupBy("e").agg(F.count_if(F.col("day") <= F.col("anchor")).alias("n_releases"), F.min("day").alias("first_release"))


PHASES = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "4-LOW": 0.5}


@query("""SELECT o_custkey AS e, min(p) AS lowest, max(p) AS highest FROM (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4.0::DOUBLE WHEN '2-HIGH' THEN 3.0 WHEN '3-MEDIUM' THEN 2.0 WHEN '4-LOW' THEN 0.5 END p FROM orders) GROUP BY 1""")
def phase_min_max(spark, d):
    """Lowest and highest of mapped ordinal labels."""
    m = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    return _orders(spark, d).groupBy("e").agg(F.min(m[F.col("o_orderpriority")]).alias("lowest"), F.max(m[F.col("o_orderpriority")]).alias("highest"))


@query("""WITH f AS (SELECT lower(trim(assignee_name)) k, n_patents, last_filing, sample_titles FROM patent_assignees WHERE assignee_name IS NOT NULL AND trim(assignee_name) NOT IN ('', 'nan', 'None', 'NaT'))
SELECT k AS assignee, sum(n_patents) AS patents, min(last_filing) AS first_seen, max(last_filing) AS last_seen, count(*) AS n_rows, sum(len(sample_titles)) AS titles FROM f GROUP BY 1""")
def assignee_totals(spark, d):
    """Patents, first and last filing per name as written, but for case."""
    p = load(spark, d, "patent_assignees").where(norm_null("assignee_name").isNotNull())
    return p.groupBy(F.lower(F.trim("assignee_name")).alias("assignee")).agg(
        F.sum("n_patents").alias("patents"), F.min("last_filing").alias("first_seen"), F.max("last_filing").alias("last_seen"),
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("sample_titles").isNotNull(), F.size("sample_titles"))).alias("titles"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS int_date,
 round(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.44, 6) AS months, CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS plus_six FROM orders""")
def date_arithmetic(spark, d):
    """Quarter labels, integer dates, counted months and calendar months."""
    day = F.col("day")
    return _orders(spark, d).select(
        "o_orderkey", N.quarter_label(day).alias("quarter"), N.int_date(day).alias("int_date"),
        F.round(N.months_between_days(day, F.lit("1995-01-01").cast("date")), 6).alias("months"), F.add_months(day, 6).cast("timestamp_ntz").alias("plus_six"),
    )


@query("""WITH x AS (SELECT row_number() OVER () i, *, TRY_CAST(replace(replace(trim(TOTALAMOUNTSOLD), ',', ''), '$', '') AS DOUBLE) s, TRY_CAST(replace(replace(trim(TOTALOFFERINGAMOUNT), ',', ''), '$', '') AS DOUBLE) o FROM offering)
SELECT CASE WHEN s > 0 AND NOT isnan(s) THEN 'HIGH' WHEN o > 0 AND NOT isnan(o) THEN 'MED' ELSE 'LOW' END AS confidence, count(*) AS n FROM x GROUP BY 1""")
def amount_confidence(spark, d):
    """How sure the amounts are: sold, else offered, else none."""
    o = load(spark, d, "offering").select(N.safe_float("TOTALAMOUNTSOLD").alias("s"), N.safe_float("TOTALOFFERINGAMOUNT").alias("o"))
    return o.groupBy(F.when(F.col("s") > 0, "HIGH").when(F.col("o") > 0, "MED").otherwise("LOW").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT final_id, round(ln(1 + greatest(0, coalesce(wayback_snapshots_12m_preA, 0))), 12) AS log_snapshots, CASE WHEN name_word_count > 0 THEN round_even(coalesce(deeptech_llm_score, 0) * 1.0 / name_word_count, 2) ELSE 0 END AS per_word,
 coalesce(seriesA_amount_usd_millions, 0) / greatest(coalesce(age_at_seriesA_years, 1), 1) AS per_year FROM final_dataset""")
def log_features(spark, d):
    """Logarithms, guarded ratios and rates."""
    f = load(spark, d, "final_dataset")
    age = F.greatest(F.coalesce("age_at_seriesA_years", F.lit(1.0)), F.lit(1.0))
    return f.select(
        "final_id", F.round(N.log_count("wayback_snapshots_12m_preA"), 12).alias("log_snapshots"),
        N.ratio(F.coalesce("deeptech_llm_score", F.lit(0)) * 1.0, "name_word_count", 2).alias("per_word"),
        (F.coalesce("seriesA_amount_usd_millions", F.lit(0.0)) / age).alias("per_year"),
    )


SIGNS = ["wayback_snapshots_12m_preA", "gdelt_mentions_3m_preA", "edgar_filings_preA", "hn_mention_count_preA", "pkg_before_seriesA"]


@query("SELECT final_id, least(3, " + " + ".join(f"CAST(coalesce({c}, 0) > 0 AS INT)" for c in SIGNS) + ") AS visibility FROM final_dataset")
def visibility_score(spark, d):
    """How many signals an entity has, 3 at most."""
    return load(spark, d, "final_dataset").select("final_id", features.active_count(SIGNS, 3).alias("visibility"))


@query("""SELECT final_id, coalesce(edgar_filings_preA, 0) AS edgar_filings_preA, coalesce(age_at_seriesA_years, (SELECT median(age_at_seriesA_years) FROM final_dataset)) AS age_at_seriesA_years FROM final_dataset""")
def impute_zero_median(spark, d):
    """Counts imputed by 0, measures by the median."""
    f = load(spark, d, "final_dataset").select("final_id", "edgar_filings_preA", "age_at_seriesA_years")
    return features.impute(f, ["edgar_filings_preA"], ["age_at_seriesA_years"])


@query("""WITH y AS (SELECT o_orderkey, year(o_orderdate) y FROM orders), p AS (SELECT CAST(trunc(quantile_cont(y, 0.8)) AS INT) hi, CAST(trunc(quantile_cont(y, 0.7)) AS INT) lo FROM y),
s AS (SELECT avg(CASE WHEN y >= hi THEN 1.0 ELSE 0 END) sh FROM y, p) SELECT o_orderkey, CASE WHEN y < CASE WHEN sh < 0.1 THEN lo ELSE hi END THEN 'train' ELSE 'test' END AS split FROM y, p, s""")
def temporal_split_p80(spark, d):
    """Train before the 80th percentile of years, test from it on."""
    return features.temporal_split(_orders(spark, d).select("o_orderkey", F.year("day").alias("y")), "y").select("o_orderkey", "split")


# --- relational --------------------------------------------------------------------------------------------

@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn = 1""")
def dedup_keep_first(spark, d):
    """The first row of each key in a stated order."""
    li = load(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")]
    return sequences.keep(li, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH o AS (SELECT o_custkey e, max(o_orderkey) k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), n AS (SELECT o_custkey e, max(o_orderkey) k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(n.e, o.e) AS e, coalesce(n.k, o.k) AS k, n.k IS NOT NULL AS is_new FROM o FULL JOIN n ON o.e = n.e""")
def stack_upsert_keep_last(spark, d):
    """Two generations stacked, the newer row of a key kept."""
    o = _orders(spark, d)
    old = o.where("o_orderstatus <> 'F'").groupBy("e").agg(F.max("o_orderkey").alias("k"))
    new = o.where("o_orderstatus = 'F'").groupBy("e").agg(F.max("o_orderkey").alias("k")).withColumn("is_new", F.lit(True))
    return sequences.stack_upsert(old, new, ["e"], [F.desc("k")]).fillna(False, ["is_new"])


@query("""SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_events, 0) AS n_events, coalesce(n_urgent, 0) AS n_urgent FROM customer
LEFT JOIN (SELECT o_custkey, count(*) n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) n_events FROM events GROUP BY 1) ON user_id = c_custkey
LEFT JOIN (SELECT o_custkey u, count(*) n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON u = c_custkey""")
def signal_merge_fold(spark, d):
    """Signal fragments joined to the cohort, absent ones 0."""
    base = load(spark, d, "customer").select("c_custkey")
    o = _orders(spark, d)
    frag = [
        o.groupBy(F.col("e").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders")),
        load(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events")),
        o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("e").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_urgent")),
    ]
    return sequences.merge_fragments(base, frag, "c_custkey", {"n_orders": 0, "n_events": 0, "n_urgent": 0})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_custkey LIMIT 50")
def ledger_next_batch(spark, d):
    """The next 50 entities that the ledger doesn't hold: the limit is the batch."""
    done = _orders(spark, d).where("o_orderstatus = 'P'").select(F.col("e").alias("c_custkey"))
    return sequences.next_batch(load(spark, d, "customer").select("c_custkey"), done, "c_custkey", 50, [F.col("c_custkey")])


@query("""SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dimension_join(spark, d):
    """A fact table with small dimensions."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_totals(spark, d):
    """Map-side combined totals."""
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


# --- metrics -------------------------------------------------------------------------------------------------

def _scored(spark, d):
    f = load(spark, d, "final_dataset").where("label IS NOT NULL")
    return f.select("final_id", F.col("label").cast("int").alias("y"), F.coalesce("edgar_filings_preA", F.lit(0)).cast("double").alias("s"), F.coalesce("wayback_snapshots_12m_preA", F.lit(0)).cast("double").alias("w"), (F.col("final_id") % 5).alias("fold"))


S = "s AS (SELECT final_id, CAST(label AS INT) y, CAST(coalesce(edgar_filings_preA, 0) AS DOUBLE) s, CAST(coalesce(wayback_snapshots_12m_preA, 0) AS DOUBLE) w, final_id % 5 AS fold FROM final_dataset WHERE label IS NOT NULL)"
AUC = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"


@query(f"WITH {S}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 r FROM s) SELECT round({AUC}, 9) AS auc FROM k")
def roc_auc_exact(spark, d):
    """Rank-sum AUC with mid-ranks."""
    return metrics.roc_auc(_scored(spark, d), "s", "y").select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {S}, g AS (SELECT s, sum(y) p, count(*) n FROM s GROUP BY 1), c AS (SELECT p, sum(p) OVER w tp, sum(n) OVER w al FROM g WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(p * tp * 1.0 / al) / sum(p), 9) AS ap FROM c""")
def average_precision(spark, d):
    """Step-wise average precision."""
    return metrics.average_precision(_scored(spark, d), "s", "y").select(F.round("ap", 9).alias("ap"))


@query(f"""WITH {S}, g AS (SELECT s, sum(y) p, count(*) - sum(y) q FROM s GROUP BY 1)
SELECT s AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp FROM g WINDOW w AS (ORDER BY s DESC)""")
def roc_points(spark, d):
    """A point per distinct score."""
    return metrics.curve_points(_scored(spark, d), "s", "y").select("threshold", "tp", "fp")


@query(f"""WITH {S}, n AS (SELECT count(*) c FROM s), q AS (SELECT q, greatest(1, CAST(floor(c * q) AS INT)) k FROM n, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2)) t(q)),
r AS (SELECT y, row_number() OVER (ORDER BY s DESC, final_id) rn FROM s) SELECT q, k, CAST(sum(y) AS BIGINT) AS hits FROM r JOIN q ON rn <= k GROUP BY 1, 2""")
def precision_at_q(spark, d):
    """Hits among the top shares."""
    return metrics.precision_at(_scored(spark, d), "s", "y", "final_id", [0.01, 0.05, 0.1, 0.2]).select("q", "k", "hits")


NUMERIC = [
    "wayback_snapshots_12m_preA", "gdelt_mentions_3m_preA", "age_at_seriesA_years", "seriesA_amount_usd_millions", "Number of Founders", "name_word_count",
    "deeptech_llm_score", "edgar_filings_preA", "hn_mention_count_preA", "pkg_before_seriesA",
]
_U = " UNION ALL ".join(f"SELECT '{c}' feature, final_id % 5 AS fold, label::INT y, coalesce(\"{c}\"::DOUBLE, 0) v FROM final_dataset WHERE label IS NOT NULL" for c in NUMERIC)
AUDIT = f"""WITH u AS ({_U}), k AS (SELECT feature, fold, y, rank() OVER (PARTITION BY feature, fold ORDER BY v) + (count(*) OVER (PARTITION BY feature, fold, v) - 1) / 2.0 r FROM u),
a AS (SELECT feature, fold, {AUC} auc FROM k GROUP BY 1, 2), f AS (SELECT DISTINCT fold FROM u),
c AS (SELECT u.feature, f.fold, count(*) * sum(v * y) - sum(v) * sum(y) < 0 falls FROM u JOIN f ON f.fold <> u.fold GROUP BY 1, 2),
m AS (SELECT feature, avg(CASE WHEN falls THEN 1 - auc ELSE auc END) auc FROM a JOIN c USING (feature, fold) GROUP BY 1),
g AS (SELECT feature, avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0 END) cov, corr(v, y) r, min(v) < max(v) varies FROM u GROUP BY 1),
z AS (SELECT feature, CASE WHEN varies THEN auc END auc, cov, r FROM m JOIN g USING (feature))"""


def _audit(spark, d):
    f = load(spark, d, "final_dataset").where("label IS NOT NULL").withColumn("fold", F.col("final_id") % 5)
    found = [c for c in evaluation.numeric_columns(f, ["final_id", "org_id", "label", "fold"]) if c in NUMERIC]
    return metrics.univariate_audit(f.select("label", "fold", *[F.col(f"`{c}`") for c in found]), found, "label", "fold")


@query(AUDIT + " SELECT feature, round(auc, 9) AS auc, round(cov, 9) AS coverage, CASE WHEN auc IS NULL THEN 'unknown' WHEN auc > 0.55 THEN 'useful' WHEN auc > 0.52 THEN 'marginal' ELSE 'useless' END AS tier FROM z")
def univariate_auc_unpivot(spark, d):
    """Every numeric feature's AUC over folds with the sign of the others, its coverage and its tier."""
    return evaluation.tiers(_audit(spark, d)).select("feature", F.round("auc", 9).alias("auc"), F.round("coverage", 9).alias("coverage"), "tier")


@query(AUDIT + " SELECT feature, round(r, 9) AS corr, coalesce(abs(r) > 0.3, false) AS suspicious FROM z ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 10")
def suspicious_features(spark, d):
    """The ten features that go with the label most: the limit is the report."""
    f = load(spark, d, "final_dataset").where("label IS NOT NULL")
    return evaluation.suspicious(f, NUMERIC, "label").withColumn("corr", F.round("corr", 9))


@query("SELECT x.f AS feature, round(x.c, 9) AS corr, coalesce(abs(x.c) > 0.7, false) AS proxy FROM (SELECT unnest([" + ", ".join(f"{{'f': '{c}', 'c': c{i}}}" for i, c in enumerate(NUMERIC) if c != "seriesA_amount_usd_millions")
  + "]) x FROM (SELECT " + ", ".join(f'corr(coalesce("{c}"::DOUBLE, 0), seriesA_amount_usd_millions) c{i}' for i, c in enumerate(NUMERIC)) + " FROM final_dataset))")
def amount_proxies(spark, d):
    """Features that are but another form of the amount."""
    c = evaluation.proxies(load(spark, d, "final_dataset"), [c for c in NUMERIC if c != "seriesA_amount_usd_millions"], "seriesA_amount_usd_millions")
    return c.withColumn("corr", F.round("corr", 9))


@query(f"WITH {S} SELECT round(corr(s, y), 9) AS r_s, round(corr(w, y), 9) AS r_w FROM s")
def pearson_audit(spark, d):
    """Correlations with the label."""
    x = _scored(spark, d)
    return x.agg(F.round(F.corr("s", F.col("y").cast("double")), 9).alias("r_s"), F.round(F.corr("w", F.col("y").cast("double")), 9).alias("r_w"))


@query(f"WITH {S} SELECT final_id, (row_number() OVER (PARTITION BY y ORDER BY md5(CAST(final_id AS VARCHAR)), final_id) - 1) % 5 AS fold FROM s")
def stratified_folds(spark, d):
    """Folds of equal label shares in a hashed order."""
    order = F.struct(F.md5(F.col("final_id").cast("string")), "final_id")
    return metrics.stratified_folds(_scored(spark, d).drop("fold"), "y", order).select("final_id", "fold")


@query(f"WITH {S}, b AS (SELECT y, CASE WHEN w >= 0 AND w < 1 THEN 0 WHEN w >= 1 AND w < 5 THEN 1 WHEN w >= 5 AND w < 20 THEN 2 WHEN w >= 20 AND w < 1000000 THEN 3 END bin FROM s) SELECT bin, count(*) AS n, round(avg(y), 9) AS rate FROM b WHERE bin IS NOT NULL GROUP BY 1")
def bin_rates(spark, d):
    """Label rate by half-open bins."""
    return features.bin_rates(_scored(spark, d), "w", "y", [0, 1, 5, 20, 1_000_000]).select("bin", "n", F.round("rate", 9).alias("rate"))


@query(f"WITH {S} SELECT y, round(avg(w), 6) AS mean_w, median(w) AS median_w FROM s GROUP BY 1")
def class_conditional(spark, d):
    """Mean and median by label."""
    return _scored(spark, d).groupBy("y").agg(F.round(F.avg("w"), 6).alias("mean_w"), F.median("w").alias("median_w"))


@query(f"WITH {S}, p AS (SELECT y, 1 - 1 / (1 + s) x FROM s) SELECT CAST(least(floor(x * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(y), 9) AS rate FROM p GROUP BY 1")
def calibration_bins(spark, d):
    """Label rate by equal bins of a score."""
    x = _scored(spark, d).withColumn("x", 1 - 1 / (1 + F.col("s")))
    return metrics.calibration(x, "x", "y", 5).select("bin", "n", F.round("rate", 9).alias("rate"))


@query(f"""WITH {S}, r AS (SELECT k, s, y, (('0x' || substr(md5(final_id || '-' || k), 1, 8))::BIGINT + 0.5) / 4294967296.0 u FROM s, range(1, 1001) t(k)),
w AS (SELECT k, s, y, (u > 0.36788)::INT + (u > 0.73576)::INT + (u > 0.9197)::INT + (u > 0.98101)::INT + (u > 0.99634)::INT w FROM r),
g AS (SELECT k, s, sum(w * y) p, sum(w) n FROM w GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM g),
t AS (SELECT k, sum(p * (below + (n + 1) / 2.0)) r, sum(p) p, sum(n) n FROM b GROUP BY 1), a AS (SELECT (r - p * (p + 1) / 2.0) / (p * (n - p)) auc FROM t WHERE p > 0 AND n > p)
SELECT round(quantile_cont(auc, 0.025), 9) AS lo, round(quantile_cont(auc, 0.975), 9) AS hi FROM a""")
def bootstrap_ci(spark, d):
    """The middle 95 % of the AUC over Poisson resamples."""
    return metrics.bootstrap_auc(_scored(spark, d), "s", "y", "final_id").select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


#: The reference's sources of features, strongest first, with those of its features that the tables hold.
SOURCES = {
    "Form D": ["seriesA_amount_usd_millions"], "Crunchbase": ["age_at_seriesA_years", "founders", "name_word_count"], "Wayback Machine": ["w"],
    "LLM (deeptech)": ["deeptech_llm_score"], "GDELT News": ["gdelt_mentions_3m_preA"], "EDGAR SEC": ["s"], "Hacker News": ["hn_mention_count_preA"],
    "Packages": ["pkg_before_seriesA"],
}
MODEL_FEATURES = [c for cols in SOURCES.values() for c in cols]
FOLDS = 5


def _model_input(spark, d):
    """Rows with all numeric features, dealt into stratified folds."""
    x = _scored(spark, d).drop("fold")
    f = load(spark, d, "final_dataset").withColumnRenamed("Number of Founders", "founders").select("final_id", *[c for c in MODEL_FEATURES if c not in x.columns])
    x = metrics.stratified_folds(x.join(f, "final_id"), "y", F.struct(F.md5(F.col("final_id").cast("string")), "final_id"), FOLDS)
    return x.withColumnsRenamed({"final_id": "row_id", "y": "label"})


@query()
def cv_models(spark, d):
    """Out-of-fold AUC of each kind of model."""
    out = None
    x = _model_input(spark, d)
    for kind in ("logistic_l2", "logistic_l1", "random_forest", "boosted_trees"):
        a = metrics.roc_auc(models.cross_validated(x, MODEL_FEATURES, kind, FOLDS), "score", "label").withColumn("model", F.lit(kind))
        out = a if out is None else out.unionByName(a)
    return out


def ablation_sets() -> list[tuple[str, str, list[str]]]:
    """(source, how, features): each source alone, with all before it, and left out."""
    out, so_far = [], []
    for g, cols in SOURCES.items():
        so_far = so_far + cols
        out += [(g, "alone", cols), (g, "cumulative", so_far), (g, "without", [c for c in MODEL_FEATURES if c not in cols])]
    return out


@query()
def source_ablation(spark, d):
    """AUC with each source of features alone, added to those before it, and left out."""
    x = _model_input(spark, d)
    out = None
    for g, how, use in ablation_sets():
        a = metrics.roc_auc(models.cross_validated(x, use, "logistic_l2", FOLDS), "score", "label").withColumns({"source": F.lit(g), "how": F.lit(how)})
        out = a if out is None else out.unionByName(a)
    return out


@query(f"""WITH {S}, r AS (SELECT final_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(final_id AS VARCHAR)), final_id) k, count(*) OVER (PARTITION BY y) n FROM s)
SELECT final_id, CASE WHEN k <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    """A fifth of each label's rows held out."""
    return evaluation.stratified_split(_scored(spark, d).drop("fold"), "y", F.struct(F.md5(F.col("final_id").cast("string")), "final_id")).select("final_id", "split")


def _labelled_input(spark, d):
    x = _model_input(spark, d)
    amount = F.coalesce("seriesA_amount_usd_millions", F.lit(0.0))
    return x.withColumns({"label_large": (F.col("label") * (amount >= 5).cast("int")), "label_early": F.col("label") * (F.coalesce("age_at_seriesA_years", F.lit(9.0)) <= 4).cast("int")})


@query()
def set_ablation(spark, d):
    """AUC, deviation and AP of all features, of the useful ones by their audit, of the rest, and without the amount."""
    x = _model_input(spark, d)
    audit = evaluation.tiers(metrics.univariate_audit(x, MODEL_FEATURES, "label", "fold"))
    useful = sorted(r.feature for r in audit.where("tier = 'useful'").collect())  # a row per feature
    sets = {"all": MODEL_FEATURES, "useful": useful, "other": [f for f in MODEL_FEATURES if f not in useful], "without_amount": [f for f in MODEL_FEATURES if f != "seriesA_amount_usd_millions"]}
    out = evaluation.compare_sets(x, {k: v for k, v in sets.items() if v})
    return out.select("features", "n", F.round("auc", 6).alias("auc"), F.round("sd", 6).alias("sd"), F.round("ap", 6).alias("ap"), "verdict")


@query()
def label_sensitivity(spark, d):
    """The same features for three labels."""
    out = evaluation.compare_labels(_labelled_input(spark, d), ["label", "label_large", "label_early"], MODEL_FEATURES)
    return out.select("label", F.round("rate", 6).alias("rate"), F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query()
def ranked_scores(spark, d):
    """Every row's score by a model fitted to the training part, and its rank; the best kind of model is chosen by its AUC on the rest."""
    x = evaluation.stratified_split(_model_input(spark, d), "label", F.struct(F.md5(F.col("row_id").cast("string")), "row_id"))
    fits = {k: models.fitted(x.where("split = 'train'"), MODEL_FEATURES, k) for k in ("logistic_l2", "logistic_l1")}
    test = models.prepared(x.where("split = 'test'"), MODEL_FEATURES)
    auc = None
    for k, m in fits.items():
        one = metrics.roc_auc(evaluation.rank_all(m, test).join(test.select("row_id", "label"), "row_id"), "score", "label").withColumn("kind", F.lit(k))
        auc = one if auc is None else auc.unionByName(one)
    best = evaluation.best_of(auc, "kind").first().kind  # a row per kind of model
    return evaluation.rank_all(fits[best], models.prepared(x, MODEL_FEATURES)).select("row_id", F.round("score", 6).alias("score"), "rank").withColumn("kind", F.lit(best))


@query()
def top_importances(spark, d):
    """The features that weigh most in the model of all rows."""
    x = _model_input(spark, d)
    got = evaluation.importances(spark, models.fitted(x, MODEL_FEATURES, "logistic_l2"), MODEL_FEATURES)
    return got.withColumn("importance", F.round("importance", 6))


# --- incremental -----------------------------------------------------------------------------------------------

@query("""SELECT c_custkey, coalesce(n.bal, 0) AS c_acctbal, coalesce(c_mktsegment, '') AS segment FROM customer LEFT JOIN (SELECT o_custkey k, max(o_totalprice) bal FROM orders GROUP BY 1) n ON k = c_custkey""")
def replace_then_merge(spark, d):
    """A column taken out and merged anew from another table."""
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return incremental.replace_then_merge(c, new, ["c_custkey"], 0.0).select("c_custkey", "c_acctbal", F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("""SELECT c_custkey, coalesce(n.bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey k, max(o_totalprice) bal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON k = c_custkey""")
def suffix_reconcile(spark, d):
    """A column that a merge left twice: the newer value where there is one."""
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("c_acctbal_x"))
    new = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal_y"))
    return incremental.reconcile(c.join(new, "c_custkey", "left"))


@query("""SELECT run_id, count(*) AS n, count(DISTINCT org_id) AS entities, arg_min(feed, final_id) AS first_state, arg_max(feed, final_id) AS last_state FROM final_dataset WHERE run_id IS NOT NULL GROUP BY 1""")
def run_ledger(spark, d):
    """Rows, entities and states of each run."""
    return incremental.run_status(load(spark, d, "final_dataset").where("run_id IS NOT NULL"), "run_id", "org_id", "feed", "final_id")


@query("""SELECT count(*) FILTER (WHERE d) AS finished, count(*) FILTER (WHERE NOT d) AS to_do FROM (SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') d FROM customer)""")
def resume_checkpoint(spark, d):
    """Entities that a checkpoint has finished, and those left."""
    done = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") == "1-URGENT", "ok").alias("marker"))
    fin, rest = incremental.resume(load(spark, d, "customer").select("c_custkey"), done, "c_custkey", "marker")
    both = fin.select(F.lit(1).alias("f")).unionByName(rest.select(F.lit(0).alias("f")))
    return both.agg(F.count_if(F.col("f") == 1).alias("finished"), F.count_if(F.col("f") == 0).alias("to_do"))


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) d, value FROM events), w AS (SELECT event_type, d - INTERVAL 1 DAY * k AS start, value FROM h, range(0, 14) t(k))
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def stream_window_counts(spark, d):
    """Sliding 14-day counts, a day apart; the streaming twin runs the same expression."""
    e = load(spark, d, "events").select(F.col("ts"), "event_type", "value")
    return windowed_counts(e, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
