"""Queries of the signals on the project's tables: documents by source are the landed records of each signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.arrays import zip_filter
from tidemark.functions.keys import accession, cik10
from tidemark.functions.names import domain_host
from tidemark.functions.numbers import parse_date
from tidemark.operators import pages, signals
from tidemark.plans.analytics import _bucket_sql
from tidemark.plans.filings import _HOST, _acc, _cik, _day
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


COHORT = f"""WITH a AS (SELECT org_id, min(CAST(seriesA_date AS DATE)) anchor FROM final_dataset WHERE regexp_full_match(seriesA_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(seriesA_date AS DATE) IS NOT NULL GROUP BY 1),
c AS (SELECT org_id, Organization_Name n, domain_clean dom, "Founded Date" founded, {_bucket_sql('Industries')} sector, anchor, (len(list_filter(regexp_split_to_array(coalesce(Organization_Name, ''), '\\s+'), lambda x: x <> '')) >= 3)::INT nd FROM companies LEFT JOIN a USING (org_id)),
d AS (SELECT org_id, source, lang, text, CAST(published_at AS DATE) AS day FROM documents)"""


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("seriesA_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("seriesA_date", "yyyy-MM-dd"))
    a = load(spark, d, "final_dataset").withColumn("anchor", day).where("anchor IS NOT NULL").groupBy("org_id").agg(F.min("anchor").alias("anchor"))
    c = load(spark, d, "companies").select(
        "org_id", F.col("Organization_Name").alias("name"), F.col("domain_clean").alias("domain"), F.col("Founded Date").alias("founded"), F.col("Industries").alias("industries"),
        X.keyword_bucket("Industries").alias("sector"), (X.word_count(F.coalesce("Organization_Name", F.lit(""))) >= 3).cast("int").alias("name_distinctive"),
    )
    return c.join(a, "org_id", "left")


def _docs(spark: SparkSession, d: str, *sources: str) -> DataFrame:
    return load(spark, d, "documents").where(F.col("source").isin(*sources)).select("org_id", "source", "lang", "text", F.col("published_at").cast("date").alias("day"))


@query(COHORT + """, m AS (SELECT c.org_id, count(day) FILTER (WHERE anchor - day BETWEEN 1 AND 365) y, count(day) FILTER (WHERE anchor - day BETWEEN 1 AND 90) q FROM c LEFT JOIN d ON d.org_id = c.org_id AND source = 'gdelt_news' GROUP BY 1),
n AS (SELECT c.*, y, q, CASE WHEN length(trim(coalesce(n, ''))) < 3 THEN 'no_name' WHEN nd = 0 THEN 'skipped_non_distinctive' WHEN anchor IS NULL THEN 'no_anchor' WHEN anchor < DATE '2017-02-19' THEN 'before_coverage' WHEN y >= 3 THEN 'noise_cap' ELSE 'queried' END note FROM c JOIN m USING (org_id))
SELECT org_id, CASE WHEN note = 'queried' THEN y ELSE 0 END AS n_12m, CASE WHEN note = 'queried' AND q < 3 THEN q ELSE 0 END AS n_3m, (note = 'queried' AND y > 0)::INT AS has_press, note FROM n""")
def news_signal(spark, d):
    """News in the year and the quarter before the anchor, with all gates; the cap is 3 as these tables hold few news per firm."""
    return signals.news_signal(_cohort(spark, d), _docs(spark, d, "gdelt_news"), "org_id", "day", cap=3)


@query(COHORT + """, m AS (SELECT c.org_id, min(day) f, count(*) FILTER (WHERE day < anchor) s FROM c JOIN d ON d.org_id = c.org_id AND source = 'wayback_about' AND day <= anchor GROUP BY 1)
SELECT c.org_id, (sector IN ('SAAS', 'HARD') AND f IS NOT NULL)::INT AS present, CASE WHEN sector IN ('SAAS', 'HARD') THEN f END AS first_day, CASE WHEN sector IN ('SAAS', 'HARD') THEN coalesce(s, 0) ELSE 0 END AS strictly_before,
  CASE WHEN sector NOT IN ('SAAS', 'HARD') THEN 'skipped_sector' WHEN f IS NOT NULL THEN 'found' ELSE 'none' END AS note FROM c LEFT JOIN m USING (org_id)""")
def presence_signal(spark, d):
    """Whether anything of a firm existed up to its anchor, for two sectors."""
    return signals.presence_signal(_cohort(spark, d), _docs(spark, d, "wayback_about"), "org_id", "day", only=["SAAS", "HARD"])


@query(COHORT + """, p AS (SELECT c.org_id, anchor, founded, day, source = 'launch_post' AND contains(lower(text), 'version') l FROM c JOIN d ON d.org_id = c.org_id AND source IN ('forum_thread', 'launch_post') AND day <= anchor)
SELECT c.org_id, count(p.day) AS mentions, coalesce(max((l AND (p.founded IS NULL OR date_diff('day', p.day, p.founded) <= 365))::INT), 0) AS launched,
  min(CASE WHEN l AND (p.founded IS NULL OR date_diff('day', p.day, p.founded) <= 365) THEN p.day END) AS first_launch FROM c LEFT JOIN p USING (org_id) GROUP BY 1""")
def forum_signal(spark, d):
    """Mentions and verified launches up to the anchor."""
    posts = _docs(spark, d, "forum_thread", "launch_post").select("org_id", "day", (F.col("source") == "launch_post").alias("launch"), F.contains(F.lower("text"), F.lit("version")).alias("verified"))
    return signals.forum_signal(_cohort(spark, d), posts, "org_id")


@query(COHORT + """, r AS (SELECT org_id, coalesce(lang, '') registry, list_sort(list(DISTINCT day)) ds FROM d WHERE source = 'pkg_readme' AND org_id IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY len(ds) DESC, registry DESC) k FROM r),
x AS (SELECT c.*, registry, ds, ds[1] f, founded IS NULL OR ds IS NULL OR date_diff('day', ds[1], founded) <= 365 ok FROM c LEFT JOIN b ON b.org_id = c.org_id AND k = 1)
SELECT org_id, CASE WHEN ok THEN registry END AS registry, CASE WHEN ok THEN f END AS first_release, CASE WHEN ok THEN coalesce(len(list_filter(ds, lambda t: t <= anchor)), 0) ELSE 0 END AS releases,
  coalesce(ok AND f <= anchor, false)::INT AS before_anchor, CASE WHEN ds IS NULL THEN 'none' WHEN NOT ok THEN 'older_than_firm' ELSE 'found' END AS note FROM x""")
def package_signal(spark, d):
    """The registry with most releases, and how many came up to the anchor."""
    r = _docs(spark, d, "pkg_readme").where("org_id IS NOT NULL AND day IS NOT NULL").groupBy("org_id", F.coalesce("lang", F.lit("")).alias("registry")).agg(F.array_sort(F.collect_set("day")).alias("releases"))
    return signals.package_signal(_cohort(spark, d), r, "org_id")


@query(f"""WITH o AS (SELECT {_acc('ACCESSIONNUMBER')} acc, {_day('FILING_DATE')} fd FROM formdsubmission), am AS (SELECT {_acc('ACCESSIONNUMBER')} acc, max((coalesce(lower(trim(ISAMENDMENT)), '') IN ('1', 'true', 't', 'yes', 'y'))::INT) am FROM offering GROUP BY 1),
i AS (SELECT DISTINCT {_acc('ACCESSIONNUMBER')} acc, {_cik('CIK')} cik FROM issuers WHERE {_acc('ACCESSIONNUMBER')} IS NOT NULL AND {_cik('CIK')} IS NOT NULL),
f AS (SELECT cik, fd, coalesce(am, 0) am FROM i JOIN o USING (acc) LEFT JOIN am USING (acc) WHERE fd IS NOT NULL), k AS (SELECT cik, max(fd) anchor FROM f GROUP BY 1)
SELECT k.cik, count(fd) FILTER (WHERE fd < anchor) AS filings, coalesce(max(CASE WHEN fd < anchor THEN am END), 0) AS periodic FROM k JOIN f USING (cik) GROUP BY 1""")
def registry_signal(spark, d):
    """Filings strictly before each registrant's last one, and whether an amendment is among them."""
    sub = load(spark, d, "formdsubmission").select(accession("ACCESSIONNUMBER").alias("accession"), parse_date("FILING_DATE").alias("day")).where("day IS NOT NULL")
    amended = load(spark, d, "offering").groupBy(accession("ACCESSIONNUMBER").alias("accession")).agg(F.max(F.coalesce(X.truthy("ISAMENDMENT"), F.lit(False)).cast("int")).alias("am"))
    keys = load(spark, d, "issuers").select(accession("ACCESSIONNUMBER").alias("accession"), cik10("CIK").alias("cik")).where("accession IS NOT NULL AND cik IS NOT NULL").distinct()
    form = F.when(F.coalesce("am", F.lit(0)) == 1, "D/A").otherwise("D")
    rows = keys.join(sub, "accession").join(amended, "accession", "left").select("cik", "day", form.alias("form"))
    arrays = rows.select("cik", F.array("day").alias("dates"), F.array("form").alias("forms"))
    return signals.registry_signal(rows.groupBy("cik").agg(F.max("day").alias("anchor")), arrays, "cik", periodic=["D/A"])


@query(COHORT + f""", k AS (SELECT {_HOST.format('dom')} dom, min(anchor) anchor FROM c WHERE {_HOST.format('dom')} <> '' GROUP BY 1),
w AS (SELECT {_HOST.format('original')} dom, strptime(timestamp, '%Y%m%d%H%M%S') ts, original url, mimetype mime, coalesce(nullif(rtrim(regexp_extract(lower(original), '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1), '/'), ''), '/') path FROM wayback_pages),
j AS (SELECT k.dom, anchor, ts, url, mime, path, anchor - CAST(ts AS DATE) gap FROM k JOIN w USING (dom) WHERE anchor - CAST(ts AS DATE) >= 0),
n AS (SELECT dom, count(*) FILTER (WHERE gap <= 365) y, count(*) FILTER (WHERE gap <= 91) q, max(regexp_matches(lower(url), '/careers|/jobs|/hiring|/join-us|/join')::INT) cr, max({{'h': contains(lower(coalesce(mime, '')), 'html'), 'ts': ts}}).ts last FROM j GROUP BY 1),
pp AS (SELECT dom, path, max({{'ts': ts, 'url': url}}).url url FROM j GROUP BY 1, 2),
ab AS (SELECT dom, min({{'r': list_position({pages.ABOUT_PATHS!r}, path), 'url': url}}).url about FROM pp WHERE list_position({pages.ABOUT_PATHS!r}, path) > 0 GROUP BY 1)
SELECT k.dom AS domain_key, coalesce(y, 0) AS n_12m, coalesce(q, 0) AS n_3m, coalesce(cr, 0) AS careers, about AS about_url, last AS snapshot, anchor - CAST(last AS DATE) AS lag FROM k LEFT JOIN n USING (dom) LEFT JOIN ab USING (dom)""")
def archive_signal(spark, d):
    """Captures of each domain in the windows before its firm's anchor, where it presents itself, and the latest one."""
    c = _cohort(spark, d).groupBy(domain_host("domain").alias("domain_key")).agg(F.min("anchor").alias("anchor")).where("domain_key <> ''")
    w = load(spark, d, "wayback_pages").select(
        domain_host("original").alias("domain_key"), pages.from_stamp("timestamp").alias("ts"), F.col("original").alias("url"), F.col("mimetype").alias("mime")
    )
    return signals.archive_signal(c, w, "domain_key").withColumn("snapshot", F.col("snapshot").cast("timestamp_ntz"))


@query(COHORT + """, g AS (SELECT org_id, CASE WHEN lang = 'en' THEN 'grant' ELSE 'contract' END kind, day, upper(trim(n)) v FROM d JOIN c USING (org_id) WHERE source = 'award_abstract'),
t AS (SELECT DISTINCT org_id, anchor, founded, upper(trim(n)) t FROM c WHERE trim(coalesce(n, '')) <> ''),
j AS (SELECT t.*, kind, day FROM t JOIN g ON g.v = t.t OR starts_with(g.v, t.t || ' ') OR starts_with(g.v, t.t || ',') WHERE day IS NOT NULL),
s AS (SELECT org_id, count(*) FILTER (WHERE kind = 'grant' AND day <= anchor AND (founded IS NULL OR date_diff('day', day, founded) <= 1825)) a, count(*) FILTER (WHERE kind = 'contract' AND day <= anchor AND (founded IS NULL OR date_diff('day', day, founded) <= 1825)) b, count(*) v FROM j GROUP BY 1)
SELECT c.org_id, coalesce(a, 0) AS n_grant, coalesce(b, 0) AS n_contract, coalesce(v, 0) AS recipient_volume FROM c LEFT JOIN s USING (org_id)""")
def awards_signal(spark, d):
    """Awards of recipients with a firm's name, up to its anchor."""
    c = _cohort(spark, d)
    a = _docs(spark, d, "award_abstract").join(c.select("org_id", F.col("name").alias("recipient")), "org_id").select("recipient", "day", F.when(F.col("lang") == "en", "grant").otherwise("contract").alias("kind"))
    return signals.awards_signal(c, a, "org_id")


@query(COHORT + """, w AS (SELECT c.org_id, count(day) FILTER (WHERE day <= anchor) m FROM c LEFT JOIN d ON d.org_id = c.org_id AND source IN ('forum_thread', 'launch_post') GROUP BY 1),
p AS (SELECT c.org_id, max((day <= anchor)::INT) wp FROM c LEFT JOIN d ON d.org_id = c.org_id AND source = 'wayback_about' GROUP BY 1)
SELECT c.org_id, coalesce(wp, 0) AS wiki_present, m AS forum_mentions FROM c JOIN w USING (org_id) JOIN p USING (org_id)""")
def signal_fold(spark, d):
    """Registered signals merged to the cohort by name."""
    tables = {"key": "org_id", "pages": _docs(spark, d, "wayback_about"), "posts": _docs(spark, d, "forum_thread", "launch_post").select("org_id", "day", F.lit(False).alias("launch"), F.lit(False).alias("verified"))}
    return signals.run_signals(_cohort(spark, d), tables, ["presence", "forum"], "org_id").select("org_id", "wiki_present", "forum_mentions")


@query("""WITH t AS (SELECT o_custkey e, CAST(o_orderdate AS DATE) anchor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 3)
SELECT e, anchor >= DATE '1995-06-17' AS covered, CASE WHEN anchor >= DATE '1995-06-17' THEN 'queried' ELSE 'before_coverage' END AS note FROM t""")
def coverage_gate(spark, d):
    """Whether a source that starts on a day covers each entity's anchor."""
    from tidemark.plans.analytics import _third

    ok = signals.coverage_gate(F.col("anchor"), "1995-06-17")
    return _third(spark, d).select("e", ok.alias("covered"), F.when(ok, "queried").otherwise("before_coverage").alias("note"))


_PAGE = "'<html><head><style>p {}</style></head><nav>Home</nav><script>x < 1</script><p>' || text || '</p>&nbsp;&amp;<footer>end</footer><!-- c --></html>'"
_TAGS = "script style nav header footer svg noscript template".split()


def _html_sql() -> str:
    s = f"regexp_replace({_PAGE}, '(?is)<!--.*?-->', ' ', 'g')"
    s = f"regexp_replace({s}, '(?is)" + "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in _TAGS) + "', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{sign}')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {_html_sql()} t FROM documents WHERE text IS NOT NULL)")
def html_to_text(spark, d):
    """Text of pages, here made of the documents with the usual furniture around."""
    page = F.concat(F.lit("<html><head><style>p {}</style></head><nav>Home</nav><script>x < 1</script><p>"), "text", F.lit("</p>&nbsp;&amp;<footer>end</footer><!-- c --></html>"))
    t = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pages.page_text(page).alias("t"))
    return t.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("""WITH l AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 60 anchor, CAST(l_shipdate AS DATE) d, l_returnflag k FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) FILTER (WHERE d < anchor AND k IN ('R', 'A')) AS n_before, min(d) AS first_day FROM l GROUP BY 1""")
def array_zip_filter(spark, d):
    """Of two parallel arrays per order the pairs before an anchor and of some kinds; an order has few lines."""
    li = load(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_shipdate").cast("date").alias("d"), F.col("l_returnflag").alias("k")).alias("x"))
    a = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.col("x.d").alias("dates"), F.col("x.k").alias("kinds"))
    o = load(spark, d, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 60).alias("anchor")).join(a, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.size(zip_filter("dates", "kinds", F.col("anchor"), ["R", "A"])).alias("n_before"), F.array_min("dates").alias("first_day"))


@query("""WITH u AS (SELECT upper(trim(assignee_name)) v, unnest(sample_titles) title, last_filing f FROM patent_assignees WHERE trim(coalesce(assignee_name, '')) NOT IN ('', 'nan', 'None', 'NaT')),
r AS (SELECT v, title, row_number() OVER (PARTITION BY v ORDER BY title) k FROM (SELECT DISTINCT v, title FROM u WHERE title IS NOT NULL))
SELECT v AS assignee, count(*) AS titles, string_agg(title, ' | ' ORDER BY title) FILTER (WHERE k <= 5) AS sample FROM r GROUP BY 1""")
def sample_titles(spark, d):
    """Distinct titles of each assignee, five of them joined."""
    p = load(spark, d, "patent_assignees").where(norm_null("assignee_name").isNotNull())
    t = p.select(F.upper(F.trim("assignee_name")).alias("assignee"), F.explode("sample_titles").alias("title")).where("title IS NOT NULL").distinct()
    n = t.groupBy("assignee").agg(F.count(F.lit(1)).alias("titles"))
    five = signals.capped_per_key(t, "assignee", [F.col("title")], 5).groupBy("assignee").agg(F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("sample"))
    return n.join(five, "assignee")
