"""Signals of entities before their anchor: gates, dated counts and the composites built of them.

A cohort has a row per entity: its key, anchor (a date) and what else a signal asks for (founded, name, domain, sector ...).
Records are landed tables. A composite gives a row per entity of the cohort with its columns and a note that says why
nothing was counted. Records are reduced per key and day before they meet the cohort, so a hot key brings a calendar at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.arrays import ordinal_range
from tidemark.functions.names import alumni_name, careers_flag, contains_any, domain_host
from tidemark.operators import matching, pages
from tidemark.operators.sequences import merge_fragments

# Words of medical lines of business; phases of trials; first day that the news source covers.
MEDICAL = [
    "biotech", "biotechnology", "biopharma", "pharma", "pharmaceutic", "therapeutic", "medical", "medicine", "health", "clinical", "diagnos",
    "life science", "drug", "oncology", "vaccine", "genomic", "neuroscience", "cardio", "immun", "cell therapy", "gene therapy",
]
PHASES = {"EARLY_PHASE1": 0.5, "PHASE1": 1.0, "PHASE2": 2.0, "PHASE3": 3.0, "PHASE4": 4.0}
COVERAGE_START = "2017-02-19"
SECTORS = ["devtools", "enterprise", "consumer", "deeptech", "other"]


# --- registry ------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Signal:
    """A named builder (cohort, tables) -> fragment, and what its columns are where it gives no row."""

    name: str
    build: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    defaults: dict[str, object] = field(default_factory=dict)
    in_model: bool = True


_SIGNALS: dict[str, Signal] = {}


def register_signal(name: str, build: Callable, defaults: dict[str, object] | None = None, in_model: bool = True) -> None:
    """Add a signal, or replace the one of that name."""
    _SIGNALS[name] = Signal(name, build, defaults or {}, in_model)


def signal_names(in_model: bool | None = None) -> list[str]:
    return [n for n, s in _SIGNALS.items() if in_model is None or s.in_model == in_model]


def run_signals(cohort: DataFrame, tables: dict[str, DataFrame], names: Sequence[str], key: str) -> DataFrame:
    """cohort plus the columns of the named signals, one row per key, defaults where a signal has none."""
    parts, defaults = [], {}
    for n in names:
        parts.append(_SIGNALS[n].build(cohort, tables))
        defaults |= _SIGNALS[n].defaults
    return merge_fragments(cohort, parts, key, defaults)


# --- gates -----------------------------------------------------------------------------------------------------

def sector_gate(sector: Column, only: Sequence[str] | None = None, without: Sequence[str] = ()) -> Column:
    """Whether a sector is one of those asked for; an unknown one isn't, unless only some are left out."""
    ok = sector.isin(*only) if only else ~sector.isin(*without)
    return F.coalesce(ok, F.lit(not only))


def keyword_gate(text: Column | str, words: Sequence[str] = MEDICAL) -> Column:
    return contains_any(text, words) == 1


def distinctive_gate(flag: Column) -> Column:
    """Whether a name may be searched for as text: NULL may."""
    return F.coalesce(flag != 0, F.lit(True))


def short_single_word(name: Column | str, most: int = 6) -> Column:
    n = F.trim(F.col(name) if isinstance(name, str) else name)
    return (X.word_count(n) == 1) & (F.length(n) <= most)


def coverage_gate(anchor: Column, start: str = COVERAGE_START) -> Column:
    """Whether a source that starts on a day covers the anchor."""
    return F.coalesce(anchor >= F.lit(start).cast("date"), F.lit(False))


def founding_gate(founded: Column, day: Column, days: int) -> Column:
    """Whether a record isn't older than its entity by more than some days; unknown dates pass."""
    return F.coalesce(F.datediff(founded, day) <= days, F.lit(True))


def noise_cap(count: Column, cap: int) -> Column:
    """A count that reaches the source's cap says nothing and becomes 0."""
    return F.when(count >= cap, 0).otherwise(count)


def capped_per_key(records: DataFrame, key: str, order: Sequence[Column], cap: int) -> DataFrame:
    """The records that a source which lists at most cap per key would have listed."""
    from pyspark.sql import Window

    return records.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


def per_day(records: DataFrame, key: str, day: str, **aggs: Column) -> DataFrame:
    """(key, day, n, ...): records per key and day, those without either left out."""
    r = records.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    return r.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in aggs.items()])


def _asof(cohort: DataFrame, daily: DataFrame, key: str, day: str, ok: Column, aggs: Sequence[Column], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregates of the daily rows that satisfy ok, per key."""
    return cohort.select(key, "anchor", *extra).join(daily, key).where(ok).groupBy(key).agg(*aggs)


def _fill(cohort: DataFrame, part: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    out = cohort.select(key).join(part, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in defaults.items()])


# --- composites --------------------------------------------------------------------------------------------------

def presence_signal(cohort: DataFrame, records: DataFrame, key: str, day: str, only: Sequence[str] | None = None) -> DataFrame:
    """(key, present, first_day, strictly_before, note): whether anything of the entity existed up to its anchor, and how many records strictly before it."""
    gate = sector_gate(F.col("sector"), only) if only else F.lit(True)
    part = _asof(
        cohort, per_day(records, key, day), key, day, F.col(day) <= F.col("anchor"),
        [F.lit(1).alias("present"), F.min(day).alias("first_day"), F.sum(F.when(F.col(day) < F.col("anchor"), F.col("n")).otherwise(0)).alias("strictly_before")],
    )
    out = cohort.select(key, gate.alias("_ok")).join(part, key, "left")
    hit = lambda c: F.when(F.col("_ok"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    note = F.when(~F.col("_ok"), "skipped_sector").when(F.col("present") == 1, "found").otherwise("none")
    return out.select(key, hit("present"), F.when(F.col("_ok"), F.col("first_day")).alias("first_day"), hit("strictly_before"), note.alias("note"))


def package_signal(cohort: DataFrame, registries: DataFrame, key: str, gate_days: int = 365) -> DataFrame:
    """(key, registry, first_release, releases, before_anchor, note): the registry with most releases; registries: key, registry, releases (array of dates)."""
    best = registries.groupBy(key).agg(F.max(F.struct(F.size(F.filter("releases", lambda d: d.isNotNull())).alias("n"), "registry", "releases")).alias("b"))
    out = cohort.select(key, "anchor", "founded").join(best, key, "left").withColumn("first_release", F.array_min("b.releases"))
    ok = founding_gate(F.col("founded"), F.col("first_release"), gate_days)
    count = F.when(ok, F.size(F.filter("b.releases", lambda d: d <= F.col("anchor"))))
    note = F.when(F.col("b").isNull(), "none").when(~ok, "older_than_firm").otherwise("found")
    before = F.coalesce((F.col("first_release") <= F.col("anchor")) & ok, F.lit(False)).cast("int")
    return out.select(key, F.when(ok, F.col("b.registry")).alias("registry"), F.when(ok, F.col("first_release")).alias("first_release"), F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).alias("releases"), before.alias("before_anchor"), note.alias("note"))


def papers_signal(cohort: DataFrame, institutions: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """(key, works, has_works, note): works up to the anchor of the institution with the entity's domain. institutions: institution,
    homepage; works: institution, day."""
    inst = institutions.groupBy(domain_host("homepage").alias("_d")).agg(F.min("institution").alias("institution")).where("_d <> ''")
    c = cohort.select(key, "anchor", domain_host("domain").alias("_d")).join(inst, "_d")
    daily = per_day(works, "institution", "day")
    n = c.join(daily, "institution", "left").groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("day") <= F.col("anchor"), F.col("n"))), F.lit(0)).alias("works"))
    out = cohort.select(key).join(n, key, "left")
    return out.select(key, F.coalesce("works", F.lit(0)).alias("works"), F.coalesce((F.col("works") > 0).cast("int"), F.lit(0)).alias("has_works"), F.when(F.col("works").isNull(), "no_institution").otherwise("found").alias("note"))


def forum_signal(cohort: DataFrame, posts: DataFrame, key: str, gate_days: int = 365) -> DataFrame:
    """(key, mentions, launched, first_launch): mentions up to the anchor; a launch counts if it is verified and not much older than
    the firm. posts: key, day, launch, verified (booleans)."""
    real = F.coalesce(F.col("launch") & F.col("verified"), F.lit(False))
    daily = per_day(posts, key, "day", launches=F.max(real.cast("int")))
    launch = (F.col("launches") == 1) & founding_gate(F.col("founded"), F.col("day"), gate_days)
    part = _asof(
        cohort, daily, key, "day", F.col("day") <= F.col("anchor"),
        [F.sum("n").alias("mentions"), F.max(launch.cast("int")).alias("launched"), F.min(F.when(launch, F.col("day"))).alias("first_launch")], ["founded"],
    )
    return _fill(cohort, part, key, {"mentions": 0, "launched": 0, "first_launch": None})


def launch_signal(cohort: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """(key, launches, first_launch, featured): verified launches up to the anchor under any slug of the entity's name or its siblings.
    posts: url, day, featured, verified."""
    p = posts.withColumn("_s", pages.post_slug("url")).where(F.coalesce("verified", F.lit(False)) & F.col("_s.base").isNotNull())
    slugs = cohort.select(key, F.explode(X.slug_candidates("name")).alias("_slug")).select(key, F.regexp_replace("_slug", r"-\d+$", "").alias("_base")).distinct()
    daily = slugs.join(p.select(F.col("_s.base").alias("_base"), "day", "featured"), "_base").groupBy(key, "day").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("featured").cast("int"), F.lit(0))).alias("f"))
    part = _asof(cohort, daily, key, "day", F.col("day") <= F.col("anchor"), [F.sum("n").alias("launches"), F.min("day").alias("first_launch"), F.max("f").alias("featured")])
    return _fill(cohort, part, key, {"launches": 0, "first_launch": None, "featured": 0})


def trials_signal(cohort: DataFrame, trials: DataFrame, key: str, words: Sequence[str] = MEDICAL) -> DataFrame:
    """(key, trials, least_phase, greatest_phase, note): trials of sponsors with the entity's name, begun up to the anchor, for medical lines only.

    trials: trial, sponsor, start (text, perhaps a month only: compared as text), phases (array), verified (verdict on names that
    only contain each other; NULL is none). cohort: name, industries.
    """
    gate = keyword_gate("industries", words)
    c = cohort.where(gate).select(key, F.date_format("anchor", "yyyy-MM-dd").alias("_a"), X.norm_text("name").alias("_n")).where("_n <> ''")
    t = trials.select("trial", "start", "phases", "verified", X.norm_text("sponsor").alias("_m")).where("_m <> ''")
    pairs = matching.containing_names(c.select("_n").distinct(), t.select("_m").distinct(), "_n", "_m")
    hit = c.join(pairs, "_n").join(t, "_m").where(((F.col("tier") == 2) | F.coalesce("verified", F.lit(False))) & (F.col("start") <= F.col("_a")))
    low, high = ordinal_range("phases", PHASES)
    part = hit.groupBy(key, "trial").agg(F.min(low).alias("l"), F.max(high).alias("h")).groupBy(key).agg(F.count(F.lit(1)).alias("trials"), F.min("l").alias("least_phase"), F.max("h").alias("greatest_phase"))
    out = cohort.select(key, gate.alias("_ok")).join(part, key, "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return out.select(key, zero("trials", 0), zero("least_phase", 0.0), zero("greatest_phase", 0.0), F.when(~F.col("_ok"), "skipped_non_medical").when(F.col("trials") > 0, "found").otherwise("none").alias("note"))


def awards_signal(cohort: DataFrame, awards: DataFrame, key: str, kinds: Sequence[str] = ("grant", "contract"), gate_days: int = 5 * 365) -> DataFrame:
    """(key, n_<kind>..., recipient_volume): awards up to the anchor of recipients whose name is the entity's or begins with it as a
    word. awards: recipient, day, kind. recipient_volume counts all of theirs, whenever."""
    prefixed = matching.prefix_join(
        cohort.select(F.upper(F.trim("name")).alias("_t")).where("_t <> ''").distinct(), awards.select(F.upper(F.trim("recipient")).alias("_v")).where("_v <> ''").distinct(), "_t", "_v", [" ", ","]
    )
    daily = awards.where("day IS NOT NULL").groupBy(F.upper(F.trim("recipient")).alias("_v"), "day", "kind").agg(F.count(F.lit(1)).alias("n"))
    j = cohort.select(key, "anchor", "founded", F.upper(F.trim("name")).alias("_t")).join(prefixed, "_t").join(daily, "_v")
    ok = (F.col("day") <= F.col("anchor")) & founding_gate(F.col("founded"), F.col("day"), gate_days)
    part = j.groupBy(key).agg(*[F.coalesce(F.sum(F.when(ok & (F.col("kind") == k), F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in kinds], F.sum("n").alias("recipient_volume"))
    return _fill(cohort, part, key, {f"n_{k}": 0 for k in kinds} | {"recipient_volume": 0})


def patent_signal(cohort: DataFrame, grants: DataFrame, key: str, accepted: DataFrame | None = None, gate_days: int = 5 * 365, names: int = 5) -> DataFrame:
    """(key, patents, first_day, last_day, assignees, titles, note): publications filed before the anchor of assignees whose name is the
    entity's with a legal ending or none.

    grants: publication, assignee, filed, title, a row per publication and assignee. accepted: (key, assignee) verdicts; all are
    accepted without. An assignee that filed long before the firm was founded is another firm. A publication of two
    accepted assignees counts for both.
    """
    up = F.upper(F.trim(F.col("name")))
    c = cohort.select(key, "anchor", "founded", up.alias("_t")).where("_t <> ''")
    g = grants.select("publication", "filed", "title", F.upper(F.trim("assignee")).alias("_v")).where("_v <> ''")
    pairs = matching.prefix_join(c.select("_t").distinct(), g.select("_v").distinct(), "_t", "_v", [" INC", " LLC", " CORP", " CO", ", INC", ","])
    j = c.join(pairs, "_t").join(g, "_v").where("filed IS NOT NULL AND filed <= anchor")
    title = F.slice(F.array_sort(F.collect_set("title")), 1, names)
    per = j.groupBy(key, "founded", "_v").agg(F.count_distinct("publication").alias("n"), F.min("filed").alias("a"), F.max("filed").alias("b"))
    per = per.where(founding_gate(F.col("founded"), F.col("a"), gate_days))
    if accepted is not None:
        per = per.join(accepted.select(key, F.upper(F.trim("assignee")).alias("_v")).distinct(), [key, "_v"], "left_semi")
    five = capped_per_key(j.select("_v", "title").where("title IS NOT NULL").distinct(), "_v", [F.col("title")], names).groupBy("_v").agg(title.alias("_ts"))
    top = capped_per_key(per, key, [F.col("_v")], names).join(five, "_v", "left")
    listed = top.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("_v")), " | ").alias("assignees"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_ts", F.array().cast("array<string>")))))), 1, names).alias("titles"))
    part = per.groupBy(key).agg(F.sum("n").alias("patents"), F.min("a").alias("first_day"), F.max("b").alias("last_day")).join(listed, key)
    out = cohort.select(key).join(part, key, "left")
    return out.select(key, F.coalesce("patents", F.lit(0)).alias("patents"), "first_day", "last_day", F.coalesce("assignees", F.lit("")).alias("assignees"), "titles", F.when(F.col("patents") > 0, "found").otherwise("none").alias("note"))


def news_signal(cohort: DataFrame, mentions: DataFrame, key: str, day: str, cap: int = 250, start: str = COVERAGE_START) -> DataFrame:
    """(key, n_12m, n_3m, has_press, note): mentions in the year and the quarter to the day before the anchor, where the source covers
    it and the name is distinctive; counts that reach the cap say nothing."""
    gap = F.datediff("anchor", day)
    part = _asof(cohort, per_day(mentions, key, day), key, day, gap.between(1, 365), [F.sum("n").alias("_y"), F.coalesce(F.sum(F.when(gap <= 90, F.col("n"))), F.lit(0)).alias("_q")])
    note = (
        F.when(F.length(F.trim(F.coalesce("name", F.lit("")))) < 3, "no_name").when(~distinctive_gate(F.col("name_distinctive")), "skipped_non_distinctive")
        .when(F.col("anchor").isNull(), "no_anchor").when(~coverage_gate(F.col("anchor"), start), "before_coverage").when(F.col("_y") >= cap, "noise_cap").otherwise("queried")
    )
    out = cohort.select(key, "anchor", "name", "name_distinctive").join(part, key, "left").withColumn("note", note)
    seen = lambda c: F.when(F.col("note") == "queried", F.coalesce(c, F.lit(0))).otherwise(0)
    return out.select(key, seen("_y").alias("n_12m"), noise_cap(seen("_q"), cap).alias("n_3m"), (seen("_y") > 0).cast("int").alias("has_press"), "note")


def registry_signal(cohort: DataFrame, filings: DataFrame, key: str, periodic: Sequence[str] = ("10-K", "10-Q")) -> DataFrame:
    """(key, filings, periodic): filings of any form strictly before the anchor, and whether a periodic one is among them. filings: key, and
    parallel arrays dates and forms."""
    one = filings.select(key, F.explode(F.arrays_zip("dates", "forms")).alias("x")).select(key, F.col("x.dates").alias("day"), F.col("x.forms").alias("form"))
    daily = per_day(one, key, "day", periodic=F.max(F.col("form").isin(*periodic).cast("int")))
    part = _asof(cohort, daily, key, "day", F.col("day") < F.col("anchor"), [F.sum("n").alias("filings"), F.max(F.coalesce("periodic", F.lit(0))).alias("periodic")])
    return _fill(cohort, part, key, {"filings": 0, "periodic": 0})


def second_papers_signal(cohort: DataFrame, papers: DataFrame, key: str, most: int = 50, citations: int = 10_000) -> DataFrame:
    """(key, papers, citations, note): papers up to the anchor's year, if verified or, without a verdict, few enough to be the entity's own.
    papers: key, year, citations, verified."""
    skip = short_single_word("name")
    j = cohort.select(key, F.year("anchor").alias("_y")).join(papers, key).where("year <= _y")
    part = j.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("citations", F.lit(0))).alias("_c"), F.max("verified").alias("_v"))
    ok = F.coalesce("_v", (F.col("_n") <= most) & (F.col("_c") <= citations))
    out = cohort.select(key, "anchor", skip.alias("_skip")).join(part, key, "left")
    note = F.when(F.col("_skip"), "skipped_short_single_word").when(F.col("anchor").isNull(), "no_anchor").when(F.col("_n").isNull(), "none").when(~ok, "rejected").otherwise("found")
    seen = lambda c: F.when(F.col("note") == "found", F.col(c)).otherwise(0)
    return out.withColumn("note", note).select(key, seen("_n").alias("papers"), seen("_c").alias("citations"), "note")


def archive_signal(cohort: DataFrame, captures: DataFrame, key: str) -> DataFrame:
    """(key, n_12m, n_3m, careers, about_url, snapshot, lag): captures in the 365 and 91 days to the anchor, its day included; whether one up
    to it seeks people; where the firm presents itself; the latest capture and its age in days. captures: key, ts, url, mime."""
    day = captures.withColumn("day", F.to_date("ts"))
    gap = F.datediff("anchor", "day")
    daily = per_day(day, key, "day", careers=F.max(careers_flag("url")))
    part = _asof(
        cohort, daily, key, "day", gap >= 0,
        [F.coalesce(F.sum(F.when(gap <= 365, F.col("n"))), F.lit(0)).alias("n_12m"), F.coalesce(F.sum(F.when(gap <= 91, F.col("n"))), F.lit(0)).alias("n_3m"), F.max("careers").alias("careers")],
    )
    until = cohort.select(key, F.col("anchor"), (F.date_add("anchor", 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("_end"))
    before = day.join(until.select(key, "_end"), key).where(F.col("ts") <= F.col("_end"))
    about = pages.first_of(pages.latest_per_path(before, key, "ts", "url"), key).select(key, F.col("url").alias("about_url"))
    last = pages.latest_capture(until, captures, key, "_end", "ts", "url", "mime").select(key, F.col("ts").alias("snapshot"))
    out = cohort.select(key, "anchor").join(part, key, "left").join(about, key, "left").join(last, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_12m", "n_3m", "careers")], "about_url", "snapshot", pages.lag_days("anchor", "snapshot").alias("lag"))


def alumni_signal(cohort: DataFrame, alumni: DataFrame, key: str, gate_days: int = 180) -> DataFrame:
    """(key, alumnus, batch, months, how, note): the accelerator's entry by domain, else name, else a former name. alumni: slug, domain,
    name, former, batch, verified (verdict on a match by name; NULL is none). One entry by domain is trusted; several, or those by name,
    need a verdict, or to be alone."""
    a = alumni.withColumn("_b", N.season_date("batch"))
    c = cohort.select(key, "anchor", "founded", domain_host("domain").alias("_d"), alumni_name("name").alias("_n"))
    by = lambda left, right, rank, how: c.where(f"{left} <> ''").join(a.select("slug", "batch", "_b", "verified", right.alias(left)).where(f"{left} <> ''"), left).select(key, "anchor", "founded", "slug", "batch", "_b", "verified", F.lit(rank).alias("_p"), F.lit(how).alias("how"))
    former = a.withColumn("name", F.explode("former"))
    hits = by("_d", domain_host("domain"), 1, "domain").unionByName(by("_n", alumni_name("name"), 2, "name"))
    hits = hits.unionByName(c.where("_n <> ''").join(former.select("slug", "batch", "_b", "verified", alumni_name("name").alias("_n")), "_n").select(key, "anchor", "founded", "slug", "batch", "_b", "verified", F.lit(3).alias("_p"), F.lit("former").alias("how")))
    hits = hits.where(founding_gate(F.col("founded"), F.col("_b"), gate_days)).groupBy(key, "slug").agg(F.min(F.struct("_p", "how", "batch", "_b", "verified", "anchor")).alias("x"))
    flat = hits.select(key, "slug", "x.*")
    first = flat.groupBy(key).agg(F.min("_p").alias("_p"))
    flat = flat.join(first, [key, "_p"])
    n = flat.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("verified")).alias("_v"))
    ok = F.coalesce(F.col("verified"), F.col("_n") == 1)
    one = flat.join(n, key).where(ok).groupBy(key).agg(F.min(F.struct("slug", "how", "batch", "_b", "anchor")).alias("y")).select(key, "y.*")
    pre = F.coalesce(F.col("_b") <= F.col("anchor"), F.lit(False))
    note = F.when(F.col("how").isNull(), "none").when(F.col("anchor").isNull(), "no_anchor").when(F.col("_b").isNull(), "no_batch_date").when(pre, "found").otherwise("after_anchor")
    out = cohort.select(key).join(one, key, "left")
    months = F.when(pre, F.bround(N.months_between_days("anchor", "_b"), 1))
    return out.select(key, pre.cast("int").alias("alumnus"), F.when(pre, F.col("batch")).alias("batch"), months.alias("months"), "how", note.alias("note"))


def classify_responses(responses: DataFrame, key: str, text: str, sectors: Sequence[str] = SECTORS) -> DataFrame:
    """(key, score, sector, name_distinctive, note): landed answers of a classifier, as JSON perhaps within a fence. Texts that aren't JSON
    give no score, an unknown sector is other, a score outside 0 to 10 is cut."""
    bare = F.regexp_replace(F.trim(F.col(text)), r"(?s)^```[a-z]*\n?|```$", "")
    j = X.json_object(bare, "deeptech_score double, startup_sector string, name_distinctive int, reasoning string")
    out = responses.select(key, j.alias("j"))
    ok = F.col("j").isNotNull() & ~(F.col("j.deeptech_score").isNull() & F.col("j.startup_sector").isNull() & F.col("j.name_distinctive").isNull() & F.col("j.reasoning").isNull())
    sector = F.lower(F.trim(F.coalesce("j.startup_sector", F.lit("other"))))
    return out.select(
        key, F.when(ok, N.clip(F.coalesce("j.deeptech_score", F.lit(0.0)).cast("int"), 0, 10)).alias("score"), F.when(ok, F.when(sector.isin(*sectors), sector).otherwise("other")).alias("sector"),
        F.coalesce(F.when(ok, F.col("j.name_distinctive")), F.lit(1)).alias("name_distinctive"), F.when(ok, F.coalesce("j.reasoning", F.lit(""))).otherwise("json_parse_error").alias("note"),
    )


register_signal("presence", lambda c, t: presence_signal(c, t["pages"], t["key"], "day").withColumnsRenamed({"present": "wiki_present", "first_day": "wiki_first_day", "strictly_before": "wiki_before", "note": "wiki_note"}), {"wiki_present": 0})
register_signal("news", lambda c, t: news_signal(c, t["news"], t["key"], "day").withColumnsRenamed({"n_12m": "news_12m", "n_3m": "news_3m", "has_press": "news_has", "note": "news_note"}), {"news_12m": 0, "news_3m": 0, "news_has": 0})
register_signal("forum", lambda c, t: forum_signal(c, t["posts"], t["key"]).withColumnsRenamed({"mentions": "forum_mentions", "launched": "forum_launched", "first_launch": "forum_first_launch"}), {"forum_mentions": 0, "forum_launched": 0})
register_signal("launch", lambda c, t: launch_signal(c, t["launches"], t["key"]), {"launches": 0}, in_model=False)
