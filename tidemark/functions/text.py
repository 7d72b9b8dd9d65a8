"""Text expressions: names, tokens, slugs, categories, sentences and HTML, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings dropped from company names; lines of business and their keywords, the first that holds one counts.
LEGAL_SUFFIXES = [
    "inc", "incorporated", "llc", "l.l.c", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sarl", "sas", "sa", "bv",
    "holdings", "holding", "group", "partners", "partner", "technologies", "technology", "systems", "system",
]
BUCKETS = {
    "BIO": ["biotech", "biotechnology", "genetics", "life science", "medical", "pharma", "therapeutics"],
    "HARD": ["aerospace", "industrial", "machinery", "manufacturing", "robotics", "battery", "energy", "semiconductor", "sensor", "cleantech"],
    "FIN": ["fintech", "financial", "wealth management", "crypto", "cryptocurrency", "blockchain"],
    "INFRA": ["cyber", "telecommunications", "quantum", "infrastructure"],
}
OTHER_BUCKET = "SAAS"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """Lower case, everything but ASCII letters, digits and blanks to a blank, blanks collapsed."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"[^a-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def company_tokens(c: Column | str, stop: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """Words of two letters or more without legal endings, each once, in order."""
    words = F.split(norm_text(c), " ")
    stops = F.array(*[F.lit(x) for x in stop])
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 2) & ~F.array_contains(stops, x)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def ambiguous(tokens: Column) -> Column:
    return F.size(tokens) <= 1


def norm_postal(c: Column | str) -> Column:
    return F.regexp_extract(F.replace(_c(c), F.lit(" ")), r"^([A-Za-z0-9]+)", 1)


def word_count(*cs: Column | str) -> Column:
    """Words of the texts joined; an empty text has none."""
    s = F.concat_ws(" ", *[_c(c) for c in cs])
    return F.size(F.filter(F.split(s, r"\s+"), lambda x: x != ""))


def slug(c: Column | str, dashed: bool = True, most: int = 40) -> Column:
    s = F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-" if dashed else "")
    return F.left(F.regexp_replace(s, r"^-+|-+$", ""), F.lit(most))


def slug_candidates(name: Column | str, stem: Column | str | None = None, most: int = 12) -> Column:
    """Ordered distinct slugs under which a name may be listed."""
    base, compact = slug(name), slug(name, dashed=False)
    more = [F.concat(base, F.lit(s)) for s in ("-2", "-3")] + [F.concat(compact, F.lit(s)) for s in ("db", "io", "app", "hq", "ai")]
    arr = F.array(base, compact, *more, *([_c(stem)] if stem is not None else []))
    return F.slice(F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != ""))), 1, most)


def surnames(c: Column | str) -> Column:
    """Sorted last words of the comma-separated persons, upper case, letters, hyphen and apostrophe, two or more."""
    last = lambda p: F.regexp_replace(F.upper(F.element_at(F.split(F.trim(p), r"\s+"), -1)), r"[^A-Z'\-]", "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(_c(c), ","), last), lambda x: F.length(x) >= 2)))


def keyword_bucket(c: Column | str, rules: dict[str, Sequence[str]] | None = None, default: str = OTHER_BUCKET) -> Column:
    """The first bucket of which a keyword occurs in the normal form of a text, else the default."""
    t, out = norm_text(c), None
    for label, words in (rules or BUCKETS).items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c).cast("string"))).isin("1", "true", "t", "yes", "y")


def sentences(c: Column | str, longer_than: int = 20) -> Column:
    return F.filter(F.transform(F.split(_c(c), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def url_path(c: Column | str) -> Column:
    """Path of a URL in lower case, without a final slash; / if none."""
    p = F.regexp_extract(F.lower(_c(c)), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)
    p = F.regexp_replace(p, r"/+$", "")
    return F.when(p == "", "/").otherwise(p)


def html_to_text(c: Column | str) -> Column:
    """Text of a page: scripts, styles, navigation and other furniture dropped, tags to blanks, entities decoded."""
    s = F.regexp_replace(_c(c), r"(?is)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style|nav|header|footer|svg|noscript|template)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def quote_verified(text: Column | str, quote: Column | str, least: int = 8) -> Column:
    """Whether a quote of some length occurs literally in the text, but for case and outer blanks."""
    q = F.lower(F.trim(_c(quote)))
    return F.coalesce((F.length(q) >= least) & F.contains(F.lower(_c(text)), q), F.lit(False))


def json_object(c: Column | str, schema: str) -> Column:
    """The object between the first { and the last } of a text, parsed; NULL if it is none."""
    return F.from_json(F.regexp_extract(_c(c), r"(?s)(\{.*\})", 1), schema)


def cache_key(stem: Column | str, *parts: Column | str) -> Column:
    joined = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.concat(F.left(F.regexp_replace(_c(stem), r"[^A-Za-z0-9._-]", "_"), F.lit(30)), F.lit("_"), F.left(F.md5(joined), F.lit(12)))
