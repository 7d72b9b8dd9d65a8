"""Name, domain and founder expressions beyond the plain normal forms, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.tables import norm_null

# What the name normalisers drop.
PATENT_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "gmbh", "plc", "limited", "company"]
ALUMNI_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "gmbh", "s.a.", "plc", "company", "the"]
CORE_SUFFIXES = [
    "inc", "llc", "ltd", "corp", "co", "company", "gmbh", "plc", "ai", "lab", "labs", "tech", "technologies", "systems", "digital", "software",
    "platform", "app", "studio", "studios", "network", "networks", "cloud", "data", "solutions", "services", "group", "ventures", "partners",
]
TECH_WORDS = ["ai", "lab", "labs", "tech", "technologies", "systems", "robotics", "bio", "therapeutics", "health"]
FOUNDER_NAME_SUFFIXES = ["inc", "llc", "ltd", "corp", "co", "company", "technologies", "tech", "labs", "health", "bio", "ai", "io", "app"]
FOUNDER_STOP = ["prof", "with", "from", "corp"]
SURNAME_SUFFIXES = [
    "JR", "SR", "II", "III", "IV", "V", "MD", "PHD", "DVM", "DDS", "MBA", "CPA", "ESQ", "PE", "JD", "CFA", "CFP", "RN", "DO", "PHARMD", "MSC",
    "BSC", "DPHIL", "FACS", "FRCS", "MRCOG", "MRCP",
]
SLUG_TLDS = ["com", "io", "ai", "co", "net", "org", "tech", "app", "dev"]
CAREERS = ["/careers", "/jobs", "/hiring", "/join-us", "/join"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_pattern(words: Sequence[str], dot: bool = False) -> str:
    """A pattern that matches any of the words whole, the longest first; with dot also a full stop after it."""
    body = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" + (r"\.?" if dot else "")


def patent_name(c: Column | str) -> Column:
    """Upper case without legal endings, blanks collapsed, only what a LIKE pattern may hold."""
    s = F.regexp_replace(F.trim(_c(c)), word_pattern(PATENT_SUFFIXES, dot=True), " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.upper(F.regexp_replace(s, r"[^A-Za-z0-9 &'\-.,]", ""))


def alumni_name(c: Column | str) -> Column:
    """Lower case letters and digits only, legal endings and the article dropped."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), word_pattern(ALUMNI_SUFFIXES, dot=True), " ")
    return F.regexp_replace(s, r"[^a-z0-9]+", "")


def domain_host(c: Column | str, query: bool = True) -> Column:
    """Host of an address in lower case without scheme, path and www.; with query also without what follows a question mark."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"^https?://", "")
    s = F.regexp_replace(s, r"[/?].*$" if query else r"/.*$", "")
    return F.trim(F.regexp_replace(s, r"^www\.", ""))


def domain_label(c: Column | str) -> Column:
    """The first label of a host, as written."""
    return F.substring_index(F.regexp_replace(F.lower(F.trim(_c(c))), r"^https?://|/.*$", ""), ".", 1)


def domain_slug(c: Column | str) -> Column:
    """Letters and digits of a host without its last label, if that is a usual one."""
    s = F.regexp_replace(domain_host(c, query=False), r"\.(?:" + "|".join(SLUG_TLDS) + r")$", "")
    return F.regexp_replace(s, r"[^a-z0-9]", "")


def registrable_domain(c: Column | str, suffixes: Sequence[str] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")) -> Column:
    """The label before a public suffix with the suffix: the last two labels, or three below one of the given suffixes."""
    labels = F.split(domain_host(c), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when((F.size(labels) >= 3) & last(2).isin(*suffixes), last(3)).otherwise(last(2))


def core_word_count(c: Column | str) -> Column:
    """Words of two letters or more once generic endings are dropped, 1 at least."""
    s = F.regexp_replace(F.coalesce(_c(c), F.lit("")), word_pattern(CORE_SUFFIXES, dot=True), "")
    return F.greatest(F.lit(1), F.size(F.filter(F.split(s, r"\s+"), lambda w: F.length(w) >= 2)))


def has_word(c: Column | str, words: Sequence[str]) -> Column:
    """1 if any of the words occurs whole, in any case."""
    return F.coalesce(_c(c).rlike(word_pattern(words)), F.lit(False)).cast("int")


def contains_any(c: Column | str, parts: Sequence[str]) -> Column:
    """1 if any of the parts occurs, in any case."""
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(s, F.lit(p.lower()))
    return out.cast("int")


def founder_cell(c: Column | str, least: int = 3) -> Column:
    """The persons of a cell parted by commas or semicolons: lower case, blanks collapsed, each once in order."""
    one = lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " "))
    return F.array_distinct(F.filter(F.transform(F.split(norm_null(c), "[,;]+"), one), lambda p: F.length(p) >= least))


def founder_in_name(company: Column | str, founders: Column | str) -> Column:
    """1 if a word of four letters or more of a founder's name is a word of the company's name without its endings."""
    name = F.regexp_replace(F.lower(F.trim(_c(company))), word_pattern(FOUNDER_NAME_SUFFIXES, dot=True), "")
    words = F.split(F.trim(F.regexp_replace(name, r"[^a-z]+", " ")), " ")
    tokens = F.split(F.regexp_replace(F.lower(norm_null(founders)), r"[^a-z]", " "), r"\s+")
    said = F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*FOUNDER_STOP))
    return F.coalesce(F.arrays_overlap(words, said), F.lit(False)).cast("int")


def surname_clean(c: Column | str) -> Column:
    """A surname as a key: before a comma, without titles and generations, upper case letters, hyphen and apostrophe."""
    s = F.trim(F.substring_index(F.upper(F.trim(_c(c))), ",", 1))
    s = F.regexp_replace(s, r"\s+(?:" + "|".join(SURNAME_SUFFIXES) + r")\b\.?", "")
    return F.regexp_replace(s, r"[^A-Z'\-]", "")


def usd_text(c: Column | str) -> Column:
    """An amount for people: $1.25B, $2.50M, $30k, $7; empty for none."""
    v = _c(c).cast("double")
    return (
        F.when(v >= 1e9, F.format_string("$%.2fB", v / 1e9)).when(v >= 1e6, F.format_string("$%.2fM", v / 1e6))
        .when(v >= 1e3, F.format_string("$%.0fk", v / 1e3)).when(v > 0, F.format_string("$%.0f", v)).otherwise("")
    )


def careers_flag(url: Column | str, parts: Sequence[str] = CAREERS) -> Column:
    """1 if an address is one of those where firms seek people."""
    return contains_any(url, parts)


def founder_signals(text: Column | str, anchors: Sequence[str], degrees: Sequence[str], serial: Sequence[str], exits: Sequence[str]) -> Column:
    """Flags of a text about founders: named, doctorate, founded before, sold before; only where an anchor word occurs."""
    near = has_word(text, anchors) == 1
    flag = lambda words: (near & (has_word(text, words) == 1)).cast("int")
    return F.struct(near.cast("int").alias("named"), flag(degrees).alias("doctorate"), flag(serial).alias("serial"), flag(exits).alias("exits"))
