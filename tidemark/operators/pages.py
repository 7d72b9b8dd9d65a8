"""Operators on captured pages: latest before an anchor, latest per path, first of a priority list, snippets, combined texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import html_to_text, url_path

# Where firms present themselves, the first that exists counts.
ABOUT_PATHS = ["/about", "/about-us", "/team", "/about/team", "/our-team", "/about/our-team", "/leadership", "/who-we-are", "/our-story"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stamp(c: Column | str) -> Column:
    """14 digits of a UTC timestamp."""
    return F.date_format(_c(c), "yyyyMMddHHmmss")


def from_stamp(c: Column | str) -> Column:
    """The UTC timestamp of 14 digits; NULL if they name none."""
    return F.try_to_timestamp(_c(c), F.lit("yyyyMMddHHmmss"))


def lag_days(anchor: Column | str, captured: Column | str) -> Column:
    """Whole days from a capture to the anchor."""
    return F.datediff(_c(anchor), F.to_date(_c(captured)))


def latest_capture(anchors: DataFrame, captures: DataFrame, key: str, anchor: str, ts: str, url: str, mime: str) -> DataFrame:
    """(key, ts, url, mime): each key's latest capture at or before its anchor, HTML preferred to anything else.

    The inequality is inside an aggregate that combines map-side, so a key with many captures brings one row per task. Keys
    without such a capture give no row; equal times go to the greatest url.
    """
    a = anchors.where(F.col(anchor).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(anchor).alias("_a"))
    c = captures.join(a, F.col(key) == F.col("_k")).where(F.col(ts) <= F.col("_a"))
    row = F.struct(F.coalesce(F.contains(F.lower(mime), F.lit("html")), F.lit(False)).alias("html"), F.col(ts).alias("ts"), F.col(url).alias("url"), F.col(mime).alias("mime"))
    return c.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.ts", "r.url", "r.mime")


def latest_per_path(captures: DataFrame, key: str, ts: str, url: str) -> DataFrame:
    """(key, path, ts, url): the newest capture of each path."""
    return captures.groupBy(key, url_path(url).alias("path")).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(url).alias("url"))).alias("r")).select(key, "path", "r.ts", "r.url")


def first_of(paths: DataFrame, key: str, wanted: Sequence[str] = ABOUT_PATHS) -> DataFrame:
    """Of (key, path, ...) the row whose path comes first in a list of wanted ones."""
    rank = F.array_position(F.array(*[F.lit(p) for p in wanted]), F.col("path"))
    rest = [c for c in paths.columns if c != key]
    found = paths.withColumn("_r", rank).where("_r > 0").groupBy(key).agg(F.min(F.struct("_r", *rest)).alias("x"))
    return found.select(key, *[f"x.{c}" for c in rest])


def snippets(text: Column | str, pattern: str, around: int = 260, glue: str = " ... ") -> Column:
    """What stands around each match of a pattern, joined; NULL without a match. Needs the places of matches, so it runs in Arrow batches."""
    p = re.compile(pattern, re.I)

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            got = [t[max(0, m.start() - around) : m.end() + around].strip() for m in p.finditer(t)] if t else []
            return glue.join(got) or None

        return texts.map(one, na_action="ignore")

    return cut(_c(text))


def page_text(html: Column | str, most: int | None = None) -> Column:
    """Text of a page, cut to so many letters where a consumer takes no more."""
    t = html_to_text(html)
    return t if most is None else F.left(t, F.lit(most))


def combine(parts: dict[str, Column | str], founders: Column | str | None = None) -> Column:
    """Texts one below the other, each under its heading, absent ones left out; founders as a last line."""
    block = lambda h, c: F.when(F.coalesce(F.trim(_c(c)), F.lit("")) != "", F.concat(F.lit(f"[{h}]\n"), F.trim(_c(c))))
    blocks = [block(h, c) for h, c in parts.items()]
    if founders is not None:
        blocks.append(F.when(F.coalesce(F.trim(_c(founders)), F.lit("")) != "", F.concat(F.lit("Founders: "), F.trim(_c(founders)))))
    return F.concat_ws("\n\n", *blocks)


def post_slug(url: Column | str) -> Column:
    """The slug of a launch's address, and without its number of recurrence."""
    s = F.regexp_extract(F.lower(_c(url)), r"/(?:posts|products)/([a-z0-9-]+)", 1)
    return F.struct(F.when(s != "", s).alias("slug"), F.when(s != "", F.regexp_replace(s, r"-\d+$", "")).alias("base"))


def names_in(sentence: Column | str, names: Column | str) -> Column:
    """Whether any of the names (an array) occurs in a sentence, in any case."""
    s = F.lower(_c(sentence))
    return F.coalesce(F.exists(_c(names), lambda n: F.contains(s, F.lower(n))), F.lit(False))
