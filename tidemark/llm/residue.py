"""Template residue and error-page text, by a regularised linear classifier on weak labels.

Texts are cut into sentences. A sentence's features are hashed word uni- and bigrams (case folded, digits
as 0, punctuation kept), its length and that of its page, the shares of capitals and signs, and those of the
title, which the first sentence is or holds: whether it is the first, short, or names the host.

Weak labels come from a few SEEDS, from the response status and from what else a page holds. They miss most
wordings; so the classifier, a logistic regression with an L2 penalty, is fitted ROUNDS times, and from the
second time on the sentences it found stand beside the seeds: the wordings that share pages with known ones
are learnt from them. It is fitted to at most about SAMPLE sentences, drawn by a hash of the page from hosts
with hash % HOLD_OUT > 0; the other hosts serve validation (see validate). Every page is then scored whole:
it is residue if some sentence is, and at most ONE other sentence of content stands beside.
"""

from __future__ import annotations

import re
import sys
import zlib
from http import HTTPStatus

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

ship(sys.modules[__name__])

BITS, SAMPLE, HOLD_OUT, ONE, L2, STEPS, ROUNDS, SURE, MENTION = 18, 80_000, 10, 1, 2e-5, 120, 3, 1.0, 8.0
#: The first indexes, kept for what isn't hashed.
DENSE = 32
#: Seeds of weak labels: the shapes of template slots, the long words with which the usual filler begins, a few phrases, and errors' names.
SLOTS = r"\{\{|\$\{|<%|__[A-Z]{3,}|%[A-Z_]{4,}%|\[[A-Z][A-Za-z]* ?[A-Z]|\bX{4,}\b"
FILLER = r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|eiusmod|incididunt|labore|aliqua|hoodie|sriracha|kombucha|fixie|typewriter)\b"
PHRASES = r"your (?:text|title|headline|own content)|goes here|sample (?:page|text)|javascript|scripts|browser|not found|forbidden|server error|unavailable|timed out|for sale|suspended|maintenance|coming soon"
#: An error's number with its name, by the HTTP standard.
STATUS = re.compile("|".join(rf"\b{x.value}\W{{1,3}}{re.escape(x.phrase)}\b" for x in HTTPStatus if x.value >= 400), re.I)
SEEDS = re.compile(f"{SLOTS}|(?i:{FILLER}|{PHRASES})")
_NUMBER = re.compile(r"\b[45]\d\d\b")
_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MENU = re.compile(r"(?:\b(?:home|about|team|blog|contact|menu|search|product|pricing|careers|log in|services|skip to content|loading\.\.\.|privacy|terms|sitemap)\b\s*)+", re.I)


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(text)) if s]


def seeded(s: str) -> bool:
    return bool(SEEDS.search(s) or (_NUMBER.search(s) and STATUS.search(s)))


def content(s: str) -> bool:
    """Whether a sentence says more than a menu or a name."""
    return len(MENU.sub(" ", s).split()) >= 4


def features(s: str, first: bool, host: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indexes and values of one sentence."""
    raw = _TOKEN.findall(s)
    toks = ["0" if t[0].isdigit() else t.lower() for t in raw]
    caps = sum(t.isupper() and len(t) > 3 for t in raw)
    signs = sum(not t[0].isalnum() for t in raw)
    crc, room = zlib.crc32, (1 << BITS) - DENSE
    got = {crc(t.encode()) % room for t in toks}
    got.update(crc((a + " " + b).encode()) % room for a, b in zip(toks, toks[1:]))
    idx = np.fromiter((g + DENSE for g in got), dtype=np.int64, count=len(got))
    val = np.full(len(idx), 1.0 / np.sqrt(max(1, len(idx))), dtype=np.float32)
    n = max(1, len(toks))
    named = first and bool(host) and host in "".join(toks)
    dense = np.array([1.0, min(3.0, np.log1p(n)) / 3, n <= 3, first, caps / n, signs / n, first and n <= 6, named], dtype=np.float32)
    return np.concatenate([np.arange(len(dense)), idx]), np.concatenate([dense, val])


def page_features(text: str, host: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    sents = sentences(text)
    stem = re.sub(r"[^a-z]", "", (host or "").lower().split(".")[0])
    return [features(s, k == 0, stem) for k, s in enumerate(sents)]


def label_page(hit: np.ndarray, own: np.ndarray, words: np.ndarray, error: bool) -> tuple[np.ndarray, np.ndarray]:
    """(label, weight) of a page's sentences; weight 0 where nothing can be said."""
    n, hits, plain = len(hit), int(hit.sum()), int((own & ~hit).sum())
    y, w = np.zeros(n), np.zeros(n)
    if hits and plain <= 2 or hits > 1:
        y[hit], w[hit] = 1, 1.0
        if plain <= max(2, hits):
            y[~hit], w[~hit] = 1, 0.15
    elif hits and plain >= 4:
        w[hit & (words >= 11)] = MENTION  # content that mentions such things
    elif not hits and error and n <= 3:
        y[:], w[:] = 1, 0.3
    elif not hits:
        w[:] = 1.0 if plain >= 3 else 0.5  # a short page may be residue in words not known yet
    return y, w


def draw(batches):
    """Features and marks of the sentences of pages (page, text, status, host), a row per page."""
    for pdf in batches:
        rows = []
        for page, text, status, host in zip(pdf["page_id"], pdf["text"], pdf["status"], pdf["host"]):
            sents = sentences(text)
            if sents:
                got = page_features(text, host)
                size = np.array([len(i) for i, _ in got], np.int32)
                marks = np.array([(seeded(s), content(s), len(s.split())) for s in sents], np.int32)
                idx, val = (np.concatenate(x) for x in zip(*got))
                rows.append((page, idx.astype(np.int32).tobytes(), val.astype(np.float32).tobytes(), size.tobytes(), marks.tobytes(), bool(status) and status[:1] in "45"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DRAWN.split(", ")])


DRAWN = "page bigint, i binary, v binary, size binary, marks binary, error boolean"


def descend(theta: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """STEPS of accelerated full-batch gradient descent on the weighted logistic loss with an L2 penalty."""
    ahead, rate = theta.copy(), 4.0
    for k in range(STEPS):
        z = np.bincount(row, weights=ahead[idx] * val, minlength=len(y))
        g = np.bincount(idx, weights=((1 / (1 + np.exp(-z)) - y) * w)[row] * val, minlength=len(theta)) + L2 * ahead
        new = ahead - rate * g
        ahead = new + k / (k + 3) * (new - theta)
        theta = new
    return theta


def fit_pages(pdf: pd.DataFrame) -> np.ndarray:
    """Weights from the drawn pages; zero where one of the labels doesn't occur."""
    theta = np.zeros(1 << BITS)
    if not len(pdf):
        return theta
    pdf = pdf.sort_values("page", kind="stable")
    join = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
    idx, val, size, marks = join("i", np.int32), join("v", np.float32), join("size", np.int32), join("marks", np.int32).reshape(-1, 3)
    row = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum([len(x) // 4 for x in pdf["size"]])
    seeded, own, words = marks[:, 0] > 0, marks[:, 1] > 0, marks[:, 2]
    hit = seeded
    for _ in range(ROUNDS):
        labels = [label_page(hit[a:b], own[a:b], words[a:b], e) for a, b, e in zip([0, *ends[:-1]], ends, pdf["error"])]
        y, w = (np.concatenate(x) for x in zip(*labels))
        pos, neg = w[y == 1].sum(), w[y == 0].sum()
        if not pos or not neg:
            break
        theta = descend(theta, idx, val, row, y, w * np.where(y == 1, 0.5 / pos, 0.5 / neg))
        hit = seeded | (np.bincount(row, weights=theta[idx] * val, minlength=len(size)) > SURE)
    return theta


def fit(batches):
    """One row with the weights fitted to all batches."""
    got = [b for b in batches if len(b)]
    pdf = pd.concat(got) if got else pd.DataFrame(columns=[c.split()[0] for c in DRAWN.split(", ")])
    yield pd.DataFrame({"theta": [fit_pages(pdf).astype(np.float32).tobytes()], "n": [len(pdf)]})


def page_score(text: str, host: str | None, theta: np.ndarray, memo: dict, weak: bool) -> tuple[int, int, float, int]:
    """(residue sentences, content sentences, greatest score, weak label or -1) of a page."""
    bad = own = seeds = plain = 0
    top = -np.inf
    stem = re.sub(r"[^a-z]", "", (host or "").lower().split(".")[0])
    for k, s in enumerate(sentences(text)):
        key = (s, stem if k == 0 else None)
        got = memo.get(key)
        if got is None:
            i, v = features(s, k == 0, stem)
            got = float(theta[i] @ v), content(s), weak and seeded(s)
            if len(memo) > 200_000:
                memo.clear()
            memo[key] = got
        z, full, seed = got
        bad += z > 0
        own += z <= 0 and full
        seeds += seed
        plain += full and not seed
        top = max(top, z)
    return bad, own, top, -1 if not weak else 1 if seeds and plain <= ONE else 0 if not seeds and plain >= 4 else -1


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", F.col("full_text").alias("text"), F.col("statuscode").alias("status"), F.col("domain_clean").alias("host"),
        F.pmod(F.xxhash64(F.coalesce("domain_clean", F.lit("")), F.lit(7)), F.lit(HOLD_OUT)).alias("fold"),
        F.pmod(F.xxhash64("page_id", F.lit(11)), F.lit(1 << 20)).alias("h"),
    )


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted to at most about sample sentences of the hosts that aren't held out.

    The table is scanned and its pages are made features by all tasks; only the drawn pages travel to the one
    that fits. Two captures of one page with different texts count as two pages of one id.
    """
    p = _pages(pages).where("fold > 0 AND text IS NOT NULL AND page_id IS NOT NULL")
    count = p.agg(F.sum(F.greatest(F.lit(1), F.size(F.split("text", r"[.!?]\s")))).alias("n")).first().n or 0
    part = (1 << 20) if count <= sample else int((1 << 20) * sample / count)
    drawn = p.where(F.col("h") < part).select("page_id", "text", "status", "host").mapInPandas(draw, DRAWN)
    got = drawn.repartition(1).mapInPandas(fit, "theta binary, n bigint").first()
    return np.frombuffer(got.theta, np.float32) if got else np.zeros(1 << BITS, np.float32)


def score_pages(pages: DataFrame, theta: np.ndarray, weak: bool = False) -> DataFrame:
    """(page_id, fold, n_residue, n_content, score, weak, residue) for every page that has a text.

    weak is the page's label by the seeds alone, NULL where they leave it open or it isn't asked for. NULL, empty and blank texts give
    no row; repeated pages give a row each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(theta)  # a model of fixed size, 1 MB

    def run(batches):
        memo: dict = {}
        for pdf in batches:
            got = [page_score(t, h, shared.value, memo, weak) for t, h in zip(pdf["text"], pdf["host"])]
            cols = {c: [g[i] for g in got] for i, c in enumerate(("n_residue", "n_content", "score", "weak"))}
            yield pd.DataFrame({"page_id": pdf["page_id"], "fold": pdf["fold"]} | cols)

    p = _pages(pages).where("text IS NOT NULL AND trim(text) <> '' AND page_id IS NOT NULL").select("page_id", "fold", "text", "host")
    out = p.mapInPandas(run, "page_id bigint, fold int, n_residue int, n_content int, score double, weak int")
    return out.withColumns({"residue": (F.col("n_residue") >= 1) & (F.col("n_content") <= ONE), "weak": F.when(F.col("weak") >= 0, F.col("weak"))})


def validate(scored: DataFrame) -> DataFrame:
    """(unseen, n, share, labelled, positive, precision, recall, accuracy): decisions against the weak labels, for the hosts
    that the classifier was fitted to and for those held out."""
    hit, weak = F.col("residue").cast("double"), F.col("weak")
    return scored.groupBy((F.col("fold") == 0).alias("unseen")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("share"), F.count("weak").alias("labelled"), F.sum(weak).alias("positive"),
        F.avg(F.when(F.col("residue") & weak.isNotNull(), weak.cast("double"))).alias("precision"),
        F.avg(F.when(weak == 1, hit)).alias("recall"), F.avg(F.when(weak.isNotNull(), (hit == weak).cast("double"))).alias("accuracy"),
    )
