"""Evaluation passages in a training corpus, found by spaced-seed hashing.

Texts become word ids (case and punctuation dropped; words of no test item are 0). A seed is a fixed mask
over SPAN words of which only the marked positions are hashed, so a substituted word under a gap doesn't
hide a hit. Hashes of all positions of all documents are joined with those of the test items: the items
are a stated, small set, split into blocks of at most BLOCK_WORDS words whose sorted hashes travel to the
scan; every block is held against all rows. Around the hits of one document and item the shared stretches
are aligned word by word, substitutions, insertions and deletions included, each run of hits on about one
diagonal by itself too, so that parts count in whatever order they come; what they mark of the item is
united and measured in characters of the item.
"""

from __future__ import annotations

import difflib
import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

ship(sys.modules[__name__])

# The masks. Each has weight 5 and misses a substitution at other places than the rest.
MASKS = ["11011011", "1101010011", "10110101", "1110011"]
#: Least share of an item's characters, and least words of a run that counts.
SHARE, RUN_WORDS, GAP_WORDS, BLOCK_WORDS = 0.4, 8, 4, 100_000
WORD = re.compile(r"\w+", re.UNICODE)


def seed_hashes(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask: positions at which all marked words are known, and their hashes."""
    out = []
    for m, mask in enumerate(MASKS):
        offsets = [i for i, b in enumerate(mask) if b == "1"]
        n = len(ids) - offsets[-1]
        if n <= 0:
            out.append((np.empty(0, np.int64), np.empty(0, np.uint64)))
            continue
        h, ok = np.full(n, 1469598103934665603 + m, dtype=np.uint64), np.ones(n, dtype=bool)
        for o in offsets:
            part = ids[o : o + n]
            ok &= part > 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(ok)
        out.append((at, h[at]))
    return out


class Index:
    """Seed hashes of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.items = []
        parts = []
        for k, (item_id, text) in enumerate(items):
            spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
            words = [text[a:b].lower() for a, b in spans]
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64)
            self.items.append((item_id, ids, spans, len(text.strip())))
            for at, h in seed_hashes(ids):
                parts.append((h, np.full(len(h), k), at))
        cat = lambda i, t: np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t)
        h, owner, at = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.at = h[order], owner[order].astype(np.int64), at[order].astype(np.int64)

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item index -> (document position, item position) of every seed hit."""
        out: dict[int, list[tuple[int, int]]] = {}
        for at, h in seed_hashes(ids):
            lo = np.searchsorted(self.hash, h, "left")
            hi = np.searchsorted(self.hash, h, "right")
            for i in np.flatnonzero(hi > lo):
                for j in range(lo[i], hi[i]):
                    out.setdefault(int(self.owner[j]), []).append((int(at[i]), int(self.at[j])))
        return out


def mark(marked: np.ndarray, blocks: list) -> None:
    """Mark the item's words in the runs of rising blocks; those less than GAP_WORDS apart on both sides join into a run."""
    run: list = []
    for b in [*blocks, None]:
        if b is not None and b.size == 0:
            continue
        if run and (b is None or b.a - (run[-1].a + run[-1].size) > GAP_WORDS or b.b - (run[-1].b + run[-1].size) > GAP_WORDS):
            same, first, last = sum(x.size for x in run), run[0].b, run[-1].b + run[-1].size
            # a run is mostly shared words; a chance chain of short phrases is not
            if same >= RUN_WORDS and max(x.size for x in run) >= 4 and same >= 0.6 * (last - first):
                marked[first:last] = True
            run = []
        if b is not None:
            run.append(b)


def chains(hits: list[tuple[int, int]], reach: int) -> list[list[tuple[int, int]]]:
    """Sorted hits (document position, item position), parted by diagonal: each joins the chain that ends nearest to its own."""
    done, live = [], []
    for d, q in hits:
        done += [c for c in live if d - c[-1][0] > reach]
        live = [c for c in live if d - c[-1][0] <= reach]
        off = lambda c: abs((d - q) - (c[-1][0] - c[-1][1]))  # noqa: B023, E731
        best = min(live, key=off, default=None)
        if best is not None and off(best) <= GAP_WORDS:
            best.append((d, q))
        else:
            live.append([(d, q)])
    return done + live


def band(doc: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[int, list[int], list[int]]:
    """(start, words, item's words): the stretch of doc that item covers on the diagonals low to high; words without a partner there are -1 and -2."""
    lo, hi = max(0, low), min(len(doc), high + len(item))
    part = doc[lo:hi]
    ours, theirs = np.zeros(len(part), dtype=bool), np.zeros(len(item), dtype=bool)
    for off in range(low - lo, high - lo + 1):  # item word q against word q + off of the part
        q0, q1 = max(0, -off), min(len(item), len(part) - off)
        if q0 < q1:
            same = item[q0:q1] == part[q0 + off : q1 + off]
            ours[q0 + off : q1 + off] |= same
            theirs[q0:q1] |= same
    return lo, np.where(ours, part, -1).tolist(), np.where(theirs, item, -2).tolist()


def covered(doc: np.ndarray, item: np.ndarray, spans: list, hits: list[tuple[int, int]]) -> int:
    """Characters of the item in the runs that the document reproduces around the hits.

    Hits are grouped where they lie close in the document; each stretch, widened by the item's length
    at most, is aligned with the item. That counts runs in the item's order only, so where not all of
    the item is marked, each chain of hits is aligned by itself as well, on the diagonals around it.
    """
    marked = np.zeros(len(item), dtype=bool)
    hits = sorted(set(hits))
    groups, start = [], 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k][0] - hits[k - 1][0] > len(item):
            groups.append(hits[start:k])
            start = k
    for g in groups:
        lo = max(0, g[0][0] - g[0][1] - GAP_WORDS)
        lo = min(lo, g[0][0])
        lo = max(lo, g[0][0] - len(item))
        hi = min(len(doc), g[-1][0] + len(item))
        mark(marked, difflib.SequenceMatcher(None, doc[lo:hi].tolist(), item.tolist(), autojunk=False).get_matching_blocks())
    for c in chains(hits, len(item)):
        if all(marked[q] for _, q in c):
            continue
        diagonals = [d - q for d, q in c]
        low, high = min(diagonals) - GAP_WORDS, max(diagonals) + GAP_WORDS
        lo, ours, theirs = band(doc, item, low, high)
        blocks = difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_matching_blocks()
        mark(marked, [b for b in blocks if low <= lo + b.a - b.b <= high])
    total, k = 0, 0
    while k < len(item):
        if marked[k]:
            e = k
            while e + 1 < len(item) and marked[e + 1]:
                e += 1
            total += spans[e][1] - spans[k][0]
            k = e + 1
        else:
            k += 1
    return total


def scan(index: Index, least: float = SHARE):
    """The function that finds a block of items in a stream of (doc_id, text)."""

    def run(batches):
        get = index.vocab.get
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                if not text:
                    continue
                ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], dtype=np.int64)
                for k, found in index.hits(ids).items():
                    item_id, item, spans, length = index.items[k]
                    # each hit vouches for one seed's span and the words that an alignment may add up to the next
                    reach = np.zeros(len(item) + 32, dtype=bool)
                    for _, q in found:
                        reach[max(0, q - 16) : q + 24] = True
                    if reach[: len(item)].sum() < least * len(item) * 0.5:
                        continue
                    n = covered(ids, item, spans, found)
                    if n:
                        out.append((doc_id, item_id, n / max(1, length)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, least: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share): documents that reproduce at least that share of an item's characters.

    docs: doc_id, text. items: item_id, text; items that are NULL or hold no word are never found, nor
    are items of fewer than RUN_WORDS words. NULL and empty documents give no row. A document listed twice gives its
    rows once; likewise an item. Columns other than these are not read.
    """
    rows = sorted({(r.item_id, r.text) for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator()})
    blocks: list[list] = [[]]
    words = 0
    for r in rows:
        n = len(WORD.findall(r[1]))
        if words + n > BLOCK_WORDS and blocks[-1]:
            blocks.append([])
            words = 0
        blocks[-1].append(r)
        words += n
    out = None
    for b in blocks:
        part = docs.select("doc_id", "text").mapInPandas(scan(Index(b), least), "doc_id bigint, item_id bigint, share double")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("share") >= least).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
