"""Lines of business and the ways they are shortened, learnt from the names themselves.

The last word of an organisation's name, or its last two, is its tail, the rest its head. Tails with LINE of all heads
or more are lines of business: names end with them whatever comes before. Firms are written with their line in full at one
place and shortened at another, so a shortened form shares its heads with its line and with no other: a tail is a
form of the line with which it shares most heads, if these are half of its own or more. There are at most
2 / LINE lines and 2 / FORM forms, however many names there are; only these reach the driver.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import Lexicon, name_words
from tidemark.session import discard, materialize, ship

ship(sys.modules[__name__])

#: Least shares of all heads of a line and of a form; fewest heads of each; share of a form's heads that its line must have; share of a word's
#: heads from which on it is but the end of a line of two words.
LINE, FORM, FEWEST_LINE, FEWEST_FORM, SAME, END = 0.01, 1e-4, 5, 2, 0.5, 0.8


def tails(batches):
    """name -> (tail, head), for tails of one and two words."""
    for pdf in batches:
        rows = []
        for name in pdf["name"]:
            t = name_words(name)
            for k in (1, 2):
                if len(t) > k:
                    rows.append((" ".join(t[-k:]), " ".join(sorted(t[:-k]))))
        yield pd.DataFrame(rows, columns=["tail", "head"])


def shortened(a: str, b: str) -> bool:
    """Whether one of two tails holds the other's letters in order from the first one on, or is its initials."""
    short, long = sorted((a.replace(" ", ""), b.replace(" ", "")), key=len)
    rest = iter(long)
    return short[:1] == long[:1] and all(c in rest for c in short)


def learn(names: DataFrame) -> Lexicon:
    """The lexicon of names (name): NULL and empty names say nothing, repeated ones count once; no names give an empty lexicon."""
    t = names.where("name IS NOT NULL AND trim(name) <> ''").select("name").distinct().mapInPandas(tails, "tail string, head string").distinct()
    t = materialize(t, "tails")
    total = t.agg(F.count_distinct("head").alias("n")).first().n
    freq = t.groupBy("tail").agg(F.count(F.lit(1)).alias("n"))
    found = {r.tail: r.n for r in freq.where(F.col("n") >= max(FEWEST_LINE, LINE * total)).collect()}
    ends = {k.split()[1] for k, n in found.items() if " " in k and n >= END * found.get(k.split()[1], n)}
    # of two words of which the second one is a line by itself, the first belongs to the name
    lines = {k for k in found if k not in ends and not (" " in k and k.split()[1] in found and k.split()[1] not in ends)}
    if not lines:
        discard(t)
        return Lexicon((), {})
    known = F.array(*[F.lit(x) for x in sorted(lines)])
    per_head = t.where(F.array_contains(known, F.col("tail"))).groupBy("head").agg(F.collect_set("tail").alias("lines"))  # 2 / LINE at most
    both = t.join(per_head, "head").select("tail", F.explode("lines").alias("line")).where("tail <> line").groupBy("tail", "line").agg(F.count(F.lit(1)).alias("both"))
    best = both.groupBy("tail").agg(F.max(F.struct("both", "line")).alias("b")).join(freq, "tail")
    ok = (F.col("n") >= max(FEWEST_FORM, FORM * total)) & (F.col("b.both") >= FEWEST_FORM) & (F.col("b.both") >= SAME * F.col("n"))
    forms = {r.tail: (r.line, r.n) for r in best.where(ok).select("tail", "b.line", "n").collect()}
    discard(t)
    # a line that is but a form of a more frequent one, and forms of those; firms of two lines may share heads too, so the letters must tell
    to = {k: v[0] for k, v in forms.items() if k not in lines or (found[k] < found[v[0]] and shortened(k, v[0]))}
    root = {}
    for k in [*lines, *to]:
        x, seen = k, set()
        while x in to and x not in seen:
            seen.add(x)
            x = to[x]
        root[k] = x
    join = lambda w: w.replace(" ", "")
    return Lexicon(tuple(sorted({join(v) for v in root.values()})), {join(k): join(v) for k, v in root.items()})
