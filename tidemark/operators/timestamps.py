"""Mixed timestamp formats and zones: all readings as arrays, chosen by Viterbi over each source's record order.

Emission cost: a reading against the source's declared order of day, month and year costs AGAINST, one
where nothing is declared 1. Transition cost: SWITCH for another format than the record before, and
log(1 + days) * BACK, at most BACK_MOST, for a jump back in time. AGAINST is more than the transitions on both
sides of a record can save, so a declared convention holds; where nothing is declared, or a declared
one leaves several readings, the order of the records decides.

Besides the best path the cost of the best path through each reading is computed (forward and backward sums).
The margin of a value is how much dearer the best path is that gives it another day or instant; a value
is fixed if its reading breaks no declared convention and the margin is CLEAR or more. Both instants of a local time that
occurs twice are an hour apart at most, which moves a path's cost by less than CLEAR.

A record with one reading parts its source's path into independent pieces, so only the others pass through Python's
recurrences, between their neighbours. A source may hold a third of all rows, so its records are cut into
blocks of consecutive ids. Each block yields the least cost between each of its first and each of its last
readings (a min-plus matrix). The matrices of CHAIN consecutive blocks are merged into one; those of a source,
one per BLOCK * CHAIN records, are joined in order, which gives the costs before and after every chain, then every
block, and the blocks are traced independently. This is exact over the whole source.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparse import AGAINST, with_readings, zone_names
from tidemark.session import materialize, ship
from tidemark.sources.tables import norm_null

ship(sys.modules[__name__])

SWITCH, BACK, BACK_MOST, CLEAR, BLOCK, CHAIN = 1.0, 0.25, 3.0, 2.0, 8192, 4096


def moves(was: list, now: list) -> np.ndarray:
    """Transition costs between two records' readings (rows: was)."""
    out = np.empty((len(was), len(now)))
    for i, a in enumerate(was):
        for j, b in enumerate(now):
            days = max(0, a["t"] - b["t"]) / 86_400
            out[i, j] = SWITCH * (a["fmt"] != b["fmt"]) + min(BACK_MOST, BACK * np.log1p(days))
    return out


def _own(readings: list) -> np.ndarray:
    return np.array([c["cost"] for c in readings], dtype=float)


def _lists(pdf: pd.DataFrame) -> list[list]:
    """Each record's readings, in order; a single one comes in the columns t and fmt."""
    return [[{"t": t, "fmt": f, "cost": 0.0}] if c is None else list(c) for c, t, f in zip(pdf["cands"], pdf["t"], pdf["fmt"])]


def path_costs(lists: list[list]) -> np.ndarray:
    """Least costs from each reading of the first record to each of the last one's, but for a constant."""
    cost = np.full((len(lists[0]), len(lists[0])), np.inf)
    np.fill_diagonal(cost, _own(lists[0]))
    single = [k for k, x in enumerate(lists) if len(x) == 1]
    hops = list(range(len(lists)))
    if single:
        hops = [*range(single[0] + 1), *range(single[-1], len(lists))]  # what lies between is the same for all paths
    for p, q in zip(hops, hops[1:]):
        if p != q and not (single and p == single[0] and q == single[-1]):
            cost = (cost[:, :, None] + moves(lists[p], lists[q])[None]).min(axis=1) + _own(lists[q])
    return cost


def block_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the block's first and last readings and the least cost between each pair of them."""
    lists = _lists(pdf.sort_values("seq", kind="stable"))
    row = pdf.iloc[0]
    return pd.DataFrame(
        {"source": [row["source"]], "block": [row["block"]], "cost": [path_costs(lists).ravel().tolist()]}
        | {f"{e}_{k}": [[c[k] for c in x]] for e, x in (("first", lists[0]), ("last", lists[-1])) for k in ("fmt", "t")}
    )


def _ends(r: pd.Series, end: str) -> list[dict]:
    return [{"fmt": f, "t": t} for f, t in zip(r[f"{end}_fmt"], r[f"{end}_t"])]


def _matrix(r: pd.Series) -> np.ndarray:
    return np.asarray(r["cost"], dtype=float).reshape(len(r["first_t"]), len(r["last_t"]))


def merge_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for consecutive blocks: the ends of their chain and the least costs between them."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    head, tail = pdf.iloc[0], pdf.iloc[-1]
    cost = _matrix(head)
    for k in range(1, len(pdf)):
        cost = (cost[:, :, None] + moves(_ends(pdf.iloc[k - 1], "last"), _ends(pdf.iloc[k], "first"))[None]).min(axis=1)
        cost = (cost[:, :, None] + _matrix(pdf.iloc[k])[None]).min(axis=1)
    row = {"source": head["source"], "block": head["chain"], "cost": cost.ravel().tolist()}
    row |= {c: head[c] for c in ("first_fmt", "first_t")} | {c: tail[c] for c in ("last_fmt", "last_t")}
    return pd.DataFrame([row])


def join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each of consecutive blocks the least costs before each of its first readings and after each of its last ones;
    columns before and after, where present, hold those of the whole chain."""
    pdf = pdf.sort_values("block").reset_index(drop=True)
    fixed = "before" in pdf.columns
    rows = [r for _, r in pdf.iterrows()]
    own = [_matrix(r) for r in rows]
    link = [moves(_ends(a, "last"), _ends(b, "first")) for a, b in zip(rows, rows[1:])]
    before = [np.asarray(rows[0]["before"], float) if fixed else np.zeros(len(own[0]))]
    for m, x in zip(own, link):
        before.append(((before[-1][:, None] + m).min(axis=0)[:, None] + x).min(axis=0))
    after = [np.asarray(rows[-1]["after"], float) if fixed else np.zeros(own[-1].shape[1])]
    for m, x in zip(reversed(own[1:]), reversed(link)):
        after.append((x + (m + after[-1][None, :]).min(axis=1)[None, :]).min(axis=1))
    return pd.DataFrame(
        {"source": pdf["source"], "block": pdf["block"], "before": [x.tolist() for x in before], "after": [x.tolist() for x in reversed(after)]}
    )


def trace(lists: list[list], before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """For each record the cost of the best path through each of its readings, each record's costs but for a constant."""
    n = len(lists)
    ahead, back = [None] * n, [None] * n
    for k in range(n):
        if len(lists[k]) == 1:
            ahead[k] = np.zeros(1)
        elif k == 0:
            ahead[k] = before + _own(lists[k])
        else:
            ahead[k] = (ahead[k - 1][:, None] + moves(lists[k - 1], lists[k])).min(axis=0) + _own(lists[k])
    for k in range(n - 1, -1, -1):
        if len(lists[k]) == 1:
            back[k] = np.zeros(1)
        elif k == n - 1:
            back[k] = after
        else:
            back[k] = (moves(lists[k], lists[k + 1]) + (_own(lists[k + 1]) + back[k + 1])[None, :]).min(axis=1)
    return [a + b for a, b in zip(ahead, back)]


def trace_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The reading of each record that has several, and its margin, given the costs before and after the block."""
    pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
    lists = _lists(pdf)
    out = []
    for rid, x, cost in zip(pdf["rid"], lists, trace(lists, np.asarray(pdf.at[0, "before"], float), np.asarray(pdf.at[0, "after"], float))):
        if len(x) > 1:
            k = int(cost.argmin())
            other = [v for c, v in zip(x, cost) if c["norm"] != x[k]["norm"]]
            out.append((rid, x[k]["norm"], x[k]["fmt"], x[k]["cost"], min(other, default=np.inf) - cost[k]))
    return pd.DataFrame(out, columns=["rid", "norm", "fmt", "cost", "margin"])


CANDS = "array<struct<norm:string,t:bigint,fmt:string,cost:double>>"


def normalise_timestamps(
    df: DataFrame, values: dict[str, str | Column], row_id: str, feeds: DataFrame, source: str = "feed"
) -> DataFrame:
    """(row_id, field, norm, fmt, fixed) for each value of the given columns that has a reading.

    values: field name -> column. feeds: (feed, zone, date_order). norm is the reading on the best path;
    fixed tells whether the value means that one day or instant and no other, by its source's declared
    conventions or, where they leave it open, by the records around it (see CLEAR). Missing and unreadable values, and days or times that don't exist, give no row; so do
    values coarser than a day. Rows with equal row_id are read separately, in the order of their texts;
    a NULL source has no conventions. An empty table gives an empty result. Columns of df other than the
    named ones are not read, so clashing names do no harm.
    """
    spark = df.sparkSession
    zones = zone_names(spark)
    src = df.select(
        F.col(f"`{row_id}`").cast("bigint").alias("row_id"),
        F.col(f"`{source}`").alias("_feed"),
        F.explode(
            F.array(
                *[F.struct(F.lit(f).alias("field"), (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string").alias("value")) for f, c in values.items()]
            )
        ).alias("v"),
    ).select("row_id", "_feed", "v.field", norm_null(F.col("v.value")).alias("value"))
    src = src.where("value IS NOT NULL AND row_id IS NOT NULL")
    known = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.min("zone").alias("_zone"), F.min("date_order").alias("_order"))
    src = src.join(known, "_feed", "left")
    src = with_readings(src, "value", "_zone", "_order", zones)
    several = F.size("cands") > 1
    flat = src.select(
        F.xxhash64("field", F.coalesce("_feed", F.lit("\0"))).alias("source"),
        F.floor(F.col("row_id") / BLOCK).alias("block"),
        F.concat(F.lpad(F.col("row_id").cast("string"), 20, "0"), "value").alias("seq"),
        F.struct("row_id", "field").alias("rid"),
        F.sort_array("cands").cast(CANDS).alias("cands"),
    )
    # Read several times; and the filter must not sink into the parsing, where it would repeat it.
    flat = materialize(flat, "readings").where(F.size("cands") > 0)
    first = F.get("cands", F.lit(0))
    records = flat.select("source", "block", "seq", "rid", first["t"].alias("t"), first["fmt"].alias("fmt"), F.when(several, F.col("cands")).alias("cands"))
    matrix = "source bigint, block bigint, cost array<double>, first_fmt array<string>, first_t array<bigint>, last_fmt array<string>, last_t array<bigint>"
    blocks = materialize(records.groupBy("source", "block").applyInPandas(block_costs, matrix), "blocks")
    blocks = blocks.withColumn("chain", F.floor(F.col("block") / CHAIN))
    sides = "source bigint, block bigint, before array<double>, after array<double>"
    chains = blocks.groupBy("source", "chain").applyInPandas(merge_blocks, matrix).groupBy("source").applyInPandas(join_blocks, sides)
    ends = blocks.join(chains.withColumnRenamed("block", "chain"), ["source", "chain"]).groupBy("source", "chain").applyInPandas(join_blocks, sides)
    traced = (
        records.join(ends, ["source", "block"])
        .groupBy("source", "block")
        .applyInPandas(trace_block, "rid struct<row_id:bigint,field:string>, norm string, fmt string, cost double, margin double")
    )
    single = flat.where(~several).select("rid", first["norm"].alias("norm"), first["fmt"].alias("fmt"), first["cost"].alias("cost"), F.lit(float("inf")).alias("margin"))
    fixed = (F.col("margin") >= CLEAR) & (F.col("cost") < AGAINST)
    return traced.unionByName(single).select("rid.row_id", "rid.field", "norm", "fmt", fixed.alias("fixed"))
