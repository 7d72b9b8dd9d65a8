"""Filling containers of fixed capacity: best-fit decreasing with certified bounds and repacking.

Sizes are tokens of a public tokenizer. A text longer than the capacity is cut into pieces of the
capacity, each a full container, and a rest; nothing else is ever cut. The rests and the other texts are
spread over partitions of bounded size by a hash and packed there by best-fit decreasing. Each partition
gets a lower bound on its containers: the greatest of the plain volume bound and of those that dual
feasible functions give (a function f with sum f(x) <= 1 for every set of sizes that fits; the sum of f over
all sizes, rounded up, then bounds the count). A partition whose count equals its bound is certified
optimal and left alone. The others keep their containers that are FULL and give up the rest's items;
these are exchanged, dealt anew to parts and packed again, ROUNDS times.
"""

from __future__ import annotations

import base64
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship

ship(sys.modules[__name__])

PART_ITEMS, ROUNDS, FULL = 50_000, 2, 0.98
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, id_: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(id, n): tokens of each text; NULL and empty texts have none and give no row."""

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            n = [len(x) for x in enc.encode_ordinary_batch(pdf["text"].tolist(), num_threads=1)]
            yield pd.DataFrame({"id": pdf["id"], "n": n})

    src = docs.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    return src.mapInPandas(run, "id bigint, n int").where("n > 0")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, free room of each container), items taken by decreasing size.

    Containers are kept by free room; the set of rooms in use is one integer with a bit per room, so the
    tightest room is a shift away.
    """
    where = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        left = room - s
        free[b] = left
        where[i] = b
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return where, np.array(free, dtype=np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, count: np.ndarray | None = None) -> int:
    """The greatest of the bounds: volume, and two families of dual feasible functions. With count, sizes are distinct and come so often."""
    if not len(sizes):
        return 0
    value, count = np.unique(sizes, return_counts=True) if count is None else (np.asarray(sizes), np.asarray(count))
    value, total = value.astype(np.int64), count.astype(np.int64)
    best = -(-int((value * total).sum()) // capacity)
    # sizes above capacity - t count whole, below t not at all, the rest by volume
    for t in value[value * 2 <= capacity]:
        big, mid = value > capacity - t, (value >= t) & (value <= capacity - t)
        best = max(best, int(total[big].sum()) + max(0, -(-int((value[mid] * total[mid]).sum()) // capacity)))
    # x -> floor((k + 1) x) / k, unless (k + 1) x is whole, which stays x (shares of the capacity)
    for k in range(1, 21):
        scaled = (k + 1) * value
        whole = scaled % capacity == 0
        f = np.where(whole, value * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((f * total).sum()) // (k * capacity)))
    return best


def pack_part(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    sizes = pdf["size"].to_numpy(np.int64)
    where, free = best_fit(sizes, capacity)
    out = pdf.assign(bin=where, room=free[where])
    bound = lower_bound(sizes, capacity)
    return out.assign(bins=len(free), bound=bound)


ITEM = "capacity_id int, part bigint, id bigint, piece int, size int"


def _pack(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    def run(key, pdf):
        pdf = pdf.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        return pack_part(pdf, capacities[int(key[0])])

    return items.groupBy("capacity_id", "part").applyInPandas(run, ITEM + ", bin bigint, room bigint, bins bigint, bound bigint")


def pack(sizes: DataFrame, capacities: dict[int, int], rounds: int = ROUNDS, part_items: int = PART_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Packs the items (id, n) for each capacity: (placed, bounds).

    placed: (capacity_id, id, piece, start, size, container, position), a row per text or piece; start is
    the piece's first token. Repeated ids are items of their own and keep their order of pieces. bounds:
    (capacity_id, containers, least): how many containers there are, and the sum of the parts' certified
    lower bounds with one per full piece. Items without tokens aren't placed; an empty table places none.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes, "sizes")
    count = sizes.count()
    parts = max(1, -(-count // part_items))
    caps = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("cap")) for i, c in sorted(capacities.items())]))
    each = sizes.select("id", "n", caps.alias("c")).select("c.capacity_id", "c.cap", "id", "n")
    each = each.withColumn("whole", F.floor(F.col("n") / F.col("cap")).cast("int")).withColumn("rest", F.col("n") % F.col("cap"))
    full = each.where("whole > 0").select("capacity_id", "id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"), F.col("cap").alias("size"))
    spread = F.pmod(F.xxhash64("id", "capacity_id", "n"), F.lit(parts))
    items = each.where("rest > 0").select(
        "capacity_id", spread.alias("part"), "id", F.col("whole").alias("piece"), F.col("rest").cast("int").alias("size")
    )
    done, packed = [], materialize(_pack(items, capacities), "packed")
    for r in range(rounds):
        # certified containers stay; of the others, those that are all but full stay as well
        cap = reduce(lambda a, b: a.when(F.col("capacity_id") == b[0], b[1]), capacities.items(), F.when(F.lit(False), 0))
        stays = (F.col("bins") <= F.col("bound")) | (F.col("room") <= (1 - FULL) * cap)
        done.append(packed.where(stays).withColumn("round", F.lit(r)))
        again = packed.where(~stays).drop("bin", "room", "bins", "bound")
        pool = materialize(again, "pool")
        n = pool.count()
        if not n:
            packed = None
            break
        fewer = max(1, -(-n // part_items))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("id", "piece", "capacity_id", F.lit(r)), F.lit(fewer)))
        packed = materialize(_pack(dealt, capacities), "packed")
    if packed is not None:
        done.append(packed.withColumn("round", F.lit(rounds)))
    rows = reduce(DataFrame.unionByName, done).select("capacity_id", "id", "piece", "size", "round", "part", "bin")
    keys = rows.select("capacity_id", "round", "part", "bin").distinct()
    # container numbers: containers are counted per part, and the parts' counts are added up
    per = keys.groupBy("capacity_id", "round", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("capacity_id").orderBy("round", "part").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    within = F.row_number().over(Window.partitionBy("capacity_id", "round", "part").orderBy("bin"))
    number = keys.withColumn("nth", within).join(offset, ["capacity_id", "round", "part"]).withColumn("container", F.col("offset") + F.col("nth"))
    number = number.drop("offset", "nth")
    place = F.row_number().over(Window.partitionBy("capacity_id", "round", "part", "bin").orderBy(F.desc("size"), "id", "piece"))
    loose = rows.join(number, ["capacity_id", "round", "part", "bin"]).withColumn("position", place).select("capacity_id", "id", "piece", "size", "container", "position")
    used = materialize(per.groupBy("capacity_id").agg(F.sum("k").alias("used")), "used")  # a row per capacity
    # full pieces: one container each, numbered after the others, per hash part so that no single task orders all
    piece = full.withColumn("part", F.pmod(F.xxhash64("id", "capacity_id"), F.lit(parts)))
    many = piece.groupBy("capacity_id", "part").agg(F.count(F.lit(1)).alias("k"))
    ahead = Window.partitionBy("capacity_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = many.withColumn("offset", F.coalesce(F.sum("k").over(ahead), F.lit(0))).drop("k")
    nth = F.row_number().over(Window.partitionBy("capacity_id", "part").orderBy("id", "piece"))
    piece = piece.withColumn("nth", nth).join(ahead, ["capacity_id", "part"]).join(F.broadcast(used), "capacity_id", "left")
    piece = piece.select("capacity_id", "id", "piece", "size", (F.coalesce("used", F.lit(0)) + F.col("offset") + F.col("nth")).alias("container"), F.lit(1).alias("position"))
    placed = loose.unionByName(piece)
    cap = reduce(lambda a, b: a.when(F.col("capacity_id") == b[0], b[1]), capacities.items(), F.when(F.lit(False), 0))
    placed = placed.withColumn("start", F.col("piece") * cap)
    volume = each.groupBy("capacity_id").agg(F.sum("whole").alias("full"), F.first("cap").alias("cap"))
    bound = _bound_all(items, capacities).join(volume, "capacity_id", "right").select("capacity_id", (F.coalesce("least", F.lit(0)) + F.col("full")).alias("least"))
    counted = placed.groupBy("capacity_id").agg(F.max("container").alias("containers"), F.sum("size").alias("tokens"))
    return placed.select("capacity_id", "id", "piece", "start", "size", "container", "position"), counted.join(bound, "capacity_id")


def _bound_all(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """The lower bound for all items of a capacity at once, from the counts of each size (at most a row per token count)."""
    sizes = items.groupBy("capacity_id", "size").agg(F.count(F.lit(1)).alias("n"))

    def run(key, pdf):
        best = lower_bound(pdf["size"].to_numpy(np.int64), capacities[int(key[0])], pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"capacity_id": [int(key[0])], "least": [best]})

    return sizes.groupBy("capacity_id").applyInPandas(run, "capacity_id int, least bigint")
