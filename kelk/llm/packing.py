"""Packing items of unequal size into containers of one capacity, with certified bounds.

Items are dealt into partitions of bounded size, and each partition packs its own by best fit decreasing. A lower bound from dual
feasible functions tells how many containers the partition needs at least; where the packing meets it, it is certified as the
best possible. The partitions with a gap exchange the items of their containers that have room left: these are dealt
anew, into fewer partitions, and packed again, as long as that saves containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kelk.session import cut

CAPACITY = 2048
PARTITION_ITEMS = 50_000
ROUNDS = 3


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes lie between 1 and capacity. Containers are looked up by their free room."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    out = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some container has exactly r free
    opened = 0
    for i in order:
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            container = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            container, room = opened, capacity
            opened += 1
        out[i] = container
        if room := room - size:
            by_room[room].append(container)
            rooms |= 1 << room
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs, the largest of three families of dual feasible functions.

    The identity gives the total size. The threshold functions (one for each t up to half the capacity) count an item above
    capacity - t as a whole container and one below t as nothing. The rounding functions (one for each small k) map an item to
    the nearest lower multiple of 1/k, where k+1 times its size is no whole number of containers.
    """
    if not len(sizes):
        return 0
    sizes = np.asarray(sizes, np.int64)
    held = np.bincount(sizes, counts, minlength=capacity + 1).astype(np.int64)
    room = np.arange(capacity + 1) * held
    count, total = np.cumsum(held), np.cumsum(room)
    best = -(-int(total[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    big = count[-1] - count[capacity - t]
    middle = total[capacity - t] - total[t - 1]
    best = max(best, int((big + -(-middle // capacity)).max()))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 101):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * held).sum()) // (k * capacity)))
    return best


_PACKED = "id long, piece long, start long, tokens long, part long, bin long, room long, bound long, bins long"


def _pack_round(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """items (id, piece, start, tokens) packed partition by partition; room is what the item's container has left."""

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["id", "piece"], ignore_index=True)
        sizes = block["tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, sizes).astype(np.int64)
        return block.assign(bin=bins, room=capacity - filled[bins], bound=lower_bound(sizes, capacity), bins=len(filled))[["id", "piece", "start", "tokens", "part", "bin", "room", "bound", "bins"]]

    dealt = items.select("id", "piece", "start", "tokens", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, _PACKED)


def pack(items: DataFrame, id: str, tokens: str, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(assignment, certificate).

    assignment: id, piece, start, tokens, container_id, one row a piece. Only an item larger than capacity is cut: into full containers and a
    last piece, numbered from 0. start is the piece's first token. An item of size 0 or null needs no container: tokens 0, container_id null.
    certificate: step, containers, bound, exchanged: one row for each partition of each round that was kept, with the containers
    that stay and those whose items moved on to the next round (then the bound is null), one for the full pieces, and one for all.
    ids are unique whole numbers; ties in size go by id. An empty table gives no rows; extra columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = items.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"))
    last = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)) - 1, F.lit(0))
    pieces = sized.select("id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"), F.col("tokens").alias("whole"))
    pieces = pieces.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).alias("tokens"))
    pieces = cut(pieces)
    none = pieces.where("tokens = 0").withColumn("container_id", F.lit(None).cast("string"))
    full = pieces.where(F.col("tokens") == capacity).withColumn("container_id", F.concat(F.lit("full-"), "id", F.lit("-"), "piece"))
    to_pack = pieces.where((F.col("tokens") > 0) & (F.col("tokens") < capacity))
    stats = pieces.agg(F.count(F.when((F.col("tokens") > 0) & (F.col("tokens") < capacity), 1)).alias("n"), F.count(F.when(F.col("tokens") == capacity, 1)).alias("full")).first()

    # What stands: the pieces settled so far, and the last round's, of which the loose ones may move on.
    settled: list[DataFrame] = []
    proofs: list[DataFrame] = []
    last_round: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None
    loose_items, parts, loose_bins = to_pack, max(1, -(-stats["n"] // partition_items)), None
    roomy = F.col("room") > 0
    for r in range(rounds):
        packed = cut(_pack_round(loose_items, parts, r, capacity))
        # One row a partition; the table stays where it is, only its sums come to the driver.
        found = cut(packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count(F.when(roomy, 1)).alias("loose"), F.countDistinct(F.when(roomy, F.col("bin"))).alias("loose_bins")))
        gap = F.col("bins") > F.col("bound")
        total = found.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("bins"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.col("loose"))), F.lit(0)).alias("loose"), F.coalesce(F.sum(F.when(gap, F.col("loose_bins"))), F.lit(0)).alias("loose_bins")).first()
        if loose_bins is not None and total["bins"] >= loose_bins:
            break  # dealing anew saved nothing, so the round before stands
        if last_round:
            settled.append(last_round[1])
            proofs.append(last_round[3])
        step = F.format_string(f"round {r}, partition %d", F.col("part"))
        rows = packed.withColumn("container_id", F.concat(F.lit(f"{r}-"), "part", F.lit("-"), "bin"))
        if total["gaps"] < 2:
            last_round = (rows.select(*_SHOWN), rows.select(*_SHOWN), found.select(step.alias("step"), F.col("bins").alias("containers"), "bound", F.lit(0).cast("long").alias("exchanged")), found)
            break
        rows = rows.join(found.where(gap).select("part", F.lit(True).alias("has_gap")), "part", "left")
        moving = roomy & F.coalesce("has_gap", F.lit(False))
        moved = F.when(gap, F.col("loose_bins")).otherwise(F.lit(0))
        last_round = (
            rows.select(*_SHOWN), rows.where(~moving).select(*_SHOWN), found.select(step.alias("step"), F.col("bins").alias("containers"), "bound", F.lit(0).cast("long").alias("exchanged")),
            found.select(step.alias("step"), (F.col("bins") - moved).alias("containers"), F.when(moved == 0, F.col("bound")).alias("bound"), moved.cast("long").alias("exchanged")),
        )
        if r == rounds - 1:
            break
        loose_items = rows.where(moving).select("id", "piece", "start", "tokens")
        parts, loose_bins = max(1, -(-total["loose"] // partition_items)), total["loose_bins"]
    settled.append(last_round[0])
    proofs.append(last_round[2])
    out = full.unionByName(none)
    for part in settled:
        out = out.unionByName(part)
    spark = items.sparkSession
    proof = "step string, containers long, bound long, exchanged long"
    certificate = spark.createDataFrame([("full pieces", stats["full"], stats["full"], 0)], proof)
    for part in proofs:
        certificate = certificate.unionByName(part)
    # capacity + 1 rows at most
    histogram = to_pack.groupBy("tokens").count().collect()
    least = stats["full"] + lower_bound(np.array([x["tokens"] for x in histogram], np.int64), capacity, np.array([x["count"] for x in histogram], float))
    whole = certificate.agg(F.lit("all").alias("step"), F.sum("containers").alias("containers"), F.lit(int(least)).cast("long").alias("bound"), F.lit(0).cast("long").alias("exchanged"))
    return out.select(F.col("id").alias(id), "piece", "start", "tokens", "container_id"), certificate.unionByName(whole)


_SHOWN = ("id", "piece", "start", "tokens", "container_id")
