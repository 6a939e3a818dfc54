"""Mixing sources to target weights, by hash thresholds found in histograms instead of sorting.

Every document has a place in [0, 2^60) by a hash of its id. For each source the tokens are summed by bucket of that place; the
budget falls into one of the buckets, and only the documents of that bucket are summed again by finer buckets, until a
bucket holds too few tokens to matter. The threshold found is a number a source, and the selection a filter. A larger budget has a larger
threshold, so selections are nested. A source with less than its budget is used again as a whole, as often as allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kelk.session import cut

BITS = 60
BUCKET_BITS = 12
BROADCAST_SOURCES = 10_000


def budgets(targets: DataFrame, available: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, available, capacity, budget of each source of the targets.

    Without total_tokens the mixture is as large as the sources allow: the least capacity / target_share over the
    sources that have any tokens. A source without tokens can't contribute; its budget is 0 and its share is reported as missed.
    """
    known = targets.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    known = known.withColumn("capacity", F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)))
    if total_tokens is None:
        reach = F.min(F.when((F.col("capacity") > 0) & (F.col("target_share") > 0), F.col("capacity") / F.col("target_share")))
        total = known.agg(F.coalesce(F.floor(reach), F.lit(0)).cast("long").alias("total"))
        known = known.join(F.broadcast(total))  # one row
    else:
        known = known.withColumn("total", F.lit(int(total_tokens)))
    return known.withColumn("budget", F.least(F.floor(F.col("total") * F.coalesce("target_share", F.lit(0.0))), F.col("capacity")).cast("long")).drop("total")


def mix(documents: DataFrame, targets: DataFrame, id: str = "doc_id", source: str = "source", tokens: str = "tokens", total_tokens: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: id, source, tokens, times for each document that is used at least once. report: for each source of targets its
    target_share, reached_tokens, reached_share (of all tokens reached), documents, most_times, max_repeats, available.
    A document whose source is null or not among the targets, or that has no tokens, is never used. targets: source
    (unique), target_share, max_repeats; a null max_repeats counts as 1. ids are unique; equal places are kept apart by the id's
    own hash only, so equal ids go together. Empty tables give an empty selection. Extra columns are ignored.
    """
    sized = documents.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).where("source IS NOT NULL AND tokens > 0")
    sized = cut(sized.withColumn("place", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 64 - BITS)))
    available = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = cut(budgets(targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL"), available, total_tokens))
    # Whole uses of the source, and what is left of the budget for one more use of a part of it.
    plan = plan.withColumn("whole", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("whole") * F.col("available"))

    # The targets are sent to every task only if they are few; else a join that spreads hot sources by itself.
    small = plan.count() <= BROADCAST_SOURCES
    by_hand = F.broadcast if small else (lambda df: df)

    bound = plan.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("low"))
    shift = BITS
    while shift > 0:
        step = min(BUCKET_BITS, shift)
        fine = shift - step
        # Only documents between the bounds of the boundary bucket are summed; a source has 2^BUCKET_BITS buckets at most.
        inside = sized.join(by_hand(bound), "source").where((F.col("place") >= F.col("low")) & (F.shiftrightunsigned(F.col("place") - F.col("low"), shift) == 0))
        sums = inside.groupBy("source", F.shiftrightunsigned("place", fine).alias("bucket")).agg(F.sum("tokens").alias("t"))
        by_source = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bucket", "t"))).alias("all"))
        # Walk the buckets in order: how many fit whole, and what is left for the one that doesn't.
        walk = F.aggregate(
            "all",
            F.struct(F.col("left").alias("left"), F.lit(False).alias("over"), F.lit(-1).cast("long").alias("at")),
            lambda s, x: F.when(s["over"] | (x["t"] > s["left"]), F.struct(s["left"].alias("left"), F.lit(True).alias("over"), F.when(s["over"], s["at"]).otherwise(x["bucket"]).alias("at"))).otherwise(F.struct((s["left"] - x["t"]).alias("left"), F.lit(False).alias("over"), F.lit(-1).cast("long").alias("at"))),
        )
        found = bound.join(by_source, "source", "left").withColumn("w", F.when(F.col("all").isNotNull(), walk))
        bound = cut(
            found.select(
                "source",
                F.coalesce(F.col("w.left"), F.col("left")).alias("left"),
                # No boundary: everything that was inside fits, and the threshold is the end of the bucket before.
                F.when(F.col("w.over"), F.shiftleft(F.col("w.at"), fine)).otherwise(F.col("low") + F.shiftleft(F.lit(1).cast("long"), shift)).alias("low"),
            )
        )
        shift = fine
    chosen = sized.join(by_hand(bound.select("source", F.col("low").alias("threshold")).join(plan.select("source", "whole", "rest"), "source")), "source")
    chosen = chosen.withColumn("times", F.col("whole") + F.when((F.col("rest") > 0) & (F.col("place") < F.col("threshold")), 1).otherwise(0)).where("times > 0")
    selection = chosen.select(F.col("id").alias(id), F.col("source").alias(source), F.col("tokens").alias(tokens), F.col("times").cast("int").alias("times"))
    reached = selection.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(tokens) * F.col("times")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    grand = reached.agg(F.sum("reached_tokens").alias("grand"))
    report = plan.join(reached, "source", "left").join(F.broadcast(grand)).select(
        "source", "target_share",
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        (F.coalesce("reached_tokens", F.lit(0)) / F.col("grand")).alias("reached_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"), "max_repeats", "available",
    )
    return selection, report
