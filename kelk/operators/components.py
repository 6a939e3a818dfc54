"""Connected components of records that share values, by alternating large and small stars.

Each value that two records share becomes a star around the smallest of its records; the stars are then rewired until every
record points at the smallest one of its component (Kiveris et al., Connected Components in MapReduce and Beyond). The number
of rounds grows with the logarithm of the longest chain. Minima are combined before the shuffle, and the join that hands them
out has one row a node on one side, so a value that a third of all rows share is spread by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from kelk.functions.text import is_blank
from kelk.session import cut


def shared_value_edges(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """u, v: u the record, v the smallest record that shares one of the key columns' values with it. Null and blank relate nothing."""
    one = lambda i, k: F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("value"))
    held = df.select(F.col(record).alias("u"), F.explode(F.array(*[one(i, k) for i, k in enumerate(keys)])).alias("x")).where(F.col("u").isNotNull() & ~is_blank(F.col("x.value")))
    held = held.select("u", "x.i", F.xxhash64("x.value").alias("h1"), F.xxhash64(F.lit("kelk"), "x.value").alias("h2"))
    centre = held.groupBy("i", "h1", "h2").agg(F.min("u").alias("v"), F.max("u").alias("most")).where("v <> most").drop("most")
    return held.join(centre, ["i", "h1", "h2"]).where("u <> v").select("u", "v").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, materialised, and a fingerprint of them that is made in the same job."""
    seen = Observation()
    stored = cut(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    told = seen.get
    return stored, (told["n"], told["sum"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One rewiring. larger: u's bigger neighbours go to the least of all; else u and its smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    ends: list[Column] = [F.col("u"), F.col("v")]
    return joined.select(F.explode(F.array(*ends)).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of its component, for every node that has an edge."""
    edges, before = _stored(edges)
    for _ in range(max_rounds):
        edges, after = _stored(_star(_star(edges, True), False))
        # A task that ran twice may count twice; that can cost a round more, but ends none too early.
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select(F.col("v").alias("node"), F.col("v").alias("component")))


def record_components(df: DataFrame, record: str, keys: Sequence[str]) -> DataFrame:
    """record, component (the smallest record related to it, directly or through others) of every record that isn't null."""
    found = components(shared_value_edges(df, record, keys)).withColumnRenamed("node", record)
    every = df.select(record).where(F.col(record).isNotNull()).distinct()
    return every.join(found, record, "left").select(record, F.coalesce("component", F.col(record)).alias("component"))
