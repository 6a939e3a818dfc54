"""Word frequencies, vocabularies that tell two groups apart, bands and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelk.functions.features import PERSIAN_WORD


def token_counts(df: DataFrame, text: str, groups: dict[str, Column], pattern: str = PERSIAN_WORD, min_length: int = 2) -> DataFrame:
    """stem and, for each group, its occurrences in the rows of that group: one pass over the text."""
    words = df.select(*[c.alias(n) for n, c in groups.items()], F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).alias("stem"))
    return words.where(F.length("stem") >= min_length).groupBy("stem").agg(*[F.count_if(F.col(n)).alias(n) for n in groups])


def differential_vocabulary(df: DataFrame, text: str, high: Column, low: Column, min_count: int, ratio: float, noise: Sequence[str] = ()) -> DataFrame:
    """stem, association, high_freq, low_freq, ratio of the words that are more frequent in one group than ratio times in the other, or only there."""
    counts = token_counts(df, text, {"high_freq": high, "low_freq": low})
    side = lambda name, a, b: counts.where((F.col(a) >= min_count) & ((F.col(b) == 0) | (F.col(a) / F.col(b) > ratio))).select("stem", F.lit(name).alias("association"), "high_freq", "low_freq", F.when(F.col(b) > 0, F.col(a) / F.col(b)).alias("ratio"))
    return side("high", "high_freq", "low_freq").unionByName(side("low", "low_freq", "high_freq")).where(~F.col("stem").isin(*noise))


def band(score: Column, low: float, mid: float, high: Column) -> Column:
    return F.when(score >= high, "high").when(score > mid, "mid").when((score >= low) & (score <= mid), "low")


def banded_sample(df: DataFrame, band: str, sizes: dict[str, int], id: str, seed: int = 7) -> DataFrame:
    """Up to the given number of rows of each band, by the order of a seeded hash of the id; equal sizes and seed give equal samples."""
    by = Window.partitionBy(band).orderBy(F.xxhash64(F.col(id), F.lit(seed)), id)
    limit = F.coalesce(*[F.when(F.col(band) == b, n) for b, n in sizes.items()], F.lit(0))
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit).drop("_n")
