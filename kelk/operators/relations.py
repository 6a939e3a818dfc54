"""Joins, projections, orders and comparisons of labelled records that the other modules compose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kelk.functions.text import is_blank
from kelk.operators.cleaning import no_id
from kelk.operators.running import positions
from kelk.session import cut

# What stands for no value.
EMPTY = ("-1", "nan", "none", "null", "unknown", "نامشخص")


def meaningful(col: Column) -> Column:
    """True where a value says something: not null, not blank, none of the words for no value."""
    return ~is_blank(col) & ~F.lower(F.trim(col)).isin(*EMPTY)


def strict_number(col: Column) -> Column:
    """The number a text states; anything but a number or null fails the query."""
    number = col.try_cast("double")
    return F.when(col.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), col)).cast("double"))


def with_defaults(df: DataFrame, defaults: dict[str, object], drop: Sequence[str] = ()) -> DataFrame:
    """df without the columns to drop, as far as it has them, and with the missing ones of the defaults; present ones stay as they are."""
    return df.drop(*drop).withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def merged(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str], prefer: str) -> DataFrame:
    """The inner join of two tables; of a column that both have, the preferred side's, under its own name."""
    shared = {c for c in left.columns if c in right.columns and c != key}
    a = left.select(key, *[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns if c != key])
    b = right.select(key, *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c != key])
    both = a.join(b, key)
    return both.drop(*[c + s for c in shared for s in suffixes if s != prefer]).withColumnsRenamed({c + prefer: c for c in shared})


def _long(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in models.items()])
    return df.withColumn("_m", F.explode(rows)).withColumns({"model": F.col("_m.model"), "off": F.abs(F.col("_m.p") - F.col(truth))}).where("off IS NOT NULL")


def errors_by_model(df: DataFrame, truth: str, models: dict[str, str]) -> DataFrame:
    """model, n, mae of each model's column, in one pass."""
    return _long(df, truth, models).groupBy("model").agg(F.count("*").alias("n"), F.avg("off").alias("mae"))


def change_by_stage(df: DataFrame, truth: str, models: dict[str, str], stage: str, before: str, after: str) -> DataFrame:
    """model, before, after: the mean errors at two stages, and change, by how many per cent the later differs."""
    out = _long(df, truth, models).groupBy("model").pivot(stage, [before, after]).agg(F.avg("off"))
    return out.select("model", F.col(before).alias("before"), F.col(after).alias("after"), (100 * F.try_divide(F.col(after) - F.col(before), F.col(before))).alias("change"))


def linear_attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """feature, mean_abs, mean_signed of what each feature adds to a linear model's value, against its own mean."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in weights])
    part = [F.struct(F.lit(c).alias("feature"), (w * (F.col(c) - F.col(f"_{c}"))).alias("v")) for c, w in weights.items()]
    rows = df.join(F.broadcast(means)).select(F.explode(F.array(*part)).alias("x")).select("x.*")  # one row
    return rows.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean_signed"))


def ordinals(df: DataFrame, group: str, first: str, pattern: str) -> DataFrame:
    """df with name: each group's place, from 0, in the order of its smallest value of the column first."""
    heads = df.groupBy(group).agg(F.min(first).alias("_first"))
    named = positions(heads, [F.col("_first").asc()], "_place").select(group, F.format_string(pattern, "_place").alias("name"))
    return df.join(named, group)


def rarity_order(df: DataFrame, group: str, label: str) -> DataFrame:
    """group, size, rarity, position: groups with the largest share of a label first, then the larger ones, then by name."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col(label).alias("_label")).agg(F.sum("n").alias("t"))
    joined = counts.join(F.broadcast(totals), F.col(label).eqNullSafe(F.col("_label")))  # a row a label
    groups = joined.groupBy(group).agg(F.sum("n").alias("size"), F.round(F.max(F.col("n") / F.col("t")), 9).alias("rarity"))
    return positions(groups, [F.desc("rarity"), F.desc("size"), F.asc(group)], "position")


def aligned_prefix(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left_rows, right_rows, equal_prefix: how many of the first keys, in order, are the same on both sides."""
    a, b = (cut(positions(df.select(F.col(key).alias("id")), [F.asc("id")], "k")) for df in (left, right))
    differ = a.alias("a").join(b.alias("b"), "k", "full").where(~F.col("a.id").eqNullSafe(F.col("b.id"))).agg(F.min("k").alias("first"))
    sizes = a.agg(F.count("*").alias("left_rows")).join(F.broadcast(b.agg(F.count("*").alias("right_rows")))).join(F.broadcast(differ))  # one row each
    return sizes.select("left_rows", "right_rows", F.coalesce("first", "left_rows").alias("equal_prefix"))


def thread_dedup(posts: DataFrame, page_rows: int) -> DataFrame:
    """The first row of each post of a thread, told by its id, else by author, time and content; a starter that a later page repeats is left out.

    Pages have page_rows rows in the order of row_ordinal. Threads are as long as they are, so the places of their rows are found in two steps.
    """
    # A row's place in its thread decides its page, and only starters need it.
    starters = posts.where("is_starter").select("thread_id", "row_ordinal").join(posts.select("thread_id", F.col("row_ordinal").alias("other")), "thread_id")
    late = starters.where("other < row_ordinal").groupBy("thread_id", "row_ordinal").agg(F.count("*").alias("before")).where(F.col("before") >= page_rows).select("row_ordinal")
    kept = posts.join(late, "row_ordinal", "left_anti")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.when(~no_id(F.col("post_id")), F.concat(F.lit("i"), F.trim("post_id"))).otherwise(F.concat(F.lit("c"), text("author"), F.lit("\x1f"), text("posted_at"), F.lit("\x1f"), text("content")))
    firsts = kept.groupBy("thread_id", F.sha2(key, 256).alias("_key")).agg(F.min("row_ordinal").alias("row_ordinal"))
    return kept.join(firsts.select("row_ordinal"), "row_ordinal", "left_semi")


def split_objective(df: DataFrame, split: str, shares: dict[str, float], label: str, source: str) -> DataFrame:
    """total, class, source: the mean squared relative deviations of the splits' sizes from their shares, over all, by label and by source; objective weighs them."""
    targets = df.sparkSession.createDataFrame(list(shares.items()), "split string, share double")
    rows = df.select(F.col(split).alias("split"), F.coalesce(label, F.lit("")).alias("label"), F.coalesce(source, F.lit("")).alias("source"))

    def deviation(by: Column, name: str) -> DataFrame:
        counts = rows.groupBy("split", by.alias("v")).agg(F.count("*").alias("n"))
        whole = counts.groupBy("v").agg(F.sum("n").alias("w"))
        cells = whole.join(F.broadcast(targets))  # a row a split
        off = F.coalesce("n", F.lit(0)) / (F.col("share") * F.col("w")) - 1
        return cells.join(counts, ["split", "v"], "left").agg(F.avg(off * off).alias(name))

    out = deviation(F.lit(""), "total").join(F.broadcast(deviation(F.col("label"), "class"))).join(F.broadcast(deviation(F.col("source"), "source")))  # one row each
    # The weights of the three.
    return out.withColumn("objective", 0.35 * F.col("total") + 2.5 * F.col("class") + 0.25 * F.col("source"))
