"""Running sums over a whole table in two levels, so that no task sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelk.session import cut

#: Buckets at least, and rows of a bucket where that gives more.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def running_sums(df: DataFrame, order: str, columns: Sequence[str], descending: bool = False, buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with cum_{c} for each of the columns: its sum over all rows, of the same values of by, up to and including this one, in the order of a column that is unique there.

    The rows are put into buckets between approximate quantiles of the order; sums run within a bucket, and over the buckets' totals.
    """
    if "_bucket" in df.columns:
        raise ValueError("the column name _bucket is taken")
    by = list(by)
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("_bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(order)))).drop("_bounds")  # one row
    if descending:
        placed = placed.withColumn("_bucket", -F.col("_bucket"))
    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most as many rows as buckets
    offsets = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in columns])
    within = Window.partitionBy(*by, "_bucket").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    if by:
        offsets = offsets.withColumnsRenamed({c: f"_b_{c}" for c in by}).withColumnRenamed("_bucket", "_b_bucket")
        same = F.col("_bucket") == F.col("_b_bucket")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        out = placed.join(offsets, same).drop("_b_bucket", *[f"_b_{c}" for c in by])
    else:
        out = placed.join(F.broadcast(offsets), "_bucket")  # as many rows as buckets
    out = out.withColumns({f"cum_{c}": F.sum(c).over(within) + F.col(f"_o_{c}") for c in columns})
    return out.drop("_bucket", *[f"_o_{c}" for c in columns])


def history(df: DataFrame, key: str, order: str, ties: Sequence[str], values: Sequence[str], n: int, buckets: int = BUCKETS) -> DataFrame:
    """df with so_far, the number of each row among its key's in the order of a numeric column, then ties, and recent, the values of the last n rows up to it.

    The rows of a key are split into buckets between quantiles of the order, so a key that has a third of all rows is spread; a bucket
    takes the number of rows and the last ones of those before it. Null keys are one key; null orders come first.
    """
    bounds = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("_bounds"))
    placed = df.join(F.broadcast(bounds)).withColumn("_bucket", F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col(order))))).drop("_bounds")  # one row
    within = Window.partitionBy(key, "_bucket").orderBy(order, *ties)
    marked = cut(placed.withColumns({"_n": F.row_number().over(within), "_recent": F.collect_list(F.struct(*values)).over(within.rowsBetween(1 - n, 0))}))
    parts = marked.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.max("_n").alias("_held"), F.max_by("_recent", "_n").alias("_tail"))
    by_key = Window.partitionBy("_key").orderBy("_b")  # as many rows a key as buckets
    before = parts.select("_key", "_b", F.coalesce(F.sum("_held").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.flatten(F.collect_list("_tail").over(by_key.rowsBetween(-n, -1))).alias("_tails"))
    both = marked.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    recent = F.expr(f"slice(concat(_tails, _recent), greatest(size(_tails) + size(_recent) - {n - 1}, 1), {n})")
    return both.withColumns({"so_far": F.col("_n") + F.col("_before"), "recent": recent}).drop("_key", "_b", "_bucket", "_n", "_recent", "_before", "_tails")


def quantiles(df: DataFrame, column: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, q0, q1, ..: the quantiles of the column, between two values the one in proportion, of each group of by; null and NaN count for nothing.

    Rows are counted by value and summed up in two levels, so that no task holds a group, or all its distinct values.
    """
    by = list(by)
    value = F.col(column).cast("double")
    counts = df.select(*by, value.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    counts = cut(counts)
    summed = running_sums(counts, "_v", ["_n"], by=by)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    if by:
        total = total.withColumnsRenamed({c: f"_g_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        summed = summed.join(total, same)
    else:
        summed = summed.join(F.broadcast(total))  # one row
    ends = []
    for i, p in enumerate(fractions):
        place = F.lit(p) * (F.col("_all") - 1)
        ends += [F.min(F.when(F.col("cum__n") > F.floor(place), F.col("_v"))).alias(f"_l{i}"), F.min(F.when(F.col("cum__n") > F.ceil(place), F.col("_v"))).alias(f"_h{i}"), F.first(place - F.floor(place)).alias(f"_f{i}")]
    found = summed.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(fractions))])


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with the exact place of each row, from 0, in an order that leaves no ties.

    The rows are sorted range by range; the places within a range are moved on by the sizes of the ranges before.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, place + F.col("_offset")).drop("_range", "_offset")  # as many rows as ranges


def exact_quantiles(df: DataFrame, column: str, percents: Sequence[int]) -> DataFrame:
    """percent and the column's value at or below which so many per cent of the rows lie: the smallest such value of the table.

    Rows are counted by value, so equal values are one row, and summed up in two levels; nothing is gathered. Null values count for nothing.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    summed = running_sums(counts, column, ["_n"])
    total = counts.agg(F.sum("_n").alias("_all"))
    wanted = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    reached = summed.join(F.broadcast(total)).select(column, "cum__n", "_all", wanted).where(F.col("cum__n") * 100 >= F.col("percent") * F.col("_all"))  # one row
    return reached.groupBy("percent").agg(F.min(column).alias(column))
