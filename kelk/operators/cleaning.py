"""Filters, deduplication, stable identity and filling joins of raw records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelk.functions.text import drop_decimal_zero, is_blank
from kelk.operators.running import history

#: White space of any kind, as a class for both Java's and RE2's expressions.
SPACE = "[ \t\n\r\x0b\x0c\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def raw_words(col: Column) -> Column:
    """Number of words between white space of any kind; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(SPACE.replace("[", "[^") + "+")), F.lit(0)).cast("bigint")


def clean_filters(df: DataFrame, content: str = "content", title: str = "thread_title", min_words: int = 3, author: str | None = None) -> DataFrame:
    """Rows with content of min_words words at least and a title; with author, only rows that have one."""
    out = df.where(~is_blank(F.col(content)) & (raw_words(F.col(content)) >= min_words) & F.col(title).isNotNull())
    return out if author is None else out.where(~is_blank(F.col(author)))


def first_rows(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by the order column, which has to be unique for a defined result."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def no_id(col: Column) -> Column:
    return F.coalesce(F.trim(col).isin("", "nan", "None"), F.lit(True))


def conflict_aware_dedup(df: DataFrame, id: str, content: str, order: str, fallback: Sequence[str]) -> DataFrame:
    """Rows with dedup_class: whole rows first, then by id, where an id with several contents keeps all its rows.

    Classes: 0 no id (one row a fallback key), 1 an id with one content (first row), 2 an id with several contents (all rows; a null
    content counts as one).
    """
    whole = first_rows(df, [c for c in df.columns if c != order], order)
    missing = no_id(F.col(id))
    # An id's contents are compared by aggregation, however many rows it has.
    held = whole.where(~missing).groupBy(F.col(id).alias("_id")).agg((F.min(F.struct(content)) != F.max(F.struct(content))).alias("_differ"))
    marked = whole.where(~missing).join(held, F.col(id) == F.col("_id")).withColumn("dedup_class", F.when(F.col("_differ"), 2).otherwise(1)).drop("_id", "_differ")
    kept = first_rows(whole.where(missing).withColumn("dedup_class", F.lit(0)), fallback, order)
    kept = kept.unionByName(marked.where("dedup_class = 2")).unionByName(first_rows(marked.where("dedup_class = 1"), [id], order))
    return kept


def stable_ids(df: DataFrame, id: str, thread: str, author: str, posted: str, starter: str, content: str, order: Sequence[str]) -> DataFrame:
    """df with stable_id: the post's own id, else of the thread's starter, else of thread, author and time; repeats get a digest as suffix."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    own = drop_decimal_zero(F.col(id))
    base = F.when(~no_id(F.col(id)), own).when(F.coalesce(F.col(starter), F.lit(False)), F.concat(F.lit("thread_"), text(thread), F.lit("_starter")))
    base = base.otherwise(F.concat(F.lit("thread_"), text(thread), F.lit("_"), text(author), F.lit("_"), text(posted)))
    # Rows without author and time fall together, so their numbers are found in two steps.
    out = history(df.withColumn("_base", base), "_base", order[0], order[1:], [order[0]], 1).withColumnRenamed("so_far", "_n").drop("recent")
    digest = F.substring(F.sha1(F.concat_ws("|", "_base", F.col("_n").cast("string"), text(content))), 1, 10)
    return out.withColumn("stable_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("__"), digest))).drop("_base", "_n")


def fill_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """df with null or blank values of the columns taken from the last row of the same key in the other table."""
    latest = first_rows(other.select(key, order, *columns), [key], order, last=True).drop(order)
    joined = df.alias("a").join(latest.alias("b"), key, "left")
    filled = {c: F.when(~is_blank(F.col(f"a.{c}").cast("string")), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) for c in columns}
    return joined.select(*[filled.get(c, F.col(c) if c == key else F.col(f"a.{c}")).alias(c) for c in df.columns])


def with_provenance(df: DataFrame, cache: DataFrame, key: Column, columns: Sequence[str], source: str, strict: bool = False, complete: bool = False) -> DataFrame:
    """df with null or blank columns looked up by a key in a cache with the unique column match_key, and where each row's came from.

    strict: fails if the cache repeats a key; complete: fails if a row stays without a value.
    """
    if strict and cache.groupBy("match_key").count().where("count > 1").limit(1).count():
        raise ValueError("the cache repeats a match_key")
    joined = df.withColumn("match_key", key).alias("a").join(cache.alias("b"), "match_key", "left")
    missing = is_blank(F.col(f"a.{columns[0]}"))
    origin = F.when(~missing, "original").when(~is_blank(F.col(f"b.{columns[0]}")), "cache").otherwise("missing").alias(source)
    values = {c: F.when(~is_blank(F.col(f"a.{c}")), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns}
    out = joined.select(*[values.get(c, F.col(f"a.{c}")) for c in df.columns], origin)
    if complete and out.where(F.col(source) == "missing").limit(1).count():
        raise ValueError(f"rows without {columns[0]}")
    return out


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with the rows of changes in place of those with the same key. changes has one row a key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)
