"""Label consolidation: hashes, ranked canonical rows, consensus of two raters, matching of labels to records, roles and weights."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.functions.text import drop_decimal_zero
from kelk.operators.running import positions
from kelk.session import cut


@arrow_udf(T.StringType())
def compatible_form(texts: pa.Array) -> pa.Array:
    """Column function: NFKC, for which Spark has no function of its own."""
    import unicodedata

    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalised(col: Column) -> Column:
    """NFKC, Persian yeh and kaf, joiners and direction marks as blanks, one blank between words; null as ''."""
    text = F.translate(compatible_form(F.coalesce(col, F.lit(""))), "يىك‌‏‎", "ییک   ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(col: Column) -> Column:
    """SHA-256 of the normalised text, '' if there is none."""
    text = normalised(col)
    return F.when(text != "", F.sha2(text, 256)).otherwise("")


def normal_id(col: Column, letters: bool = False) -> Column:
    """An id in its normal form: as normalised() and without the .0 of a number; with letters, as NFKC with the Arabic letters' variants as one and blanks squeezed."""
    if not letters:
        return drop_decimal_zero(normalised(col))
    return F.trim(F.regexp_replace(F.translate(compatible_form(F.coalesce(col, F.lit(""))), "يىكةۀ", "ییکهه"), r"(?U)\s+", " "))


def row_fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of name=value of all columns in the order of their names; null as ''."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(f"{n}="), F.coalesce(columns[n].cast("string"), F.lit(""))) for n in sorted(columns)]), 256)


def canonical_by_rank(df: DataFrame, id: str, rank: Column, source: str, value: str) -> DataFrame:
    """id, value, source, versions, discarded: of each id the row of the lowest rank (ties by source), and the other rows' sources."""
    by = Window.partitionBy(id).orderBy(rank, source)
    numbered = df.withColumn("_r", F.row_number().over(by))
    every = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("_r", source))), lambda x: x["_r"] > 1), lambda x: x[source]), "|")
    return numbered.groupBy(id).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias(value), F.max(F.when(F.col("_r") == 1, F.col(source))).alias(source), F.count("*").alias("versions"), every.alias("discarded"))


# Fixed value: how much more the first rater's label counts than the second's.
FIRST_WEIGHT = 1.7


def weighted_consensus(first: Column, second: Column, weight: float = FIRST_WEIGHT) -> Column:
    """The mean of two labels, the first of which counts weight times; null if either is missing."""
    return (first * F.lit(weight) + second) / F.lit(weight + 1)


def resolve_matches(labels: DataFrame, records: DataFrame) -> DataFrame:
    """id, outcome, row_ordinal of each label (id, content_hash) among the records (id, content_hash, fingerprint, row_ordinal).

    The outcomes, first that holds: no_candidate; unique_id_match; exact_content_match (one candidate of equal, non-empty hash);
    exact_content_identical (several, all of one fingerprint: the first row); ambiguous_exact; identical_source (no label
    content, but all candidates have one content); ambiguous_no_content; content_mismatch. Only the first four and identical_source have a row.
    """
    joined = labels.select("id", F.col("content_hash").alias("want")).join(records, "id", "left")
    exact = (F.col("want") != "") & (F.col("want") == F.col("content_hash"))
    found = joined.groupBy("id", "want").agg(
        F.count("row_ordinal").alias("n"), F.count_if(exact).alias("hits"), F.countDistinct(F.when(exact, F.col("fingerprint"))).alias("prints"),
        F.countDistinct("content_hash").alias("contents"), F.min("row_ordinal").alias("first"), F.min(F.when(exact, F.col("row_ordinal"))).alias("first_hit"),
    )
    outcome = (
        F.when(F.col("n") == 0, "no_candidate").when(F.col("n") == 1, "unique_id_match").when(F.col("hits") == 1, "exact_content_match").when((F.col("hits") > 1) & (F.col("prints") == 1), "exact_content_identical")
        .when(F.col("hits") > 1, "ambiguous_exact").when((F.col("want") == "") & (F.col("contents") == 1), "identical_source").when(F.col("want") == "", "ambiguous_no_content").otherwise("content_mismatch")
    )
    row = F.when(F.col("n") == 1, F.col("first")).when((F.col("hits") >= 1) & (F.col("prints") == 1), F.col("first_hit")).when((F.col("hits") == 0) & (F.col("want") == "") & (F.col("contents") == 1), F.col("first"))
    return found.select("id", outcome.alias("outcome"), row.alias("row_ordinal"))


@arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column function: the share of matching blocks (Ratcliff and Obershelp), null for a null."""
    import difflib

    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def fuzzy_matches(labels: DataFrame, records: DataFrame, least: float = 0.97, margin: float = 0.02) -> DataFrame:
    """id, row_ordinal, ratio: the best candidate of each label if its ratio is high enough and leads the next one's.

    Candidates whose lengths alone keep the ratio below least can't be the best; they only count for the lead if they reach least - margin.
    """
    scored = labels.select("id", F.col("content").alias("want")).join(records, "id")
    a, b = F.length("want"), F.length("content")
    # Twice the shorter length over both lengths is the most that a ratio can reach.
    possible = scored.where(2.0 * F.least(a, b) >= (least - margin) * (a + b))
    rated = possible.select("id", "row_ordinal", similarity(F.col("want"), F.col("content")).alias("ratio"))
    place = F.struct(-F.col("ratio"), F.col("row_ordinal"))
    best = rated.groupBy("id").agg(F.min_by(F.struct("row_ordinal", "ratio"), place).alias("b"))
    rest = rated.join(best, "id").where(F.col("row_ordinal") != F.col("b.row_ordinal")).groupBy("id").agg(F.max("ratio").alias("next"))
    led = best.join(rest, "id", "left").where((F.col("b.ratio") >= least) & (F.col("b.ratio") - F.coalesce("next", F.lit(0.0)) >= margin))
    return led.select("id", "b.row_ordinal", "b.ratio")


def resolve_with_fuzzy(labels: DataFrame, records: DataFrame, least: float = 0.97, margin: float = 0.02) -> DataFrame:
    """The whole ladder: resolve_matches of labels (id, content, content_hash), and for the ids whose content matches none exactly the fuzzy match.

    The outcomes are those of resolve_matches, missing_id for a null or blank id, and fuzzy_match, which has a row.
    """
    nameless = F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) == ""
    exact = resolve_matches(labels.where(~nameless).select("id", "content_hash"), records.drop("content") if "content" in records.columns else records)
    exact = cut(exact)
    left = exact.where("outcome = 'content_mismatch'").select("id")
    fuzzy = fuzzy_matches(labels.where("content IS NOT NULL").select("id", "content").join(left, "id", "left_semi"), records.where("content IS NOT NULL").select("id", "row_ordinal", "content"), least, margin)
    told = exact.join(fuzzy.select("id", F.col("row_ordinal").alias("_row")), "id", "left")
    out = told.select("id", F.when(F.col("_row").isNotNull(), "fuzzy_match").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("row_ordinal", "_row").alias("row_ordinal"))
    return out.unionByName(labels.where(nameless).select("id", F.lit("missing_id").alias("outcome"), F.lit(None).cast("long").alias("row_ordinal")))


def assign_roles(df: DataFrame, group: str, split: Column, eligible: Column) -> DataFrame:
    """df with role: train for rows of the train split or of groups without any eligible row, else the split of eligible rows, else embargo."""
    # The groups are summed up and joined, so that a large one is never gathered.
    held = df.groupBy(F.col(group).alias("_group")).agg(F.sum(eligible.cast("int")).alias("_eligible"))
    df = df.join(held, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    role = F.when((split == "train") | (F.col("_eligible") == 0), "train").when(eligible & (split == "val"), "validation").when(eligible & (split == "test"), "test").otherwise("embargo")
    return df.withColumn("role", role).drop("_eligible")


def read_labels(df: DataFrame, id: str) -> DataFrame:
    """Labels with their ids in normal form; fails if two rows have the same one, null and blank ids left aside."""
    out = df.withColumn(id, normal_id(F.col(id)))
    if out.where(F.col(id) != "").groupBy(id).count().where("count > 1").limit(1).count():
        raise ValueError(f"{id} repeats after normalisation")
    return out


def annotation_template(df: DataFrame, columns: Sequence[str], fields: Sequence[str] = ("stress", "notes")) -> DataFrame:
    """The columns to show an annotator and empty ones to fill in."""
    return df.select(*columns, *[F.lit("").alias(f) for f in fields])


def sample_weights(df: DataFrame, label: str, weight: str, train: Column) -> DataFrame:
    """df with training_weight: the weight times its class's, so that the mean over the training rows is 1; null for all others."""
    classes = class_weights(df.where(train), label).select(F.col(label).alias("_label"), F.col("weight").alias("_class"))
    both = df.join(F.broadcast(classes), F.col(label).eqNullSafe(F.col("_label")), "left").withColumn("_raw", F.when(train, F.col(weight) * F.col("_class")))  # a row a class
    mean = both.agg(F.avg("_raw").alias("_mean"))
    return both.join(F.broadcast(mean)).withColumn("training_weight", F.col("_raw") / F.col("_mean")).drop("_label", "_class", "_raw", "_mean")  # one row


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: the root of the inverse frequency, relative to equal classes."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(whole)).select(label, "n", F.sqrt(F.col("whole") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row


def grouped_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 11) -> DataFrame:
    """group, fold: whole groups in folds of like size and label mix.

    Groups of the same dominant label and size are dealt out in turn, in the order of a seeded hash, which is one window over
    pre-aggregated groups; no group's rows are ever gathered.
    """
    sizes = df.groupBy(group, label).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("size"), F.max_by(label, F.struct("n", label)).alias("main"))
    dealt = F.row_number().over(Window.partitionBy("main", "size").orderBy(F.xxhash64(F.col(group), F.lit(seed)), group))
    start = F.pmod(F.xxhash64("main", "size", F.lit(seed)), F.lit(folds))
    return sizes.select(group, F.pmod(dealt + start, F.lit(folds)).cast("int").alias("fold"))


#: Row digests that are joined to one digest of the next level.
CHUNK = 4096


def dataset_digest(df: DataFrame, id: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """digest: SHA-256 over the rows in the order of id, then value, whatever their order in the table.

    The digests of so many neighbouring rows are joined and digested again, level by level, until one is left; no task holds more.
    """
    row = F.concat(F.col(id), F.lit("\x1f"), F.coalesce(F.col(value).cast("string"), F.lit("")), F.lit("\n"))
    level = positions(df.select(F.col(id).alias("_id"), F.sha2(row, 256).alias("h")), [F.asc("_id"), F.asc("h")], "at").select("at", "h")
    n = level.count()
    while True:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)
        if n <= chunk:
            return level.agg(joined.alias("digest"))
        level = cut(level.groupBy(F.floor(F.col("at") / F.lit(chunk)).alias("at")).agg(joined.alias("h")))
        n = -(-n // chunk)
