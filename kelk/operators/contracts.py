"""Contracts of tables and predictions, as counts of what breaks them: one row a rule, 0 where it holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kelk.functions.text import is_blank
from kelk.sources.readers import exists, save_json

# The classes with the scores that each may have; a bound that two classes share belongs to both but for 5.
CLASS_RANGES = (("Low", 1.0, 3.0, True), ("Moderate", 3.0, 5.0, False), ("High", 5.0, 7.0, True), ("Very High", 7.0, 10.0, True))
ROLES = ("train", "validation", "test", "embargo")


class ContractError(ValueError):
    """A table that breaks its contract."""


def require_columns(df: DataFrame, needed: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """df, if it has all of the needed columns and none of the forbidden ones."""
    missing, extra = [c for c in needed if c not in df.columns], [c for c in forbidden if c in df.columns]
    if missing or extra:
        raise ContractError(f"missing columns {missing}, forbidden columns {extra}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: the rows that break each rule, in one pass. A rule is the condition of a breach; null is none."""
    counts = df.agg(F.array(*[F.struct(F.lit(name).alias("rule"), F.count_if(F.coalesce(broken, F.lit(False))).alias("n")) for name, broken in rules.items()]).alias("rows"))
    return counts.select(F.explode("rows").alias("r")).select("r.*")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """repeated_keys, surplus_rows: keys with more than one row, null ones left out, and the rows beyond the first of each."""
    n = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def class_breach(label: Column, score: Column) -> Column:
    """Whether a class and a score contradict each other, or the class is unknown; null for a null class or score."""
    out = F.when(label.isNull() | score.isNull(), None)
    for name, low, high, closed in CLASS_RANGES:
        out = out.when(label == name, ~((score >= low) & ((score <= high) if closed else (score < high))))
    return out.otherwise(True)


def input_contract(df: DataFrame, id: str, role: str, fold: str, score: str, label: str, weight: str, folds: int = 5, scores: tuple[float, float] = (1.0, 10.0)) -> DataFrame:
    """rule, n over a table of records with roles, folds, scores and weights."""
    c = {n: F.col(x) for n, x in (("id", id), ("role", role), ("fold", fold), ("score", score), ("label", label), ("weight", weight))}
    labelled, train = c["role"].isin("train", "validation", "test"), c["role"] == "train"
    rules = {
        "missing_id": is_blank(c["id"]), "unknown_role": ~F.coalesce(c["role"].isin(*ROLES), F.lit(False)), "missing_score": labelled & c["score"].isNull(), "score_out_of_range": labelled & ~c["score"].between(*scores),
        "train_without_fold": train & c["fold"].isNull(), "fold_outside_train": ~train & c["fold"].isNotNull(), "unknown_fold": ~c["fold"].between(0, folds - 1), "bad_weight": train & ~F.coalesce(c["weight"] > 0, F.lit(False)),
        "class_against_score": labelled & class_breach(c["label"], c["score"]),
    }
    surplus = repeated_keys(df, [id]).select(F.lit("repeated_id").alias("rule"), F.col("surplus_rows").alias("n"))
    return violations(df, rules).unionByName(surplus)


def crossings(df: DataFrame, key: str, bins: str) -> DataFrame:
    """rule, n: values of the key, blank ones left out, that lie in more than one of the bins."""
    torn = df.where(~is_blank(F.col(key)) & F.col(bins).isNotNull()).groupBy(key).agg(F.min(bins).alias("a"), F.max(bins).alias("b")).where("a <> b")
    return torn.agg(F.lit(f"{key}_across_{bins}").alias("rule"), F.count("*").alias("n"))


def fold_contract(train: DataFrame, id: str, fold: str, groups: Sequence[str], folds: int = 5) -> DataFrame:
    """rule, n: ids and groups in several folds, rows without a fold, and folds of 0 to folds - 1 that have no row or are none of them."""
    held = train.select(F.col(fold).alias("f")).where("f IS NOT NULL").distinct()
    wanted = train.sparkSession.range(folds).select(F.col("id").cast("int").alias("f"))
    one = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    out = crossings(train, id, fold)
    for group in groups:
        out = out.unionByName(crossings(train, group, fold))
    out = out.unionByName(one("empty_fold", wanted.join(held, "f", "left_anti"))).unionByName(one("unknown_fold", held.where(~F.col("f").between(0, folds - 1))))
    return out.unionByName(one("without_fold", train.where(F.col(fold).isNull())))


def verify_predictions(predictions: DataFrame, expected: DataFrame, id: str, prediction: str, parts: Sequence[str] = (), scores: tuple[float, float] = (1.0, 10.0), slack: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """rule, n: expected ids without a prediction, predictions nobody expects or repeated, missing or beyond the scores by more than slack, and not the mean of their parts."""
    value = F.col(prediction)
    rules = {"missing_value": value.isNull() | F.isnan(value), "out_of_range": ~value.between(scores[0] - slack, scores[1] + slack)}
    if parts:
        mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
        rules["not_the_mean"] = F.abs(mean - value) > tolerance
    both = expected.select(F.col(id), F.lit(True).alias("asked")).distinct().join(predictions.groupBy(id).agg(F.count("*").alias("given")), id, "full")
    found = violations(both, {"missing": F.col("given").isNull(), "unexpected": F.col("asked").isNull(), "repeated": F.col("given") > 1})
    return found.unionByName(violations(predictions, rules))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on a key that neither side repeats; raises otherwise."""
    for side, df in (("left", left), ("right", right)):
        if n := repeated_keys(df, [key]).first()["surplus_rows"]:
            raise ContractError(f"the {side} side repeats {key} in {n} rows")
    return left.join(right, key)


def recall_floors(report: DataFrame, floors: dict[str, float]) -> DataFrame:
    """passed, classes, status, failed: the classes of a report (class, recall) that reach their floors, and the names of those that don't, in the floors' order."""
    spark = report.sparkSession
    table = spark.createDataFrame([(i, c, f) for i, (c, f) in enumerate(floors.items())], "i int, class string, floor double")
    judged = F.broadcast(table).join(report.select("class", "recall"), "class", "left").withColumn("ok", F.coalesce(F.col("recall") + 1e-12 >= F.col("floor"), F.lit(False)))
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("i", "class")))), lambda x: x["class"]), "|")
    out = judged.agg(F.count_if("ok").alias("passed"), F.count("*").alias("classes"), failed.alias("failed"))
    return out.select("passed", "classes", F.concat("passed", F.lit("_of_"), "classes", F.lit("_recall_floors")).alias("status"), "failed")


def alignment(tables: dict[str, DataFrame], id: str) -> DataFrame:
    """table, ids, missing, unexpected: of each table the ids of the first that it lacks, and those that the first doesn't have."""
    names = list(tables)
    held = None
    for name, df in tables.items():
        part = df.select(F.col(id).alias("id"), F.lit(name).alias("table")).where("id IS NOT NULL").distinct()
        held = part if held is None else held.unionByName(part)
    # One row an id with the tables that have it; the counts are made in one pass over these.
    by_id = held.groupBy("id").agg(F.collect_set("table").alias("in"))
    first = F.array_contains("in", names[0])
    rows = [
        F.struct(F.lit(n).alias("table"), F.count_if(F.array_contains("in", n)).alias("ids"), F.count_if(first & ~F.array_contains("in", n)).alias("missing"), F.count_if(F.array_contains("in", n) & ~first).alias("unexpected"))
        for n in names
    ]
    return by_id.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def evaluate_once(spark: SparkSession, marker: str, run: Callable[[], dict[str, Any]], confirmed: bool, force: bool = False) -> dict[str, Any]:
    """What run gives, if it is confirmed and the marker file tells of no earlier run; the marker then holds the report. force runs again."""
    if not confirmed:
        raise ContractError("the locked evaluation has to be confirmed")
    if exists(spark, marker) and not force:
        raise ContractError(f"evaluated before: {marker}")
    report = run()
    save_json(spark, marker, report)
    return report
