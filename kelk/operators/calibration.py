"""Labels of several rounds brought together, and calibrators of one rater against the consensus, compared over folds."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from kelk.functions.features import half_open_class
from kelk.operators.labels import FIRST_WEIGHT, weighted_consensus

# The sources of a label in the order of preference, with the weight of each in training.
SOURCES = (("original_dual", 1.0), ("original_p1_high_selected", 0.9), ("active_dual", 1.0), ("active_p2_calibrated", 0.65))
ROUNDS = {"original_round": "original", "original_extra_person1_round": "extra", "active_learning_round": "active"}


def linear_fit(pairs: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept of y over x by least squares."""
    return pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def reconstruct_labels(history: DataFrame) -> DataFrame:
    """One row a record: unique_post_id, final_stress, clinical_class, label_source, person1_raw, person2_raw, person1_estimated, default_label_weight, canonical_preference_rank, versions.

    history: unique_post_id, label_round, annotator, stress, observed. Where both persons labelled a record of a round the stress is their
    weighted consensus; in the extra round it is the first person's; where only the second one labelled, the first one's label is
    estimated by a line fitted over the records of the first round that both labelled. Of several rounds the preferred source counts.
    """
    observed = history.where("observed").select("unique_post_id", "label_round", "annotator", "stress").distinct()
    label = lambda who: F.max(F.when(F.col("annotator") == who, F.col("stress")))
    rounds = observed.where(F.col("label_round").isin(*ROUNDS) & F.col("annotator").isin("person1", "person2")).groupBy("unique_post_id", "label_round").agg(label("person1").alias("p1"), label("person2").alias("p2"))
    line = linear_fit(rounds.where("label_round = 'original_round' AND p1 IS NOT NULL AND p2 IS NOT NULL"), "p1", "p2")
    rounds = rounds.join(F.broadcast(line))  # one row
    kind = F.create_map(*[F.lit(x) for pair in ROUNDS.items() for x in pair])[F.col("label_round")]
    both = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    source = F.when((kind == "original") & both, SOURCES[0][0]).when((kind == "extra") & F.col("p1").isNotNull(), SOURCES[1][0]).when((kind == "active") & both, SOURCES[2][0]).when((kind == "active") & F.col("p2").isNotNull(), SOURCES[3][0])
    estimated = F.when(source == SOURCES[3][0], F.col("slope") * F.col("p2") + F.col("intercept"))
    final = F.when(source == SOURCES[1][0], F.col("p1")).otherwise(weighted_consensus(F.coalesce(estimated, "p1"), F.col("p2")))
    rank, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, (name, w) in enumerate(SOURCES):
        rank, weight = F.when(source == name, i + 1).otherwise(rank), F.when(source == name, w).otherwise(weight)
    made = rounds.select("unique_post_id", final.alias("final_stress"), source.alias("label_source"), F.col("p1").alias("person1_raw"), F.col("p2").alias("person2_raw"), estimated.alias("person1_estimated"), weight.alias("default_label_weight"), rank.alias("canonical_preference_rank"))
    made = made.where("label_source IS NOT NULL")
    columns = [c for c in made.columns if c != "unique_post_id"]
    best = made.groupBy("unique_post_id").agg(F.min_by(F.struct(*columns), "canonical_preference_rank").alias("b"), F.count("*").alias("versions")).select("unique_post_id", "b.*", "versions")
    return best.withColumn("clinical_class", half_open_class(F.col("final_stress")))


def calibrator_errors(pairs: DataFrame, fold: Column, folds: int = 5, weight: float = FIRST_WEIGHT) -> DataFrame:
    """calibrator, mae, rmse, mae_to_first of six ways to bring the second rater's labels to the consensus, each fitted on the other folds.

    pairs: p1, p2, the labels of the two raters. identity; mean_shift by the difference of the means; linear, fitted to the consensus;
    linear_first, a line to the first rater, then the consensus of that with the label; isotonic; lookup, the mean consensus of equal
    labels (of all, where the other folds have no such label). Every fit is made of sums by distinct label.
    """
    rows = pairs.select("p1", "p2", fold.alias("fold"), weighted_consensus(F.col("p1"), F.col("p2"), weight).alias("y")).where("p1 IS NOT NULL AND p2 IS NOT NULL")
    # A row stands for all of a fold's pairs with the same two labels.
    rows = rows.groupBy("fold", "p1", "p2", "y").agg(F.count("*").alias("n"))
    parts = []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        by_label = train.groupBy("p2").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("label"), F.sum("n").cast("double").alias("weight"))
        w = lambda c: F.sum(F.col("n") * c)
        x, y, z = F.col("p2"), F.col("y"), F.col("p1")
        sums = train.agg(F.sum("n").alias("m"), w(x).alias("x"), w(y).alias("y"), w(z).alias("z"), w(x * x).alias("xx"), w(x * y).alias("xy"), w(x * z).alias("xz"))
        spread = F.col("m") * F.col("xx") - F.col("x") * F.col("x")
        slope = lambda c: F.try_divide(F.col("m") * F.col(f"x{c}") - F.col("x") * F.col(c), spread)  # noqa: B023, E731
        line = sums.select((F.col("y") / F.col("m")).alias("my"), (F.col("x") / F.col("m")).alias("mx"), (F.col("z") / F.col("m")).alias("mz"), slope("y").alias("by"), slope("z").alias("bz"))
        fitted = IsotonicRegression(featuresCol="p2", labelCol="label", weightCol="weight", predictionCol="isotonic").fit(by_label)
        told = fitted.transform(test.join(F.broadcast(line)))  # one row
        told = told.join(by_label.select("p2", F.col("label").alias("known")), "p2", "left")
        first = F.col("mz") + F.col("bz") * (x - F.col("mx"))
        parts.append(told.select("p1", "y", "n", F.array(
            *[F.struct(F.lit(name).alias("calibrator"), value.alias("p")) for name, value in (
                ("identity", x), ("mean_shift", x + F.col("my") - F.col("mx")), ("linear", F.col("my") + F.col("by") * (x - F.col("mx"))), ("linear_first", weighted_consensus(first, x, weight)), ("isotonic", F.col("isotonic")), ("lookup", F.coalesce("known", "my")),
            )]).alias("c")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.select("p1", "y", "n", F.explode("c").alias("c")).select("p1", "y", "n", "c.*")
    n, off = F.col("n"), F.col("p") - F.col("y")
    return every.groupBy("calibrator").agg((F.sum(n * F.abs(off)) / F.sum("n")).alias("mae"), F.sqrt(F.sum(n * off * off) / F.sum("n")).alias("rmse"), (F.sum(n * F.abs(F.col("p") - F.col("p1"))) / F.sum("n")).alias("mae_to_first"))
