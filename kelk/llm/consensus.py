"""Consensus of several annotators' labels, with a classifier of the items as prior.

A model of two parts is fitted by expectation-maximisation: a regularised softmax classifier of hashed words, whose output is
the prior of an item's true class, and a confusion matrix for each annotator, which may be noisy, biased or contrary. Classes are
half points. The consensus is the expectation of the posterior, so an annotator who is always two points too high or turns the scale
round says as much as an honest one. To begin with, each annotator has an offset and an error, from what the others say of the same
items; the offset of most labels is none. The items stay spread over the cluster: each iteration is one pass in which every
partition turns its items into sums by annotator and label, which Spark adds up; it ends when the likelihood does not rise any more.
Of few annotators the matrices are sent to every task; of more than SENT_ANNOTATORS they stay a table, which is joined to the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.llm.overlap import plain_words
from kelk.session import cut

CLASSES = 19
FEATURES = 512
#: Iterations at most, and the rise of the mean log-likelihood of an item that ends them before.
ITERATIONS, TOLERANCE = 40, 1e-3
#: Pseudo-counts of each row of a confusion matrix: of the matrix to begin with, and of the labels of neighbouring classes.
ANCHOR, SMOOTHING = 10.0, 1.0
#: Rounds in which the annotators' offsets are found to begin with.
OFFSET_ROUNDS = 4
RIDGE = 1e-3
STEP = 4.0
#: Annotators whose matrices are sent to every task.
SENT_ANNOTATORS = 5_000
#: An annotator is reliable whose labels, against the consensus, correlate at least so much and lie off by at most so much.
LEAST_CORRELATION, MOST_ERROR = 0.6, 1.0


@dataclass
class Model:
    weights: np.ndarray  # (FEATURES + 1) x classes, the last row is the bias
    confusion: np.ndarray | None = None  # log P(label | true), annotators x true x label
    table: DataFrame | None = None  # the same as rows who, label, c0.. by true class, of many annotators
    likelihoods: tuple[float, ...] = ()  # the mean log-likelihood of an item before each iteration


@arrow_udf(T.ArrayType(T.IntegerType()))
def word_features(texts: pa.Array) -> pa.Array:
    """Column function: the hashed words of each text, each once; none for null."""
    import zlib

    return pa.array([sorted({zlib.crc32(w.encode()) % FEATURES for w in plain_words(t)}) for t in texts.to_pylist()], pa.list_(pa.int32()))


def usable_labels(history: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """item, annotator, value: observed labels between 1 and 10, those of canonical's raw columns included; one row an item and annotator.

    Estimates, impossible and missing values and rows without item or annotator are left out; repeated rows count once, and
    several different labels by one annotator for one item count as their mean.
    """
    rows = history.where("observed").select(F.col("unique_post_id").alias("item"), "annotator", F.col("stress").alias("value"))
    if canonical is not None:
        for person in ("person1", "person2"):
            rows = rows.unionByName(canonical.select(F.col("unique_post_id").alias("item"), F.lit(person).alias("annotator"), F.col(f"{person}_raw").alias("value")))
    rows = rows.where("item IS NOT NULL AND annotator IS NOT NULL AND value BETWEEN 1 AND 10 AND NOT isnan(value)")
    return rows.distinct().groupBy("item", "annotator").agg(F.avg("value").alias("value"))


def _flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and the row of each."""
    sizes = np.array([0 if x is None else len(x) for x in column], np.int64)
    parts = [np.asarray(x) for x in column if x is not None and len(x)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.repeat(np.arange(len(column)), sizes)


def _sum_rows(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share an entry of the ascending array of."""
    out = np.zeros((n, rows.shape[1]))
    if len(of):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _words(batch: pd.DataFrame) -> np.ndarray:
    """Items x (FEATURES + 1): an item's words, which weigh less the more there are, and one for the bias."""
    word, item = _flat(batch["words"])
    out = np.zeros((len(batch), FEATURES + 1))
    out[item, word.astype(np.int64)] = (1 / np.sqrt(np.maximum(np.bincount(item, minlength=len(batch)), 1)))[item]
    out[:, -1] = 1.0
    return out


def _log_prior(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    logits = words @ weights
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def _posterior(log_prior: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, log of the evidence) by item."""
    log = log_prior + likelihood
    most = log.max(1, keepdims=True)
    post = np.exp(log - most)
    total = post.sum(1, keepdims=True)
    return post / total, (most + np.log(total))[:, 0]


_C = [f"c{i}" for i in range(CLASSES)]
_SUMS = "who long, label long, " + ", ".join(f"{c} double" for c in _C)


def _class_rows(who: np.ndarray, label: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"who": who, "label": label, **{c: rows[:, i] for i, c in enumerate(_C)}})


def _gradient_rows(words: np.ndarray, post: np.ndarray, log_prior: np.ndarray, evidence: np.ndarray) -> pd.DataFrame:
    """The classifier's gradient as rows of negative numbers, -1 - feature, and in the last one the items and their evidence."""
    gradient = np.zeros((FEATURES + 2, CLASSES))
    gradient[:-1] = words.T @ (post - np.exp(log_prior))
    gradient[FEATURES + 1, :2] = len(post), evidence.sum()
    return _class_rows(-1 - np.arange(FEATURES + 2), np.zeros(FEATURES + 2, np.int64), gradient)


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("who", "label").agg(*[F.sum(c).alias(c) for c in _C])


def _stepped(model: Model, rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """The classifier's weights after a step, and the mean log-likelihood of an item, from the rows of negative numbers."""
    sums = np.zeros((FEATURES + 2, CLASSES))
    sums[-1 - rows["who"].to_numpy()] = rows[_C].to_numpy()
    n, evidence = sums[-1, :2]
    return model.weights + STEP * (sums[:-1] / max(n, 1) - RIDGE * model.weights), evidence / max(n, 1)


def _offsets(labels: DataFrame) -> DataFrame:
    """who, bias, error: how far an annotator's labels (item, who, value) lie from the other labels of their items, and how much that differs.

    The labels of each item are weighed by their annotators' errors, less their offsets; half of all labels come from offsets below
    zero, half from above. An annotator who never shares an item has no offset and an error of one.
    """
    offsets = labels.select("who").distinct().withColumns({"bias": F.lit(0.0), "error": F.lit(1.0)})
    for _ in range(OFFSET_ROUNDS):
        weighed = labels.join(offsets, "who").select("item", "who", "value", (1 / (F.col("error") * F.col("error"))).alias("w"), (F.col("value") - F.col("bias")).alias("x"))
        items = weighed.groupBy("item").agg(F.sum("w").alias("all_w"), F.sum(F.col("w") * F.col("x")).alias("all_x"))
        rest = F.col("all_w") - F.col("w")
        off = F.when(rest > 1e-9, F.col("value") - (F.col("all_x") - F.col("w") * F.col("x")) / rest)
        found = cut(weighed.join(items, "item").withColumn("off", off).groupBy("who").agg(F.count("*").alias("n"), F.coalesce(F.avg("off"), F.lit(0.0)).alias("bias"), F.coalesce(F.var_pop("off"), F.lit(0.9)).alias("spread")))
        steps = sorted(found.groupBy(F.round(F.col("bias") * 20).alias("at")).agg(F.sum("n").alias("n"), F.min("bias").alias("bias")).collect(), key=lambda r: r["at"])  # a row for each twentieth of a point between -9 and 9
        total, seen, middle = sum(r["n"] for r in steps), 0, 0.0
        for r in steps:
            seen += r["n"]
            if 2 * seen >= total:
                middle = r["bias"]
                break
        offsets = found.select("who", (F.col("bias") - middle).alias("bias"), F.sqrt(F.col("spread") + 0.1).alias("error"))
    return cut(offsets)


def _beginning(bias: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Matrices of annotators whose labels lie bias off the truth, normally by error, and anywhere at times."""
    label, true = np.arange(CLASSES)[None, None, :] / 2, np.arange(CLASSES)[None, :, None] / 2
    p = np.exp(-((label - true - bias[:, None, None]) ** 2) / (2 * error[:, None, None] ** 2)) + 1e-12
    return np.log(0.95 * p / p.sum(2, keepdims=True) + 0.05 / CLASSES)


def _confusions(counts: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """Log of the matrices, with pseudo-counts of those to begin with, which tie the classes to their values, and of the neighbouring classes' labels."""
    off = np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :]
    # A class that an annotator has hardly met takes the labels of its wider neighbourhood, then of all classes.
    wide = np.exp(-(off**2) / 32.0) @ counts
    wide += 1e-3 * counts.sum(1, keepdims=True) + 1e-6
    smoothed = counts + ANCHOR * np.exp(begun) + SMOOTHING * wide / wide.sum(2, keepdims=True) + 0.01 / CLASSES
    return np.log(smoothed / smoothed.sum(2, keepdims=True))


def _sent_pass(items: DataFrame, model: Model, begun: np.ndarray) -> tuple[Model, float]:
    """An iteration in which every task has all matrices."""
    broadcast = items.sparkSession.sparkContext.broadcast(model)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = broadcast.value
        for batch in batches:
            words = _words(batch)
            who, item = _flat(batch["who"])
            label = _flat(batch["label"])[0].astype(np.int64)
            who = who.astype(np.int64)
            prior = _log_prior(words, known.weights)
            likelihood = _sum_rows(known.confusion[who, :, label], item, len(batch))
            post, evidence = _posterior(prior, likelihood)
            order = np.argsort(who * CLASSES + label, kind="stable")
            codes = (who * CLASSES + label)[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
            sums = np.add.reduceat(post[item[order]], first, axis=0) if len(codes) else np.zeros((0, CLASSES))
            yield _class_rows(codes[first] // CLASSES, codes[first] % CLASSES, sums)
            yield _gradient_rows(words, post, prior, evidence)

    rows = _added(items.mapInPandas(partial, _SUMS)).toPandas()  # SENT_ANNOTATORS x CLASSES + FEATURES + 2 rows at most
    mine = rows[rows["who"] >= 0]
    counts = np.zeros_like(begun)
    counts[mine["who"].to_numpy(), :, mine["label"].to_numpy()] = mine[_C].to_numpy()
    weights, likelihood = _stepped(model, rows[rows["who"] < 0])
    return Model(weights, _confusions(counts, begun)), likelihood


def _with_likelihood(items: DataFrame, table: DataFrame) -> DataFrame:
    """item, words and the labels' log-likelihood by class, from the table of all matrices."""
    votes = items.select("item", F.explode(F.arrays_zip("who", "label")).alias("v")).select("item", "v.who", F.col("v.label").cast("long").alias("label"))
    told = votes.join(table, ["who", "label"]).groupBy("item").agg(*[F.sum(c).alias(c) for c in _C])
    return items.select("item", "words").join(told, "item")


def _table_pass(items: DataFrame, model: Model, offsets: DataFrame) -> tuple[Model, float]:
    """The same iteration with the matrices as a table: nothing of an annotator's is sent to all tasks or to the driver."""
    weights = items.sparkSession.sparkContext.broadcast(model.weights)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = _words(batch)
            prior = _log_prior(words, weights.value)
            post, evidence = _posterior(prior, batch[_C].to_numpy())
            yield _class_rows(np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), post).assign(item=batch["item"].to_numpy())
            yield _gradient_rows(words, post, prior, evidence).assign(item=None)

    rows = cut(_with_likelihood(items, model.table).mapInPandas(decide, _SUMS + ", item string"))
    votes = items.select("item", F.explode(F.arrays_zip("who", "label")).alias("v")).select("item", F.col("v.who").cast("long").alias("who"), F.col("v.label").cast("long").alias("label"))
    counts = _added(votes.join(rows.where("item IS NOT NULL").drop("who", "label"), "item"))

    def matrix(mine: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((1, CLASSES, CLASSES))
        sums[0][:, mine["label"].to_numpy()] = mine[_C].to_numpy().T
        begun = _beginning(mine["bias"].to_numpy()[:1], mine["error"].to_numpy()[:1])
        return _class_rows(np.full(CLASSES, mine["who"].iloc[0]), np.arange(CLASSES), _confusions(sums, begun)[0].T)

    stepped, likelihood = _stepped(model, _added(rows.where("item IS NULL").drop("item")).toPandas())  # FEATURES + 2 rows
    return Model(stepped, table=cut(counts.join(offsets, "who").groupBy("who").applyInPandas(matrix, _SUMS))), likelihood


def fit(items: DataFrame, offsets: DataFrame, annotators: int, iterations: int = ITERATIONS, sent: int = SENT_ANNOTATORS, classifier: bool = True) -> Model:
    """The model of items (item, who, label, words) when its likelihood no longer rises. Without classifier, the classes' prior stays even."""
    none, seen = np.zeros((FEATURES + 1, CLASSES)), []
    if annotators <= sent:
        rows = offsets.toPandas().sort_values("who")  # sent rows at most
        begun = _beginning(rows["bias"].to_numpy(), rows["error"].to_numpy())
        model = Model(none, begun)
    else:

        def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = _beginning(batch["bias"].to_numpy(), batch["error"].to_numpy()).transpose(0, 2, 1).reshape(-1, CLASSES)
                yield _class_rows(np.repeat(batch["who"].to_numpy(), CLASSES), np.tile(np.arange(CLASSES), len(batch)), found)

        model = Model(none, table=cut(offsets.mapInPandas(matrices, _SUMS)))
    for _ in range(iterations):
        model, likelihood = _sent_pass(items, model, begun) if annotators <= sent else _table_pass(items, model, offsets)
        if not classifier:
            model.weights = none
        seen.append(likelihood)
        if len(seen) > 2 and seen[-1] - seen[-2] < TOLERANCE:
            break
    model.likelihoods = tuple(seen)
    return model


_ITEM = T.StructType([T.StructField("item", T.StringType()), T.StructField("expected", T.DoubleType()), T.StructField("top_class", T.DoubleType()), T.StructField("certainty", T.DoubleType())])


def consensus(history: DataFrame, canonical: DataFrame, iterations: int = ITERATIONS, sent: int = SENT_ANNOTATORS, classifier: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, annotators, confusions).

    posts: unique_post_id, n_labels, n_annotators, consensus, certainty, agreement, top_class of each post with a usable label.
    consensus is the mean of the model's posterior, top_class its most probable value and certainty the probability of that; agreement is
    the share of the labels within one point of the consensus. annotators: annotator, n_labels, correlation, bias, mean_error,
    within_one, reliable, all against the consensus. confusions: annotator, true_stress, label, probability.
    The features come from canonical.content; a post without content or without a canonical row has none. An item's classes
    stand for the half points; equal probabilities take the lower class. Empty tables give no rows; extra columns are ignored.
    """
    labels = cut(usable_labels(history, canonical))
    # Annotators are numbered within the order of their names; a table of many stays one.
    names = labels.select("annotator").distinct()
    count = names.count()
    if count <= sent:
        found = sorted(r["annotator"] for r in names.collect())
        numbers = F.broadcast(history.sparkSession.createDataFrame([(name, i) for i, name in enumerate(found)], "annotator string, who long"))
    else:
        numbers = cut(names.withColumn("who", F.monotonically_increasing_id()))
    half = F.least(F.greatest(F.round((F.col("value") - 1) * 2).cast("int"), F.lit(0)), F.lit(CLASSES - 1))
    labels = cut(labels.join(numbers, "annotator"))
    votes = labels.select("item", F.struct("who", half.alias("label")).alias("v"))
    texts = canonical.where("unique_post_id IS NOT NULL").groupBy("unique_post_id").agg(F.min("content").alias("content"))
    grouped = votes.groupBy("item").agg(F.array_sort(F.collect_list("v")).alias("v")).join(texts.withColumnRenamed("unique_post_id", "item"), "item", "left")
    items = cut(grouped.select("item", F.col("v.who").alias("who"), F.col("v.label").alias("label"), word_features(F.col("content")).alias("words")))
    model = fit(items, _offsets(labels), count, iterations, sent, classifier) if count else Model(np.zeros((FEATURES + 1, CLASSES)), np.zeros((0, CLASSES, CLASSES)))
    broadcast = history.sparkSession.sparkContext.broadcast((model.weights, model.confusion))
    values = 1 + np.arange(CLASSES) / 2

    def shown(item: pd.Series, prior: np.ndarray, likelihood: np.ndarray) -> pd.DataFrame:
        post = _posterior(prior, likelihood)[0]
        return pd.DataFrame({"item": item, "expected": post @ values, "top_class": values[post.argmax(1)], "certainty": post.max(1)})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, confusion = broadcast.value
        for batch in batches:
            if confusion is None:
                likelihood = batch[_C].to_numpy()
            else:
                who, item = _flat(batch["who"])
                likelihood = _sum_rows(confusion[who.astype(np.int64), :, _flat(batch["label"])[0].astype(np.int64)], item, len(batch))
            yield shown(batch["item"], _log_prior(_words(batch), weights), likelihood)

    decided = cut((items if model.table is None else _with_likelihood(items, model.table)).mapInPandas(decide, _ITEM))
    against = labels.join(decided, "item")
    off = F.col("value") - F.col("expected")
    annotators = against.groupBy("annotator").agg(
        F.count("*").alias("n_labels"), F.corr("value", "expected").alias("correlation"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mean_error"), F.avg((F.abs(off) <= 1).cast("double")).alias("within_one")
    )
    reliable = (F.coalesce("correlation", F.lit(0.0)) >= LEAST_CORRELATION) & (F.col("mean_error") <= MOST_ERROR)
    annotators = annotators.withColumn("reliable", reliable)
    posts = against.groupBy("item").agg(
        F.count("*").alias("n_labels"), F.countDistinct("annotator").alias("n_annotators"), F.first("expected").alias("consensus"),
        F.first("certainty").alias("certainty"), F.avg((F.abs(off) <= 1).cast("double")).alias("agreement"), F.first("top_class").alias("top_class"),
    ).withColumnRenamed("item", "unique_post_id")
    table = model.table
    if table is None:
        rows = model.confusion.transpose(0, 2, 1).reshape(-1, CLASSES)
        made = _class_rows(np.repeat(np.arange(count), CLASSES), np.tile(np.arange(CLASSES), count), rows)
        table = history.sparkSession.createDataFrame(made, _SUMS) if count else history.sparkSession.createDataFrame([], _SUMS)
    cells = table.join(numbers, "who").select("annotator", "label", F.posexplode(F.array(*_C)).alias("true", "p"))
    confusions = cells.select("annotator", (1 + F.col("true") / 2).alias("true_stress"), (1 + F.col("label") / 2).alias("label"), F.exp("p").alias("probability"))
    return posts, annotators, confusions


#: Wrong final values lie two points or more from the agreed stress and right ones within one; the middle tells them apart.
CONTRADICTION = 1.5


def contradicted(history: DataFrame, canonical: DataFrame, least_annotators: int = 3) -> DataFrame:
    """unique_post_id, final_stress, consensus of the posts with enough annotators whose final_stress the posterior's expectation contradicts."""
    posts = consensus(history, canonical)[0].where(F.col("n_annotators") >= least_annotators)
    final = canonical.where("unique_post_id IS NOT NULL AND final_stress IS NOT NULL").select("unique_post_id", "final_stress").distinct()
    return posts.join(final, "unique_post_id").where(F.abs(F.col("final_stress") - F.col("consensus")) >= CONTRADICTION).select("unique_post_id", "final_stress", "consensus")


def krippendorff_alpha(labels: DataFrame) -> DataFrame:
    """n_items, n_labels, alpha: interval-scale agreement over the items with at least two labels, from sums alone."""
    per_item = labels.groupBy("item").agg(F.count("*").alias("m"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).where("m > 1")
    # Pairwise squared differences of an item add up to 2 (m q - s^2); each counts 1 / (m - 1).
    sums = per_item.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_labels"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.col("n_labels")
    observed, expected = F.col("within") / n, 2 * (n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1))
    return sums.select("n_items", F.coalesce(n, F.lit(0)).alias("n_labels"), F.try_subtract(F.lit(1.0), F.try_divide(observed, expected)).alias("alpha"))
