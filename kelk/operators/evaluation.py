"""Metrics of scores and classes, threshold search, blends and ensembles, ranking for annotation."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelk.functions.features import wilson
from kelk.operators.running import quantiles, running_sums

CLASSES = ("Low", "Moderate", "High", "Very High")


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """n, mae, rmse, pearson, least, most in one pass."""
    error = F.col(prediction) - F.col(truth)
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.corr(truth, prediction).alias("pearson"), F.min(prediction).alias("least"), F.max(prediction).alias("most"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the rank of the column, ties sharing the mean of their places: counts by value, summed up over the distinct values."""
    by_value = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranks = running_sums(by_value, column, ["_n"]).select(column, (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_ranks(average_ranks(both, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def average_precision(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """average_precision: the sum of precision times gained recall over falling scores, ties as one step."""
    steps = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    curve = running_sums(steps, score, ["n", "p"], descending=True).select("p", (F.col("cum_p") / F.col("cum_n")).alias("precision"))
    return curve.agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("average_precision"))


def confusion(df: DataFrame, truth: str, prediction: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """truth, prediction, n for every pair of classes, also those that never occur."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in classes for b in classes], "truth string, prediction string")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("c"))
    return F.broadcast(cells).join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("c", F.lit(0)).alias("n"))


def confusion_shares(df: DataFrame, truth: str, prediction: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """truth, prediction, share: the confusions as shares of each true class; null for a class that never occurs."""
    cells = confusion(df, truth, prediction, classes)
    whole = cells.groupBy(F.col("truth").alias("of")).agg(F.sum("n").alias("all"))
    return cells.join(F.broadcast(whole), F.col("truth") == F.col("of")).select("truth", "prediction", F.try_divide("n", "all").alias("share"))  # a row a class


def class_summary(df: DataFrame, truth: str, prediction: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """n, accuracy, macro_f1 over all classes."""
    report = class_report(df, truth, prediction, classes)
    return report.agg(F.sum("support").alias("n"), F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def class_report(df: DataFrame, truth: str, prediction: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """class, support, predicted, hits, precision, recall, f1 and the recall's interval; a share of nothing is 0."""
    cells = confusion(df, truth, prediction, classes)
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n"))
    rows = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    columns = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    low, high = wilson(F.col("hits"), F.col("support"))
    out = rows.join(columns, "class").withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    return out.withColumns({"f1": share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "recall_low": low, "recall_high": high})


def threshold_grid(df: DataFrame, score: str, label: str, classes: Sequence[str] = CLASSES, most: int = 200) -> DataFrame:
    """t, and per class the rows below t: at the midpoints of neighbouring distinct scores and beyond the highest one.

    A threshold below all scores leaves the class under it empty, whose recall then can't reach a floor, so none is tried.
    Of more than most candidates every k-th is taken, so that the search over triples stays bounded whatever the data.
    """
    names = [f"c{i}" for i in range(len(classes))]
    by_score = df.where(F.col(score).isNotNull()).groupBy(score).agg(*[F.count_if(F.col(label) == c).alias(n) for n, c in zip(names, classes)]).withColumn("k", F.lit(1))
    summed = running_sums(by_score, score, [*names, "k"])
    size = by_score.agg(F.greatest(F.ceil(F.count("*") / F.lit(most)), F.lit(1)).alias("step"))
    # The candidate's row and the next one, of which the midpoint is taken.
    near = summed.join(F.broadcast(size)).where((F.pmod("cum_k", "step") == 0) | (F.pmod("cum_k", "step") == F.pmod(F.lit(1), F.col("step"))))  # one row
    after = near.select((F.col("cum_k") - 1).alias("cum_k"), F.col(score).alias("next"))
    return near.where(F.pmod("cum_k", "step") == 0).join(after, "cum_k", "left").select(F.coalesce((F.col(score) + F.col("next")) / 2, F.col(score) + 1e-8).alias("t"), *[F.col(f"cum_{n}").alias(f"b{i}") for i, n in enumerate(names)])


def best_triples(t: np.ndarray, below: np.ndarray, floors: Sequence[float], keep: int) -> list[tuple[float, ...]]:
    """The rows of threshold_search over candidates t, rising, with the rows of each class (columns) below each.

    The top precision depends on t3 alone, so the t3 are taken from the best on. For each, blocks of t1 and t2 are halved, and those whose
    bound of the macro f1 stays under the worst triple kept are dropped: no triple is left out that belongs to the best.
    """
    size, every = below[-1], below.sum(1)  # the last candidate lies above all rows
    share = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.broadcast_to(b, np.broadcast(a, b).shape) > 0)

    def f1(hits: np.ndarray, support: int, chosen: np.ndarray) -> np.ndarray:
        recall, precision = share(hits, support), share(hits, chosen)
        return share(2 * recall * precision, recall + precision)

    enough = lambda hits, c: share(hits, size[c]) + 1e-12 >= floors[c]
    first = np.flatnonzero(enough(below[:, 0], 0))
    top = np.flatnonzero(enough(size[3] - below[:, 3], 3))
    tops = np.round(share(size[3] - below[:, 3], every[-1] - every), 12)
    f_low, f_top = f1(below[:, 0], size[0], every), f1(size[3] - below[:, 3], size[3], every[-1] - every)
    out: list[tuple[float, ...]] = []
    for precision in np.unique(tops[top])[::-1]:
        if len(out) >= keep:
            break
        room, best = keep - len(out), []

        def trim() -> None:
            best.sort(key=lambda r: (-r[4], -r[5], *r[:3]))
            del best[room:]

        for k in top[tops[top] == precision]:
            second = np.flatnonzero(enough(below[k, 2] - below[:k, 2], 2))
            if not len(second) or not len(first):
                continue
            hits, chosen = below[k, 2] - below[second, 2], every[k] - every[second]
            f_high, p_high = f1(hits, size[2], chosen), np.round(share(hits, chosen), 12)
            blocks = [(-np.inf, 0, len(first), 0, len(second))]
            while blocks:
                bound, a, b, c, d = heapq.heappop(blocks)
                if len(best) >= room and -bound < best[-1][4] - 1e-11:
                    break
                if (b - a) * (d - c) <= 4096:
                    i, j = first[a:b, None], second[None, c:d]
                    hits, chosen = below[j, 1] - below[i, 1], every[j] - every[i]
                    rows, columns = np.nonzero((i < j) & enough(hits, 1))
                    macro = np.round((f_low[i] + f1(np.maximum(hits, 0), size[1], np.maximum(chosen, 0)) + f_high[None, c:d] + f_top[k]) / 4, 12)[rows, columns]
                    if len(best) >= room:
                        good = macro >= best[-1][4]
                        rows, columns, macro = rows[good], columns[good], macro[good]
                    best += [(*map(float, t[[first[a + x], second[c + y], k]]), float(precision), float(m), float(p_high[c + y])) for x, y, m in zip(rows, columns, macro)]
                    trim()
                    continue
                half = [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)] if b - a >= d - c else [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
                for a, b, c, d in half:
                    most = below[second[d - 1], 1] - below[first[a], 1]
                    if second[d - 1] <= first[a] or not enough(most, 1):
                        continue
                    least = max(every[second[c]] - every[first[b - 1]], most)
                    middle = 2 * most / (size[1] + least) if most else 0.0
                    heapq.heappush(blocks, (-(f_low[first[a:b]].max() + middle + f_high[c:d].max() + f_top[k]) / 4, a, b, c, d))
        out += best
    return out


def threshold_search(df: DataFrame, score: str, label: str, floors: Sequence[float] = (0.75, 0.5, 0.5, 0.75), keep: int = 100, most: int | None = None) -> DataFrame:
    """t1 < t2 < t3 whose four recalls reach their floors, with recalls and precisions, the best first.

    All candidates are searched; the grid, five numbers a distinct score, is searched in the driver. With most, only so many are tried:
    the thresholds are joined level by level then, and each level drops what its recalls rule out before the next joins.
    """
    if most is None:
        grid = threshold_grid(df, score, label, most=2**31 - 1).toPandas().sort_values("t")
        names = [f"b{i}" for i in range(len(CLASSES))]
        found = best_triples(grid["t"].to_numpy(), grid[names].to_numpy(np.int64), floors, keep) if len(grid) else []
        return df.sparkSession.createDataFrame(found, "t1 double, t2 double, t3 double, top_precision double, macro_f1 double, high_precision double")
    grid = threshold_grid(df, score, label, most=most)
    totals = df.agg(*[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(CLASSES)])
    grid = grid.join(F.broadcast(totals))  # one row
    enough = lambda hits, i: F.coalesce(F.try_divide(hits, F.col(f"n{i}")), F.lit(0.0)) + 1e-12 >= floors[i]
    first = grid.where(enough(F.col("b0"), 0)).select(F.col("t").alias("t1"), *[F.col(f"b{i}").alias(f"x{i}") for i in range(4)])
    level = first.join(F.broadcast(grid), F.col("t1") < F.col("t")).where(enough(F.col("b1") - F.col("x1"), 1))
    level = level.select("t1", F.col("t").alias("t2"), *[f"x{i}" for i in range(4)], *[F.col(f"b{i}").alias(f"y{i}") for i in range(4)])
    top = grid.where(enough(F.col("n3") - F.col("b3"), 3))
    level = level.join(F.broadcast(top), F.col("t2") < F.col("t")).where(enough(F.col("b2") - F.col("y2"), 2))
    hits = [F.col("x0"), F.col("y1") - F.col("x1"), F.col("b2") - F.col("y2"), F.col("n3") - F.col("b3")]
    chosen = [sum(F.col(f"x{i}") for i in range(4)), sum(F.col(f"y{i}") - F.col(f"x{i}") for i in range(4)), sum(F.col(f"b{i}") - F.col(f"y{i}") for i in range(4)), sum(F.col(f"n{i}") - F.col(f"b{i}") for i in range(4))]
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recalls = [ratio(h, F.col(f"n{i}")) for i, h in enumerate(hits)]
    precisions = [ratio(h, c) for h, c in zip(hits, chosen)]
    f1 = [ratio(2 * r * p, r + p) for r, p in zip(recalls, precisions)]
    out = level.select("t1", F.col("t2"), F.col("t").alias("t3"), F.round(precisions[3], 12).alias("top_precision"), F.round(sum(f1[1:], f1[0]) / 4, 12).alias("macro_f1"), F.round(precisions[2], 12).alias("high_precision"))
    return out.orderBy(F.desc("top_precision"), F.desc("macro_f1"), F.desc("high_precision"), "t1", "t2", "t3").limit(keep)


def fold_ensemble(df: DataFrame, id: str, predictions: Sequence[str]) -> DataFrame:
    """id, prediction (the mean), spread (population standard deviation) of the columns of one row."""
    mean = sum((F.col(p) for p in predictions[1:]), F.col(predictions[0])) / len(predictions)
    square = sum(((F.col(p) - mean) * (F.col(p) - mean) for p in predictions), F.lit(0.0)) / len(predictions)
    return df.select(id, mean.alias("prediction"), F.sqrt(square).alias("spread"))


def blends(df: DataFrame, truth: str, a: str, b: str, weights: Sequence[float]) -> DataFrame:
    """weight, mae, rmse of each fixed blend of two predictions, all in one pass."""
    error = lambda w: w * F.col(a) + (1 - w) * F.col(b) - F.col(truth)
    rows = [F.struct(F.lit(w).alias("weight"), F.avg(F.abs(error(w))).alias("mae"), F.sqrt(F.avg(error(w) * error(w))).alias("rmse")) for w in weights]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def ridge_stack(df: DataFrame, truth: str, a: str, b: str, alpha: float, weight: Column | None = None) -> DataFrame:
    """intercept, first, second of the ridge regression of the truth on two predictions, from weighted sums."""
    w = weight if weight is not None else F.lit(1.0)
    x = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(truth).alias("y"), w.alias("w"))
    m = x.agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in "aby"], *[F.sum(F.col("w") * F.col(p) * F.col(q)).alias(f"{p}{q}") for p, q in ("aa", "ab", "bb", "ay", "by")])
    c = lambda p, q: F.col(p + q) - F.col("n") * F.col(f"m{p}") * F.col(f"m{q}")
    saa, sab, sbb, say, sby = c("a", "a") + alpha, c("a", "b"), c("b", "b") + alpha, c("a", "y"), c("b", "y")
    det = saa * sbb - sab * sab
    first, second = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    return m.select((F.col("my") - first * F.col("ma") - second * F.col("mb")).alias("intercept"), first.alias("first"), second.alias("second"))


def register(df: DataFrame, truth: str, first: str, second: str, weights: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    """candidate, mae, rmse, rank of the two predictions, their blends and their ridge stacks, all over df; ties go by rmse, then name."""
    a, b = F.col(first), F.col(second)
    rows = df
    values = {"first": a, "second": b, **{f"blend {w:.2f}": w * a + (1 - w) * b for w in weights}}
    for i, alpha in enumerate(alphas):
        stack = ridge_stack(df, truth, first, second, alpha).toDF(f"_i{i}", f"_f{i}", f"_s{i}")
        rows = rows.join(F.broadcast(stack))  # one row
        values[f"ridge {alpha}"] = F.col(f"_i{i}") + F.col(f"_f{i}") * a + F.col(f"_s{i}") * b
    error = lambda v: v - F.col(truth)
    found = rows.agg(F.array(*[F.struct(F.lit(n).alias("candidate"), F.round(F.avg(F.abs(error(v))), 5).alias("mae"), F.round(F.sqrt(F.avg(error(v) * error(v))), 5).alias("rmse")) for n, v in values.items()]).alias("rows"))
    found = found.select(F.explode("rows").alias("r")).select("r.*")
    return found.withColumn("rank", F.row_number().over(Window.orderBy("mae", "rmse", "candidate")))  # one row a candidate


def robust_z(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the column's distance from the median in units of 1.4826 times the median absolute deviation; 0 where that is 0."""
    centre = quantiles(df, column, [0.5]).select(F.col("q0").alias("_m"))
    off = df.join(F.broadcast(centre))  # one row
    scale = quantiles(off.select(F.abs(F.col(column) - F.col("_m")).alias("_a")), "_a", [0.5]).select((F.col("q0") * 1.4826).alias("_s"))
    return off.join(F.broadcast(scale)).withColumn(out, F.when(F.col("_s") > 1e-12, (F.col(column) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")  # one row


def acquisition_rank(df: DataFrame, id: str, first: str, second: str, score: str, spread: str, thresholds: Sequence[float], top: int) -> DataFrame:
    """id, acquisition of the top rows to annotate: disagreement, closeness to a threshold, uncertainty and the upper tail, weighted."""
    # The weights of the four parts, and how fast closeness and the upper tail fall off.
    both = robust_z(robust_z(df.withColumn("_d", F.abs(F.col(first) - F.col(second))), "_d", "_zd"), spread, "_zu")
    near = F.exp(-F.least(*[F.abs(F.col(score) - t) for t in thresholds]) / 0.40)
    tail = 1 / (1 + F.exp(-(F.col(score) - thresholds[-1]) / 0.5))
    value = 0.35 * F.col("_zd") + 0.35 * near + 0.20 * F.col("_zu") + 0.10 * tail
    return both.select(id, value.alias("acquisition")).orderBy(F.desc("acquisition"), id).limit(top)
