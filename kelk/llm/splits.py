"""Splits and folds that keep related records together, by a swap search over whole components.

A component is assigned as a whole to one of the bins (validation, test, and each fold of train). The search starts from a
hashed assignment and moves or exchanges components by annealing, so that the sizes and the label counts of the bins come close
to their shares; the best state seen is kept. The components are dealt into blocks of bounded size which are annealed in
parallel, each towards its own shares. Components of more than LARGE of all records, of which there can be 1 / LARGE at most, are
placed first, on the driver, and the blocks' shares are what they leave.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kelk.operators.components import record_components
from kelk.session import cut

RELATING = ("group_id", "author", "thread_id", "content_hash")
SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}
FOLDS = 5
LARGE = 0.002
BLOCK = 4_000
LABEL_WEIGHT = 0.5
LABELS = 64


def bins(splits: dict[str, float] = SPLITS, folds: int = FOLDS) -> list[tuple[str, int | None, float]]:
    """(split, fold, share) of each bin; train is divided into equal folds."""
    return [(name, fold, share / folds) for name, share in splits.items() if name == "train" for fold in range(folds)] + [(name, None, share) for name, share in splits.items() if name != "train"]


def anneal(counts: np.ndarray, start: np.ndarray, targets: np.ndarray, seed: int, steps: int | None = None, restarts: int = 2) -> np.ndarray:
    """Bin of each component. counts: components x (size, labels...); targets: bins x the same; start: the bins to begin with.

    The cost is the sum of the relative deviations of the sizes plus LABEL_WEIGHT times those of the labels.
    """
    n, width = counts.shape
    k = len(targets)
    if not n or k < 2:
        return start
    weight = np.full(width, LABEL_WEIGHT / max(1, width - 1))
    weight[0] = 1.0
    scale = weight / np.maximum(targets, 1.0)
    best, best_cost = start, np.inf
    steps = steps or min(30_000, 2_000 + 10 * n)
    # Plain numbers are faster here than arrays of a few entries.
    rows, scales = counts.tolist(), scale.tolist()
    columns = range(width)
    for restart in range(restarts):
        rng = np.random.default_rng(seed + restart)
        state = start.tolist()
        held = np.zeros_like(targets)
        np.add.at(held, start, counts)
        off = (held - targets).tolist()
        cost = sum(abs(x) * y for r, t in zip(off, scales) for x, y in zip(r, t))
        if cost < best_cost:
            best, best_cost = list(state), cost
        picks, others, to, swap = (rng.integers(m, size=steps).tolist() for m in (n, n, k, 2))
        chance = rng.random(steps).tolist()
        heat = 0.05 * max(cost, 1e-9)
        for step in range(steps):
            i = picks[step]
            a = state[i]
            if swap[step]:
                j = others[step]
                b, mine, other = state[j], rows[i], rows[j]
                change = [mine[c] - other[c] for c in columns]
            else:
                b, change = to[step], rows[i]
            from_, into, x, y = off[a], off[b], scales[a], scales[b]
            gain = 0.0
            for c in columns:
                d = change[c]
                if d:
                    gain += (abs(from_[c]) - abs(from_[c] - d)) * x[c] + (abs(into[c]) - abs(into[c] + d)) * y[c]
            if a != b and (gain >= 0 or chance[step] < math.exp(gain / (heat * (1 - step / steps) + 1e-12))):
                for c in columns:
                    from_[c] -= change[c]
                    into[c] += change[c]
                state[i] = b
                if swap[step]:
                    state[j] = a
                cost -= gain
            # Copies cost more than steps, so the best is looked for now and then, and at the end.
            if (not step & 63 or step == steps - 1) and cost < best_cost - 1e-12:
                best, best_cost = list(state), cost
    best = np.array(best)
    return best


def _hashed(u: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Bin by where u in [0, 1) falls among the summed shares."""
    return np.minimum(np.searchsorted(np.cumsum(shares / shares.sum()), u, side="right"), len(shares) - 1)


def assign_splits(df: DataFrame, record: str = "unique_post_id", keys: Sequence[str] = RELATING, label: str = "clinical_class", role: str = "model_role", fold: str = "oof_fold", seed: int = 17) -> DataFrame:
    """record, related_min_id, split, new_fold, mixed of each record.

    related_min_id is the smallest record of its component, new_fold is null outside train, and mixed tells that the present role and fold
    do not keep the component together: it has records of more than one of the splits, or train records of more than one fold.
    Repeated rows count once; a record with several rows has the relations and roles of all of them. Null ids take no part,
    null and blank values relate nothing, a null label is a label of its own. An empty table gives no rows. Extra columns are ignored.
    """
    names = bins()
    shares = np.array([share for _, _, share in names])
    related = cut(record_components(df, record, keys))
    rows = df.select(F.col(record), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.col(role).alias("role"), F.col(fold).alias("fold")).where(F.col(record).isNotNull())
    # The commonest LABELS labels have a measure each, all others share one more.
    labels = [r["label"] for r in rows.groupBy("label").agg(F.countDistinct(record).alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()]
    in_splits = F.col("role").isin(*SPLITS)
    units = rows.join(related, record).groupBy("component").agg(
        F.countDistinct(record).cast("double").alias("size"),
        *[F.countDistinct(F.when(which, F.col(record))).cast("double").alias(f"l{i}") for i, which in enumerate([*[F.col("label") == x for x in labels], ~F.col("label").isin(labels)])],
        (F.min(F.when(in_splits, F.col("role"))) != F.max(F.when(in_splits, F.col("role")))).alias("roles_differ"),
        (F.min(F.when(F.col("role") == "train", F.col("fold"))) != F.max(F.when(F.col("role") == "train", F.col("fold")))).alias("folds_differ"),
    )
    units = units.withColumn("mixed", F.coalesce("roles_differ", F.lit(False)) | F.coalesce("folds_differ", F.lit(False))).drop("roles_differ", "folds_differ")
    units = cut(units.withColumn("u", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))))

    measures = ["size", *[f"l{i}" for i in range(len(labels) + 1)]]
    total = units.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in measures]).first()
    whole = np.array([total[c] or 0.0 for c in measures])
    targets = shares[:, None] * whole[None, :]
    limit = max(LARGE * whole[0], 1.0)
    large = units.where(F.col("size") > limit).orderBy("component").toPandas()  # 1 / LARGE rows at most
    counts = large[measures].to_numpy(float).reshape(len(large), len(measures))
    placed = anneal(counts, _hashed(large["u"].to_numpy(float), shares), targets, seed, steps=20_000) if len(large) else np.zeros(0, int)
    left = targets.copy()
    np.subtract.at(left, placed, counts)
    left = np.maximum(left, 0.0)
    rest_shares = np.where(left.sum(axis=0) > 0, left / np.maximum(left.sum(axis=0), 1e-12), shares[:, None])

    blocks = max(1, -(-int(total["n"]) // BLOCK))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("component", ignore_index=True)
        mine = block[measures].to_numpy(float)
        goal = rest_shares * mine.sum(axis=0)[None, :]
        start = _hashed(block["u"].to_numpy(float), rest_shares[:, 0])
        return pd.DataFrame({"component": block["component"], "bin": anneal(mine, start, goal, seed), "mixed": block["mixed"]})

    schema = "component string, bin long, mixed boolean"
    small = units.where(F.col("size") <= limit).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks))).groupBy("block").applyInPandas(search, schema)
    spark = df.sparkSession
    fixed = spark.createDataFrame([(c, int(b), bool(m)) for c, b, m in zip(large["component"], placed, large["mixed"])], schema)
    which = small.unionByName(fixed)
    split = F.element_at(F.lit([x for x, _, _ in names]), (F.col("bin") + 1).cast("int"))
    new_fold = F.element_at(F.lit([-1 if y is None else y for _, y, _ in names]), (F.col("bin") + 1).cast("int"))
    out = related.join(which, "component")
    return out.select(record, F.col("component").alias("related_min_id"), split.alias("split"), F.when(new_fold >= 0, new_fold).cast("int").alias("new_fold"), "mixed")


def split_report(assigned: DataFrame, df: DataFrame, record: str = "unique_post_id", label: str = "clinical_class") -> DataFrame:
    """split, new_fold, label, records, wanted: the records of each label in each bin and its share of all of them; the null label stands for all."""
    rows = df.select(record, label).where(F.col(record).isNotNull()).distinct().join(assigned.select(record, "split", "new_fold"), record)
    shares = df.sparkSession.createDataFrame([(name, fold, share) for name, fold, share in bins()], "split string, new_fold int, share double")
    counts = rows.withColumn("label", F.explode(F.array(F.coalesce(label, F.lit("")), F.lit(None).cast("string")))).groupBy("split", "new_fold", "label").agg(F.countDistinct(record).alias("records"))
    totals = counts.groupBy(F.col("label").alias("of")).agg(F.sum("records").alias("all"))
    cells = totals.join(F.broadcast(shares))  # one row a bin
    both = cells.join(counts, cells["split"].eqNullSafe(counts["split"]) & cells["new_fold"].eqNullSafe(counts["new_fold"]) & cells["of"].eqNullSafe(counts["label"]), "left")
    return both.select(cells["split"], cells["new_fold"], F.col("of").alias("label"), F.coalesce("records", F.lit(0)).alias("records"), (F.col("share") * F.col("all")).alias("wanted"))
