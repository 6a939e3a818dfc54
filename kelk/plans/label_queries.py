"""Queries of label consolidation, roles, metrics, thresholds, ensembles and annotation ranking.

Two predictions of each labelled post stand in for models: the raw labels of the two persons, a missing one filled by the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelk.functions.features import half_open_class
from kelk.operators import components, evaluation, labels
from kelk.plans.cleaning_queries import P, posts
from kelk.session import table

CUTS = (3.0954385027019997, 4.905160815295, 6.4621351159455)
C, M, H = "canonical_labels", "modeling_manifest_v2", "annotation_history"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, C).where("final_stress IS NOT NULL")
    first, second = F.coalesce("person1_raw", "person2_raw"), F.coalesce("person2_raw", "person1_raw")
    return df.select("unique_post_id", F.col("final_stress").alias("truth"), "clinical_class", first.alias("a"), second.alias("b"), ((first * 2 + second) / 3).alias("score"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", labels.content_hash(F.col("content")).alias("hash"))


#: Characters that the compatibility form leaves as they are: ASCII, Arabic but for four letters, the non-joiner, symbols and emoji.
STABLE = r"[\x{20}-\x{7e}\n\t\x{600}-\x{674}\x{679}-\x{6ff}\x{200c}\x{fe0f}\x{2600}-\x{27bf}\x{1f000}-\x{1faff}]"


def content_hash_stable(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the whole content of every post, for those whose characters SQL can normalise; null for the others, which content_hash has."""
    stable = F.coalesce("content", F.lit("")).rlike(f"^{STABLE}*$")
    return posts(spark, d).select("row_ordinal", stable.alias("stable"), F.when(stable, labels.content_hash(F.col("content"))).alias("hash"))


def dup_content_groups(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "duplicate_content_audit")
    return df.where("content_hash <> ''").groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")


#: Rounds of labels in the order of preference.
ROUNDS = ("original_round", "original_extra_person1_round", "active_learning_round", "panel_round")


def canonical_by_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.coalesce(F.array_position(F.lit(list(ROUNDS)), F.col("label_round")), F.lit(len(ROUNDS) + 1))
    return labels.canonical_by_rank(table(spark, d, H).where("observed").distinct(), "unique_post_id", F.when(rank == 0, len(ROUNDS) + 1).otherwise(rank), "annotator", "stress")


def ols_consensus(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, C)
    fit = df.agg(F.regr_slope("person1_raw", "person2_raw").alias("slope"), F.regr_intercept("person1_raw", "person2_raw").alias("intercept"), F.avg(labels.weighted_consensus(F.col("person1_raw"), F.col("person2_raw"))).alias("consensus"))
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


def match_ladder(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, C).select(F.col("unique_post_id").alias("id"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    df = posts(spark, d)
    plain = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "[ \n\t]+", " "))
    records = df.select(F.col("unique_post_id").alias("id"), "row_ordinal", F.when(plain != "", F.sha2(plain, 256)).otherwise("").alias("content_hash"), labels.row_fingerprint({c: F.col(c) for c in ("author", "thread_id", "content")}).alias("fingerprint"))
    return labels.resolve_matches(wanted, records).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("row_ordinal").alias("rows"))


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, C).where("content IS NOT NULL").select(F.col("unique_post_id").alias("id"), "content")
    records = posts(spark, d).where("content IS NOT NULL").select(F.col("unique_post_id").alias("id"), "row_ordinal", "content")
    return labels.fuzzy_matches(wanted, records)


def dataset_digest(spark: SparkSession, d: str) -> DataFrame:
    return labels.dataset_digest(table(spark, d, C), "unique_post_id", "final_stress")


def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The whole ladder over hashes of the whole content, the fuzzy match of what is left included."""
    wanted = table(spark, d, C).select(F.col("unique_post_id").alias("id"), "content", labels.content_hash(F.col("content")).alias("content_hash"))
    df = posts(spark, d)
    records = df.select(F.col("unique_post_id").alias("id"), "row_ordinal", "content", labels.content_hash(F.col("content")).alias("content_hash"), labels.row_fingerprint({c: F.col(c) for c in ("author", "thread_id", "content")}).alias("fingerprint"))
    return labels.resolve_with_fuzzy(wanted, records)


def class_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.class_summary(_classed(spark, d), "clinical_class", "predicted")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_shares(_classed(spark, d), "clinical_class", "predicted").withColumn("share", F.round("share", 6))


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, M).distinct()
    out = labels.assign_roles(df, "group_id", F.col("original_component_split"), F.col("label_source") == "original_dual")
    return out.groupBy("role").agg(F.count("*").alias("n"))


def role_class_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, M).distinct().groupBy("model_role").pivot("clinical_class", list(evaluation.CLASSES)).count().fillna(0)
    return out.withColumnsRenamed({"Low": "low", "Moderate": "moderate", "High": "high", "Very High": "very_high"})


def leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, M).distinct().where("model_role <> 'embargo'")
    one = lambda key: df.where(f"{key} IS NOT NULL AND trim({key}) <> ''").groupBy(key).agg(F.countDistinct("model_role").alias("roles")).where("roles > 1").agg(F.lit(key).alias("key"), F.count("*").alias("leaking"))
    return one("group_id").unionByName(one("author")).unionByName(one("thread_id")).unionByName(one("content_hash"))


def acceptance_counts(spark: SparkSession, d: str) -> DataFrame:
    floors = spark.createDataFrame([("Low", 0.75), ("Moderate", 0.5), ("High", 0.5), ("Very High", 0.75)], "clinical_class string, floor double")
    counts = table(spark, d, M).distinct().where("model_role = 'test'").groupBy("clinical_class").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(floors).join(counts, "clinical_class", "left").select("clinical_class", n.alias("n"), F.ceil(n * F.col("floor")).alias("needed"), (n - F.ceil(n * F.col("floor"))).alias("misses"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_weights(table(spark, d, M).distinct().where("model_role = 'train'"), "clinical_class").withColumn("weight", F.round("weight", 9))


def grouped_folds(spark: SparkSession, d: str) -> DataFrame:
    return labels.grouped_folds(table(spark, d, M).distinct().where("model_role = 'train'"), "group_id", "clinical_class")


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, M).select("unique_post_id", "author", "thread_id").distinct()
    out = components.record_components(df, "unique_post_id", ["author", "thread_id"])
    return out.groupBy("component").agg(F.count("*").alias("size"))


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.regression_metrics(predictions(spark, d), "truth", "score")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spearman(predictions(spark, d), "truth", "score").select(F.round("spearman", 6).alias("spearman"))


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.average_precision(predictions(spark, d), F.col("clinical_class") == "Very High", "score").select(F.round("average_precision", 6).alias("average_precision"))


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumn("predicted", half_open_class(F.col("score"), CUTS))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_classed(spark, d), "clinical_class", "predicted")


def class_report(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.class_report(_classed(spark, d), "clinical_class", "predicted")
    return out.select("class", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "recall_low", "recall_high")])


def safety_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = _classed(spark, d)
    under = F.avg((F.col("score") < F.col("truth")).cast("double"))
    return df.groupBy("clinical_class").agg(F.round(under, 6).alias("under"), F.round(F.avg(F.col("score") - F.col("truth")), 6).alias("bias"), F.round(F.avg(F.abs(F.col("score") - F.col("truth"))), 6).alias("error"))


def asym_mse(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("score") - F.col("truth")
    return predictions(spark, d).agg(F.round(F.avg(F.when(e < 0, 1.75).otherwise(1.0) * e * e), 6).alias("loss"))


def threshold_distances(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("unique_post_id", *[F.round(F.col("score") - t, 6).alias(f"to_t{i + 1}") for i, t in enumerate(CUTS)])


def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.threshold_search(predictions(spark, d), "score", "clinical_class", most=60)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def threshold_search_exact(spark: SparkSession, d: str) -> DataFrame:
    """Over all midpoints of a continuous score: the stand-in's half points, spread by up to half a point by the id's hash."""
    spread = F.pmod(F.xxhash64("unique_post_id"), F.lit(1_000_003)) / 1_000_003 - 0.5
    out = evaluation.threshold_search(predictions(spark, d).withColumn("score", F.col("score") + spread), "score", "clinical_class")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


#: Points of the sweep between 1 and 10, both ends included.
SWEEP = 180


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    cum = predictions(spark, d).groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("clinical_class") == "Very High").alias("p"))
    # Every score counts at the grid points up to it: added up by its own point, then summed from the top of the points.
    point = F.floor((F.col("score") - 1) * ((SWEEP - 1) / 9) + 1e-9)
    at = cum.where("score IS NOT NULL").groupBy(F.least(point, F.lit(SWEEP - 1)).alias("id")).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    down = Window.orderBy(F.desc("id"))  # SWEEP rows
    points = spark.range(SWEEP).join(at, "id", "left").select("id", F.sum(F.coalesce("n", F.lit(0))).over(down).alias("flagged"), F.sum(F.coalesce("p", F.lit(0))).over(down).alias("hits"))
    return points.select(F.col("id").alias("step"), "flagged", "hits")


def fold_ensemble(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 2 + 5).alias(f"m{i}") for i in range(5)])
    out = evaluation.fold_ensemble(df, "vec_id", [f"m{i}" for i in range(5)])
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"), F.round("spread", 6).alias("spread"))


def blend_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.blends(predictions(spark, d), "truth", "a", "b", [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])
    return out.select("weight", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def ridge_stack(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.ridge_stack(predictions(spark, d), "truth", "a", "b", 1.0)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    out = blend_candidates(spark, d)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("mae", "rmse", F.desc("weight"))))  # one row a candidate


def candidate_register(spark: SparkSession, d: str) -> DataFrame:
    """candidate, mae, rmse, rank of two base predictions, eleven blends and four ridge stacks; ties go by rmse, then name."""
    df = predictions(spark, d).where("a IS NOT NULL")
    return evaluation.register(df, "truth", "a", "b", [w / 100 for w in range(50, 101, 5)], [0.0, 0.1, 1.0, 10.0])


def robust_zscore(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.robust_z(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "z")
    return out.select("c_custkey", F.round("z", 6).alias("z"))


def acquisition_rank(spark: SparkSession, d: str) -> DataFrame:
    df = predictions(spark, d).withColumn("spread", F.abs(F.col("a") - F.col("b")) / 2)
    return evaluation.acquisition_rank(df, "unique_post_id", "a", "b", "score", "spread", CUTS, 50).withColumn("acquisition", F.round("acquisition", 6))


def _density(df: DataFrame, points: int) -> DataFrame:
    """clinical_class, g, density of the scores x at points of an even grid from 1 to 10."""
    # Equal values share one term: the points are aggregated before they meet the grid.
    stats = df.groupBy("clinical_class").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("s")).withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2)))
    values = df.groupBy("clinical_class", "x").agg(F.count("*").alias("w")).join(F.broadcast(stats), "clinical_class")  # one row a class
    grid = values.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", 1 + F.col("g") * 9.0 / (points - 1))
    z = (F.col("at") - F.col("x")) / F.col("h")
    density = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * 2.5066282746310002)
    return grid.groupBy("clinical_class", "g").agg(density.alias("density"))


KDE_POINTS = 500


def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, C).where("final_stress IS NOT NULL").select("clinical_class", F.col("final_stress").alias("x"))
    return _density(df, KDE_POINTS).withColumn("density", F.round("density", 6))


_PRED = f"(SELECT unique_post_id, final_stress AS truth, clinical_class, coalesce(person1_raw, person2_raw) AS a, coalesce(person2_raw, person1_raw) AS b, (coalesce(person1_raw, person2_raw) * 2 + coalesce(person2_raw, person1_raw)) / 3 AS score FROM {C} WHERE final_stress IS NOT NULL)"
_CUT = f"CASE WHEN score IS NULL THEN NULL WHEN score < {CUTS[0]} THEN 'Low' WHEN score < {CUTS[1]} THEN 'Moderate' WHEN score < {CUTS[2]} THEN 'High' ELSE 'Very High' END"
_NAMES = "(SELECT unnest(['Low', 'Moderate', 'High', 'Very High']) AS c)"
_MD = f"(SELECT DISTINCT * FROM {M})"
_LEAK = " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS leaking FROM (SELECT {k} FROM {_MD} WHERE model_role <> 'embargo' AND {k} IS NOT NULL AND trim({k}) <> '' GROUP BY 1 HAVING count(DISTINCT model_role) > 1)" for k in ("group_id", "author", "thread_id", "content_hash"))
_HASH = "CASE WHEN t <> '' THEN sha256(t) ELSE '' END"
_ROBUST = lambda x, t: f"CASE WHEN (SELECT 1.4826 * median(abs({x} - (SELECT median({x}) FROM {t}))) FROM {t}) > 1e-12 THEN ({x} - (SELECT median({x}) FROM {t})) / (SELECT 1.4826 * median(abs({x} - (SELECT median({x}) FROM {t}))) FROM {t}) ELSE 0.0 END"

ORACLE = {
    "content_hash_stable": f"SELECT row_ordinal, regexp_full_match(coalesce(content, ''), '{STABLE}*') AS stable, CASE WHEN regexp_full_match(coalesce(content, ''), '{STABLE}*') THEN {_HASH} END AS hash FROM (SELECT row_ordinal, content, trim(regexp_replace(translate(nfc_normalize(coalesce(content, '')), 'يىك\u200c', 'ییک '), '[ \n\t]+', ' ', 'g')) AS t FROM {P})",
    "dup_content_groups": "SELECT content_hash, count(*) AS n FROM duplicate_content_audit WHERE content_hash <> '' GROUP BY 1 HAVING count(*) > 1",
    "canonical_by_rank": f"""WITH h AS (SELECT DISTINCT * FROM {H} WHERE observed), r AS (SELECT *, row_number() OVER (PARTITION BY unique_post_id ORDER BY coalesce(nullif(list_position({list(ROUNDS)}, label_round), 0), 5), annotator) AS r FROM h)
SELECT unique_post_id, max(stress) FILTER (r = 1) AS stress, max(annotator) FILTER (r = 1) AS annotator, count(*) AS versions, coalesce(string_agg(annotator, '|' ORDER BY r) FILTER (r > 1), '') AS discarded FROM r GROUP BY 1""",
    "ols_consensus": f"SELECT round(regr_slope(person1_raw, person2_raw), 6) AS slope, round(regr_intercept(person1_raw, person2_raw), 6) AS intercept, round(avg((person1_raw * 1.7::DOUBLE + person2_raw) / 2.7::DOUBLE), 6) AS consensus FROM {C}",
    "match_ladder": f"""WITH r AS (SELECT unique_post_id AS id, row_ordinal, t, {_HASH} AS h, sha256('author=' || coalesce(author, '') || chr(31) || 'content=' || coalesce(content, '') || chr(31) || 'thread_id=' || coalesce(thread_id, '')) AS f
  FROM (SELECT *, trim(regexp_replace(coalesce(content, ''), '[ \n\t]+', ' ', 'g')) AS t FROM {P})),
g AS (SELECT l.unique_post_id AS id, coalesce(l.content_hash, '') AS w, count(row_ordinal) AS n, count(*) FILTER (coalesce(l.content_hash, '') <> '' AND l.content_hash = h) AS hits, count(DISTINCT f) FILTER (coalesce(l.content_hash, '') <> '' AND l.content_hash = h) AS prints,
  count(DISTINCT h) AS contents, min(row_ordinal) AS a, min(row_ordinal) FILTER (coalesce(l.content_hash, '') <> '' AND l.content_hash = h) AS b FROM {C} l LEFT JOIN r ON r.id = l.unique_post_id GROUP BY 1, 2)
SELECT CASE WHEN n = 0 THEN 'no_candidate' WHEN n = 1 THEN 'unique_id_match' WHEN hits = 1 THEN 'exact_content_match' WHEN hits > 1 AND prints = 1 THEN 'exact_content_identical' WHEN hits > 1 THEN 'ambiguous_exact'
  WHEN w = '' AND contents = 1 THEN 'identical_source' WHEN w = '' THEN 'ambiguous_no_content' ELSE 'content_mismatch' END AS outcome, count(*) AS n,
  CAST(sum(CASE WHEN n = 1 THEN a WHEN hits >= 1 AND prints = 1 THEN b WHEN hits = 0 AND w = '' AND contents = 1 THEN a END) AS BIGINT) AS rows FROM g GROUP BY 1""",
    "role_assignment": f"""WITH x AS (SELECT *, original_component_split AS s, label_source = 'original_dual' AS e, sum((label_source = 'original_dual')::INT) OVER (PARTITION BY group_id) AS k FROM {_MD})
SELECT CASE WHEN s = 'train' OR k = 0 THEN 'train' WHEN e AND s = 'val' THEN 'validation' WHEN e AND s = 'test' THEN 'test' ELSE 'embargo' END AS role, count(*) AS n FROM x GROUP BY 1""",
    "role_class_pivot": f"SELECT model_role, count(*) FILTER (clinical_class = 'Low') AS low, count(*) FILTER (clinical_class = 'Moderate') AS moderate, count(*) FILTER (clinical_class = 'High') AS high, count(*) FILTER (clinical_class = 'Very High') AS very_high FROM {_MD} GROUP BY 1",
    "leakage_audit": _LEAK,
    "acceptance_counts": f"SELECT f.c AS clinical_class, count(m.unique_post_id) AS n, CAST(ceil(count(m.unique_post_id) * f.floor) AS BIGINT) AS needed, CAST(count(m.unique_post_id) - ceil(count(m.unique_post_id) * f.floor) AS BIGINT) AS misses FROM (VALUES ('Low', 0.75), ('Moderate', 0.5), ('High', 0.5), ('Very High', 0.75)) f(c, floor) LEFT JOIN {_MD} m ON m.clinical_class = f.c AND m.model_role = 'test' GROUP BY f.c, f.floor",
    "class_weights": f"WITH k AS (SELECT clinical_class, count(*) AS n FROM {_MD} WHERE model_role = 'train' GROUP BY 1) SELECT clinical_class, n, round(sqrt((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n)), 9) AS weight FROM k",
    "graph_components": f"""WITH RECURSIVE r AS (SELECT DISTINCT unique_post_id AS id, author, thread_id FROM {M}), v AS (SELECT id, 'a' AS k, author AS v FROM r WHERE author IS NOT NULL AND trim(author) <> '' UNION SELECT id, 't', thread_id FROM r WHERE thread_id IS NOT NULL AND trim(thread_id) <> ''),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM v x JOIN v y USING (k, v)), reach AS (SELECT DISTINCT id AS a, id AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b) SELECT c AS component, count(*) AS size FROM (SELECT a, min(b) AS c FROM reach GROUP BY a) GROUP BY 1""",
    "regression_metrics": f"SELECT count(*) AS n, round(avg(abs(score - truth)), 6) AS mae, round(sqrt(avg((score - truth) * (score - truth))), 6) AS rmse, round(corr(truth, score), 6) AS pearson, round(min(score), 6) AS least, round(max(score), 6) AS most FROM {_PRED}",
    "spearman": f"WITH r AS (SELECT rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS x, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS y FROM {_PRED} WHERE score IS NOT NULL) SELECT round(corr(x, y), 6) AS spearman FROM r",
    "pr_auc": f"WITH s AS (SELECT score, count(*) AS n, count(*) FILTER (clinical_class = 'Very High') AS p FROM {_PRED} GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS pr FROM s) SELECT round(sum(p * pr) / sum(p), 6) AS average_precision FROM c",
    "confusion_matrix": f"SELECT t.c AS truth, q.c AS prediction, (SELECT count(*) FROM {_PRED} WHERE clinical_class = t.c AND {_CUT} = q.c) AS n FROM {_NAMES} t CROSS JOIN {_NAMES} q",
    "class_report": f"""WITH x AS (SELECT clinical_class AS t, {_CUT} AS p FROM {_PRED}), k AS (SELECT c, (SELECT count(*) FROM x WHERE t = c AND p IS NOT NULL) AS s, (SELECT count(*) FROM x WHERE p = c) AS q, (SELECT count(*) FROM x WHERE t = c AND p = c) AS h FROM {_NAMES}),
m AS (SELECT *, coalesce(h / nullif(q, 0), 0) AS pr, coalesce(h / nullif(s, 0), 0) AS re, 1.959963984540054::DOUBLE AS z FROM k)
SELECT c AS class, s AS support, q AS predicted, h AS hits, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
 round((h / s + z * z / (2 * s) - z * sqrt(h / s * (1 - h / s) / s + z * z / (4 * s * s))) / (1 + z * z / s), 6) AS recall_low, round((h / s + z * z / (2 * s) + z * sqrt(h / s * (1 - h / s) / s + z * z / (4 * s * s))) / (1 + z * z / s), 6) AS recall_high FROM m""",
    "safety_metrics": f"SELECT clinical_class, round(avg((score < truth)::INT), 6) AS under, round(avg(score - truth), 6) AS bias, round(avg(abs(score - truth)), 6) AS error FROM {_PRED} GROUP BY 1",
    "asym_mse": f"SELECT round(avg(CASE WHEN score < truth THEN 1.75::DOUBLE ELSE 1 END * (score - truth) * (score - truth)), 6) AS loss FROM {_PRED}",
    "threshold_distances": f"SELECT unique_post_id, round(score - {CUTS[0]}::DOUBLE, 6) AS to_t1, round(score - {CUTS[1]}::DOUBLE, 6) AS to_t2, round(score - {CUTS[2]}::DOUBLE, 6) AS to_t3 FROM {_PRED}",
    "threshold_search": f"""WITH s AS (SELECT score, count(*) FILTER (clinical_class = 'Low') AS c0, count(*) FILTER (clinical_class = 'Moderate') AS c1, count(*) FILTER (clinical_class = 'High') AS c2, count(*) FILTER (clinical_class = 'Very High') AS c3 FROM {_PRED} WHERE score IS NOT NULL GROUP BY 1),
u AS (SELECT coalesce((score + lead(score) OVER (ORDER BY score)) / 2, score + 1e-8) AS t, row_number() OVER (ORDER BY score) AS k, sum(c0) OVER w AS b0, sum(c1) OVER w AS b1, sum(c2) OVER w AS b2, sum(c3) OVER w AS b3 FROM s WINDOW w AS (ORDER BY score)),
n AS (SELECT sum(c0) AS n0, sum(c1) AS n1, sum(c2) AS n2, sum(c3) AS n3, greatest(ceil(count(*) / 60.0), 1) AS step FROM s), g AS (SELECT * FROM u, n WHERE k % step = 0),
x AS (SELECT p.t AS t1, q.t AS t2, r.t AS t3, p.b0 AS h0, q.b1 - p.b1 AS h1, r.b2 - q.b2 AS h2, p.n3 - r.b3 AS h3, p.n0, p.n1, p.n2, p.n3, p.b0 + p.b1 + p.b2 + p.b3 AS s0, q.b0 + q.b1 + q.b2 + q.b3 - p.b0 - p.b1 - p.b2 - p.b3 AS s1,
  r.b0 + r.b1 + r.b2 + r.b3 - q.b0 - q.b1 - q.b2 - q.b3 AS s2, p.n0 + p.n1 + p.n2 + p.n3 - r.b0 - r.b1 - r.b2 - r.b3 AS s3 FROM g p JOIN g q ON p.t < q.t JOIN g r ON q.t < r.t),
y AS (SELECT *, coalesce(h0 / nullif(n0, 0), 0) AS r0, coalesce(h1 / nullif(n1, 0), 0) AS r1, coalesce(h2 / nullif(n2, 0), 0) AS r2, coalesce(h3 / nullif(n3, 0), 0) AS r3, coalesce(h0 / nullif(s0, 0), 0) AS p0, coalesce(h1 / nullif(s1, 0), 0) AS p1, coalesce(h2 / nullif(s2, 0), 0) AS p2, coalesce(h3 / nullif(s3, 0), 0) AS p3 FROM x),
z AS (SELECT t1, t2, t3, round(p3, 12) AS a, round((coalesce(2 * r0 * p0 / nullif(r0 + p0, 0), 0) + coalesce(2 * r1 * p1 / nullif(r1 + p1, 0), 0) + coalesce(2 * r2 * p2 / nullif(r2 + p2, 0), 0) + coalesce(2 * r3 * p3 / nullif(r3 + p3, 0), 0)) / 4, 12) AS b, round(p2, 12) AS c
  FROM y WHERE r0 + 1e-12 >= 0.75 AND r1 + 1e-12 >= 0.5 AND r2 + 1e-12 >= 0.5 AND r3 + 1e-12 >= 0.75 ORDER BY 4 DESC, 5 DESC, 6 DESC, t1, t2, t3 LIMIT 100)
SELECT round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3, round(a, 6) AS top_precision, round(b, 6) AS macro_f1, round(c, 6) AS high_precision FROM z""",
    "threshold_sweep": f"SELECT g AS step, count(*) FILTER (floor((score - 1) * ({SWEEP - 1}::DOUBLE / 9) + 1e-9) >= g OR g = 0) AS flagged, count(*) FILTER ((floor((score - 1) * ({SWEEP - 1}::DOUBLE / 9) + 1e-9) >= g OR g = 0) AND clinical_class = 'Very High') AS hits FROM (SELECT unnest(range({SWEEP})) AS g) CROSS JOIN {_PRED} WHERE score IS NOT NULL GROUP BY 1",
    "fold_ensemble": "WITH m AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE * 2 + 5) AS v FROM embeddings) SELECT vec_id, round(list_avg(v), 6) AS prediction, round(list_stddev_pop(v), 6) AS spread FROM m",
    "blend_candidates": f"SELECT w AS weight, round(avg(abs(w * a + (1 - w) * b - truth)), 6) AS mae, round(sqrt(avg((w * a + (1 - w) * b - truth) ** 2)), 6) AS rmse FROM (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]::DOUBLE[]) AS w) CROSS JOIN {_PRED} GROUP BY 1",
    "ridge_stack": f"""WITH x AS (SELECT * FROM {_PRED} WHERE a IS NOT NULL), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(truth) AS my FROM x), c AS (SELECT sum((a - ma) * (a - ma)) + 1 AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) + 1 AS bb, sum((a - ma) * (truth - my)) AS ay, sum((b - mb) * (truth - my)) AS ty FROM x, m),
s AS (SELECT (ay * bb - ty * ab) / (aa * bb - ab * ab) AS f, (ty * aa - ay * ab) / (aa * bb - ab * ab) AS g FROM c) SELECT round(my - f * ma - g * mb, 5) AS intercept, round(f, 5) AS first, round(g, 5) AS second FROM s, m""",
    "robust_zscore": f"SELECT c_custkey, round({_ROBUST('c_acctbal', 'customer')}, 6) AS z FROM customer",
    "acquisition_rank": f"""WITH p AS (SELECT *, abs(a - b) AS dd, abs(a - b) / 2 AS u FROM {_PRED}), z AS (SELECT *, {_ROBUST('dd', 'p')} AS zd, {_ROBUST('u', 'p')} AS zu FROM p)
SELECT unique_post_id, round(v, 6) AS acquisition FROM (SELECT unique_post_id, 0.35::DOUBLE * zd + 0.35::DOUBLE * exp(-least(abs(score - {CUTS[0]}::DOUBLE), abs(score - {CUTS[1]}::DOUBLE), abs(score - {CUTS[2]}::DOUBLE)) / 0.40::DOUBLE) + 0.20::DOUBLE * zu + 0.10::DOUBLE / (1 + exp(-(score - {CUTS[2]}::DOUBLE) / 0.5::DOUBLE)) AS v FROM z) ORDER BY v DESC NULLS LAST, unique_post_id LIMIT 50""",
    "kde_grid": f"WITH x AS (SELECT clinical_class, final_stress AS x FROM {C} WHERE final_stress IS NOT NULL), s AS (SELECT clinical_class, count(*) AS n, stddev_samp(x) * count(*) ** (-0.2) AS h FROM x GROUP BY 1) SELECT clinical_class, CAST(g AS INTEGER) AS g, round(sum(exp(-0.5 * ((1 + g * 9.0::DOUBLE / {KDE_POINTS - 1} - x) / h) ** 2)) / (first(n) * first(h) * 2.5066282746310002), 6) AS density FROM x JOIN s USING (clinical_class) CROSS JOIN (SELECT unnest(range({KDE_POINTS})) AS g) GROUP BY 1, 2",
}
ORACLE["leaderboard"] = f"SELECT *, CAST(row_number() OVER (ORDER BY mae, rmse, weight DESC) AS INTEGER) AS rank FROM ({ORACLE['blend_candidates']})"
ORACLE["dataset_digest"] = f"""WITH RECURSIVE r AS (SELECT sha256(unique_post_id || chr(31) || coalesce(final_stress::VARCHAR, '') || chr(10)) AS h, unique_post_id AS i FROM {C}), z AS (SELECT h, row_number() OVER (ORDER BY i, h) - 1 AS k FROM r),
l1 AS (SELECT sha256(string_agg(h, '' ORDER BY k)) AS h, k // 4096 AS k FROM z GROUP BY k // 4096), l2 AS (SELECT sha256(string_agg(h, '' ORDER BY k)) AS h, k // 4096 AS k FROM l1 GROUP BY k // 4096)
SELECT CASE WHEN (SELECT count(*) FROM z) <= 4096 THEN (SELECT h FROM l1) WHEN (SELECT count(*) FROM l1) <= 4096 THEN (SELECT h FROM l2) END AS digest"""
_STACK = lambda alpha: f"""(WITH x AS (SELECT * FROM {_PRED} WHERE a IS NOT NULL), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(truth) AS my FROM x), c AS (SELECT sum((a - ma) * (a - ma)) + {alpha} AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) + {alpha} AS bb, sum((a - ma) * (truth - my)) AS ay, sum((b - mb) * (truth - my)) AS ty FROM x, m),
s AS (SELECT (ay * bb - ty * ab) / (aa * bb - ab * ab) AS f, (ty * aa - ay * ab) / (aa * bb - ab * ab) AS g FROM c) SELECT 'ridge {alpha}' AS candidate, avg(abs(my - f * ma - g * mb + f * a + g * b - truth)) AS mae, sqrt(avg((my - f * ma - g * mb + f * a + g * b - truth) ** 2)) AS rmse FROM x, s, m)"""  # noqa: E731
ORACLE["candidate_register"] = f"""WITH p AS (SELECT * FROM {_PRED} WHERE a IS NOT NULL), r AS (SELECT 'first' AS candidate, avg(abs(a - truth)) AS mae, sqrt(avg((a - truth) ** 2)) AS rmse FROM p UNION ALL SELECT 'second', avg(abs(b - truth)), sqrt(avg((b - truth) ** 2)) FROM p
UNION ALL SELECT printf('blend %.2f', w), avg(abs(w * a + (1 - w) * b - truth)), sqrt(avg((w * a + (1 - w) * b - truth) ** 2)) FROM (SELECT unnest(list_transform(range(50, 101, 5), lambda x: x / 100::DOUBLE)) AS w), p GROUP BY w {' '.join(f'UNION ALL SELECT * FROM {_STACK(x)}' for x in (0.0, 0.1, 1.0, 10.0))})
SELECT candidate, round(mae, 5) AS mae, round(rmse, 5) AS rmse, CAST(row_number() OVER (ORDER BY round(mae, 5), round(rmse, 5), candidate) AS INTEGER) AS rank FROM r"""
_SUMMARY = ORACLE["class_report"][: ORACLE["class_report"].index("SELECT c AS class, s AS support")]
ORACLE["class_summary"] = _SUMMARY + "SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(h) / sum(s), 6) AS accuracy, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS macro_f1 FROM m"
ORACLE["confusion_shares"] = f"SELECT truth, prediction, round(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 6) AS share FROM ({ORACLE['confusion_matrix']})"
QUERIES = {name: globals()[name] for name in [*ORACLE, "content_hash", "match_outcomes", "fuzzy_match", "grouped_folds", "threshold_search_exact"]}
