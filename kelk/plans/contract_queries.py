"""Queries of contracts, label reconstruction, calibrators, and orders and compositions of the labelled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelk.functions import features, lexicons
from kelk.functions.text import is_blank
from kelk.operators import calibration, cleaning, contracts, evaluation, labels, relations, running, vocabulary
from kelk.operators.components import record_components
from kelk.plans.cleaning_queries import ORACLE as CLEANING_ORACLE, _NO, P, posts
from kelk.plans.label_queries import _CUT, _MD, _PRED, C, H, M, _classed, predictions
from kelk.plans.label_queries import ORACLE as LABEL_ORACLE
from kelk.session import table

FLOORS = {"Low": 0.75, "Moderate": 0.5, "High": 0.5, "Very High": 0.75}


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, M).distinct()


def input_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.input_contract(table(spark, d, M), "unique_post_id", "model_role", "oof_fold", "final_stress", "clinical_class", "training_sample_weight")


def class_consistency(spark: SparkSession, d: str) -> DataFrame:
    broken = contracts.class_breach(F.col("clinical_class"), F.col("final_stress"))
    return table(spark, d, C).groupBy("clinical_class").agg(F.count("*").alias("n"), F.count_if(F.coalesce(broken, F.lit(False))).alias("against"))


def fold_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.fold_contract(_manifest(spark, d).where("model_role = 'train'"), "unique_post_id", "oof_fold", ["group_id", "author", "thread_id"])


def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, keys: contracts.repeated_keys(table(spark, d, name), keys).select(F.lit(name).alias("table"), "*")
    return one(P, ["unique_post_id"]).unionByName(one(P, ["row_ordinal"])).unionByName(one(C, ["unique_post_id"])).unionByName(one(M, ["unique_post_id"])).unionByName(one("lineitem", ["l_orderkey", "l_linenumber"]))


def role_disjointness(spark: SparkSession, d: str) -> DataFrame:
    return contracts.crossings(table(spark, d, M), "unique_post_id", "model_role").unionByName(contracts.crossings(table(spark, d, M), "group_id", "model_role"))


def prediction_verification(spark: SparkSession, d: str) -> DataFrame:
    given = predictions(spark, d).withColumn("score", (F.col("a") + F.col("b")) / 2)
    return contracts.verify_predictions(given, _manifest(spark, d).where("model_role <> 'embargo'"), "unique_post_id", "score", ["a", "b"])


def recall_floor_status(spark: SparkSession, d: str) -> DataFrame:
    return contracts.recall_floors(evaluation.class_report(_classed(spark, d), "clinical_class", "predicted"), FLOORS)


def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    right = _manifest(spark, d).select("unique_post_id", "model_role", F.col("final_stress").alias("given"))
    both = contracts.one_to_one(table(spark, d, C).select("unique_post_id", "final_stress"), right, "unique_post_id")
    return both.groupBy("model_role").agg(F.count("*").alias("n"), F.count_if(F.col("final_stress").eqNullSafe(F.col("given"))).alias("equal"))


def label_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    out = calibration.reconstruct_labels(table(spark, d, H))
    return out.withColumns({c: F.round(c, 6) for c in ("final_stress", "person1_estimated")})


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, C).select(F.col("person1_raw").alias("p1"), F.col("person2_raw").alias("p2"), "unique_post_id")


def calibrator_cv(spark: SparkSession, d: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.encode("unique_post_id", "UTF-8")), F.lit(5))
    out = calibration.calibrator_errors(_pairs(spark, d), fold)
    return out.select("calibrator", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def calibrator_by_digit(spark: SparkSession, d: str) -> DataFrame:
    """The same over folds by the id's last digit, which SQL can state, too."""
    fold = F.pmod(F.substring("unique_post_id", -1, 1).try_cast("int"), F.lit(5))
    out = calibration.calibrator_errors(_pairs(spark, d), fold)
    return out.select("calibrator", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def model_errors(spark: SparkSession, d: str) -> DataFrame:
    return relations.errors_by_model(predictions(spark, d), "truth", {"first": "a", "second": "b", "blend": "score"}).withColumn("mae", F.round("mae", 6))


def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = predictions(spark, d).join(table(spark, d, C).select("unique_post_id", F.when(F.col("label_source").startswith("original"), "before").otherwise("after").alias("stage")), "unique_post_id")
    out = relations.change_by_stage(df, "truth", {"first": "a", "second": "b", "blend": "score"}, "stage", "before", "after")
    return out.select("model", *[F.round(c, 5).alias(c) for c in ("before", "after", "change")])


def source_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, C).groupBy("label_source", "clinical_class").agg(F.count("*").alias("n"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    out = relations.linear_attribution(df, {"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 1.5})
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("mean_abs", "mean_signed")])


def component_ordinals(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, M).select("unique_post_id", "author", "thread_id", "content_hash").distinct()
    comps = record_components(df, "unique_post_id", ["author", "thread_id", "content_hash"])
    return relations.ordinals(comps, "component", "unique_post_id", "G%05d").select("unique_post_id", F.col("name").alias("component"))


def role_order(spark: SparkSession, d: str) -> DataFrame:
    df = _manifest(spark, d).select("unique_post_id", "model_role", "oof_fold")
    place = F.array_position(F.lit(list(contracts.ROLES)), F.col("model_role"))
    return running.positions(df, [place.asc_nulls_last(), F.col("oof_fold").asc_nulls_last(), F.col("unique_post_id").asc_nulls_last()], "position")


def group_order(spark: SparkSession, d: str) -> DataFrame:
    return relations.rarity_order(_manifest(spark, d), "group_id", "clinical_class")


def prefix_alignment(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, C).select(F.col("unique_post_id").alias("id"))
    right = table(spark, d, H).where("observed AND annotator = 'person2'").select(F.col("unique_post_id").alias("id")).distinct()
    return relations.aligned_prefix(left, right, "id")


def thread_dedup(spark: SparkSession, d: str) -> DataFrame:
    return relations.thread_dedup(posts(spark, d), page_rows=20).select("row_ordinal", "thread_id")


def split_objective(spark: SparkSession, d: str) -> DataFrame:
    out = relations.split_objective(_manifest(spark, d).where("model_role <> 'embargo'"), "model_role", {"train": 0.7, "validation": 0.15, "test": 0.15}, "clinical_class", "label_source")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def label_prefix(spark: SparkSession, d: str) -> DataFrame:
    return relations.prefixed(table(spark, d, C).select("unique_post_id", "final_stress", "clinical_class", "label_source"), "label__", keep=["unique_post_id"])


def default_columns(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).select("row_ordinal", "likes", "signature")
    return relations.with_defaults(df, {"likes": 0, "gender_code": -1, "source": "forum"}, drop=["signature", "no_such_column"])


def suffix_resolution(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, C).select("unique_post_id", "final_stress", "clinical_class")
    right = _manifest(spark, d).select("unique_post_id", "final_stress", "clinical_class", "model_role")
    return relations.merged(left, right, "unique_post_id", ("_label", "_manifest"), prefer="_label")


def meaningful_keys(spark: SparkSession, d: str) -> DataFrame:
    df = _manifest(spark, d)
    return df.agg(*[F.count_if(relations.meaningful(F.col(c))).alias(c) for c in ("author", "thread_id", "content_hash", "group_id")])


def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that must be numbers: anything else fails the query instead of turning into null."""
    return table(spark, d, C).select("unique_post_id", relations.strict_number(F.col("final_stress").cast("string")).alias("final_stress"))


def role_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = _manifest(spark, d).select("unique_post_id", "use_for_training", "exclude_from_modeling")
    out = posts(spark, d).select("row_ordinal", "unique_post_id").join(flags, "unique_post_id", "left")
    return out.select("row_ordinal", F.coalesce("use_for_training", F.lit(False)).alias("use_for_training"), F.coalesce("exclude_from_modeling", F.lit(True)).alias("exclude_from_modeling"))


def hash_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Size of the group of equal content hashes of each record; 0 where there is no hash."""
    df = table(spark, d, C).select("unique_post_id", "content_hash")
    sizes = df.where(~is_blank(F.col("content_hash"))).groupBy("content_hash").agg(F.count("*").alias("group_size"))
    return df.join(sizes, "content_hash", "left").select("unique_post_id", F.coalesce("group_size", F.lit(0)).alias("group_size"))


def alignment_audit(spark: SparkSession, d: str) -> DataFrame:
    return contracts.alignment({"manifest": table(spark, d, M), "labels": table(spark, d, C), "history": table(spark, d, H), "posts": posts(spark, d)}, "unique_post_id")


def evaluation_by_role(spark: SparkSession, d: str) -> DataFrame:
    """n, mae, rmse, accuracy and macro_f1 of the scores in each role."""
    df = _classed(spark, d).join(_manifest(spark, d).select("unique_post_id", "model_role"), "unique_post_id")
    out = None
    for role in ("train", "validation", "test"):
        part = df.where(F.col("model_role") == role)
        errors = evaluation.regression_metrics(part, "truth", "score").select("mae", "rmse")
        both = errors.join(F.broadcast(evaluation.class_summary(part, "clinical_class", "predicted"))).select(F.lit(role).alias("role"), "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "accuracy", "macro_f1")])  # one row each
        out = both if out is None else out.unionByName(both)
    return out


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of the least error, of equal ones the one with the smaller root, then the first by name."""
    found = evaluation.register(predictions(spark, d).where("a IS NOT NULL"), "truth", "a", "b", [w / 100 for w in range(50, 101, 5)], [0.0, 0.1, 1.0, 10.0])
    return found.agg(F.min_by(F.struct("candidate", "mae", "rmse"), F.struct("mae", "rmse", "candidate")).alias("b")).select("b.*")


def sample_weights(spark: SparkSession, d: str) -> DataFrame:
    out = labels.sample_weights(_manifest(spark, d), "clinical_class", "annotation_weight", F.col("model_role") == "train")
    return out.select("unique_post_id", F.round("training_weight", 9).alias("training_weight"))


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records, classes and sources of each group."""
    df = _manifest(spark, d).where("group_id IS NOT NULL")
    return df.groupBy("group_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("clinical_class") == c).alias(c.lower().replace(" ", "_")) for c in evaluation.CLASSES], F.countDistinct("label_source").alias("sources"), F.min_by("unique_post_id", "unique_post_id").alias("first_record"))


def annotation_template(spark: SparkSession, d: str) -> DataFrame:
    return labels.annotation_template(table(spark, d, C), ["unique_post_id", "content"])


def clean_with_author(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_filters(posts(spark, d), author="author").select("row_ordinal")


def vocabulary_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """Words that tell stressed posts from calm ones, without those that say nothing."""
    noise = (*lexicons.NEGATIVE_NOISE, *lexicons.POSITIVE_NOISE)
    out = vocabulary.differential_vocabulary(table(spark, d, C), "content", F.col("final_stress") >= 7, F.col("final_stress") <= 3, 3, 1.5, noise)
    return out.withColumn("ratio", F.round("ratio", 6))


_OK = "CASE clinical_class WHEN 'Low' THEN final_stress BETWEEN 1 AND 3 WHEN 'Moderate' THEN final_stress >= 3 AND final_stress < 5 WHEN 'High' THEN final_stress BETWEEN 5 AND 7 WHEN 'Very High' THEN final_stress BETWEEN 7 AND 10 ELSE false END"
_LABELLED = "model_role IN ('train', 'validation', 'test')"
_RULES = {
    "missing_id": "trim(coalesce(unique_post_id, '')) = ''", "unknown_role": "coalesce(model_role, '') NOT IN ('train', 'validation', 'test', 'embargo')", "missing_score": f"{_LABELLED} AND final_stress IS NULL",
    "score_out_of_range": f"{_LABELLED} AND NOT final_stress BETWEEN 1 AND 10", "train_without_fold": "model_role = 'train' AND oof_fold IS NULL", "fold_outside_train": "model_role <> 'train' AND oof_fold IS NOT NULL",
    "unknown_fold": "NOT oof_fold BETWEEN 0 AND 4", "bad_weight": "model_role = 'train' AND NOT coalesce(training_sample_weight > 0, false)",
    "class_against_score": f"{_LABELLED} AND clinical_class IS NOT NULL AND final_stress IS NOT NULL AND NOT {_OK}",
}
_SURPLUS = lambda t, k: f"SELECT count(*) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM {t} WHERE {' AND '.join(x + ' IS NOT NULL' for x in k.split(', '))} GROUP BY {k} HAVING count(*) > 1)"
_ACROSS = lambda t, k, b: f"SELECT '{k}_across_{b}' AS rule, count(*) AS n FROM (SELECT {k} FROM {t} WHERE trim(coalesce({k}, '')) <> '' AND {b} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {b}) > 1)"
_TRAIN = f"(SELECT * FROM {_MD} WHERE model_role = 'train')"
_MODELS = f"(SELECT unique_post_id, truth, unnest(['first', 'second', 'blend']) AS model, unnest([a, b, score]) AS p FROM {_PRED})"
_FOLDS = """WITH r AS (SELECT unique_post_id AS id, person1_raw AS p1, person2_raw AS p2, (person1_raw * 1.7::DOUBLE + person2_raw) / 2.7::DOUBLE AS y, TRY_CAST(right(unique_post_id, 1) AS INT) % 5 AS f FROM canonical_labels WHERE person1_raw IS NOT NULL AND person2_raw IS NOT NULL),
k AS (SELECT unnest(range(5)) AS k), t AS (SELECT k, r.* FROM k JOIN r ON f <> k),
l AS (SELECT k, avg(p2) AS mx, avg(y) AS my, avg(p1) AS mz, regr_slope(y, p2) AS b, regr_slope(p1, p2) AS c FROM t GROUP BY 1),
g AS (SELECT k, p2 AS x, sum(y) AS s, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT a.k, a.x AS low, z.x AS high, sum(m.s) / sum(m.n) AS v FROM g a JOIN g z ON a.k = z.k AND a.x <= z.x JOIN g m ON m.k = a.k AND m.x BETWEEN a.x AND z.x GROUP BY 1, 2, 3),
i AS (SELECT k, x, max(v) AS iso FROM (SELECT g.k, g.x, h.low, min(h.v) AS v FROM g JOIN h ON h.k = g.k AND h.low <= g.x AND h.high >= g.x GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT r.*, l.*, g.s / g.n AS known, i.iso FROM r JOIN l ON l.k = r.f LEFT JOIN g ON g.k = r.f AND g.x = r.p2 LEFT JOIN i ON i.k = r.f AND i.x = r.p2),
q AS (SELECT p1, y, unnest(['identity', 'mean_shift', 'linear', 'linear_first', 'isotonic', 'lookup']) AS calibrator, unnest([p2, p2 + my - mx, my + b * (p2 - mx), ((mz + c * (p2 - mx)) * 1.7::DOUBLE + p2) / 2.7::DOUBLE, iso, coalesce(known, my)]) AS v FROM p)
SELECT calibrator, round(avg(abs(v - y)), 6) AS mae, round(sqrt(avg((v - y) ** 2)), 6) AS rmse, round(avg(abs(v - p1)), 6) AS mae_to_first FROM q GROUP BY 1"""
_GRAPH = f"""WITH RECURSIVE r AS (SELECT DISTINCT unique_post_id AS id, author, thread_id, content_hash FROM {M}),
v AS (SELECT id, 'a' AS k, author AS v FROM r WHERE trim(coalesce(author, '')) <> '' UNION SELECT id, 't', thread_id FROM r WHERE trim(coalesce(thread_id, '')) <> '' UNION SELECT id, 'c', content_hash FROM r WHERE trim(coalesce(content_hash, '')) <> ''),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM v x JOIN v y USING (k, v)), reach AS (SELECT DISTINCT id AS a, id AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), c AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)"""
_BLANK = "trim(coalesce({0}, '')) <> '' AND lower(trim({0})) NOT IN ('-1', 'nan', 'none', 'null', 'unknown', 'نامشخص')"

ORACLE = {
    "input_contract": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n FROM {M}" for n, c in _RULES.items()) + f" UNION ALL SELECT 'repeated_id', surplus_rows FROM ({_SURPLUS(M, 'unique_post_id')})",
    "class_consistency": f"SELECT clinical_class, count(*) AS n, count(*) FILTER (final_stress IS NOT NULL AND NOT {_OK}) AS against FROM {C} GROUP BY 1",
    "fold_contract": " UNION ALL ".join(_ACROSS(_TRAIN, k, "oof_fold") for k in ("unique_post_id", "group_id", "author", "thread_id"))
    + f" UNION ALL SELECT 'empty_fold', count(*) FROM (SELECT unnest(range(5)) EXCEPT SELECT oof_fold FROM {_TRAIN}) UNION ALL SELECT 'unknown_fold', count(DISTINCT oof_fold) FILTER (oof_fold NOT BETWEEN 0 AND 4) FROM {_TRAIN} UNION ALL SELECT 'without_fold', count(*) FROM {_TRAIN} WHERE oof_fold IS NULL",
    "unique_keys": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", * FROM ({_SURPLUS(t, k)})" for t, k in ((P, "unique_post_id"), (P, "row_ordinal"), (C, "unique_post_id"), (M, "unique_post_id"), ("lineitem", "l_orderkey, l_linenumber"))),
    "role_disjointness": f"{_ACROSS(M, 'unique_post_id', 'model_role')} UNION ALL {_ACROSS(M, 'group_id', 'model_role')}",
    "prediction_verification": f"""WITH p AS (SELECT unique_post_id AS id, a, b, (a + b) / 2 AS s FROM {_PRED}), x AS (SELECT DISTINCT unique_post_id AS id FROM {M} WHERE model_role <> 'embargo'), c AS (SELECT id, count(*) AS n FROM p GROUP BY 1)
SELECT 'missing' AS rule, count(*) AS n FROM x ANTI JOIN c USING (id) UNION ALL SELECT 'unexpected', count(*) FROM c ANTI JOIN x USING (id) UNION ALL SELECT 'repeated', count(*) FROM c WHERE n > 1
UNION ALL SELECT 'missing_value', count(*) FROM p WHERE s IS NULL OR isnan(s) UNION ALL SELECT 'out_of_range', count(*) FROM p WHERE NOT s BETWEEN 0 AND 11 UNION ALL SELECT 'not_the_mean', count(*) FROM p WHERE abs((a + b) / 2 - s) > 1e-5""",
    "recall_floor_status": f"""WITH f AS (SELECT unnest(['Low', 'Moderate', 'High', 'Very High']) AS c, unnest([0.75, 0.5, 0.5, 0.75]::DOUBLE[]) AS floor, unnest(range(4)) AS i), x AS (SELECT f.*, coalesce(recall + 1e-12 >= floor, false) AS ok FROM f LEFT JOIN ({LABEL_ORACLE['class_report'].replace('round(re, 6)', 're')}) r ON r.class = f.c)
SELECT count(*) FILTER (ok) AS passed, count(*) AS classes, count(*) FILTER (ok) || '_of_' || count(*) || '_recall_floors' AS status, coalesce(string_agg(c, '|' ORDER BY i) FILTER (NOT ok), '') AS failed FROM x""",
    "one_to_one_join": f"SELECT model_role, count(*) AS n, count(*) FILTER (c.final_stress IS NOT DISTINCT FROM m.final_stress) AS equal FROM {C} c JOIN {_MD} m USING (unique_post_id) GROUP BY 1",
    "label_reconstruction": f"""WITH o AS (SELECT unique_post_id AS id, label_round AS r, max(stress) FILTER (annotator = 'person1') AS p1, max(stress) FILTER (annotator = 'person2') AS p2 FROM {H} WHERE observed AND annotator IN ('person1', 'person2') AND label_round IN ('original_round', 'original_extra_person1_round', 'active_learning_round') GROUP BY 1, 2),
l AS (SELECT regr_slope(p1, p2) AS s, regr_intercept(p1, p2) AS t FROM o WHERE r = 'original_round'),
k AS (SELECT *, CASE WHEN r = 'original_round' AND p1 IS NOT NULL AND p2 IS NOT NULL THEN 1 WHEN r = 'original_extra_person1_round' AND p1 IS NOT NULL THEN 2 WHEN r = 'active_learning_round' AND p1 IS NOT NULL AND p2 IS NOT NULL THEN 3 WHEN r = 'active_learning_round' AND p2 IS NOT NULL THEN 4 END AS k FROM o, l),
e AS (SELECT *, CASE WHEN k = 4 THEN s * p2 + t END AS est, CASE WHEN k = 2 THEN p1 WHEN k = 4 THEN ((s * p2 + t) * 1.7::DOUBLE + p2) / 2.7::DOUBLE ELSE (p1 * 1.7::DOUBLE + p2) / 2.7::DOUBLE END AS y, count(*) OVER (PARTITION BY id) AS versions FROM k WHERE k IS NOT NULL)
SELECT id AS unique_post_id, round(y, 6) AS final_stress, ['original_dual', 'original_p1_high_selected', 'active_dual', 'active_p2_calibrated'][k] AS label_source, p1 AS person1_raw, p2 AS person2_raw, round(est, 6) AS person1_estimated, (CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 1.0 ELSE 0.65 END)::DOUBLE AS default_label_weight,
  CAST(k AS INTEGER) AS canonical_preference_rank, versions, CASE WHEN y IS NULL THEN NULL WHEN y < 3 THEN 'Low' WHEN y < 5 THEN 'Moderate' WHEN y < 7 THEN 'High' ELSE 'Very High' END AS clinical_class FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1""",
    "calibrator_by_digit": _FOLDS,
    "model_errors": f"SELECT model, count(*) AS n, round(avg(abs(p - truth)), 6) AS mae FROM {_MODELS} WHERE p IS NOT NULL GROUP BY 1",
    "stage_pivot": f"""WITH s AS (SELECT model, avg(abs(p - truth)) FILTER (label_source LIKE 'original%') AS b, avg(abs(p - truth)) FILTER (label_source NOT LIKE 'original%') AS f FROM {_MODELS} JOIN (SELECT unique_post_id, label_source FROM {C}) USING (unique_post_id) GROUP BY 1)
SELECT model, round(b, 5) AS before, round(f, 5) AS after, round(100 * (f - b) / b, 5) AS change FROM s""",
    "source_class_counts": f"SELECT label_source, clinical_class, count(*) AS n FROM {C} GROUP BY 1, 2",
    "attribution": """WITH x AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([0.02 * (l_quantity - avg(l_quantity) OVER ()), -3.0 * (l_discount - avg(l_discount) OVER ()), 1.5 * (l_tax - avg(l_tax) OVER ())]::DOUBLE[]) AS v FROM lineitem)
SELECT feature, round(avg(abs(v)), 6) AS mean_abs, round(avg(v), 6) + 0.0 AS mean_signed FROM x GROUP BY 1""",
    "component_ordinals": f"{_GRAPH} SELECT id AS unique_post_id, printf('G%05d', dense_rank() OVER (ORDER BY c) - 1) AS component FROM c",
    "role_order": f"SELECT unique_post_id, model_role, oof_fold, row_number() OVER (ORDER BY list_position(['train', 'validation', 'test', 'embargo'], model_role) NULLS LAST, oof_fold NULLS LAST, unique_post_id NULLS LAST) - 1 AS position FROM (SELECT DISTINCT unique_post_id, model_role, oof_fold FROM {_MD})",
    "group_order": f"""WITH m AS (SELECT group_id AS g, clinical_class AS c, count(*) AS n FROM {_MD} WHERE group_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT c, sum(n) AS t FROM m GROUP BY 1), r AS (SELECT g, sum(n) AS size, max(n / t) AS rarity FROM m JOIN t ON m.c IS NOT DISTINCT FROM t.c GROUP BY 1)
SELECT g AS group_id, CAST(size AS BIGINT) AS size, round(rarity, 9) AS rarity, row_number() OVER (ORDER BY round(rarity, 9) DESC, size DESC, g) - 1 AS position FROM r""",
    "prefix_alignment": f"""WITH a AS (SELECT unique_post_id AS id, row_number() OVER (ORDER BY unique_post_id) - 1 AS k FROM {C}), b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT unique_post_id AS id FROM {H} WHERE observed AND annotator = 'person2')),
f AS (SELECT min(coalesce(a.k, b.k)) AS first FROM a FULL JOIN b USING (k) WHERE a.id IS DISTINCT FROM b.id)
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, coalesce(first, (SELECT count(*) FROM a)) AS equal_prefix FROM f""",
    "thread_dedup": f"""WITH n AS (SELECT *, CAST((row_number() OVER (PARTITION BY thread_id ORDER BY row_ordinal) - 1) // 20 AS BIGINT) + 1 AS page FROM {P}),
k AS (SELECT *, CASE WHEN trim(coalesce(post_id, '')) NOT IN ('', 'nan', 'None') THEN 'i' || trim(post_id) ELSE 'c' || coalesce(author, '') || chr(31) || coalesce(posted_at, '') || chr(31) || coalesce(content, '') END AS key FROM n WHERE NOT (coalesce(is_starter, false) AND page > 1))
SELECT min(row_ordinal) AS row_ordinal, thread_id FROM k GROUP BY thread_id, key""",
    "split_objective": f"""WITH m AS (SELECT * FROM {_MD} WHERE model_role <> 'embargo'), t AS (SELECT unnest(['train', 'validation', 'test']) AS s, unnest([0.7, 0.15, 0.15]::DOUBLE[]) AS share),
o AS (SELECT avg(((SELECT count(*) FROM m WHERE model_role = s) / (share * (SELECT count(*) FROM m)) - 1) ** 2) AS total FROM t),
c AS (SELECT avg((coalesce(n, 0) / (share * w) - 1) ** 2) AS class FROM t CROSS JOIN (SELECT clinical_class AS v, count(*) AS w FROM m GROUP BY 1) LEFT JOIN (SELECT model_role AS s, clinical_class AS v, count(*) AS n FROM m GROUP BY 1, 2) USING (s, v)),
l AS (SELECT avg((coalesce(n, 0) / (share * w) - 1) ** 2) AS source FROM t CROSS JOIN (SELECT label_source AS v, count(*) AS w FROM m GROUP BY 1) LEFT JOIN (SELECT model_role AS s, label_source AS v, count(*) AS n FROM m GROUP BY 1, 2) USING (s, v))
SELECT round(total, 8) AS total, round(class, 8) AS class, round(source, 8) AS source, round(0.35 * total + 2.5 * class + 0.25 * source, 8) AS objective FROM o, c, l""",
    "label_prefix": f"SELECT unique_post_id, final_stress AS label__final_stress, clinical_class AS label__clinical_class, label_source AS label__label_source FROM {C}",
    "default_columns": f"SELECT row_ordinal, likes, -1 AS gender_code, 'forum' AS source FROM {P}",
    "suffix_resolution": f"SELECT unique_post_id, c.final_stress, c.clinical_class, model_role FROM {C} c JOIN {_MD} m USING (unique_post_id)",
    "meaningful_keys": f"SELECT {', '.join(f'count(*) FILTER ({_BLANK.format(c)}) AS {c}' for c in ('author', 'thread_id', 'content_hash', 'group_id'))} FROM {_MD}",
    "strict_numbers": f"SELECT unique_post_id, final_stress FROM {C}",
    "role_flags": f"SELECT row_ordinal, coalesce(use_for_training, false) AS use_for_training, coalesce(exclude_from_modeling, true) AS exclude_from_modeling FROM {P} LEFT JOIN {_MD} USING (unique_post_id)",
    "hash_group_sizes": f"SELECT unique_post_id, CASE WHEN trim(coalesce(content_hash, '')) = '' THEN 0 ELSE count(*) OVER (PARTITION BY content_hash) END AS group_size FROM {C}",
    "alignment_audit": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", (SELECT count(DISTINCT unique_post_id) FROM {t}) AS ids, (SELECT count(*) FROM (SELECT unique_post_id FROM {M} WHERE unique_post_id IS NOT NULL EXCEPT SELECT unique_post_id FROM {t})) AS missing, (SELECT count(*) FROM (SELECT unique_post_id FROM {t} WHERE unique_post_id IS NOT NULL EXCEPT SELECT unique_post_id FROM {M})) AS unexpected" for n, t in (("manifest", M), ("labels", C), ("history", H), ("posts", P))),
    "evaluation_by_role": f"""WITH x AS (SELECT p.*, {_CUT} AS q, model_role FROM {_PRED} p JOIN (SELECT unique_post_id, model_role FROM {_MD}) USING (unique_post_id) WHERE model_role <> 'embargo'),
k AS (SELECT model_role, c, count(*) FILTER (clinical_class = c AND q IS NOT NULL) AS s, count(*) FILTER (q = c) AS w, count(*) FILTER (clinical_class = c AND q = c) AS h FROM x, (SELECT unnest(['Low', 'Moderate', 'High', 'Very High']) AS c) GROUP BY 1, 2),
f AS (SELECT model_role, sum(s) AS n, sum(h) / sum(s) AS accuracy, avg(coalesce(2 * h / nullif(s + w, 0), 0)) AS macro_f1 FROM k GROUP BY 1)
SELECT model_role AS role, CAST(n AS BIGINT) AS n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM f JOIN (SELECT model_role, avg(abs(score - truth)) AS mae, sqrt(avg((score - truth) ** 2)) AS rmse FROM x GROUP BY 1) USING (model_role)""",
    "best_candidate": f"SELECT candidate, mae, rmse FROM ({LABEL_ORACLE['candidate_register']}) WHERE rank = 1",
    "sample_weights": f"""WITH k AS (SELECT clinical_class AS c, count(*) AS n FROM {_MD} WHERE model_role = 'train' GROUP BY 1), w AS (SELECT c, sqrt((SELECT sum(n) FROM k) / ((SELECT count(*) FROM k) * n)) AS w FROM k),
r AS (SELECT unique_post_id, CASE WHEN model_role = 'train' THEN annotation_weight * w END AS raw FROM {_MD} LEFT JOIN w ON c = clinical_class) SELECT unique_post_id, round(raw / (SELECT avg(raw) FROM r), 9) AS training_weight FROM r""",
    "group_summary": f"SELECT group_id, count(*) AS n, count(*) FILTER (clinical_class = 'Low') AS low, count(*) FILTER (clinical_class = 'Moderate') AS moderate, count(*) FILTER (clinical_class = 'High') AS high, count(*) FILTER (clinical_class = 'Very High') AS very_high, count(DISTINCT label_source) AS sources, min(unique_post_id) AS first_record FROM {_MD} WHERE group_id IS NOT NULL GROUP BY 1",
    "annotation_template": f"SELECT unique_post_id, content, '' AS stress, '' AS notes FROM {C}",
    "clean_with_author": CLEANING_ORACLE["clean_filters"].replace("SELECT row_ordinal, unique_post_id", "SELECT row_ordinal") + f" AND NOT {_NO('author')}",
    "vocabulary_without_noise": f"""WITH t AS (SELECT final_stress AS s, unnest(regexp_extract_all(coalesce(content, ''), '{features.PERSIAN_WORD}')) AS stem FROM {C}), c AS (SELECT stem, count(*) FILTER (s >= 7) AS h, count(*) FILTER (s <= 3) AS l FROM t WHERE length(stem) >= 2 AND stem NOT IN ({', '.join(f"'{w}'" for w in (*lexicons.NEGATIVE_NOISE, *lexicons.POSITIVE_NOISE))}) GROUP BY 1)
SELECT stem, 'high' AS association, h AS high_freq, l AS low_freq, round(h / nullif(l, 0), 6) AS ratio FROM c WHERE h >= 3 AND (l = 0 OR h / l > 1.5) UNION ALL SELECT stem, 'low', h, l, round(l / nullif(h, 0), 6) FROM c WHERE l >= 3 AND (h = 0 OR l / h > 1.5)""",
}
QUERIES = {name: globals()[name] for name in [*ORACLE, "calibrator_cv"]}
