"""Queries of alerts (batch and stream), incremental ingest, page parsing and models over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelk.functions.features import half_open_class, tabular_features
from kelk.operators import models
from kelk.plans.cleaning_queries import SPACE, P, posts
from kelk.plans.label_queries import _PRED, CUTS, predictions
from kelk.plans.text_queries import ORACLE as TEXT_ORACLE
from kelk.session import shared_folder, spill, table
from kelk.sources import html, readers
from kelk.streaming import alerts

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _scored(events: DataFrame) -> DataFrame:
    score = F.least(F.greatest(1 + F.col("value") / 25.0, F.lit(1.0)), F.lit(10.0))
    return events.select("user_id", "event_id", "ts", score.alias("score"), half_open_class(score, CUTS).alias("level"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("event", *[F.round(c, 6).alias(c) for c in alerts.SCORES], *alerts.FLAGS)


def alerts_ewma_batch(spark: SparkSession, d: str) -> DataFrame:
    return _shown(alerts.alerts_batch(_scored(table(spark, d, "events")), "user_id", "event_id", "ts", "score", "level"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def alerts_streaming(spark: SparkSession, d: str) -> DataFrame:
    """The stream's result, which is the batch's where events come in order."""
    out = shared_folder(spark, "alerts")
    alerts.alerts_stream(_scored(_stream(spark, d, "events")), "user_id", "event_id", "ts", "score", "level", out).trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{out}/table"))


def resume_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over a growing folder: half of the events, all of them, and nothing new; each event is taken once."""
    out = shared_folder(spark, "ingest")
    events = spark.read.schema(_EVENTS).parquet(f"{d}/events.parquet")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1", None):
        if part:
            events.where(part).write.mode("append").parquet(f"{out}/source")
        readers.ingest_new(spark, f"{out}/source", f"{out}/table", f"{out}/log", _EVENTS)
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.count("*").alias("n"))


def html_posts(spark: SparkSession, d: str) -> DataFrame:
    """Each post written as a topic page and read again."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")
    page = F.concat(
        F.lit('<html><body><article class="topic-post" id="post-'), F.col("row_ordinal"), F.lit('"><a class="nickname">'), safe(F.col("author")), F.lit('</a><div class="post-message"><p>'), safe(F.col("content")),
        F.lit('</p><blockquote>quoted</blockquote><div class="signature">'), safe(F.col("signature")), F.lit('</div></div><a class="like-count" data-like-count="'), F.coalesce(F.col("likes").cast("string"), F.lit("")), F.lit('"></a></article></body></html>'),
    )
    out = html.posts_of_pages(posts(spark, d).select(page.alias("html"), F.lit(1).alias("page")), "html", "page")
    return out.select(F.col("post_id").cast("bigint").alias("row_ordinal"), "author", "content", "likes", "is_starter")


def page_rewrite(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://forum.example/topic/"), F.col("o_orderkey"), F.when(F.col("o_custkey") % 3 == 0, "?page=9").when(F.col("o_custkey") % 3 == 1, "?a=1").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", html.with_page(url, F.pmod("o_orderkey", F.lit(3)) + 1).alias("url"))


def last_page(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit('<a href="?page='), F.pmod("o_orderkey", F.lit(97)), F.lit('">'))), " ").alias("html"))
    return links.select("o_custkey", html.last_page(F.col("html")).alias("last_page"))


def _first_posts(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each post's id."""
    df = posts(spark, d)
    firsts = df.groupBy("unique_post_id").agg(F.min("row_ordinal").alias("row_ordinal"))
    return df.join(firsts.select("row_ordinal"), "row_ordinal", "left_semi")


def _training(spark: SparkSession, d: str) -> tuple[DataFrame, models.Features]:
    """The labelled records with all 67 features of their posts, kept as a table for the models' passes."""
    rows = tabular_features(_first_posts(spark, d), "unique_post_id")
    features = models.columns_of(rows, ["unique_post_id"])
    roles = table(spark, d, "modeling_manifest_v2").select("unique_post_id", "final_stress", "model_role", "oof_fold", "training_sample_weight").distinct()
    return spill(roles.join(rows, "unique_post_id")), features


def _fold_models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list, models.Features]:
    df, features = _training(spark, d)
    train = df.where("model_role = 'train' AND oof_fold IS NOT NULL")
    return df, train, models.train_folds(train, features, "final_stress", "oof_fold", 5, "training_sample_weight"), features


def oof_gbt(spark: SparkSession, d: str) -> DataFrame:
    _, train, fitted, features = _fold_models(spark, d)
    return models.out_of_fold(train, fitted, features, "oof_fold").select("unique_post_id", "oof_fold", F.col("final_stress").alias("true_stress"), "prediction")


def importance(spark: SparkSession, d: str) -> DataFrame:
    _, train, fitted, features = _fold_models(spark, d)
    return models.importance(train, fitted, features)


def holdout_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the folds' models, stored and read again, for the records of the evaluation roles."""
    df, train, fitted, features = _fold_models(spark, d)
    folder = shared_folder(spark, "models")
    models.save(fitted, features, folder, train)
    holdout = df.where("model_role IN ('validation', 'test')")
    return models.serve(holdout, folder, "unique_post_id").join(holdout.select("unique_post_id", "model_role"), "unique_post_id")


def hybrid_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The 67 features and the five of two predictions of each labelled post."""
    rows = models.hybrid(tabular_features(_first_posts(spark, d), "unique_post_id"), predictions(spark, d), "unique_post_id", "a", "b")
    return rows.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


def hybrid_trees(spark: SparkSession, d: str) -> DataFrame:
    """Errors out of fold of trees over the hybrid matrix: squared loss at depths 3 to 5, absolute loss at depth 4."""
    rows = models.hybrid(tabular_features(_first_posts(spark, d), "unique_post_id"), predictions(spark, d), "unique_post_id", "a", "b")
    features = models.columns_of(rows, ["unique_post_id"])
    roles = table(spark, d, "modeling_manifest_v2").where("model_role = 'train' AND oof_fold IS NOT NULL").select("unique_post_id", "final_stress", "oof_fold", "training_sample_weight").distinct()
    df = spill(roles.join(rows, "unique_post_id"))
    out = None
    for name, trees in (("squared-3", models.Trees(5, 3)), ("squared-4", models.Trees(5, 4)), ("squared-5", models.Trees(5, 5)), ("absolute-4", models.Trees(5, 4, "absolute"))):
        told = models.out_of_fold(df, models.train_folds(df, features, "final_stress", "oof_fold", 5, "training_sample_weight", trees), features, "oof_fold")
        part = told.agg(F.lit(name).alias("candidate"), F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("final_stress"))).alias("mae"))
        out = part if out is None else out.unionByName(part)
    return out


_KEEP = lambda half: f"CASE WHEN e.t <= s.tm THEN 1.0::DOUBLE ELSE exp(-ln(2.0::DOUBLE) * ((e.t - s.tm) / 6e7) / {half}) END"
_MIX = lambda name, half: f"{_KEEP(half)} * s.{name} + (1.0::DOUBLE - {_KEEP(half)}) * e.s AS {name}"
_ALERTS = f"""WITH RECURSIVE x AS (SELECT user_id AS u, event_id AS e, epoch_us(ts) AS t, least(greatest(1 + value / 25, 1), 10)::DOUBLE AS s FROM events),
o AS (SELECT *, CASE WHEN s < {CUTS[0]} THEN 0 WHEN s < {CUTS[1]} THEN 1 WHEN s < {CUTS[2]} THEN 2 ELSE 3 END AS l, row_number() OVER (PARTITION BY u ORDER BY t, e) AS n FROM x),
w AS (SELECT *, sum((l >= 2)::INT) OVER (PARTITION BY u ORDER BY n ROWS 4 PRECEDING) AS high FROM o),
f AS (SELECT u, n, e, s.t AS tm, s.s AS fast, s.s AS sustained, s.s AS baseline, l, high FROM w s WHERE n = 1
  UNION ALL SELECT e.u, e.n, e.e, e.t, {_MIX('fast', 45)}, {_MIX('sustained', 180)}, {_MIX('baseline', 1440)}, e.l, e.high FROM f s JOIN w e ON e.u = s.u AND e.n = s.n + 1),
g AS (SELECT f.*, w.s, f.l = 3 AND w.s >= 7.5 AS immediate, f.n >= 2 AND sustained >= 6.5 AS is_sustained, f.n >= 5 AND f.high >= 3 AS repeated, fast >= 6.0 AND fast - baseline >= 1.5 AS escalating FROM f JOIN w USING (u, n)),
a AS (SELECT u, n, tm, false AS cooling, immediate OR is_sustained OR repeated OR escalating AS alert, CASE WHEN immediate OR is_sustained OR repeated OR escalating THEN tm END AS alerted FROM g WHERE n = 1
  UNION ALL SELECT g.u, g.n, g.tm, coalesce(g.tm - a.alerted < 3600000000, false), (g.immediate OR g.is_sustained OR g.repeated OR g.escalating) AND (g.immediate OR NOT coalesce(g.tm - a.alerted < 3600000000, false)),
    CASE WHEN (g.immediate OR g.is_sustained OR g.repeated OR g.escalating) AND (g.immediate OR NOT coalesce(g.tm - a.alerted < 3600000000, false)) THEN g.tm ELSE a.alerted END FROM a JOIN g ON g.u = a.u AND g.n = a.n + 1)
SELECT e AS event, round(fast, 6) AS fast, round(sustained, 6) AS sustained, round(baseline, 6) AS baseline, immediate, is_sustained, repeated, escalating, cooling, alert FROM g JOIN a USING (u, n)"""
_SQUEEZED = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"

ORACLE = {
    "alerts_ewma_batch": _ALERTS,
    "alerts_streaming": _ALERTS,
    "resume_ingest": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "html_posts": f"SELECT row_ordinal, {_SQUEEZED('author')} AS author, {_SQUEEZED('content')} AS content, CAST(coalesce(likes, 0) AS BIGINT) AS likes, true AS is_starter FROM {P}",
    "page_rewrite": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://forum.example/topic/' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '?page=9' WHEN 1 THEN '?a=1' ELSE '' END
ELSE 'https://forum.example/topic/' || o_orderkey || CASE o_custkey % 3 WHEN 1 THEN '?a=1&' ELSE '?' END || 'page=' || (o_orderkey % 3 + 1) END AS url FROM orders""",
    "last_page": "SELECT o_custkey, CAST(greatest(max(o_orderkey % 97), 1) AS INTEGER) AS last_page FROM orders GROUP BY 1",
}
ORACLE["hybrid_matrix"] = f"""WITH f AS ({TEXT_ORACLE['tabular_features67']}), o AS (SELECT unique_post_id, min(row_ordinal) AS row_ordinal FROM {P} GROUP BY 1)
SELECT f.* EXCLUDE (row_ordinal), unique_post_id, round(a, 6) + 0.0 AS base_first, round(b, 6) + 0.0 AS base_second, round((a + b) / 2, 6) + 0.0 AS base_mean, round(a - b, 6) + 0.0 AS base_difference, round(abs(a - b), 6) + 0.0 AS base_distance FROM f JOIN o USING (row_ordinal) JOIN {_PRED} USING (unique_post_id)"""
QUERIES = {name: globals()[name] for name in [*ORACLE, "oof_gbt", "importance", "holdout_ensemble", "hybrid_trees"]}
