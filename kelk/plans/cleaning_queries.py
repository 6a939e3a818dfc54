"""Queries of cleaning, identity, joins and set operations on the forum and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelk.functions.text import drop_decimal_zero, is_blank
from kelk.operators import cleaning, running
from kelk.session import table

SPACE = cleaning.SPACE
NOT_SPACE = SPACE.replace("[", "[^")
P = "ninisite_cleaned_enriched"


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, P)


def clean_filters(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_filters(posts(spark, d)).select("row_ordinal", "unique_post_id")


def clean_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d)
    content = ~is_blank(F.col("content"))
    enough = content & (cleaning.raw_words(F.col("content")) >= 3)
    n = lambda c: F.count_if(c).alias
    return df.agg(F.count("*").alias("raw_rows"), n(content)("with_content"), n(enough)("with_words"), n(enough & F.col("thread_title").isNotNull())("clean_rows"), n(is_blank(F.col("author")))("without_author"))


def profile_fill_join(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).select("row_ordinal", "thread_id", "category", "sub_category")
    return cleaning.fill_from(df, posts(spark, d).where(~is_blank(F.col("category"))).select("thread_id", "row_ordinal", "category", "sub_category"), "thread_id", ["category", "sub_category"], "row_ordinal").select("row_ordinal", "category", "sub_category")


def category_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d)
    key = F.concat_ws("_", F.coalesce("thread_id", F.lit("nan")), F.coalesce("section_name", F.lit("nan")))
    cache = df.where(~is_blank(F.col("category"))).groupBy(key.alias("match_key")).agg(F.max("category").alias("category"))
    return cleaning.with_provenance(df.select("row_ordinal", "thread_id", "section_name", "category"), cache, key, ["category"], "category_source").select("row_ordinal", "category", "category_source")


def flag_override(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d)
    men = df.where(F.col("gender") == "مرد").select("profile_url").distinct().withColumn("listed", F.lit(True))
    joined = df.select("row_ordinal", "profile_url", "gender").join(men, "profile_url", "left")
    code = F.when(F.col("listed"), 0).when(F.col("gender") == "زن", 1).otherwise(-1)
    source = F.when(F.col("listed"), "list").when(F.col("gender") == "زن", "explicit").otherwise("unresolved")
    return joined.select("row_ordinal", code.cast("int").alias("gender_code"), source.alias("gender_source"))


def pending_work_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def aligned_threeway_join(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda df: df.withColumn("unique_post_id", drop_decimal_zero(F.col("unique_post_id")))
    m = clean(table(spark, d, "modeling_manifest_v2").select("unique_post_id", "model_role", "clinical_class").distinct())
    c = clean(table(spark, d, "canonical_labels").select("unique_post_id", F.col("final_stress").alias("label")))
    h = clean(table(spark, d, "annotation_history").where("observed")).groupBy("unique_post_id").agg(F.avg("stress").alias("mean_stress"))
    return m.join(c, "unique_post_id").join(h, "unique_post_id").select("unique_post_id", "model_role", "label", F.round("mean_stress", 6).alias("mean_stress"))


def id_set_diff(spark: SparkSession, d: str) -> DataFrame:
    a = posts(spark, d).select("unique_post_id").distinct()
    b = table(spark, d, "canonical_labels").select("unique_post_id").distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.exceptAll(b), "only_posts").unionByName(count(b.exceptAll(a), "only_labels")).unionByName(count(a.intersect(b), "both"))


def row_dedup(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "annotation_history")
    return df.dropDuplicates().groupBy("annotator").agg(F.count("*").alias("n"))


def fallback_dedup(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).where(is_blank(F.col("post_id")))
    return cleaning.first_rows(df, ["thread_id", "author", "posted_at", "content"], "row_ordinal").select("row_ordinal")


def conflict_dedup(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).select("row_ordinal", "post_id", "thread_id", "author", "posted_at", "content")
    return cleaning.conflict_aware_dedup(df, "post_id", "content", "row_ordinal", ["thread_id", "author", "posted_at", "content"]).select("row_ordinal", "dedup_class")


def canonical_post_id(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit(" "), F.format_number("l_orderkey", 1), F.lit(" "))
    return table(spark, d, "lineitem").select("l_orderkey", drop_decimal_zero(F.regexp_replace(value, ",", "")).alias("canonical")).distinct()


def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d)
    return cleaning.stable_ids(df, "post_id", "thread_id", "author", "posted_at", "is_starter", "content", ["row_ordinal"]).select("row_ordinal", "stable_id")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).select("profile_url", "row_ordinal", "user_post_count").where("profile_url IS NOT NULL")
    old = cleaning.first_rows(df.where("row_ordinal % 2 = 0"), ["profile_url"], "row_ordinal", last=True)
    new = cleaning.first_rows(df.where("row_ordinal % 2 = 1"), ["profile_url"], "row_ordinal", last=True)
    return cleaning.upsert(old, new, "profile_url")


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


def semi_join_candidates(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "canonical_labels").select("unique_post_id")
    found = posts(spark, d).join(labelled, "unique_post_id", "left_semi")
    return found.groupBy("unique_post_id").agg(F.count("*").alias("candidates"), F.min("row_ordinal").alias("first_row"), F.countDistinct(F.struct("content")).alias("contents"))


def topk_per_row(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def last_n_history(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = running.history(df, "user_id", "at", ["event_id"], ["event_type"], 5)
    return out.select("event_id", F.array_join(F.transform("recent", lambda x: x["event_type"]), ",").alias("last_five"), F.col("so_far").cast("int").alias("so_far"))


def elapsed_lag(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = (F.col("at") - F.col("recent")[0]["at"]) / F.lit(6e7)
    return running.history(df, "user_id", "at", ["event_id"], ["at"], 2).select("event_id", F.round(F.when(F.size("recent") > 1, F.greatest(gap, F.lit(0.0))), 3).alias("minutes"))


_BLANK = f"(content IS NULL OR NOT regexp_matches(content, '{NOT_SPACE}'))"
_WORDS = f"len(regexp_extract_all(coalesce(content, ''), '{NOT_SPACE}+'))"
_NO = lambda c: f"({c} IS NULL OR NOT regexp_matches({c}, '{NOT_SPACE}'))"
_OK = f"NOT {_BLANK} AND {_WORDS} >= 3"
_MISSING = "(post_id IS NULL OR trim(post_id) IN ('', 'nan', 'None'))"

ORACLE = {
    "clean_filters": f"SELECT row_ordinal, unique_post_id FROM {P} WHERE {_OK} AND thread_title IS NOT NULL",
    "clean_audit_counts": f"SELECT count(*) AS raw_rows, count(*) FILTER (NOT {_BLANK}) AS with_content, count(*) FILTER ({_OK}) AS with_words, count(*) FILTER ({_OK} AND thread_title IS NOT NULL) AS clean_rows, count(*) FILTER ({_NO('author')}) AS without_author FROM {P}",
    "profile_fill_join": f"""WITH l AS (SELECT thread_id, arg_max(category, row_ordinal) AS c, arg_max(coalesce(sub_category, chr(0)), row_ordinal) AS s FROM {P} WHERE NOT {_NO('category')} GROUP BY 1)
SELECT row_ordinal, CASE WHEN {_NO('category')} THEN l.c ELSE category END AS category, CASE WHEN {_NO('sub_category')} THEN nullif(l.s, chr(0)) ELSE sub_category END AS sub_category FROM {P} p LEFT JOIN l ON l.thread_id = p.thread_id""",
    "category_cache_fill": f"""WITH k AS (SELECT *, concat_ws('_', coalesce(thread_id, 'nan'), coalesce(section_name, 'nan')) AS m FROM {P}), l AS (SELECT m, max(category) AS c FROM k WHERE NOT {_NO('category')} GROUP BY 1)
SELECT row_ordinal, CASE WHEN {_NO('category')} THEN c ELSE category END AS category, CASE WHEN NOT {_NO('category')} THEN 'original' WHEN c IS NOT NULL THEN 'cache' ELSE 'missing' END AS category_source FROM k LEFT JOIN l USING (m)""",
    "flag_override": f"""WITH m AS (SELECT DISTINCT profile_url AS u FROM {P} WHERE gender = 'مرد')
SELECT row_ordinal, CASE WHEN u IS NOT NULL THEN 0 WHEN gender = 'زن' THEN 1 ELSE -1 END AS gender_code, CASE WHEN u IS NOT NULL THEN 'list' WHEN gender = 'زن' THEN 'explicit' ELSE 'unresolved' END AS gender_source FROM {P} LEFT JOIN m ON u = profile_url""",
    "pending_work_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "aligned_threeway_join": """SELECT unique_post_id, model_role, final_stress AS label, round(m, 6) AS mean_stress FROM (SELECT DISTINCT unique_post_id, model_role, clinical_class FROM modeling_manifest_v2) JOIN canonical_labels USING (unique_post_id)
JOIN (SELECT unique_post_id, avg(stress) AS m FROM annotation_history WHERE observed GROUP BY 1) USING (unique_post_id)""",
    "id_set_diff": f"""WITH a AS (SELECT DISTINCT unique_post_id AS i FROM {P}), b AS (SELECT DISTINCT unique_post_id AS i FROM canonical_labels)
SELECT 'only_posts' AS part, count(*) AS n FROM (SELECT i FROM a EXCEPT SELECT i FROM b) UNION ALL SELECT 'only_labels', count(*) FROM (SELECT i FROM b EXCEPT SELECT i FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT i FROM a INTERSECT SELECT i FROM b)""",
    "row_dedup": "SELECT annotator, count(*) AS n FROM (SELECT DISTINCT * FROM annotation_history) GROUP BY 1",
    "fallback_dedup": f"SELECT min(row_ordinal) AS row_ordinal FROM {P} WHERE {_NO('post_id')} GROUP BY thread_id, author, posted_at, content",
    "conflict_dedup": f"""WITH w AS (SELECT min(row_ordinal) AS o, post_id, thread_id, author, posted_at, content FROM {P} GROUP BY ALL), k AS (SELECT post_id AS k, count(DISTINCT coalesce('x' || content, '')) AS n FROM w WHERE NOT {_MISSING} GROUP BY 1)
SELECT min(o) AS row_ordinal, 0 AS dedup_class FROM w WHERE {_MISSING} GROUP BY thread_id, author, posted_at, content
UNION ALL SELECT o, 2 FROM w JOIN k ON k = post_id WHERE n > 1 UNION ALL SELECT min(o), 1 FROM w JOIN k ON k = post_id WHERE n = 1 GROUP BY post_id""",
    "canonical_post_id": "SELECT DISTINCT l_orderkey, CAST(l_orderkey AS VARCHAR) AS canonical FROM lineitem",
    "unique_ids": f"""WITH b AS (SELECT row_ordinal, content, CASE WHEN NOT {_MISSING} THEN regexp_replace(trim(post_id), '^([+-]?[0-9]+)\\.0+$', '\\1') WHEN coalesce(is_starter, false) THEN 'thread_' || coalesce(thread_id, 'nan') || '_starter'
  ELSE 'thread_' || coalesce(thread_id, 'nan') || '_' || coalesce(author, 'nan') || '_' || coalesce(posted_at, 'nan') END AS base FROM {P}), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY row_ordinal) AS n FROM b)
SELECT row_ordinal, CASE WHEN n = 1 THEN base ELSE base || '__' || substr(sha1(base || '|' || n || '|' || coalesce(content, 'nan')), 1, 10) END AS stable_id FROM n""",
    "upsert_latest": f"""WITH x AS (SELECT profile_url, row_ordinal % 2 AS odd, max(row_ordinal) AS row_ordinal FROM {P} WHERE profile_url IS NOT NULL GROUP BY 1, 2), y AS (SELECT profile_url, arg_max(row_ordinal, odd) AS row_ordinal FROM x GROUP BY 1)
SELECT y.profile_url, y.row_ordinal, p.user_post_count FROM y JOIN {P} p USING (row_ordinal)""",
    "union_by_name": "SELECT segment, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT NULL, s_acctbal FROM supplier) GROUP BY 1",
    "semi_join_candidates": f"SELECT unique_post_id, count(*) AS candidates, min(row_ordinal) AS first_row, count(DISTINCT coalesce('x' || content, '')) AS contents FROM {P} WHERE unique_post_id IN (SELECT unique_post_id FROM canonical_labels) GROUP BY 1",
    "topk_per_row": "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "last_n_history": "SELECT event_id, string_agg(event_type, ',') OVER w AS last_five, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)",
    "elapsed_lag": "SELECT event_id, round(greatest((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 6e7, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN NULL ELSE 0.0 END), 3) AS minutes FROM events",
}
QUERIES = {name: globals()[name] for name in ORACLE}
