"""Queries of text, calendar and profile features, vocabularies, quantiles and samples on the forum tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelk.functions import features, jalali, lexicons
from kelk.functions.text import alternation
from kelk.operators import labels, running, vocabulary
from kelk.plans.cleaning_queries import SPACE, P, posts
from kelk.plans.core_queries import _POSTS_SQL
from kelk.session import table


def text_surface_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.text_features(F.col("content"), "post")
    return posts(spark, d).select("row_ordinal", *[f[f"post_{n}_count"].alias(f"post_{n}_count") for n in ("char", "punct", "question", "excl", "emoji")])


def emoji_polarity(spark: SparkSession, d: str) -> DataFrame:
    f = features.text_features(F.col("content"), "post")
    return posts(spark, d).select("row_ordinal", f["post_pos_emoji"].alias("pos"), f["post_neg_emoji"].alias("neg"))


def lexicon_counts(spark: SparkSession, d: str) -> DataFrame:
    f = features.text_features(F.col("content"), "post")
    return posts(spark, d).select("row_ordinal", f["post_word_count"].alias("words"), f["post_neg_count"].alias("neg"), f["post_pos_count"].alias("pos"))


def signature_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.signature_features(F.col("signature"))
    return posts(spark, d).select("row_ordinal", *[f[n].alias(n) for n in f])


def proxy_scores(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", F.round(features.initial_score(features.text_features(F.col("content"), "post")), 6).alias("score"))


def education_case(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws(" ", "education_clean", F.element_at(F.lit(["", "فوق  لیسانس", "دکتری", "فوق دیپلم", "سیکل", "دانشجو"]), (F.pmod("row_ordinal", F.lit(6)) + 1).cast("int")))
    return posts(spark, d).select("row_ordinal", features.education(raw).alias("education"))


def age_parse(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", features.age(F.col("content")).alias("age"))


def bucketize_left(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_history").groupBy(features.half_open_class(F.col("stress")).alias("label")).agg(F.count("*").alias("n"))


def bucketize_right(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotation_history").groupBy(features.half_open_class(F.col("stress"), closed="right").alias("label")).agg(F.count("*").alias("n"))


def jalali_features(spark: SparkSession, d: str) -> DataFrame:
    df = jalali.with_date(posts(spark, d).select("row_ordinal", "posted_at"), "posted_at", "at_").where("at_day_index IS NOT NULL")
    return df.select("row_ordinal", F.col("at_day_index").alias("day_index"), jalali.weekday(F.col("at_day_index")).alias("weekday"), features.daypart(F.col("at_hour")).alias("daypart"))


def tabular_features67(spark: SparkSession, d: str) -> DataFrame:
    out = features.tabular_features(posts(spark, d), "row_ordinal")
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.token_counts(posts(spark, d), "content", {"n": F.lit(True)})


def differential_vocab(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_labels")
    out = vocabulary.differential_vocabulary(c, "content", F.col("final_stress") >= 7, F.col("final_stress") <= 3, 5, 2.0)
    return out.withColumn("ratio", F.round("ratio", 6))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = running.quantiles(table(spark, d, "orders"), "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95], by=["o_orderpriority"])
    return out.select("o_orderpriority", *[F.round(f"q{i}", 4).alias(f"q{q}") for i, q in enumerate((5, 25, 50, 75, 95))])


def histogram(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    ends = running.quantiles(df, "l_extendedprice", [0.005, 0.995])
    kept = df.join(F.broadcast(ends)).where(F.col("l_extendedprice").between(F.col("q0"), F.col("q1")))  # one row
    return kept.groupBy((F.floor(F.col("l_extendedprice") / 1000.0) * 1000.0).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def group_stats(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d)
    out = df.groupBy("is_starter").agg(F.count("*").alias("n"), F.round(F.avg("likes"), 6).alias("mean_likes"), F.min("likes").alias("least"), F.max("likes").alias("most"))
    medians = running.quantiles(df, "likes", [0.5], by=["is_starter"]).select(F.col("is_starter").alias("s"), F.round("q0", 4).alias("median_likes"))
    return out.join(medians, F.col("is_starter").eqNullSafe(F.col("s")), "left").drop("s")


def nsmallest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_totalprice", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def top_n(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).orderBy(F.desc_nulls_last("likes"), "row_ordinal").limit(50).select("row_ordinal", "likes")


def band_sample_pools(spark: SparkSession, d: str) -> DataFrame:
    df = proxy_scores(spark, d)
    high = running.quantiles(df, "score", [0.95]).select(F.col("q0").alias("high"))
    banded = df.join(F.broadcast(high)).select(vocabulary.band(F.col("score"), -0.5, 0.2, F.col("high")).alias("band"))  # one row
    return banded.groupBy("band").agg(F.count("*").alias("n"))


def band_sample(spark: SparkSession, d: str) -> DataFrame:
    df = proxy_scores(spark, d)
    high = running.quantiles(df, "score", [0.95]).select(F.col("q0").alias("high"))
    banded = df.join(F.broadcast(high)).select("row_ordinal", vocabulary.band(F.col("score"), -0.5, 0.2, F.col("high")).alias("band"))  # one row
    return vocabulary.banded_sample(banded, "band", {"low": 500, "mid": 600, "high": 900}, "row_ordinal")


def refined_scores(spark: SparkSession, d: str) -> DataFrame:
    df = posts(spark, d).select("row_ordinal", "content").withColumn("_words", features.persian_words(F.col("content")))
    f = features.text_features(F.col("content"), "post", tokens=F.col("_words"))
    f |= {"post_neg_count_temp": features.count_words(F.col("_words"), lexicons.NEGATIVE_WORDS), "post_pos_count_temp": features.count_words(F.col("_words"), lexicons.POSITIVE_WORDS)}
    return df.select("row_ordinal", (F.round(features.refined_score(f), 6) + 0.0).alias("score"))


def gender_codes(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", features.gender_code(F.col("gender"), F.pmod("row_ordinal", F.lit(3))).alias("gender_code"))


def fallback_text(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", features.fallback_normal(F.col("content")).alias("text"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("content", F.lit("")), SPACE + "+"), lambda x: x != "")
    return posts(spark, d).select("row_ordinal", words.alias("w"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Words of each post, and the digest of its first 384 words, filled up to that many."""
    return _split(spark, d).select("row_ordinal", F.size("w").alias("words"), F.sha2(F.trim(F.array_join(features.padded_words(F.col("w"), 384), " ")), 256).alias("digest"))


def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths in words at or below which the given per cent of the posts lie, from counts by length."""
    return running.exact_quantiles(_split(spark, d).select(F.size("w").cast("bigint").alias("n")), "n", (50, 90, 95, 99)).withColumnRenamed("n", "words")


def id_forms(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("row_ordinal", F.regexp_replace(F.trim(F.coalesce("reply_to", F.lit(""))), r"^([+-]?\d+)\.0+$", "$1").alias("reply_to"))


def id_variants(spark: SparkSession, d: str) -> DataFrame:
    """The two normal forms of an id for which SQL has no function: compatibility forms decomposed, with and without the letters' variants."""
    return posts(spark, d).select("row_ordinal", labels.normal_id(F.col("unique_post_id")).alias("plain"), labels.normal_id(F.col("unique_post_id"), True).alias("letters"))


_CHARS = "coalesce(content, '')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda words: "(" + alternation(words) + ")"
_COUNT = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
_PUNCT = features.PUNCTUATION.replace("'", "''")
_IN = lambda text, words: f"len(list_filter(regexp_extract_all({text}, '{features.PERSIAN_WORD}'), lambda w: list_contains({_LIST(words)}, w)))"
_CLASS = lambda op: f"CASE WHEN stress IS NULL THEN NULL WHEN stress {op} 3 THEN 'Low' WHEN stress {op} 5 THEN 'Moderate' WHEN stress {op} 7 THEN 'High' ELSE 'Very High' END"
_SCORE = f"""(SELECT row_ordinal, round({_IN(_CHARS, features.NEGATIVE)} * 4.0 + {_COUNT(_CHARS, _ANY(lexicons.NEGATIVE_EMOJI))} * 2.0 + {_COUNT(_CHARS, '[!！]')} * 0.5 + CASE WHEN {_COUNT(_CHARS, '[؟?]')} > 0 THEN 1.2 ELSE 0 END
  - {_IN(_CHARS, features.POSITIVE)} * 0.2 - {_COUNT(_CHARS, _ANY(lexicons.POSITIVE_EMOJI))} * 0.5, 6)::DOUBLE AS score FROM {P})"""
_SIG = "CASE WHEN signature IS NULL OR trim(signature) = '' THEN -1 ELSE {} END AS {}"

ORACLE = {
    "text_surface_features": f"SELECT row_ordinal, length({_CHARS}) AS post_char_count, {_COUNT(_CHARS, _PUNCT)} AS post_punct_count, {_COUNT(_CHARS, '[؟?]')} AS post_question_count, {_COUNT(_CHARS, '[!！]')} AS post_excl_count, {_COUNT(_CHARS, features.EMOJI)} AS post_emoji_count FROM {P}",
    "emoji_polarity": f"SELECT row_ordinal, {_COUNT(_CHARS, _ANY(lexicons.POSITIVE_EMOJI))} AS pos, {_COUNT(_CHARS, _ANY(lexicons.NEGATIVE_EMOJI))} AS neg FROM {P}",
    "lexicon_counts": f"SELECT row_ordinal, {_COUNT(_CHARS, features.PERSIAN_WORD)} AS words, {_IN(_CHARS, features.NEGATIVE)} AS neg, {_IN(_CHARS, features.POSITIVE)} AS pos FROM {P}",
    "proxy_scores": f"SELECT row_ordinal, score FROM {_SCORE}",
    "education_case": f"SELECT row_ordinal, CASE WHEN trim(e) = '' THEN 'نامشخص' " + " ".join(f"WHEN regexp_matches(e, '{pattern}') THEN '{label}'" for pattern, label in features.EDUCATION)
    + f" ELSE 'سایر' END AS education FROM (SELECT row_ordinal, concat_ws(' ', education_clean, ['', 'فوق  لیسانس', 'دکتری', 'فوق دیپلم', 'سیکل', 'دانشجو'][row_ordinal % 6 + 1]) AS e FROM {P})",
    "age_parse": f"SELECT row_ordinal, CASE WHEN a BETWEEN 10 AND 110 THEN a ELSE -1 END AS age FROM (SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(translate(content, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[0-9]{{1,3}}'), '') AS INTEGER) AS a FROM {P})",
    "bucketize_left": f"SELECT {_CLASS('<')} AS label, count(*) AS n FROM annotation_history GROUP BY 1",
    "bucketize_right": f"SELECT {_CLASS('<=')} AS label, count(*) AS n FROM annotation_history GROUP BY 1",
    "jalali_features": _POSTS_SQL.split("posts AS (")[0].replace("SELECT translate(profile_url", "SELECT row_ordinal, translate(profile_url").replace("SELECT TRY_CAST(nullif(regexp_extract(url", "SELECT row_ordinal, TRY_CAST(nullif(regexp_extract(url").replace("SELECT user_id,\n         coalesce(", "SELECT row_ordinal, user_id,\n         coalesce(")
    + """x AS (SELECT row_ordinal, CAST(day0 + d - 1 - (SELECT first FROM years WHERE y = 1400) AS BIGINT) AS day_index, h FROM fields JOIN calendar ON calendar.y = fields.y AND calendar.m = fields.mo WHERE d BETWEEN 1 AND len AND h BETWEEN 0 AND 23 AND i BETWEEN 0 AND 59)
SELECT row_ordinal, day_index, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][(((6 + day_index) % 7) + 7) % 7 + 1] AS weekday, CASE WHEN h < 6 THEN 'overnight' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS daypart FROM x""",
    "token_freq": f"SELECT stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_CHARS}, '{features.PERSIAN_WORD}')) AS stem FROM {P}) WHERE length(stem) >= 2 GROUP BY 1",
    "differential_vocab": f"""WITH t AS (SELECT final_stress AS s, unnest(regexp_extract_all({_CHARS}, '{features.PERSIAN_WORD}')) AS stem FROM canonical_labels), c AS (SELECT stem, count(*) FILTER (s >= 7) AS h, count(*) FILTER (s <= 3) AS l FROM t WHERE length(stem) >= 2 GROUP BY 1)
SELECT stem, 'high' AS association, h AS high_freq, l AS low_freq, round(h / nullif(l, 0), 6) AS ratio FROM c WHERE h >= 5 AND (l = 0 OR h / l > 2) UNION ALL SELECT stem, 'low', h, l, round(l / nullif(h, 0), 6) FROM c WHERE l >= 5 AND (h = 0 OR l / h > 2)""",
    "quantiles": "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q / 100}), 4) AS q{q}" for q in (5, 25, 50, 75, 95)) + " FROM orders GROUP BY 1",
    "histogram": "WITH e AS (SELECT quantile_cont(l_extendedprice, 0.005) AS a, quantile_cont(l_extendedprice, 0.995) AS b FROM lineitem) SELECT CAST(floor(l_extendedprice / 1000) * 1000 AS DOUBLE) AS bin, count(*) AS n FROM lineitem, e WHERE l_extendedprice BETWEEN a AND b GROUP BY 1",
    "value_counts": f"SELECT category, count(*) AS n FROM {P} GROUP BY 1",
    "group_stats": f"SELECT is_starter, count(*) AS n, round(avg(likes), 6) AS mean_likes, min(likes) AS least, max(likes) AS most, round(quantile_cont(likes, 0.5), 4) AS median_likes FROM {P} GROUP BY 1",
    "nsmallest": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100",
    "top_n": f"SELECT row_ordinal, likes FROM {P} ORDER BY likes DESC NULLS LAST, row_ordinal LIMIT 50",
    "band_sample_pools": f"WITH h AS (SELECT quantile_cont(score, 0.95) AS q FROM {_SCORE}) SELECT CASE WHEN score >= q THEN 'high' WHEN score > 0.2 THEN 'mid' WHEN score >= -0.5 THEN 'low' END AS band, count(*) AS n FROM {_SCORE}, h GROUP BY 1",
}
# The 67 features: dates by the year table, counts by RE2.
_DATE = lambda c: f"translate(translate(regexp_replace({c}, '[­​‌‎‏⁠﻿]', '', 'g'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), 'يىك', 'ییک')"
_NUM = lambda x: f"TRY_CAST(nullif({x}, '') AS INT)"
_MONTHS = "|".join(jalali.MONTHS)
_PARTS = lambda c, p: f"regexp_extract({c}, '([0-9]{{4}})[/-]([0-9]{{1,2}})[/-]([0-9]{{1,2}})', ['y', 'm', 'd']) AS {p}n, regexp_extract({c}, '([0-9]{{1,2}})\\s*({_MONTHS})\\s*([0-9]{{4}})', ['d', 'm', 'y']) AS {p}w, regexp_extract({c}, '([0-9]{{1,2}}):([0-9]{{2}})', ['h', 'i']) AS {p}c"
_WHOLE = lambda c, p: (
    f"coalesce({_NUM(f'{p}n.y')}, {_NUM(f'{p}w.y')}) AS {p}y, coalesce({_NUM(f'{p}n.m')}, nullif(list_position({_LIST(jalali.MONTHS)}, {p}w.m), 0)) AS {p}m, coalesce({_NUM(f'{p}n.d')}, {_NUM(f'{p}w.d')}) AS {p}d, "
    f"CASE WHEN {c} LIKE '%:%' THEN {_NUM(f'{p}c.h')} ELSE 0 END AS {p}h, CASE WHEN {c} LIKE '%:%' THEN {_NUM(f'{p}c.i')} ELSE 0 END AS {p}i"
)
_VALID = lambda p: f"coalesce({p}d BETWEEN 1 AND {p}k.len AND {p}h BETWEEN 0 AND 23 AND {p}i BETWEEN 0 AND 59, false)"
_SHOW = lambda p: ", ".join(f"CASE WHEN {_VALID(p)} THEN {p}{x} END::DOUBLE AS {p}{x}" for x in "ymdhi") + f", CASE WHEN {_VALID(p)} THEN {p}k.day0 + {p}d - 1 END AS {p}x"
_TEN = lambda text, p: {
    f"{p}_char_count": f"length({text})", f"{p}_punct_count": _COUNT(text, _PUNCT), f"{p}_question_count": _COUNT(text, "[؟?]"), f"{p}_excl_count": _COUNT(text, "[!！]"), f"{p}_emoji_count": _COUNT(text, features.EMOJI),
    f"{p}_word_count": _COUNT(text, features.PERSIAN_WORD), f"{p}_neg_count": _IN(text, features.NEGATIVE), f"{p}_pos_count": _IN(text, features.POSITIVE), f"{p}_pos_emoji": _COUNT(text, _ANY(lexicons.POSITIVE_EMOJI)), f"{p}_neg_emoji": _COUNT(text, _ANY(lexicons.NEGATIVE_EMOJI)),
}
_POST10, _SIG10 = _TEN(_CHARS, "post"), _TEN("coalesce(signature, '')", "sig")
_NONE = "(signature IS NULL OR trim(signature) = '')"
_R = lambda x, name: f"round(({x})::DOUBLE, 6) + 0.0 AS {name}"
_W, _CH, _M = "greatest(post_word_count, 1)", "greatest(post_char_count, 1)", "coalesce({0}, '__MISSING__') AS {0}"
_AGE = "CASE WHEN px IS NOT NULL AND jx IS NOT NULL THEN greatest(px - jx, 0) END"
_RATE = f"CASE WHEN px IS NOT NULL AND jx IS NOT NULL THEN n_posts / greatest(({_AGE}) / 365.25::DOUBLE, 0.25) END"
_DAY = "((6 + px - e0) % 7 + 7) % 7"
_FINITE = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_COLUMNS = {
    "likes": "n_likes", "log1p_likes": "ln(1 + n_likes)", "user_post_count": "n_posts", "log1p_user_post_count": "ln(1 + n_posts)", "children_count": "n_children", "age_missing": "CASE WHEN n_age IS NULL OR n_age = -1 THEN 1 ELSE 0 END",
    "age_num": "CASE WHEN n_age BETWEEN 12 AND 80 THEN n_age END", "is_starter": "coalesce(is_starter, false)::INT", "has_reply": "(coalesce(TRY_CAST(reply_to AS DOUBLE), -1) <> -1)::INT",
    "posted_year": "py", "posted_month": "pm", "posted_day": "pd", "posted_hour": "ph", "posted_minute": "pi", "posted_weekday": _DAY, "posted_is_weekend": f"({_DAY} IN (3, 4))::INT", "posted_is_night": "(ph < 6)::INT", "posted_is_late_evening": "(ph >= 22)::INT",
    "posted_hour_sin": "sin(2 * pi() * ph / 24)", "posted_hour_cos": "cos(2 * pi() * ph / 24)", "posted_month_sin": "sin(2 * pi() * (pm - 1) / 12)", "posted_month_cos": "cos(2 * pi() * (pm - 1) / 12)", "join_year": "jy", "join_month": "jm", "join_day": "jd",
    "account_age_days": _AGE, "account_age_years": f"({_AGE}) / 365.25::DOUBLE", "posts_per_account_year": _RATE, "log1p_posts_per_account_year": f"ln(1 + ({_RATE}))", "likes_per_100_posts": "n_likes / (1 + n_posts / 100)", "has_signature": f"(NOT {_NONE})::INT",
    **{n: f"CASE WHEN {_NONE} THEN 0 ELSE {n} END" for n in _SIG10}, **{n: n for n in _POST10}, "post_neg_count_temp": "post_neg_count_temp", "post_pos_count_temp": "post_pos_count_temp",
    "post_neg_word_ratio": f"post_neg_count / {_W}", "post_pos_word_ratio": f"post_pos_count / {_W}", "post_question_per_100_words": f"100 * post_question_count / {_W}", "post_excl_per_100_words": f"100 * post_excl_count / {_W}", "post_emoji_per_100_words": f"100 * post_emoji_count / {_W}",
    "post_punct_per_100_chars": f"100 * post_punct_count / {_CH}", "post_temp_neg_ratio": f"post_neg_count_temp / {_W}", "post_temp_pos_ratio": f"post_pos_count_temp / {_W}",
}
ORACLE["signature_features"] = f"SELECT row_ordinal, {', '.join(f'CASE WHEN {_NONE} THEN -1 ELSE {x} END AS {n}' for n, x in _SIG10.items())} FROM {P}"
ORACLE["refined_scores"] = f"""SELECT row_ordinal, round(a * 4.0 + c * 0.5 + e * 2.0 + least(x, 6) * 1.5 + least(q, 5) * 0.5 - b * 0.3 - d * 0.08 - g * 0.5, 6)::DOUBLE + 0.0 AS score FROM (SELECT row_ordinal, {_IN(_CHARS, lexicons.NEGATIVE_WORDS)} AS a, {_IN(_CHARS, lexicons.POSITIVE_WORDS)} AS b,
  {_POST10['post_neg_count']} AS c, {_POST10['post_pos_count']} AS d, {_POST10['post_neg_emoji']} AS e, {_POST10['post_pos_emoji']} AS g, {_POST10['post_excl_count']} AS x, {_POST10['post_question_count']} AS q FROM {P})"""
ORACLE["gender_codes"] = f"SELECT row_ordinal, CASE WHEN gender LIKE '%مرد%' THEN 0 WHEN gender LIKE '%زن%' THEN 1 WHEN row_ordinal % 3 IN (0, 1) THEN CAST(row_ordinal % 3 AS INT) ELSE -1 END AS gender_code FROM {P}"
ORACLE["fallback_text"] = f"SELECT row_ordinal, trim(regexp_replace(translate(coalesce(content, ''), 'يكةۀ\u200f\u200e', 'یکهه'), '{SPACE}+', ' ', 'g')) AS text FROM {P}"
ORACLE["token_windows"] = f"""WITH w AS (SELECT row_ordinal, list_filter(regexp_split_to_array(coalesce(content, ''), '{SPACE}+'), lambda x: x <> '') AS w FROM {P})
SELECT row_ordinal, CAST(len(w) AS INT) AS words, sha256(array_to_string(w[1:384], ' ') || repeat(' <pad>', greatest(384 - len(w), 0)::INT)) AS digest FROM w"""
ORACLE["token_lengths"] = f"""WITH w AS (SELECT len(list_filter(regexp_split_to_array(coalesce(content, ''), '{SPACE}+'), lambda x: x <> '')) AS n FROM {P}) SELECT unnest([50, 90, 95, 99]) AS percent, unnest([quantile_disc(n, 0.5), quantile_disc(n, 0.9), quantile_disc(n, 0.95), quantile_disc(n, 0.99)]) AS words FROM w"""
ORACLE["id_forms"] = f"SELECT row_ordinal, regexp_replace(trim(coalesce(reply_to, '')), '^([+-]?[0-9]+)\\.0+$', '\\1') AS reply_to FROM {P}"
ORACLE["tabular_features67"] = (
    "WITH RECURSIVE " + _POSTS_SQL[_POSTS_SQL.index("years AS (") : _POSTS_SQL.index("posts AS (")]
    + f"""a AS (SELECT *, {_DATE('posted_at')} AS ps, {_DATE('join_date')} AS js FROM {P}), b AS (SELECT *, {_PARTS('ps', 'p')}, {_PARTS('js', 'j')} FROM a), c AS (SELECT *, {_WHOLE('ps', 'p')}, {_WHOLE('js', 'j')} FROM b),
d AS (SELECT c.* EXCLUDE (py, pm, pd, ph, pi, jy, jm, jd, jh, ji, sig_char_count, sig_word_count), {_SHOW('p')}, {_SHOW('j')}, (SELECT first FROM years WHERE y = 1400) AS e0, greatest(likes, CASE WHEN likes IS NULL THEN NULL ELSE 0 END)::DOUBLE AS n_likes, greatest(user_post_count, CASE WHEN user_post_count IS NULL THEN NULL ELSE 0 END)::DOUBLE AS n_posts,
  {_FINITE('children_count')} AS n_children, {_FINITE('age_num')} AS n_age, {', '.join(f'{x} AS {n}' for n, x in (_POST10 | _SIG10).items())}, {_IN(_CHARS, lexicons.NEGATIVE_WORDS)} AS post_neg_count_temp, {_IN(_CHARS, lexicons.POSITIVE_WORDS)} AS post_pos_count_temp
  FROM c LEFT JOIN calendar pk ON pk.y = c.py AND pk.m = c.pm LEFT JOIN calendar jk ON jk.y = c.jy AND jk.m = c.jm)
SELECT row_ordinal, {', '.join(_R(x, n) for n, x in _COLUMNS.items())}, {', '.join(_M.format(c) for c in ('gender', 'category', 'sub_category', 'education_clean'))},
 coalesce({_LIST(jalali.WEEKDAYS)}[{_DAY} + 1], '__MISSING__') AS posted_weekday_name, CASE WHEN ph IS NULL THEN '__MISSING__' WHEN ph < 6 THEN 'overnight' WHEN ph < 12 THEN 'morning' WHEN ph < 18 THEN 'afternoon' ELSE 'evening' END AS posted_daypart FROM d"""
)
QUERIES = {name: globals()[name] for name in [*ORACLE, "band_sample", "id_variants"]}
