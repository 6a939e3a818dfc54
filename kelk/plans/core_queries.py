"""Queries of the general problems on the forum tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelk.functions import jalali
from kelk.functions.text import ascii_digits
from kelk.operators.sessions import sessionize
from kelk.session import table

VISIT_GAP_MINUTES = 30


def visits(posts: DataFrame, gap: int = VISIT_GAP_MINUTES) -> DataFrame:
    """user_id, session_start, session_end, duration (minutes) and n_events of each visit of each user.

    The user is the number after /user/ in profile_url, in any spelling of the address. Rows without it, or whose posted_at
    does not state an existing Jalali date and a time of day, are left out.
    """
    user = F.regexp_extract(ascii_digits(F.col("profile_url")), r"(?i)/user/([0-9]+)", 1).try_cast("bigint")
    moments = jalali.with_date(posts.select(user.alias("user_id"), "posted_at"), "posted_at", "at_")
    # Forty days of one user are one sorting task's share at most.
    return sessionize(moments.select("user_id", jalali.minutes("at_").alias("minute")), "user_id", "minute", gap, slice_width=57600)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with Jalali times, as TESTDATA.md defines them."""
    out = visits(table(spark, sf_dir, "ninisite_cleaned_enriched"))
    return jalali.with_text(out, {"session_start": "session_start", "session_end": "session_end"}).select("user_id", "session_start", "session_end")


def p3_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with duration in minutes and number of posts."""
    out = visits(table(spark, sf_dir, "ninisite_cleaned_enriched"))
    out = jalali.with_text(out, {"session_start": "session_start", "session_end": "session_end"})
    return out.select("user_id", "session_start", "session_end", F.col("duration").alias("duration_minutes"), F.col("n_events").alias("n_posts"))


#: Minutes since 1400/01/01 of every usable post; DuckDB's own route: one regular expression per spelling, days counted by a year table.
_POSTS_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT translate(profile_url, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789') AS url,
         translate(translate(regexp_replace(posted_at, '[­​‌‎‏⁠﻿]', '', 'g'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), 'يىك', 'ییک') AS stamp
  FROM ninisite_cleaned_enriched),
names AS (SELECT unnest(['فروردین','اردیبهشت','خرداد','تیر','مرداد','شهریور','مهر','آبان','آذر','دی','بهمن','اسفند']) AS name, unnest(range(1, 13)) AS m),
cut AS (
  SELECT TRY_CAST(nullif(regexp_extract(url, '(?i)/user/([0-9]+)', 1), '') AS BIGINT) AS user_id,
         regexp_extract(stamp, '([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})', ['y','m','d']) AS n,
         regexp_extract(stamp, '([0-9]{1,2})\s*(فروردین|اردیبهشت|خرداد|تیر|مرداد|شهریور|مهر|آبان|آذر|دی|بهمن|اسفند)\s*([0-9]{4})', ['d','m','y']) AS w,
         regexp_extract(stamp, '([0-9]{1,2}):([0-9]{2})', ['h','i']) AS c
  FROM raw),
fields AS (
  SELECT user_id,
         coalesce(TRY_CAST(nullif(n.y, '') AS INT), TRY_CAST(nullif(w.y, '') AS INT)) AS y,
         coalesce(TRY_CAST(nullif(n.m, '') AS INT), names.m) AS mo,
         coalesce(TRY_CAST(nullif(n.d, '') AS INT), TRY_CAST(nullif(w.d, '') AS INT)) AS d,
         TRY_CAST(nullif(c.h, '') AS INT) AS h, TRY_CAST(nullif(c.i, '') AS INT) AS i
  FROM cut LEFT JOIN names ON names.name = w.m),
years AS (SELECT 1200 AS y, 0 AS first UNION ALL
  SELECT y + 1, first + 365 + CASE WHEN y % 33 IN (1,5,9,13,17,22,26,30) THEN 1 ELSE 0 END FROM years WHERE y < 1600),
calendar AS (
  SELECT years.y, mo.m, years.first + CASE WHEN mo.m <= 7 THEN (mo.m - 1) * 31 ELSE 186 + (mo.m - 7) * 30 END AS day0,
         CASE WHEN mo.m <= 6 THEN 31 WHEN mo.m <= 11 THEN 30 WHEN years.y % 33 IN (1,5,9,13,17,22,26,30) THEN 30 ELSE 29 END AS len
  FROM years CROSS JOIN (SELECT unnest(range(1, 13)) AS m) mo),
posts AS (
  SELECT user_id, (day0 + d - 1) * 1440 + h * 60 + i AS t
  FROM fields JOIN calendar ON calendar.y = fields.y AND calendar.m = fields.mo
  WHERE user_id IS NOT NULL AND d BETWEEN 1 AND len AND h BETWEEN 0 AND 23 AND i BETWEEN 0 AND 59),
marked AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 30 THEN 0 ELSE 1 END AS starts FROM posts),
numbered AS (SELECT user_id, t, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM marked),
visits AS (SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM numbered GROUP BY user_id, s),
shown AS (SELECT t, printf('%04d/%02d/%02d %02d:%02d', y, m, day - day0 + 1, (t % 1440) // 60, t % 60) AS text
  FROM (SELECT DISTINCT t, t // 1440 AS day FROM posts) x JOIN calendar ON day >= day0 AND day < day0 + len)
"""

ORACLE = {
    "p3_found": _POSTS_SQL + "SELECT user_id, x.text AS session_start, z.text AS session_end FROM visits JOIN shown x ON x.t = a JOIN shown z ON z.t = b",
    "p3_visits": _POSTS_SQL + "SELECT user_id, x.text AS session_start, z.text AS session_end, CAST(b - a AS BIGINT) AS duration_minutes, CAST(n AS BIGINT) AS n_posts FROM visits JOIN shown x ON x.t = a JOIN shown z ON z.t = b",
}
QUERIES = {"p3_found": p3_found, "p3_visits": p3_visits}
