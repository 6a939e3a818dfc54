"""Queries of page parsing, page addresses, demo rows and stored dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kelk.plans.cleaning_queries import SPACE, P, posts
from kelk.session import shared_folder, table
from kelk.sources import html, readers

_TOKENS = ("is-woman", "is-user", "iconuser-01", "iconwoman iconman", "plain")


def _safe(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "&", "&amp;"), "<", "&lt;")


def profile_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each post's author written as a profile page, with one of five marks of gender, and read again."""
    kind = F.pmod("row_ordinal", F.lit(5))
    token = F.element_at(F.lit(list(_TOKENS)), (kind + 1).cast("int"))
    word = F.when(kind == 0, "زن").when(kind == 1, "مرد").otherwise("?")
    page = F.concat(
        F.lit('<html><div class="profile__name"><h4>'), _safe("author"), F.lit('</h4></div><i class="'), token, F.lit('"></i><span>'), word, F.lit('</span><p><i class="iconeducation"></i><span>'), _safe("education_clean"),
        F.lit('</span></p><div><i class="iconcalender"></i><span>تاریخ عضویت</span><span>'), _safe("join_date"), F.lit("</span></div></html>"),
    )
    out = html.profiles_of_pages(posts(spark, d).select(F.col("row_ordinal").cast("string").alias("url"), page.alias("html")), "html", "url")
    return out.select(F.col("url").cast("bigint").alias("row_ordinal"), "username", "gender_code", "gender_source", "education", "join_date")


def listing_threads(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as threads of their nation's listing, with their orders as replies; those with ten replies and more."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    threads = table(spark, d, "customer").join(orders, "c_custkey", "left").select("c_nationkey", F.format_string('<div><a href="/discussion/topic/%d/x"><span class="topic_subject">thread %d</span></a><span class="topic_number">%d</span></div>', "c_custkey", "c_custkey", F.coalesce("n", F.lit(0))).alias("part"))
    pages = threads.groupBy(F.concat(F.lit("https://forum.example/"), "c_nationkey").alias("url")).agg(F.array_join(F.collect_list("part"), "\n").alias("html"))
    return html.threads_of_pages(pages, "html", "url", 10).select("thread_id", "title", "replies")


def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages to read of each nation as a section; some are comments or placeholders."""
    name = F.when(F.col("n_nationkey") % 7 == 0, "# off").when(F.col("n_nationkey") % 11 == 0, "https://forum.example/REPLACE_ME").otherwise(F.concat(F.lit("https://forum.example/"), "n_nationkey"))
    sections = table(spark, d, "nation").select(name.alias("url"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("requested"), (F.col("n_regionkey") + 3).alias("discovered"))
    return html.listing_pages(sections, "url", "requested", "discovered", 6)


def demo_posts(spark: SparkSession, d: str) -> DataFrame:
    return readers.demo_posts(spark).select("thread_id", "post_id", "author", "likes", "reply_to", "is_starter", "posted_at")


def url_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Posts of men's profiles, which are a stored dimension: written once as a table of distinct addresses, checked, and joined."""
    folder = shared_folder(spark, "men")
    readers.write_dimension(posts(spark, d).where("gender = 'مرد'"), "profile_url", f"{folder}/urls")
    men = readers.read_dimension(spark, f"{folder}/urls", "profile_url")
    return posts(spark, d).join(men, "profile_url", "left_semi").groupBy("section_name").agg(F.count("*").alias("n"))


def profile_pending(spark: SparkSession, d: str) -> DataFrame:
    """Profiles to be read: all of the posts but those whose latest row has a gender; what was not resolved stays due."""
    df = posts(spark, d).where("profile_url IS NOT NULL")
    latest = df.groupBy("profile_url").agg(F.max_by("gender", "row_ordinal").alias("gender"))
    return df.select("profile_url").distinct().join(latest.where("gender IN ('زن', 'مرد')"), "profile_url", "left_anti")


_SHOWN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"
ORACLE = {
    "profile_attributes": f"""SELECT row_ordinal, {_SHOWN('author')} AS username, CASE row_ordinal % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE -1 END AS gender_code,
 ['explicit_text_female', 'explicit_text_male', 'class_marker:iconuser-01', 'unresolved', 'unresolved'][row_ordinal % 5 + 1] AS gender_source, {_SHOWN('education_clean')} AS education, {_SHOWN('join_date')} AS join_date FROM {P}""",
    "listing_threads": "SELECT CAST(o_custkey AS VARCHAR) AS thread_id, 'thread ' || o_custkey AS title, count(*) AS replies FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) >= 10",
    "listing_pages": "SELECT 'https://forum.example/' || n_nationkey || CASE WHEN p > 1 THEN '?page=' || p ELSE '' END AS page_url, CAST(p AS INTEGER) AS page FROM nation, (SELECT unnest(range(1, 7)) AS p) WHERE n_nationkey % 7 <> 0 AND n_nationkey % 11 <> 0 AND p <= least(n_regionkey + 3, 6, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 6 END)",
    "demo_posts": """WITH k AS (SELECT unnest(range(4)) AS k, unnest(['1', '1', '2', '2']) AS t, unnest(['سارا', 'مینا', 'نگار', 'الهه']) AS author, unnest([4, 9, 1, 2]) AS likes, unnest([NULL, '0', NULL, '2']) AS a, unnest([true, false, true, false]) AS is_starter), i AS (SELECT unnest(range(60)) AS i)
SELECT t || '_' || i AS thread_id, CASE WHEN NOT is_starter THEN k || '_' || i END AS post_id, author, likes, a || '_' || i AS reply_to, is_starter, printf('1404/01/%02d %02d:00', i % 28 + 1, (i + k) % 24) AS posted_at FROM k, i""",
    "url_dimension": f"SELECT section_name, count(*) AS n FROM {P} WHERE profile_url IN (SELECT profile_url FROM {P} WHERE gender = 'مرد' AND trim(profile_url) <> '') GROUP BY 1",
    "profile_pending": f"SELECT profile_url FROM {P} WHERE profile_url IS NOT NULL GROUP BY 1 HAVING coalesce(first(gender ORDER BY row_ordinal DESC), '') NOT IN ('زن', 'مرد')",
}
QUERIES = {name: globals()[name] for name in ORACLE}
