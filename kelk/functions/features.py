"""Numeric features of posts, signatures, profiles and times, as projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.functions import jalali
from kelk.functions.lexicons import NEGATIVE_EMOJI, NEGATIVE_WORDS, POSITIVE_EMOJI, POSITIVE_WORDS
from kelk.functions.text import alternation, count_any, is_blank
from kelk.session import spread

# Character classes of punctuation and emoji, and the pattern of a Persian word.
PUNCTUATION = r"[،؛؟!\.,\"'\(\)\[\]\{\}<>«»]"
EMOJI = "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f1e0-\U0001f1ff\U00002702-\U000027b0\U000024c2-\U0001f251]+"
PERSIAN_WORD = "[؀-ۿ‌]+"
#: Default word lists; every function takes its own instead. The wider ones add words that a vocabulary of the forum yields.
NEGATIVE = (*NEGATIVE_WORDS, "مضطرب", "خسته", "کلافه", "ناامید", "تنها", "دلتنگ", "پریشون", "دلشکسته")
POSITIVE = (*POSITIVE_WORDS, "امیدوار", "راضی", "آروم", "مطمئن")
SIGNATURE = ("char", "punct", "question", "excl", "emoji", "word", "neg", "pos", "pos_emoji", "neg_emoji")


def count(col: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(pattern)), F.lit(0)).cast("bigint")


def persian_words(col: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(col, F.lit(PERSIAN_WORD), F.lit(0)), F.array().cast("array<string>"))


def stemmed(tokens: Column, stem: Callable[[str], str] | None = None) -> Column:
    """The stems of an array of words by any function of a word, as a dictionary or a stemmer gives it; without one each word is its own."""
    if stem is None:
        return tokens

    @arrow_udf(T.ArrayType(T.StringType()))
    def stems(words: pa.Array) -> pa.Array:
        known: dict[str, str] = {}
        return pa.array([None if row is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in row] for row in words.to_pylist()], pa.list_(pa.string()))

    return stems(tokens)


def count_words(tokens: Column, words: Sequence[str]) -> Column:
    """Words of an array that are in the list."""
    return F.size(F.filter(tokens, lambda t: t.isin(*sorted(set(words))))).cast("bigint")


def text_features(col: Column, prefix: str, negative: Sequence[str] = NEGATIVE, positive: Sequence[str] = POSITIVE, tokens: Column | None = None) -> dict[str, Column]:
    """The ten counts of a text, 0 each for null. tokens: its words, if they have been taken already."""
    text = F.coalesce(col, F.lit(""))
    tokens = persian_words(text) if tokens is None else tokens
    values = (
        F.length(text).cast("bigint"), count(text, PUNCTUATION), count(text, "[؟?]"), count(text, "[!！]"), count(text, EMOJI), F.size(tokens).cast("bigint"),
        count_words(tokens, negative), count_words(tokens, positive), count_any(text, POSITIVE_EMOJI), count_any(text, NEGATIVE_EMOJI),
    )
    names = [f"{prefix}_{n}" if n.endswith("emoji") and n != "emoji" else f"{prefix}_{n}_count" for n in SIGNATURE]
    return dict(zip(names, values))


def signature_features(col: Column, tokens: Column | None = None, blank: Column | None = None) -> dict[str, Column]:
    """The ten counts of a signature, -1 each where there is none. tokens and blank: what has been worked out already."""
    blank = is_blank(col) if blank is None else blank
    return {name: F.when(blank, F.lit(-1).cast("bigint")).otherwise(value) for name, value in text_features(col, "sig", tokens=tokens).items()}


# The weights of both scores.
def initial_score(f: dict[str, Column]) -> Column:
    asks = F.when(f["post_question_count"] > 0, 1.2).otherwise(0.0)
    return f["post_neg_count"] * 4.0 + f["post_neg_emoji"] * 2.0 + f["post_excl_count"] * 0.5 + asks - f["post_pos_count"] * 0.2 - f["post_pos_emoji"] * 0.5


def refined_score(f: dict[str, Column]) -> Column:
    """The score with the counts of both kinds of word lists; many exclamation and question marks count as six and five."""
    capped = lambda c, most: F.least(c, F.lit(most))
    return (
        f["post_neg_count_temp"] * 4.0 + f["post_neg_count"] * 0.5 + f["post_neg_emoji"] * 2.0 + capped(f["post_excl_count"], 6) * 1.5 + capped(f["post_question_count"], 5) * 0.5
        - f["post_pos_count_temp"] * 0.3 - f["post_pos_count"] * 0.08 - f["post_pos_emoji"] * 0.5
    )


def gender_code(gender: Column, code: Column, missing: str = "unknown") -> Column:
    """1 for a woman, 0 for a man: by the word, else by a code that is one of these, else by the policy ('female', 'male', or -1)."""
    told = F.when(gender.contains("مرد"), 0).when(gender.contains("زن"), 1).when(code.isin(0, 1), code.cast("int"))
    return F.coalesce(told, F.lit({"female": 1, "male": 0}.get(missing, -1)))


def fallback_normal(col: Column) -> Column:
    """Yeh and kaf as Persian, teh marbuta and its like as heh, no direction marks, one blank between words; null as ''."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(col, F.lit("")), "يكةۀ\u200f\u200e", "یکهه"), r"(?U)\s+", " "))


def padded_words(tokens: Column, length: int, filler: str = "<pad>") -> Column:
    """The first words of an array, filled up to a length."""
    kept = F.slice(tokens, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(filler), F.lit(length) - F.size(kept)))


#: Ordered patterns of an education and its label; the first that matches counts.
EDUCATION = (
    (r"فوق\s*لیسانس|کارشناسی\s*ارشد|ارشد", "فوق لیسانس"),
    (r"دکتر[ایيى]|دکترا", "دکترا"),
    (r"فوق\s*دیپلم", "فوق دیپلم"),
    (r"کاردانی", "کاردانی"),
    (r"کارشناس|کارشناسی|لیسانس", "کارشناسی"),
    (r"دیپلم", "دیپلم"),
    (r"سیکل", "سیکل"),
    (r"دانشجو", "دانشجو"),
    (r"نامشخص|درج نشده", "نامشخص"),
)


def education(col: Column) -> Column:
    out = F.when(is_blank(col), "نامشخص")
    for pattern, label in EDUCATION:
        out = out.when(col.rlike(pattern), label)
    return out.otherwise("سایر")


def age(col: Column) -> Column:
    """The first run of up to three digits of any script if it lies between 10 and 110, else -1."""
    number = F.regexp_extract(F.translate(col, "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"), "([0-9]{1,3})", 1).try_cast("int")
    return F.when(number.between(10, 110), number).otherwise(-1)


def half_open_class(score: Column, thresholds: Sequence[float] = (3.0, 5.0, 7.0), labels: Sequence[str] = ("Low", "Moderate", "High", "Very High"), closed: str = "left") -> Column:
    """Class of a score; closed tells to which side a threshold belongs: 'left' to the class above it, 'right' to the one below."""
    out = F.when(score.isNull(), None)
    for t, label in zip(thresholds, labels):
        out = out.when(score < t if closed == "left" else score <= t, label)
    return out.otherwise(labels[-1])


def wilson(hits: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95% interval of a share; null for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def daypart(hour: Column) -> Column:
    return F.when(hour.isNull(), "__MISSING__").when(hour < 6, "overnight").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


_NULLS_PASS = lambda x, low: F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
MISSING = "__MISSING__"


def tabular_features(df: DataFrame, id: str) -> DataFrame:
    """The id and 67 features of each post, in a fixed order; unknown numbers are null, unknown categories MISSING.

    Needs content, signature, likes, user_post_count, children_count, age_num, is_starter, reply_to, gender, category, sub_category,
    education_clean, posted_at and join_date. The post's two kinds of word counts differ in their lists: the short one ('temp') and the default.
    """
    post, sig = text_features(F.col("content"), "post", tokens=F.col("_words")), signature_features(F.col("signature"), F.col("_sig_words"), F.col("_no_sig"))
    temp = {"post_neg_count_temp": count_words(F.col("_words"), NEGATIVE_WORDS), "post_pos_count_temp": count_words(F.col("_words"), POSITIVE_WORDS)}
    number = lambda c: F.col(c).cast("string").try_cast("double")
    base = spread(df).select(F.col(id), "likes", "user_post_count", "children_count", "age_num", "is_starter", "reply_to", "gender", "category", "sub_category", "education_clean", "posted_at", "join_date", "content", "signature")
    base = jalali.barrier(base, {"_words": persian_words(F.col("content")), "_sig_words": persian_words(F.col("signature")), "_no_sig": is_blank(F.col("signature"))})
    base = jalali.barrier(base, {**post, **sig, **temp, "n_likes": _NULLS_PASS(number("likes"), 0.0), "n_posts": _NULLS_PASS(number("user_post_count"), 0.0), "n_children": F.nanvl(number("children_count"), F.lit(None).cast("double")), "n_age": F.nanvl(number("age_num"), F.lit(None).cast("double")), "n_reply": F.coalesce(number("reply_to"), F.lit(-1.0))})
    base = jalali.with_date(base.drop("content", "signature", "_words", "_sig_words", "_no_sig"), "posted_at", "posted_", need_time=False)
    base = jalali.with_date(base, "join_date", "join_", need_time=False)
    days = F.when(F.col("posted_day_index").isNotNull() & F.col("join_day_index").isNotNull(), F.greatest(F.col("posted_day_index") - F.col("join_day_index"), F.lit(0)).cast("double"))
    base = jalali.barrier(base, {"account_age_days": days, "weekday_no": F.pmod(F.lit(6) + F.col("posted_day_index"), F.lit(7)).cast("double")})
    years = F.col("account_age_days") / 365.25
    rate = F.col("n_posts") / F.greatest(years, F.lit(0.25))
    base = jalali.barrier(base, {"account_age_years": years, "posts_per_account_year": F.when(years.isNotNull(), rate)})

    c, d = F.col, lambda x: F.col(x).cast("double")
    hour, month = d("posted_hour"), d("posted_month")
    words, chars = F.greatest(d("post_word_count"), F.lit(1.0)), F.greatest(d("post_char_count"), F.lit(1.0))
    no_age = c("n_age").isNull() | (c("n_age") == -1)
    category = lambda x: F.coalesce(F.col(x), F.lit(MISSING)).alias(x)
    truthy = F.lower(F.trim(c("is_starter").cast("string"))).isin("1", "true", "yes", "y")
    sig_names = [f"sig_{n}" if n.endswith("emoji") and n != "emoji" else f"sig_{n}_count" for n in SIGNATURE]
    known = lambda cond: F.when(cond.isNotNull(), cond.cast("double"))
    return base.select(
        c(id), c("n_likes").alias("likes"), F.log1p("n_likes").alias("log1p_likes"), c("n_posts").alias("user_post_count"), F.log1p("n_posts").alias("log1p_user_post_count"),
        c("n_children").alias("children_count"), no_age.cast("double").alias("age_missing"), F.when(~no_age & c("n_age").between(12, 80), c("n_age")).alias("age_num"),
        F.coalesce(truthy, F.lit(False)).cast("double").alias("is_starter"), (c("n_reply") != -1).cast("double").alias("has_reply"),
        category("gender"), category("category"), category("sub_category"), category("education_clean"),
        d("posted_year").alias("posted_year"), month.alias("posted_month"), d("posted_day").alias("posted_day"), hour.alias("posted_hour"), d("posted_minute").alias("posted_minute"),
        c("weekday_no").alias("posted_weekday"), F.coalesce(jalali.weekday(c("posted_day_index")), F.lit(MISSING)).alias("posted_weekday_name"), daypart(hour).alias("posted_daypart"),
        known(c("weekday_no").isin(3.0, 4.0)).alias("posted_is_weekend"), known(hour < 6).alias("posted_is_night"), known(hour >= 22).alias("posted_is_late_evening"),
        F.sin(2 * math.pi * hour / 24).alias("posted_hour_sin"), F.cos(2 * math.pi * hour / 24).alias("posted_hour_cos"),
        F.sin(2 * math.pi * (month - 1) / 12).alias("posted_month_sin"), F.cos(2 * math.pi * (month - 1) / 12).alias("posted_month_cos"),
        d("join_year").alias("join_year"), d("join_month").alias("join_month"), d("join_day").alias("join_day"),
        "account_age_days", "account_age_years", "posts_per_account_year", F.log1p("posts_per_account_year").alias("log1p_posts_per_account_year"), (c("n_likes") / (1 + c("n_posts") / 100)).alias("likes_per_100_posts"),
        (c("sig_char_count") != -1).cast("double").alias("has_signature"), *[F.greatest(d(s), F.lit(0.0)).alias(s) for s in sig_names],
        *[d(f"post_{n}").alias(f"post_{n}") for n in ("char_count", "punct_count", "question_count", "excl_count", "emoji_count", "pos_emoji", "neg_emoji", "word_count", "neg_count", "pos_count", "neg_count_temp", "pos_count_temp")],
        (d("post_neg_count") / words).alias("post_neg_word_ratio"), (d("post_pos_count") / words).alias("post_pos_word_ratio"),
        (100 * d("post_question_count") / words).alias("post_question_per_100_words"), (100 * d("post_excl_count") / words).alias("post_excl_per_100_words"), (100 * d("post_emoji_count") / words).alias("post_emoji_per_100_words"),
        (100 * d("post_punct_count") / chars).alias("post_punct_per_100_chars"), (d("post_neg_count_temp") / words).alias("post_temp_neg_ratio"), (d("post_pos_count_temp") / words).alias("post_temp_pos_ratio"),
    )
