"""The general operators on small tables: values, nulls, empty tables, ties, repeated rows, clashing columns."""

import datetime as dt
import hashlib
import math
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from kelk.functions import features, jalali
from kelk.functions.text import ascii_digits, count_any, drop_decimal_zero
from kelk.operators import cleaning, components, evaluation, labels, running, vocabulary
from kelk.operators.sessions import sessionize
from kelk.plans import label_queries
from kelk.sources import html, readers
from kelk.streaming import alerts


def brute_sessions(rows, gap):
    out, by = [], {}
    for k, t in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("width", [None, 7, 40])
def test_sessions_are_those_of_a_scan(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(-300, 900), None if rng.random() < 0.1 else 5])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k long, t long").withColumn("slice", F.lit("clash"))
    got = sorted((r.k, r.session_start, r.session_end, r.n_events) for r in sessionize(df, "k", "t", 10, width).collect())
    assert got == brute_sessions(rows, 10)


def test_sessions_exact_gap_and_empty(spark):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("a", 61), ("a", 61)], "k string, t long")
    assert sorted((r.session_start, r.session_end, r.duration, r.n_events) for r in sessionize(df, "k", "t", 30).collect()) == [(0, 30, 30, 2), (61, 61, 0, 2)]
    assert sessionize(df.where("false"), "k", "t", 30).count() == 0
    with pytest.raises(ValueError):
        sessionize(df, "k", "t", -1)


def test_jalali_round_trip_and_spellings(spark):
    days = spark.range(-60000, 60000, 37).select((F.col("id") * 1440 + F.pmod("id", F.lit(1440))).alias("m"))
    text = jalali.with_text(days, {"s": "m"})
    back = jalali.with_date(text, "s", "x_")
    assert back.where(jalali.minutes("x_") != F.col("m")).count() == 0
    cases = {
        "1400/01/01 00:00": (1400, 1, 1, 0, 0), "۱۳۹۹-۱۲-۳۰ ۲۳:۵۹": (1399, 12, 30, 23, 59), "1400/12/30 10:00": None, "1400/13/01 10:00": None, "7:05 1402/2/3": (1402, 2, 3, 7, 5),
        "۳ شهريور ۱۳۹۹ ساعت ۰۰:۰۴": (1399, 6, 3, 0, 4), "1400/01/01": None, "1400/01/01 24:00": None, "دیروز": None, "": None, None: None, "1400/01/01، 09:30": (1400, 1, 1, 9, 30), "1400/01/01 22:23:38": (1400, 1, 1, 22, 23),
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = {r.i: None if r.x_year is None else (r.x_year, r.x_month, r.x_day, r.x_hour, r.x_minute) for r in jalali.with_date(df, "s", "x_").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert jalali.with_date(df.where("i = 6"), "s", "x_", need_time=False).first().x_hour == 0
    # 1400/01/01 was Sunday, 21 March 2021.
    assert spark.range(1).select(jalali.weekday(F.lit(0))).first()[0] == dt.date(2021, 3, 21).strftime("%A")


def test_text_helpers(spark):
    row = spark.range(1).select(ascii_digits(F.lit("۱٢３ a‌b")), drop_decimal_zero(F.lit(" 412.0 ")), count_any(F.lit("aaab"), ["a", "aa"]), count_any(F.lit(None).cast("string"), ["a"])).first()
    assert tuple(row) == ("123 ab", "412", 2, 0)


# Scores at and next to the thresholds, and their classes.
def test_classes_meet_their_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 3.099, 3.1, 4.899, 4.9, 6.499, 6.5, 9.0, None)], "s double")
    got = [r[0] for r in df.select(features.half_open_class(F.col("s"), (3.1, 4.9, 6.5))).collect()]
    assert got == ["Low", "Low", "Moderate", "Moderate", "High", "High", "Very High", "Very High", None]
    assert [r[0] for r in df.limit(3).select(features.half_open_class(F.col("s"), (3.1, 4.9, 6.5), closed="right")).collect()] == ["Low"] * 3


def test_wilson_and_features(spark):
    low, high = spark.range(1).select(*features.wilson(F.lit(8), F.lit(10))).first()
    assert math.isclose(low, 0.4901624, abs_tol=1e-6) and math.isclose(high, 0.9433178, abs_tol=1e-6)
    assert spark.range(1).select(features.wilson(F.lit(0), F.lit(0))[0]).first()[0] is None
    f = features.signature_features(F.col("s"))
    rows = spark.createDataFrame([("نگران! 😔",), ("  ",), (None,)], "s string").select(*[f[c].alias(c) for c in ("sig_char_count", "sig_excl_count", "sig_neg_count", "sig_neg_emoji")]).collect()
    assert [tuple(r) for r in rows] == [(8, 1, 1, 1), (-1, -1, -1, -1), (-1, -1, -1, -1)]


def test_tabular_features_have_67_columns_and_no_nan(spark):
    schema = "id string, content string, signature string, likes int, user_post_count int, children_count double, age_num double, is_starter boolean, reply_to string, gender string, category string, sub_category string, education_clean string, posted_at string, join_date string"
    rows = [("a", "سلام؟ نگران", None, 3, 100, 1.0, 30.0, True, "-1", "زن", "x", None, "y", "1401/01/02 23:10", "1400/01/02"), ("b", None, "s", None, -5, None, -1.0, None, "7", None, None, None, None, None, None), ("c", "", "", 0, 0, float("nan"), 99.0, False, None, "زن", "x", "z", "y", "1399/01/01 05:00", "1400/01/01")]
    out = features.tabular_features(spark.createDataFrame(rows, schema), "id")
    assert len(out.columns) == 68
    a, b, c = (r.asDict() for r in out.orderBy("id").collect())
    assert (a["account_age_days"], a["posted_weekday_name"], a["posted_daypart"], a["posted_is_late_evening"], a["has_reply"], a["is_starter"]) == (366.0 - 1, dt.date(2022, 3, 22).strftime("%A"), "evening", 1.0, 0.0, 1.0)
    assert (b["likes"], b["user_post_count"], b["age_missing"], b["age_num"], b["gender"], b["has_reply"], b["posted_weekday_name"]) == (None, 0.0, 1.0, None, "__MISSING__", 1.0, "__MISSING__")
    assert (c["account_age_days"], c["age_num"], c["children_count"], c["has_signature"]) == (0.0, None, None, 0.0)


def test_conflicting_ids_are_kept(spark):
    rows = [(1, "p", "x", "t"), (2, "p", "x", "u"), (3, "q", "x", "t"), (4, "q", "y", "t"), (5, None, "n", "t"), (6, "nan", "n", "t"), (7, None, "n", "t"), (8, "r", None, "t"), (9, "r", "x", "t")]
    df = spark.createDataFrame(rows, "o long, post_id string, content string, thread string")
    got = {r.o: r.dedup_class for r in cleaning.conflict_aware_dedup(df, "post_id", "content", "o", ["thread", "content"]).collect()}
    assert got == {1: 1, 3: 2, 4: 2, 5: 0, 8: 2, 9: 2}


def test_stable_ids_are_unique(spark):
    rows = [(i, p, "t", "a", "d", s, "c") for i, (p, s) in enumerate([("1.0", False), ("1", False), (None, True), (None, True), (None, False), (None, None)])]
    df = spark.createDataFrame(rows, "o long, post_id string, thread string, author string, at string, starter boolean, content string")
    ids = [r.stable_id for r in cleaning.stable_ids(df, "post_id", "thread", "author", "at", "starter", "content", ["o"]).orderBy("o").collect()]
    assert ids[0] == "1" and ids[1].startswith("1__") and ids[2] == "thread_t_starter" and ids[4] == "thread_t_a_d" and len(set(ids)) == 6


def test_upsert_and_fill(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, cleaning.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    other = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, o int, v string")
    filled = cleaning.fill_from(spark.createDataFrame([(1, " "), (1, "z"), (9, None)], "k int, v string"), other, "k", ["v"], "o")
    assert sorted(filled.collect(), key=str) == sorted([(1, "y"), (1, "z"), (9, None)], key=str)


def test_components_are_those_of_a_union_find(spark):
    rng = random.Random(1)
    rows = [(f"r{i:03d}", rng.choice([None, "", " ", *[f"a{j}" for j in range(60)]]), f"t{rng.randrange(70)}") for i in range(150)] + [(f"c{i:03d}", f"n{i}", f"m{i // 2}") for i in range(40)] + [(f"c{i:03d}", f"n{i - 1}", "x" * i) for i in range(1, 40, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, a, t in rows:
        for node in (("a", a), ("t", t)):
            if node[1] and node[1].strip():
                x, y = find(("r", r)), find(node)
                parent[x] = y
        find(("r", r))
    groups = {}
    for r, _, _ in rows:
        groups.setdefault(find(("r", r)), set()).add(r)
    want = {r: min(g) for g in groups.values() for r in g}
    df = spark.createDataFrame(rows, "id string, a string, t string")
    assert {r.id: r.component for r in components.record_components(df, "id", ["a", "t"]).collect()} == want
    assert components.record_components(df.where("false"), "id", ["a", "t"]).count() == 0


def test_matches_follow_the_ladder(spark):
    want = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("d", "h1"), ("e", ""), ("f", ""), ("g", "h9"), ("z", "h")], "id string, content_hash string")
    rows = [("a", 1, "h2", "f1"), ("b", 2, "h1", "f1"), ("b", 3, "h2", "f2"), ("c", 4, "h1", "f"), ("c", 5, "h1", "f"), ("d", 6, "h1", "f"), ("d", 7, "h1", "g"), ("e", 8, "h", "f"), ("e", 9, "h", "g"), ("f", 10, "h", "f"), ("f", 11, "i", "f"), ("g", 12, "h", "f"), ("g", 13, "h", "f")]
    got = {r.id: (r.outcome, r.row_ordinal) for r in labels.resolve_matches(want, spark.createDataFrame(rows, "id string, row_ordinal long, content_hash string, fingerprint string")).collect()}
    assert got == {"a": ("unique_id_match", 1), "b": ("exact_content_match", 2), "c": ("exact_content_identical", 4), "d": ("ambiguous_exact", None), "e": ("identical_source", 8), "f": ("ambiguous_no_content", None), "g": ("content_mismatch", None), "z": ("no_candidate", None)}


def test_fuzzy_match_needs_a_lead(spark):
    want = spark.createDataFrame([("a", "abcdefghij" * 10), ("b", "abcdefghij" * 10)], "id string, content string")
    records = spark.createDataFrame([("a", 1, "abcdefghij" * 10 + "x"), ("a", 2, "zzz"), ("b", 3, "abcdefghij" * 10 + "x"), ("b", 4, "abcdefghij" * 10)], "id string, row_ordinal long, content string")
    assert [r.id for r in labels.fuzzy_matches(want, records).collect()] == ["a"]


def test_content_hash_and_digest(spark):
    df = spark.createDataFrame([(" كتاب‌ها  ي ",), ("کتاب ها ی",), ("",), (None,)], "c string")
    hashes = [r[0] for r in df.select(labels.content_hash(F.col("c"))).collect()]
    assert hashes[0] == hashes[1] != "" and hashes[2:] == ["", ""]
    rows = [(str(i), float(i)) for i in range(50)]
    digest = lambda x: labels.dataset_digest(spark.createDataFrame(x, "id string, v double"), "id", "v").first()[0]
    assert digest(rows) == digest(rows[::-1]) != digest(rows[1:])


def test_content_hash_of_whole_posts_against_brute_force(spark, tmp_path):
    texts = ["كتاب‌ها  ي", "کتاب ها ی", "ﷺ ① ｆｕｌｌ", "سلام", "بدرود", "!", "", None, " \u200c\u3000\n "]
    spark.createDataFrame(list(enumerate(texts)), "row_ordinal long, content string").write.parquet(f"{tmp_path}/ninisite_cleaned_enriched.parquet")

    def brute(text):
        plain = unicodedata.normalize("NFKC", text or "").translate({0x64A: "ی", 0x649: "ی", 0x643: "ک", 0x200C: " ", 0x200F: " ", 0x200E: " "})
        return hashlib.sha256(" ".join(plain.split()).encode()).hexdigest() if plain.split() else ""

    got = {r.row_ordinal: r.hash for r in label_queries.QUERIES["content_hash"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] and len({got[k] for k in (1, 2, 3, 4, 5)}) == 5


def test_canonical_rows_of_all_annotators(spark, tmp_path):
    rows = [("a", "r1", "person4", 3.0, True), ("a", "r1", "person1", 5.0, True), ("a", "r1", "person1", 5.0, True), ("a", "r1", "person9", 9.0, False), ("b", "panel_round", "person2", 2.0, True), ("b", "active_learning_round", "person14", 7.0, True), ("c", "r1", "person7", 4.0, True)]
    spark.createDataFrame(rows, "unique_post_id string, label_round string, annotator string, stress double, observed boolean").write.parquet(f"{tmp_path}/annotation_history.parquet")
    got = sorted(tuple(r) for r in label_queries.QUERIES["canonical_by_rank"](spark, str(tmp_path)).collect())
    assert got == [("a", 5.0, "person1", 2, "person4"), ("b", 7.0, "person14", 2, "person2"), ("c", 4.0, "person7", 1, "")]


def test_density_at_all_points(spark, tmp_path):
    rng = random.Random(3)
    values = {c: [rng.random() * 9 + 1 for _ in range(30)] for c in ("Low", "High")}
    spark.createDataFrame([(c, x) for c, v in values.items() for x in v] + [("Low", None)], "clinical_class string, final_stress double").write.parquet(f"{tmp_path}/canonical_labels.parquet")
    got = {(r.clinical_class, r.g): r.density for r in label_queries.QUERIES["kde_grid"](spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 500
    for c, v in values.items():
        h = statistics.stdev(v) * len(v) ** -0.2
        assert all(math.isclose(got[c, g], sum(math.exp(-0.5 * ((1 + g * 9 / 499 - x) / h) ** 2) for x in v) / (len(v) * h * math.sqrt(2 * math.pi)), abs_tol=6e-7) for g in (0, 7, 250, 499))


def test_grouped_folds_keep_groups_and_balance(spark):
    rows = [(f"g{i % 200}", "A" if i % 200 < 150 else "B") for i in range(1000)]
    folds = labels.grouped_folds(spark.createDataFrame(rows, "g string, c string"), "g", "c").collect()
    assert len(folds) == 200 and len({r.g for r in folds}) == 200
    sizes = [sum(r.fold == k for r in folds) for k in range(5)]
    assert max(sizes) - min(sizes) <= 2


def test_running_sums(spark):
    rng = random.Random(2)
    values = rng.sample(range(10000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in values], "x int, n int")
    for down in (False, True):
        got = {r.x: r.cum_n for r in running.running_sums(df, "x", ["n"], descending=down, buckets=8).collect()}
        total, want = 0, {}
        for v in sorted(values, reverse=down):
            total += v % 7
            want[v] = total
        assert got == want


def test_metrics(spark):
    rows = [(1.0, 1.0, "Low"), (2.0, 2.0, "Low"), (2.0, 4.0, "Very High"), (9.0, 3.0, "Very High")]
    df = spark.createDataFrame(rows, "truth double, score double, label string")
    # Positives at ranks 1 and 2 of the falling scores.
    assert evaluation.average_precision(df, F.col("label") == "Very High", "score").first()[0] == 1.0
    assert math.isclose(evaluation.spearman(df, "truth", "score").first()[0], 0.6324555, abs_tol=1e-6)
    cells = evaluation.confusion(df.withColumn("p", F.lit("Low")), "label", "p").collect()
    assert len(cells) == 16 and sum(r.n for r in cells) == 4
    report = {r["class"]: r for r in evaluation.class_report(df.withColumn("p", F.lit("Low")), "label", "p").collect()}
    assert report["High"].recall == 0.0 and report["High"].recall_low is None and report["Low"].precision == 0.5
    z = [r.z for r in evaluation.robust_z(spark.createDataFrame([(1.0,)] * 3, "x double"), "x", "z").collect()]
    assert z == [0.0] * 3


def test_ridge_of_exact_data(spark):
    df = spark.createDataFrame([(2 * a + 3 * b + 1.0, a, b) for a, b in ((1.0, 2.0), (2.0, 1.0), (4.0, 4.0), (0.0, 3.0))], "y double, a double, b double")
    r = evaluation.ridge_stack(df, "y", "a", "b", 0.0).first()
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(r, (1.0, 2.0, 3.0)))


def test_threshold_search_against_all_triples(spark):
    rng = random.Random(5)
    names = evaluation.CLASSES
    rows = [(round(k * 2 + rng.random() * 2.4, 2), names[k]) for k in range(4) for _ in range(12)]
    got = evaluation.threshold_search(spark.createDataFrame(rows, "s double, c string"), "s", "c", keep=10_000).collect()
    scores = sorted({s for s, _ in rows})
    grid = [(a + b) / 2 for a, b in zip(scores, scores[1:])] + [scores[-1] + 1e-8]
    n = {c: sum(x == c for _, x in rows) for c in names}
    count = 0
    for i, a in enumerate(grid):
        for j in range(i + 1, len(grid)):
            for k in range(j + 1, len(grid)):
                b, c = grid[j], grid[k]
                hits = [sum(x == names[0] and s < a for s, x in rows), sum(x == names[1] and a <= s < b for s, x in rows), sum(x == names[2] and b <= s < c for s, x in rows), sum(x == names[3] and s >= c for s, x in rows)]
                count += all(h / n[m] >= f for h, m, f in zip(hits, names, (0.75, 0.5, 0.5, 0.75)))
    assert len(got) == count > 0


def test_best_triples_of_many_scores(spark):
    rng = random.Random(6)
    names = evaluation.CLASSES
    rows = [(k * 2 + rng.random() * 2.6, names[k]) for k in range(4) for _ in range(75)]
    df = spark.createDataFrame(rows, "s double, c string")
    # All 300 midpoints joined level by level, against the default, which took every second one.
    every = [tuple(r) for r in evaluation.threshold_search(df, "s", "c", most=10_000).collect()]
    got = [tuple(r) for r in evaluation.threshold_search(df, "s", "c").collect()]
    assert len(got) == 100 and all(math.isclose(x, y, abs_tol=1e-9) for a, b in zip(got, every) for x, y in zip(a, b))


def test_vocabulary_and_sample(spark):
    df = spark.createDataFrame([("سلام خوب", 1), ("سلام بد بد بد", 0), (None, 1)], "t string, h int")
    out = {r.stem: (r.association, r.high_freq, r.low_freq) for r in vocabulary.differential_vocabulary(df, "t", F.col("h") == 1, F.col("h") == 0, 1, 2.0).collect()}
    assert out == {"خوب": ("high", 1, 0), "بد": ("low", 0, 3)}
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "low").otherwise("high").alias("b"))
    take = lambda: vocabulary.banded_sample(rows, "b", {"low": 20, "high": 20}, "id").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in take()} == {"low": 20, "high": 10}


EPOCH = dt.datetime(2024, 1, 1)
GOLDEN = [(0, 3.2, "Moderate"), (35, 5.8, "High"), (70, 6.7, "High"), (105, 7.8, "Very High"), (165, 6.4, "High")]


def _alerted(spark, rows):
    schema = "u long, e long, t timestamp, s double, l string"
    return {r.event: r for r in alerts.alerts_batch(spark.createDataFrame(rows, schema), "u", "e", "t", "s", "l").collect()}


def _by_hand(events, rules=alerts.Rules()):
    """Scores and flags of one user's events (minute, score, level) in the order they come, one by one."""
    out, scores, levels, clock, alerted = [], {}, [], None, None
    for minute, score, level in events:
        for name, half in (("fast", rules.fast), ("sustained", rules.sustained), ("baseline", rules.baseline)):
            left = 1.0 if clock is None or minute <= clock else 2.0 ** (-(minute - clock) / half)
            scores[name] = score if clock is None else scores[name] * left + score * (1 - left)
        clock = minute
        levels.append(level in ("High", "Very High"))
        five = levels[-rules.window :]
        flags = [level == "Very High" and score >= rules.immediate_score, len(levels) > 1 and scores["sustained"] >= rules.sustained_score, len(five) == rules.window and sum(five) >= rules.window_high, scores["fast"] >= rules.escalation_fast and scores["fast"] - scores["baseline"] >= rules.escalation]
        cooling = alerted is not None and minute - alerted < rules.cooldown
        fires = flags[0] or (any(flags) and not cooling)
        out.append(([scores[n] for n in alerts.SCORES], [*flags, cooling, fires]))
        alerted = minute if fires else alerted
    return out


# A sequence of scores and what its last event must come to.
def test_alert_sequence(spark):
    found = _alerted(spark, [(1, i, EPOCH + dt.timedelta(minutes=m), s, x) for i, (m, s, x) in enumerate(GOLDEN)])
    assert all(math.isclose(found[4][n], v, rel_tol=1e-12) for n, v in zip(alerts.SCORES, (6.374730931076565, 4.825347435097895, 3.4624180873758115)))
    assert [tuple(found[i][f] for f in alerts.FLAGS) for i in range(5)] == [(False,) * 6, (False,) * 6, (False,) * 6, (True, False, False, True, False, True), (False, False, True, True, False, True)]


def _events(rng, n, spread):
    level = lambda s: "Low" if s < 3 else "Moderate" if s < 5 else "High" if s < 6.5 else "Very High"
    times = sorted(rng.choices(range(spread), k=n))
    scores = [min(10.0, max(1.0, rng.gauss(rng.choice([3, 5, 8]), 1.5))) for _ in times]
    return [(m, s, level(s)) for m, s in zip(times, scores)]


def test_alerts_of_a_hot_user_over_many_slices(spark):
    rng = random.Random(3)
    users = {1: _events(rng, 1500, 200 * 1440), 2: _events(rng, 40, 900 * 1440), 3: _events(rng, 300, 600), 4: [(5, 9.0, "Very High")]}
    rows = [(u, u * 10_000 + i, EPOCH + dt.timedelta(minutes=m), s, x) for u, events in users.items() for i, (m, s, x) in enumerate(events)]
    rng.shuffle(rows)
    found = _alerted(spark, rows)
    assert len(found) == len(rows)
    for u, events in users.items():
        for i, (scores, flags) in enumerate(_by_hand(events)):
            row = found[u * 10_000 + i]
            assert all(math.isclose(row[n], v, rel_tol=1e-9) for n, v in zip(alerts.SCORES, scores)) and [row[f] for f in alerts.FLAGS] == flags


def test_alerts_leave_out_what_has_no_user_time_or_score(spark):
    rows = [(1, 1, EPOCH, 5.0, "High"), (None, 2, EPOCH, 5.0, "High"), (1, 3, None, 5.0, "High"), (2, 4, EPOCH, None, "High"), (3, 5, EPOCH, 9.0, None)]
    assert sorted(_alerted(spark, rows)) == [1, 5] and _alerted(spark, [])  == {}


def test_stream_with_events_out_of_order(spark, tmp_path):
    rng = random.Random(5)
    batches = [{u: _events(rng, n, 400) for u, n in ((1, 30), (2, 3))} for _ in range(3)]
    # The second batch lies half before the first one's end, the third at the same times as the first.
    shift = (0, 200, 0)
    hands = {u: _by_hand([(m + shift[k], s, x) for k, b in enumerate(batches) for m, s, x in b[u]]) for u in (1, 2)}
    schema, want, number = "u long, e long, t timestamp, s double, l string", {}, {1: 0, 2: 0}
    out = str(tmp_path / "out")
    for k, batch in enumerate(batches):
        rows = []
        for u, events in batch.items():
            for m, s, x in events:
                want[len(want)] = hands[u][number[u]]
                rows.append((u, len(want) - 1, EPOCH + dt.timedelta(minutes=m + shift[k]), s, x))
                number[u] += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        alerts.alerts_stream(stream, "u", "e", "t", "s", "l", out).trigger(availableNow=True).start().awaitTermination()
    found = {r.event: r for r in spark.read.parquet(out + "/table").collect()}
    assert found.keys() == want.keys()
    for e, (scores, flags) in want.items():
        assert all(math.isclose(found[e][n], v, rel_tol=1e-9) for n, v in zip(alerts.SCORES, scores)) and [found[e][f] for f in alerts.FLAGS] == flags


# Pages and what is read from them.
def test_pages():
    page = '<article class="topic-post" id="post-456"><a class="nickname">سارا</a><span class="date">1400/01/01 10:00</span><div class="post-count">۱۲ پست</div><blockquote id="post-9"><a class="nickname">x</a></blockquote><div class="post-message">متن  <b>پست</b><div class="signature">امضا</div></div><a class="like-count" data-like-count="7"></a></article><article id="post-457"><div class="post-message">b<br>c</div></article>'
    first, second = html.topic_posts(page, 1)
    assert first == {"post_id": "456", "author": "سارا", "posted_at": "1400/01/01 10:00", "content": "متن پست", "likes": 7, "user_post_count": 12, "reply_to": "9", "is_starter": True}
    assert second["content"] == "b c" and not second["is_starter"] and second["author"] is None
    gender = lambda page: html.profile_gender(page)[:2]
    assert gender('<div><i class="is-woman"></i><span>زن</span></div>') == ("زن", 1) and gender('<i class="is-user"></i><span>مرد</span>') == ("مرد", 0)
    assert gender('<i class="iconman"></i>') == gender('<i class="is-user"></i>') == gender('<i class="iconuser-01"></i>') == ("مرد", 0) and gender('<i class="iconwoman"></i>') == ("زن", 1)
    assert gender("<p>زن</p>") == gender('<i class="icon-man"></i><i class="female"></i>') == gender("") == ("unknown", -1)
    # The word decides against the token.
    assert html.profile_gender('<i class="iconuser"></i><span>زن</span>') == ("زن", 1, "explicit_text_female") and html.profile_gender('<i class="icon-user man"></i>')[2] == "class_marker:icon-user"
    profile = html.profile_fields('<div class="profile__name"><h4> سارا </h4></div><i class="is-woman"></i><p><i class="iconbirthday-stroke"></i><span>۳۰ ساله</span></p><i class="iconeducation"></i><b>x</b><span>لیسانس</span><div><i class="iconcalender"></i><span>تاریخ عضویت</span><span>1399/02/03</span></div><i class="iconsignature"></i>')
    assert (profile["username"], profile["age"], profile["education"], profile["join_date"], profile["signature"], profile["gender_code"]) == ("سارا", "۳۰ ساله", "لیسانس", "1399/02/03", "", 1)
    assert html.listing_threads('<div><a href="/topic/55/x"><span class="topic_subject">t</span></a><span class="topic_number">12</span></div>', 5) == [{"thread_id": "55", "title": "t", "replies": 12}]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"a\nb"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("y,x,z\nc,2,3\n", encoding="utf-8")
    (tmp_path / "c_manifest.csv").write_text("x,y\n9,9\n", encoding="utf-8")
    got = readers.read_fragments(spark, str(tmp_path), ["x", "y"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "a\nb", None), ("2", "c", "3")]
    assert readers.file_digests(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, [(str(tmp_path / "none"), lambda p: None)])
    assert readers.first_source(spark, [(str(tmp_path / "none"), lambda p: None), (str(tmp_path / "a.csv"), lambda p: readers.read_csv(spark, p))]).count() == 1
    named = readers.read_fragments(spark, str(tmp_path), ["x", "y"], source="file")
    assert {r.file for r in named.collect()} == {"a.csv", "b.csv"}
    import gzip

    with gzip.open(tmp_path / "g.csv.gz", "wt", encoding="utf-8") as f:
        f.write('x,y\n5,"q ""z"""\n')
    assert readers.read_csv(spark, str(tmp_path / "g.csv.gz")).first().y == 'q "z"'
    (tmp_path / "lines.txt").write_text("one\r\n\ntwo\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_numbered(spark, str(tmp_path / "lines.txt"), 2).orderBy("number").collect()] == [(2, "one"), (3, ""), (4, "two")]


def test_reports_and_handoffs(spark, tmp_path):
    out = str(tmp_path / "out")
    df = readers.demo_posts(spark, 5)
    readers.export_handoff(spark, out, {"posts": df}, by="is_starter")
    assert readers.load_json(spark, out + "/manifest.json")["posts"]["by"] == {"true": 10, "false": 10} or readers.load_json(spark, out + "/manifest.json")["posts"]["by"] == {"True": 10, "False": 10}
    assert readers.verify_handoff(spark, out) == []
    spark.range(3).write.mode("overwrite").parquet(out + "/posts")
    assert readers.verify_handoff(spark, out) == ["posts: other rows or columns"]
    readers.save_json(spark, out + "/r.json", {"a": float("nan"), "b": [1, {"c": "ی"}]})
    assert readers.load_json(spark, out + "/r.json") == {"a": None, "b": [1, {"c": "ی"}]}
    with pytest.raises(FileNotFoundError):
        readers.load_bundle(spark, {"x": out + "/posts", "y": out + "/none"})
    cleaned = cleaning.clean_filters(df)
    assert df.count() == 20 and cleaned.count() == 20 and df.select("thread_id").distinct().count() == 10


def test_sinks_append_and_partition(spark, tmp_path):
    readers.append(spark.range(3), str(tmp_path / "grown"))
    readers.append(spark.range(2).withColumn("x", F.lit(1)), str(tmp_path / "grown"))
    grown = spark.read.option("mergeSchema", "true").parquet(str(tmp_path / "grown"))
    assert grown.count() == 5 and grown.where("x IS NULL").count() == 3
    readers.write_partitioned(spark.range(4).withColumn("part", F.col("id") % 2), str(tmp_path / "parts"), "part")
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == ["part=0", "part=1"]
    readers.write_csv(spark.createDataFrame([('a "b"\nc', 1)], "t string, n int"), str(tmp_path / "c"), gzip=True)
    assert readers.read_csv(spark, str(tmp_path / "c")).first().t == 'a "b"\nc'
