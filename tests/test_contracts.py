"""Contracts, calibrators, orders, quantiles and models on small tables."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kelk.functions import features
from kelk.operators import calibration, cleaning, contracts, labels, models, relations, running


def rows_of(df):
    return {r.rule: r.n for r in df.collect()}


def test_input_contract_counts_each_breach(spark):
    good = [(f"p{i}", "train", i % 5, 2.0, "Low", 1.0) for i in range(5)] + [("v", "validation", None, 3.0, "Low", None), ("t", "test", None, 3.0, "Moderate", None), ("e", "embargo", None, None, None, None)]
    schema = "id string, role string, fold int, score double, label string, weight double"
    check = lambda rows: rows_of(contracts.input_contract(spark.createDataFrame(rows, schema), "id", "role", "fold", "score", "label", "weight"))
    assert set(check(good).values()) == {0} and set(check([]).values()) == {0}
    bad = check([*good, (None, "other", 7, 11.0, "Low", 1.0), ("p0", "train", None, None, "Low", 0.0), ("x", "test", 1, 5.0, "Moderate", 1.0), ("y", "validation", None, 12.0, "Huge", 1.0)])
    assert bad == {"missing_id": 1, "unknown_role": 1, "missing_score": 1, "score_out_of_range": 1, "train_without_fold": 1, "fold_outside_train": 2, "unknown_fold": 1, "bad_weight": 1, "class_against_score": 2, "repeated_id": 1}


def test_fold_and_prediction_contracts(spark):
    train = spark.createDataFrame([("a", 0, "g"), ("b", 1, "g"), ("c", 2, ""), ("d", 4, ""), ("d", 3, None), ("e", None, "h")], "id string, fold int, grp string")
    assert rows_of(contracts.fold_contract(train, "id", "fold", ["grp"])) == {"id_across_fold": 1, "grp_across_fold": 1, "empty_fold": 0, "unknown_fold": 0, "without_fold": 1}
    given = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("a", 2.0, 2.0, 2.0), ("b", 12.0, 12.0, 12.0), ("z", 3.0, 1.0, 2.0), ("c", None, 1.0, 1.0)], "id string, p double, x double, y double")
    found = rows_of(contracts.verify_predictions(given, train.select("id"), "id", "p", ["x", "y"]))
    assert found == {"missing": 2, "unexpected": 1, "repeated": 1, "missing_value": 1, "out_of_range": 1, "not_the_mean": 1}
    with pytest.raises(contracts.ContractError, match="right side repeats id"):
        contracts.one_to_one(train.select("id").distinct(), given, "id")
    with pytest.raises(contracts.ContractError, match="forbidden"):
        contracts.require_columns(given, ["id"], ["p"])
    report = spark.createDataFrame([("Low", 0.75), ("High", 0.4)], "class string, recall double")
    assert tuple(contracts.recall_floors(report, {"Low": 0.75, "Moderate": 0.5, "High": 0.5}).first()) == (1, 3, "1_of_3_recall_floors", "Moderate|High")


def test_reconstructed_labels_prefer_their_sources(spark):
    rows = [("a", "original_round", "person1", 4.0, True), ("a", "original_round", "person2", 2.0, True), ("b", "original_round", "person1", 8.0, True), ("b", "original_round", "person2", 6.0, True)]
    rows += [("c", "original_extra_person1_round", "person1", 5.0, True), ("c", "active_learning_round", "person2", 3.0, True), ("d", "active_learning_round", "person2", 4.0, True), ("d", "active_learning_round", "person1_estimated", 9.0, False)]
    found = {r.unique_post_id: r for r in calibration.reconstruct_labels(spark.createDataFrame(rows, "unique_post_id string, label_round string, annotator string, stress double, observed boolean")).collect()}
    assert math.isclose(found["a"].final_stress, (4 * 1.7 + 2) / 2.7) and found["a"].label_source == "original_dual"
    assert found["c"].final_stress == 5.0 and found["c"].versions == 2 and found["c"].canonical_preference_rank == 2
    # The line through (2, 4) and (6, 8) makes 6 of the second person's 4.
    assert math.isclose(found["d"].person1_estimated, 6.0) and math.isclose(found["d"].final_stress, (6 * 1.7 + 4) / 2.7) and found["d"].default_label_weight == 0.65


def _isotonic(points):
    """The monotone means of (x, y) by pooling neighbours, one by one."""
    blocks = []
    for x, ys in sorted(points.items()):
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_calibrators_against_fits_by_hand(spark):
    rng = random.Random(2)
    rows = [(min(10.0, max(1.0, round(2 * (t + rng.gauss(0, 1))) / 2)), min(10.0, max(1.0, round(2 * (0.8 * t + rng.gauss(0, 1))) / 2)), i % 5) for i, t in enumerate(rng.uniform(1, 10) for _ in range(300))]
    found = {r.calibrator: r for r in calibration.calibrator_errors(spark.createDataFrame(rows, "p1 double, p2 double, f int"), F.col("f")).collect()}
    off = {c: [] for c in found}
    for k in range(5):
        train, test = [r for r in rows if r[2] != k], [r for r in rows if r[2] == k]
        mix = lambda a, b: (1.7 * a + b) / 2.7
        x, y, z = [r[1] for r in train], [mix(r[0], r[1]) for r in train], [r[0] for r in train]
        line, first = statistics.linear_regression(x, y), statistics.linear_regression(x, z)
        by = {}
        for a, b in zip(x, y):
            by.setdefault(a, []).append(b)
        rising = _isotonic(by)
        for p1, p2, _ in test:
            told = {"identity": p2, "mean_shift": p2 + statistics.fmean(y) - statistics.fmean(x), "linear": line.intercept + line.slope * p2, "linear_first": mix(first.intercept + first.slope * p2, p2), "isotonic": rising.get(p2), "lookup": statistics.fmean(by.get(p2, y))}
            for c, v in told.items():
                off[c].append(abs(v - mix(p1, p2)))
    for c, errors in off.items():
        assert math.isclose(found[c].mae, statistics.fmean(errors), rel_tol=1e-9)


def test_quantiles_and_positions(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[float(rng.randrange(50)) for _ in range(20)]])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in running.quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], by=["g"]).collect()}
    for g in ("a", "b", None):
        values = sorted(v for x, v in rows if x == g and v is not None and v == v)
        at = 0.3 * (len(values) - 1)
        want = values[int(at)] + (values[math.ceil(at)] - values[int(at)]) * (at - int(at))
        assert (found[g].q0, found[g].q2, found[g].q3) == (values[0], statistics.median(values), values[-1]) and math.isclose(found[g].q1, want)
    assert running.quantiles(df.where("false"), "v", [0.5]).collect()[0].q0 is None
    placed = {r.v: r.p for r in running.positions(spark.range(500).select(((F.col("id") * 7919) % 500).alias("v")), [F.desc("v")], "p").collect()}
    assert placed == {v: 499 - v for v in range(500)}


def test_digest_depends_on_rows_alone(spark):
    df = spark.createDataFrame([(f"i{i:03d}", i / 7) for i in range(100)], "id string, v double")
    one = labels.dataset_digest(df, "id", "v", chunk=7).first().digest
    assert one == labels.dataset_digest(df.repartition(5).orderBy(F.desc("v")), "id", "v", chunk=7).first().digest
    assert one != labels.dataset_digest(df.where("id <> 'i050'"), "id", "v", chunk=7).first().digest


def test_ladder_ends_with_the_fuzzy_rung(spark):
    text = "this is a rather long text about the weather of today "
    wanted = spark.createDataFrame([("a", text + "x"), ("b", "short"), ("c", text), (" ", text), ("d", text)], "id string, content string")
    records = spark.createDataFrame([("a", 1, text + "y"), ("a", 2, "else"), ("b", 3, "other"), ("b", 4, "words"), ("c", 5, text), ("c", 6, "x"), ("d", 7, text + "1"), ("d", 8, text + "2")], "id string, row_ordinal long, content string")
    hashed = lambda df: df.withColumns({"content_hash": labels.content_hash(F.col("content")), "fingerprint": F.col("content")} if "row_ordinal" in df.columns else {"content_hash": labels.content_hash(F.col("content"))})
    found = {r.id: (r.outcome, r.row_ordinal) for r in labels.resolve_with_fuzzy(hashed(wanted), hashed(records)).collect()}
    assert found == {"a": ("fuzzy_match", 1), "b": ("content_mismatch", None), "c": ("exact_content_match", 5), " ": ("missing_id", None), "d": ("content_mismatch", None)}


def test_compositions(spark):
    df = spark.createDataFrame([(1, "a", 5)], "id int, x string, y int")
    assert relations.with_defaults(df, {"x": "z", "n": 3}, ["y", "none"]).columns == ["id", "x", "n"] and relations.with_defaults(df, {"x": "z", "n": 3}).first().x == "a"
    assert relations.prefixed(df, "label__", ["id"]).columns == ["id", "label__x", "label__y"]
    other = spark.createDataFrame([(1, "b")], "id int, x string")
    assert relations.merged(df, other, "id", ("_l", "_r"), "_r").first().x == "b"
    kept = spark.createDataFrame([("-1",), (" None ",), ("نامشخص",), ("",), (None,), ("x",)], "v string").where(relations.meaningful(F.col("v"))).collect()
    assert [r.v for r in kept] == ["x"]
    with pytest.raises(Exception, match="not a number: x1"):
        spark.createDataFrame([("1.5",), ("x1",)], "v string").select(relations.strict_number(F.col("v"))).collect()
    ids = spark.createDataFrame([("۱۲٣", ), ("Ａ‌b  c",), ("7.0",), (None,)], "v string")
    assert [tuple(r) for r in ids.select(labels.normal_id(F.col("v")), labels.normal_id(F.col("v"), True)).collect()] == [("۱۲٣", "۱۲٣"), ("A b c", "A‌b c"), ("7", "7.0"), ("", "")]
    padded = spark.createDataFrame([(["a", "b", "c"],), ([],)], "w array<string>").select(features.padded_words(F.col("w"), 2).alias("p")).collect()
    assert [r.p for r in padded] == [["a", "b"], ["<pad>", "<pad>"]]


def test_models_out_of_fold_are_stored_and_served(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"i{i}", x := rng.uniform(0, 10), None if i % 7 == 0 else rng.uniform(0, 1), rng.choice(["u", "v", None]), 2 * x + rng.gauss(0, 0.1), i % 3, 1.0 if i % 5 else 0.0) for i in range(180)]
    df = spark.createDataFrame(rows, "id string, x double, z double, c string, y double, fold int, w double").fillna("missing", ["c"])
    columns = models.columns_of(df, ["id", "y", "fold", "w"])
    assert columns.numbers == ("x", "z") and columns.categories == ("c",)
    fitted = models.train_folds(df, columns, "y", "fold", 3, "w", models.Trees(8, 4))
    out = models.out_of_fold(df, fitted, columns, "fold").collect()
    assert len(out) == 180 and statistics.fmean(abs(r.prediction - r.y) for r in out) < 1.5
    # A row's prediction is that of the one model that has not seen its fold.
    alone = {r.id: r.p for r in models.predict(df.where("fold = 1"), fitted[1], columns, "p").collect()}
    assert all(r.prediction == alone[r.id] for r in out if r.fold == 1)
    models.save(fitted, columns, str(tmp_path / "m"), df)
    served = {r.id: r for r in models.serve(df.drop("z"), str(tmp_path / "m"), "id").collect()}
    again = {r.id: r for r in models.serve(df, str(tmp_path / "m"), "id").collect()}
    direct = {r.id: r for r in models.ensemble(df, fitted, columns).collect()}
    assert len(served) == 180 and all(again[i].prediction == direct[i].prediction for i in direct)


def test_guards(spark, tmp_path):
    marker, calls = str(tmp_path / "marker.json"), []
    run = lambda: calls.append(1) or {"mae": 0.5}
    with pytest.raises(contracts.ContractError, match="confirmed"):
        contracts.evaluate_once(spark, marker, run, confirmed=False)
    assert contracts.evaluate_once(spark, marker, run, confirmed=True) == {"mae": 0.5}
    with pytest.raises(contracts.ContractError, match="evaluated before"):
        contracts.evaluate_once(spark, marker, run, confirmed=True)
    contracts.evaluate_once(spark, marker, run, confirmed=True, force=True)
    assert len(calls) == 2
    rows = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    cache = spark.createDataFrame([("1", "a"), ("1", "b")], "match_key string, v string")
    key = F.col("k").cast("string")
    with pytest.raises(ValueError, match="repeats a match_key"):
        cleaning.with_provenance(rows, cache, key, ["v"], "source", strict=True)
    filled = cleaning.with_provenance(rows, cache.limit(1), key, ["v"], "source", strict=True, complete=True)
    assert {r.k: r.source for r in filled.collect()} == {1: "cache", 2: "original"}
    with pytest.raises(ValueError, match="rows without v"):
        cleaning.with_provenance(rows, cache.where("false"), key, ["v"], "source", complete=True)
    with pytest.raises(ValueError, match="id repeats"):
        labels.read_labels(spark.createDataFrame([("Ａ",), ("A",)], "id string"), "id")
    assert labels.read_labels(spark.createDataFrame([("7.0",), ("",), (None,)], "id string"), "id").count() == 3


def test_any_stemmer_and_any_text_model(spark):
    df = spark.createDataFrame([(["walks", "walk"],), ([],), (None,)], "w array<string>")
    assert [r.s for r in df.select(features.stemmed(F.col("w"), lambda w: w.rstrip("s")).alias("s")).collect()] == [["walk", "walk"], [], None]
    assert features.stemmed(F.col("w")) is not None and df.select(features.stemmed(F.col("w")).alias("s")).first().s == ["walks", "walk"]
    texts = spark.createDataFrame([("abc",), (None,), ("x" * 50,)], "t string")

    def make():
        return lambda part: [len(t) for t in part] if len(part) <= 2 else []

    assert [r.p for r in models.predict_batches(texts, make, "t", "p", batch=2, low=1.0, high=10.0).collect()] == [3.0, None, 10.0]


def test_alignment_and_weights(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    found = {r.table: (r.ids, r.missing, r.unexpected) for r in contracts.alignment({"a": ids("1", "2", "2", None), "b": ids("2", "3"), "c": ids("1", "2")}, "id").collect()}
    assert found == {"a": (2, 0, 0), "b": (2, 1, 1), "c": (2, 0, 0)}
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, True), ("b", 5.0, False)], "label string, w double, train boolean")
    weights = [r.training_weight for r in labels.sample_weights(df, "label", "w", F.col("train")).collect()]
    assert sum(x is None for x in weights) == 1 and math.isclose(statistics.fmean(x for x in weights if x is not None), 1.0)


def test_history_of_a_hot_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(300)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    found = {r.id: (r.so_far, [x.id for x in r.recent]) for r in running.history(df, "k", "t", ["id"], ["id"], 4, buckets=16).collect()}
    assert len(found) == 900
    for key in ("hot", "a", None):
        ordered = [i for k, t, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        assert all(found[i] == (n + 1, ordered[max(0, n - 3) : n + 1]) for n, i in enumerate(ordered))
