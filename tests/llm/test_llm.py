"""The operators for training data on small tables, against brute force, round trips and invariants."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelk.llm import capping, confusables, consensus, mixing, overlap, packing, personal, splits, tokens, webspam
from kelk.llm.confusables import skeleton

# --- 1 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("کتاب", "كتاب"), ("بازی", "بازي"), ("آب", "آب"), ("مسئله", "مسئله"), ("ABC", "ＡＢＣ"), ("CAT", "САТ"), ("a b", "a b"), ("a b", "a b"), ("۱۲", "١٢"), ("12", "１２"),
        ("نی‌نی", "نینی"), ("سلام", "س­ل​ام﻿"), ("خانه", "ﺧﺎﻧﻪ"), ("لا", "ﻻ"), ("é", "é"), ("ΒΑ", "BA"), ("a\nb", "a\r\nb"), ("𝐀", "A"), ("ᎪᏟ", "AC"), ("ꓝꓬ", "FY"), ("ⲞⲢ", "OP"), ("ɑɡ", "ag"), ("خانۀ", "خانهٔ"),
    ],
)
def test_what_looks_alike_is_one(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("۱", "1"), ("a  b", "a b"), ("a", "A"), ("ا", "آ"), ("a.", "a"), ("a b", "a\nb"), ("🌸", "🌷"), ("ه", "ة"), ("،", ",")])
def test_what_a_reader_tells_apart_stays_apart(a, b):
    assert skeleton(a) != skeleton(b)


def test_skeleton_is_stable():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x700), rng.randrange(0x2000, 0x2070), rng.randrange(0xFB50, 0xFF00), rng.randrange(0xFF00, 0xFFEF)])) for _ in range(8))
        once = skeleton(text)
        assert skeleton(once) == once == unicodedata.normalize("NFC", once) or skeleton(once) == once


def test_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    forms = ["سلام", "سلام​", "سلا‌م", "خوب ي", "خوب ی", "", "​", None, "x" * 50_000, "x" * 49_999 + "х"]
    rows = [(i, rng.choice(forms), rng.choice(["1", "１", None]), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "row_ordinal long, content string, unique_post_id string, k1 string")
    want = set()
    for f, c in (("content", 1), ("unique_post_id", 2)):
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[c] is not None and b[c] is not None and a[c] != b[c] and skeleton(a[c]) == skeleton(b[c]):
                    want.add((f, a[0], b[0]))
    found = confusables.look_alike_pairs(df, "row_ordinal", ["content", "unique_post_id"], salt_rows=20).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert confusables.look_alike_pairs(df.where("false"), "row_ordinal", ["content"]).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------------------


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], (before + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_lcs_and_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    assert all(overlap.lcs_length(a, b) == slow_lcs(a, b) for a, b in (("".join(rng.choices("abcd", k=rng.randrange(0, 90))), "".join(rng.choices("abcd", k=rng.randrange(0, 90)))) for _ in range(200)))
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 15, 40, 90]))] for _ in range(40)]
    texts = []
    for words in base:
        for _ in range(4):
            kept = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in words]
            texts.append(" ".join(kept) + rng.choice(["", "!", " ‌ ..."]))
    texts += ["", None, "!!!", "W1 w2", "w1 w2"]
    rows = [(f"p{i:03d}", rng.choice(["train", "train", "test", "validation", "embargo", None]), t) for i, t in enumerate(texts)]
    manifest = spark.createDataFrame([(i, r, "x") for i, r, _ in rows] + [(rows[0][0], rows[0][1], "x")], "unique_post_id string, model_role string, plain string")
    hashes = {i: ("h" if k >= len(rows) - 5 else None) for k, (i, _, _) in enumerate(rows)}
    contents = spark.createDataFrame([(i, t, hashes[i], "s") for i, _, t in rows] * 2, "unique_post_id string, content string, content_hash string, label_source string")
    want = set()
    for i, r, t in rows:
        for j, q, u in rows:
            if r == "train" and q in ("test", "validation"):
                a, b = overlap.plain_words(t), overlap.plain_words(u)
                if (a and b and 10 * slow_lcs(a, b) >= 7 * max(len(a), len(b))) or (not (a and b) and hashes[i] and hashes[i] == hashes[j]):
                    want.add((j, i))
    found = overlap.cross_split_overlaps(manifest, contents).collect()
    got = {(r.eval_id, r.train_id) for r in found}
    assert got == want and len(got) > 30
    assert all(0 < r.coverage <= 1 and 0.7 <= r.share <= 1 for r in found if r.method == "text")
    assert overlap.cross_split_overlaps(manifest.where("false"), contents).count() == 0


def test_overlaps_in_a_hot_group_of_near_copies():
    rng = random.Random(21)
    base = [f"w{i}" for i in range(30)]

    def variants(tag, n, size):
        out = []
        for i in range(n):
            words = base[:size]
            words[rng.randrange(size)] = f"{tag}{i}"
            out.append(" ".join(words))
        return out

    # One word each is changed, so every pair has at least size - 2 words in common; the rest share single words only.
    every_third = [" ".join(f"{w}x" if i % 4 == 3 else w for i, w in enumerate(base))]
    evaluation, training = variants("e", 300, 30) + every_third, variants("t", 200, 30) + [" ".join(base)] + ["w1 w9 other words"] * 3
    shard = overlap._Shard(evaluation)
    got = {(k, row): (covered, common) for row, text in enumerate(training) for k, covered, common in shard.near(text)}
    want = {(i, j): c for i, a in enumerate(evaluation) for j, b in enumerate(training) if 10 * (c := overlap.lcs_length(a.split(" "), b.split(" "))) >= 7 * max(len(a.split(" ")), len(b.split(" ")))}
    assert {p: c for p, (_, c) in got.items()} == want and len(want) > 300 * 200
    assert all(0 <= covered <= 30 for covered, _ in got.values())


def test_overlaps_of_repeated_words_and_refrains_in_routed_buckets(spark):
    rng = random.Random(33)
    texts = ["no no no", "haha " * 12, "haha " * 11, "a b c " * 20, "a b c " * 19 + "a b", "one", "one", "b a", "a b"]
    refrains = [" ".join(rng.choices("xyzuvw", k=3)) for _ in range(6)]
    for _ in range(80):
        refrain = rng.choice(refrains)
        texts.append(" ".join([refrain] * rng.randrange(1, 9) + rng.choices("abcdefgh", k=rng.randrange(0, 12))))
    plain = [" ".join(t.split()) for t in texts]
    want = {(a, b) for a in plain[::2] for b in plain if a != b and 10 * slow_lcs(a.split(), b.split()) >= 7 * max(len(a.split()), len(b.split()))}
    frame = lambda rows: spark.createDataFrame([(i, i + 1, t, len(t.split())) for i, t in enumerate(sorted(set(rows)))], "k1 long, k2 long, plain string, n long")
    evaluation, training = frame(plain[::2]), frame(plain)
    left, right = sorted(set(plain[::2])), sorted(set(plain))
    # One bucket, and many: buckets of 40 words, shards of 20 and slices of 30.
    for sizes in ((10**6, 10**6, 10**6), (40, 20, 30)):
        found = overlap.near_texts(evaluation, training, *sizes).collect()
        assert {(left[r.e1], right[r.t1]) for r in found} == want and len(found) == len(want) > 20
        assert all(r.common <= r.eval_words and 0 <= r.covered <= r.eval_words for r in found)


def test_equal_repetitive_texts_overlap(spark):
    rows = [("a1", "train", "no no no"), ("a2", "test", "no no no"), ("b1", "train", "haha " * 12), ("b2", "validation", "haha! " * 12), ("c1", "train", "a b c " * 20), ("c2", "test", "a b c " * 20), ("d1", "test", None)]
    manifest = spark.createDataFrame([(i, r) for i, r, _ in rows], "unique_post_id string, model_role string")
    contents = spark.createDataFrame([(i, t, "h" if i in ("d1", "a1") else None, "s") for i, _, t in rows], "unique_post_id string, content string, content_hash string, label_source string")
    found = {(r.eval_id, r.train_id): r.coverage for r in overlap.cross_split_overlaps(manifest, contents).collect()}
    assert found == {("a2", "a1"): 1.0, ("b2", "b1"): 1.0, ("c2", "c1"): 1.0, ("d1", "a1"): None}
    report = {r.model_role: (r.records, r.overlapping, r.links) for r in overlap.overlap_report(manifest, contents).collect()}
    assert report == {"test": (3, 3, 3), "validation": (1, 1, 1)}


def test_near_texts_are_paired_without_copies(spark):
    rng = random.Random(52)
    texts = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame([(i, i + 1, t, 12) for i, t in enumerate(sorted(set(rows)))], "k1 long, k2 long, plain string, n long")
    # Twenty shards and more meet as many slices, in one bucket and in many; a shuffle would hold each text as often.
    for bucket in (10**6, 60):
        found = overlap.near_texts(frame(texts[:30]), frame(texts), bucket, 20, 20)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        left, right = sorted(set(texts[:30])), sorted(set(texts))
        want = {(a, b) for a in left for b in right if a != b and 10 * slow_lcs(a.split(), b.split()) >= 7 * 12}
        assert {(left[r.e1], right[r.t1]) for r in found.collect()} == want


@pytest.mark.parametrize("bits", [0, 64, 1 << 26])
def test_near_texts_by_bits_or_lists_of_leading_words(monkeypatch, bits):
    monkeypatch.setattr(overlap, "BITS_BYTES", bits)
    rng = random.Random(53)
    base = [[f"w{int(300 * rng.random() ** 2)}" for _ in range(rng.choice([1, 4, 9, 20, 25, 40, 70, 400]))] for _ in range(40)]
    texts = [" ".join(w if rng.random() > change else f"w{rng.randrange(300)}" for w in words) for words in base for change in (0, 0.1, 0.2, 0.27, 0.33)]
    evaluation, training = texts[::2], texts[1::2] + ["no word of these", *texts[:20]]
    got = {(k, row): common for k, row, _, common in overlap._Shard(evaluation).near_all(overlap._Texts(training))}
    lcs = {(i, j): overlap.lcs_length(a.split(), b.split()) for i, a in enumerate(evaluation) for j, b in enumerate(training) if a != b}
    assert got == {(i, j): c for (i, j), c in lcs.items() if 10 * c >= 7 * max(len(evaluation[i].split()), len(training[j].split()))} and len(got) > 100
    assert not list(overlap._Shard([]).near_all(overlap._Texts(training))) and not list(overlap._Shard(evaluation).near_all(overlap._Texts([])))


# --- 4 ------------------------------------------------------------------------------------------------------------------------


def test_splits_keep_components_and_shares(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        g = rng.randrange(1200)
        rows.append((f"u{i:05d}", f"g{g}", None if rng.random() < 0.3 else "guest" if g < 120 else f"a{g}", "", None, rng.choice(["Low", "High", None]), "train", g % 5 if g % 50 else rng.randrange(5), 1))
    schema = "unique_post_id string, group_id string, author string, thread_id string, content_hash string, clinical_class string, model_role string, oof_fold int, size int"
    out = splits.assign_splits(spark.createDataFrame(rows + rows[:50], schema)).toPandas()
    assert len(out) == 3000 and out.groupby("related_min_id").split.nunique().max() == 1 and out.groupby("related_min_id").new_fold.nunique(dropna=False).max() == 1
    shares = out.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["test"] - 0.15) < 0.02
    assert (out.new_fold.notna() == (out.split == "train")).all()
    folds = out[out.split == "train"].new_fold.value_counts(normalize=True)
    assert len(folds) == 5 and abs(folds - 0.2).max() < 0.03
    assert out[out.mixed].related_min_id.nunique() > 0
    assert splits.assign_splits(spark.createDataFrame([], schema)).count() == 0


def test_anneal_never_ends_worse_than_it_starts():
    rng = np.random.default_rng(1)
    counts = np.c_[rng.integers(1, 30, 200), rng.integers(0, 9, 200)].astype(float)
    targets = np.outer([0.5, 0.3, 0.2], counts.sum(0))
    cost = lambda s: (np.abs(np.array([counts[s == k].sum(0) for k in range(3)]) - targets) * np.array([1, splits.LABEL_WEIGHT]) / targets).sum()
    start = rng.integers(3, size=200)
    end = splits.anneal(counts, start, targets, 3)
    assert cost(end) < 0.05 * cost(start) or cost(end) < 0.02


# --- 5 ------------------------------------------------------------------------------------------------------------------------


def test_consensus_finds_wrong_labels_and_bad_annotators(spark):
    rng = random.Random(10)
    history, canonical, wrong = [], [], set()
    for i in range(400):
        truth = rng.choice([1.5, 2.5, 3.0, 5.0, 7.0, 9.0])
        item = f"p{i}"
        for a in rng.sample(range(8), 4):
            noisy = truth + rng.choice([-0.5, 0, 0, 0.5]) if a < 5 else rng.uniform(1, 10) if a < 7 else 11 - truth
            history.append((item, f"a{a}", min(10.0, max(1.0, noisy)), True))
        history += [(item, "guess", 9.9, False), (item, "a0", 99.0, True), (item, "a1", None, True), (None, "a1", 3.0, True)]
        bad = i % 20 == 0
        final = (truth + 4 if truth < 5 else truth - 4) if bad else truth + rng.uniform(-0.5, 0.5)
        canonical.append((item, f"word{int(truth)}" if i % 3 else None, final, None, float("nan") if i % 2 else None))
        if bad:
            wrong.add(item)
    h = spark.createDataFrame(history + history[:100], "unique_post_id string, annotator string, stress double, observed boolean")
    c = spark.createDataFrame(canonical, "unique_post_id string, content string, final_stress double, person1_raw double, person2_raw double")
    posts, people, cells = consensus.consensus(h, c)
    reliable = {r.annotator for r in people.collect() if r.reliable}
    assert reliable == {f"a{k}" for k in range(5)}
    n = {r.unique_post_id: r.n_annotators for r in posts.collect()}
    found = {r.unique_post_id for r in consensus.contradicted(h, c).collect()}
    assert found <= {i for i in n if n[i] >= 3} and len(found ^ wrong) <= 3
    empty = consensus.consensus(h.where("false"), c.where("false"))
    assert all(x.count() == 0 for x in empty)
    # Each row of a matrix is a distribution; the contrary annotator's is turned round.
    rows = {}
    for r in cells.collect():
        rows.setdefault((r.annotator, r.true_stress), {})[r.label] = r.probability
    assert len(rows) == 8 * 19 and all(abs(sum(x.values()) - 1) < 1e-9 for x in rows.values())
    turned = rows["a7", 9.0]
    assert max(turned, key=turned.get) == 2.0
    # The same model with the matrices as a table.
    one = {r.unique_post_id: r.consensus for r in posts.collect()}
    two = {r.unique_post_id: r.consensus for r in consensus.consensus(h, c, sent=2)[0].collect()}
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-6


def test_posterior_corrects_biased_annotators_whom_the_median_follows(spark):
    rng = random.Random(12)
    history, canonical, wrong, medians = [], [], set(), {}
    clip = lambda x: min(10.0, max(1.0, x))
    for i in range(600):
        truth = rng.choice([2.0, 3.0, 4.0, 5.0, 6.0])
        item = f"p{i:03d}"
        honest = lambda who: (who, clip(truth + rng.choice([-0.5, 0, 0, 0.5])))  # noqa: B023, E731
        # Two honest annotators label half of the items; the others have one of them and two who are always three points too high.
        given = [honest("honest1"), honest("honest2")] if i % 2 == 0 else [honest(rng.choice(["honest1", "honest2"])), ("high1", truth + 3), ("high2", clip(truth + 3 + rng.choice([-0.5, 0, 0.5])))]
        history += [(item, a, v, True) for a, v in given]
        bad = i % 10 == 1
        final = truth + 3 if bad else truth
        if len(given) > 2:
            medians[item] = abs(final - float(np.median([v for _, v in given])))
        canonical.append((item, " ".join([f"mood{int(truth)}", f"feeling{int(truth)}", f"w{rng.randrange(40)}"]), final, None, None))
        if bad:
            wrong.add(item)
    h = spark.createDataFrame(history, "unique_post_id string, annotator string, stress double, observed boolean")
    c = spark.createDataFrame(canonical, "unique_post_id string, content string, final_stress double, person1_raw double, person2_raw double")
    by_median = {i for i, off in medians.items() if off >= consensus.CONTRADICTION}
    found = {r.unique_post_id for r in consensus.contradicted(h, c).collect()}
    assert len(found ^ wrong) <= 3, (len(found), len(wrong), len(found & wrong))
    assert not wrong & by_median
    plain = {r.unique_post_id: r.consensus for r in consensus.consensus(h, c, classifier=False)[0].collect()}
    informed = {r.unique_post_id: r.consensus for r in consensus.consensus(h, c)[0].collect()}
    assert max(abs(plain[i] - informed[i]) for i in plain) > 0.1


def test_alpha_of_agreement(spark):
    labels = spark.createDataFrame([(f"i{k}", a, float(k)) for k in range(5) for a in "xy"] + [("alone", "x", 3.0)], "item string, annotator string, value double")
    assert consensus.krippendorff_alpha(labels).first().alpha == 1.0
    assert consensus.krippendorff_alpha(labels.where("false")).first().alpha is None


# --- 6 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("ایمیلم a.b_3@mail.example هست", ["email"]), ("a3 (at) mail (dot) example", ["email"]), ("a3[at]mail.example", ["email"]), ("a3 ات ساین mail نقطه example", ["email"]), ("@maman_3 بیا", []),
        ("زنگ بزن ۰۹۱۲ ۳۴۵ ۶۷ ۸۹", ["phone"]), ("+98 912 345 6789", ["phone"]), ("00989123456789", ["phone"]), ("(029) 5824 4878", ["phone"]), ("0 9 1 2 3 4 5 6 7 8 9", ["phone"]), ("با ۱۱۵ تماس", []),
        ("کد ملیم 8561691697 هست", ["id_number"]), ("کد ملی: 899-885422-8", ["id_number"]), ("کد پیگیری 9565779769 رو گرفتم", []), ("شماره پاسپورتم X12345678", ["id_number"]), ("شماره تاپیک 13368378", []), ("فاکتور شد ۳۲۱۹۳۰۳۶ تومن", []),
        ("خیابان چنار خشک پلاک 49 طبقه 7ه", ["address"]), ("بلوار لاله نبش کوچه انار ساختمان 15 واحد 2", ["address"]), ("رفتیم خیابون تا سر کوچه", []), ("12, Anar St, Unit 3, بادامک", ["address"]),
        ("اسم: مینا فامیل: رودکامپور", ["name", "name"]), ("وقتی اسم حرف فامیل میاد", []), ("تاریخ 1402/02/12 نوبت دارم", []), ("", []),
    ],
)
def test_forms_of_personal_information(text, kinds):
    assert [k for _, _, k in personal.structured(skeleton(text))] == kinds


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("شماره‌م صفر نه هفت یک یک چهار هفت هفت سه هشت شش هست", ["phone"]), ("(صفر، نه، هفت، صفر، چهار، چهار، یک، هشت، چهار، یک، شش) خط خودمه", ["phone"]), ("صفر نهصد و دوازده سیصد و چهل و پنج شصت و هفت هشتاد و نه", ["phone"]),
        ("zero nine one two three four five six seven eight nine", ["phone"]), ("صفر نه ۱۲ ۳۴۵ شش هفت ۸۹", ["phone"]), ("نود و هشت نه یک دو سه چهار پنج شش هفت هشت نه", ["phone"]), ("ساعت ۲ صفر نه یک دو سه چهار پنج شش هفت هشت نه", ["phone"]),
        ("کد ملیم هشت پنج شش یک شش نه یک شش نه هفت هست", ["id_number"]), ("تا ده شمردم یک دو سه چهار پنج شش هفت هشت نه ده", []), ("صفر یک دو سه چهار پنج شش هفت هشت نه ده", []), ("دو سه تا بچه، یک دو سه", []), ("کد پیگیری صفر نه یک دو سه چهار پنج شش هفت هشت نه", []),
    ],
)
def test_numbers_in_words(text, kinds):
    flat = skeleton(text)
    found = personal.structured(flat)
    assert [k for _, _, k in found] == kinds
    assert all(flat[stop - 1 : stop + 1].strip() and not flat[stop : stop + 1].isalnum() for _, stop, _ in found)


def test_names_are_bootstrapped_and_the_rest_unchanged(spark):
    rng = random.Random(11)
    known, unknown, families = ["مینا", "شیوا", "نگار", "آرمان"], ["گوهرشاد", "کیومرث"], [f"خاندان{c}پور" for c in "ابپتثجچحخد"]
    frames = ["پرونده به اسم {} باز شده", "با احترام {}", "برای نوبت بگید {} معرفی کرده", "نتیجه رو {} امضا کرد"]
    fill = ["امروز هوا خوب بود و رفتیم پارک", "اسم بچه رو شیوا بذاریم یا ترانه", "دکتر گفت استراحت کن"]
    rows, want = [], set()
    for i in range(600):
        text = rng.choice(fill)
        if i % 10 == 0:
            text = f"{text}. {rng.choice(frames).format(f'{rng.choice(known + unknown)} {rng.choice(families)}')}"
            want.add(i)
        rows.append((i, text, "c"))
    rows += [(1000, None, "c"), (1001, "", "c"), (1002, "خوب " * 20_000 + "تلفن 09123456789", "c")]
    df = spark.createDataFrame(rows, "row_ordinal long, content string, hash string")
    found = personal.find_personal(df).collect()
    assert {r.row for r in found if r.pii_type == "name"} == want
    # The same with the trusted names and patterns joined instead of sent.
    assert sorted(map(tuple, found)) == sorted(map(tuple, personal.find_personal(df, sent=0).collect()))
    out = {r.row_ordinal: r.content for r in personal.redact(df).collect()}
    assert len(out) == len(rows) and out[1000] is None and out[1002].endswith("تلفن <phone>")
    for i, text, _ in rows[:600]:
        assert (out[i] == text) == (i not in want) and (i not in want or "<name>" in out[i])
    assert personal.find_personal(df.where("false")).count() == 0


def test_names_of_two_common_words(spark):
    rng = random.Random(12)
    known, families = ["شیوا", "نگار", "آرمان"], [f"خاندان{c}پور" for c in "ابپتثجچحخد"]
    fill = ["امروز هوا خوب بود و رفتیم پارک", "اسم بچه رو شیوا بذاریم یا ترانه", "دکتر گفت استراحت کن"]
    # A third of the texts are signed with one full name.
    rows = [(i, f"{rng.choice(fill)}. با احترام مینا رودکامپور") for i in range(100)]
    rows += [(1000 + i, f"{rng.choice(fill)}. با احترام {rng.choice(known)} {rng.choice(families)}") for i in range(30)]
    rows += [(2000 + i, rng.choice(fill)) for i in range(170)]
    found = personal.find_personal(spark.createDataFrame(rows, "row_ordinal long, content string")).collect()
    assert {r.row for r in found if r.pii_type == "name"} == {i for i, _ in rows if i < 2000}


def test_contexts_discover_what_has_no_form(spark):
    rng = random.Random(14)
    digits = lambda n: "".join(rng.choices("123456789", k=n))
    rows = []
    for i in range(60):
        rows.append((i, f"سلام. زنگ بزنید 09{digits(9)} ممنون"))
        rows.append((100 + i, f"دوستان ایمیل من {'abcdefgh'[i % 8]}x{i}@mail.example است"))
        rows.append((200 + i, f"آدرس ما خیابان چنار{i} پلاک {i + 1} نزدیک مترو"))
        rows.append((300 + i, f"کد پیگیری {digits(10)} رو گرفتم"))
    # No form tells these: a number of nine digits, an address of mail without a dot, a street without a house.
    rows += [(1000, f"سلام. زنگ بزنید 2{digits(8)} ممنون"), (1001, "دوستان ایمیل من someone@localhost است"), (1002, "آدرس ما خیابان لاله 17 نزدیک مترو")]
    rows += [(1003, f"کد پیگیری {digits(9)} رو گرفتم"), (1004, f"مبلغ {digits(9)} واریز شد"), (1005, "رفتیم خیابان نور 17 بار")]
    df = spark.createDataFrame(rows, "row_ordinal long, content string")
    found = {(r.row, r.pii_type) for r in personal.find_personal(df).collect() if r.row >= 1000}
    assert found == {(1000, "phone"), (1001, "email"), (1002, "address")}


def test_windows_are_placed_as_they_are_counted():
    rng = random.Random(15)
    for _ in range(300):
        flat = "".join(rng.choice(["ab", "c", " ", "  ", "\n", ".", "12", "_", "de", "9"]) for _ in range(rng.randrange(40)))
        windows = personal._Windows({}, [flat, "xx yy"])
        places = personal._window_places(flat)
        assert len(windows.first) == len(places) + 1 and windows.text.tolist() == [0] * len(places) + [1]
        for (start, stop), first in zip(places, windows.first.tolist()):
            assert personal._word_code(re.match(r"[^\W\d_]+", flat[start:stop])[0]) == first


def test_places_lead_back_to_the_original():
    text = "شماره‌م ٠٩١‌٢٣٤٥٦‏٧٨٩ هست آ"
    places = personal.original_places(text)
    flat = skeleton(text)
    (start, stop, kind), = personal.structured(flat)
    assert kind == "phone" and text[places[start] : places[stop - 1] + 1] == "٠٩١‌٢٣٤٥٦‏٧٨٩"


# --- 7 ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 3])
def test_cap_against_sorting(spark, batches):
    rng = random.Random(12)
    rows = [(i, rng.choice(["کاربر", "كاربر", "کاربر​", "x", "", " ", None]), rng.choice([None, 0, 1, 2]), rng.choice([None, 5, 6]), "c") for i in range(500)]
    by = {}
    for i, a, likes, n, _ in rows:
        if a and a.strip():
            by.setdefault(skeleton(a), []).append((likes is None, -(likes or 0), n is None, -(n or 0), i))
    want = sorted(x[-1] for v in by.values() for x in sorted(v)[25:])
    df = spark.createDataFrame(rows, "row_ordinal long, author string, likes int, user_post_count int, place string")
    assert sorted(r.row_ordinal for r in capping.displaced_posts(df, 25, batches).collect()) == want
    assert capping.kept_posts(df, 25, batches).count() == 500 - len(want)
    assert capping.displaced_posts(df.where("false")).count() == 0
    # A share of the posts with an author.
    most = max(1, int(0.2 * sum(map(len, by.values()))))
    assert sorted(r.row_ordinal for r in capping.displaced_posts(df, None, batches, share=0.2).collect()) == sorted(x[-1] for v in by.values() for x in sorted(v)[most:])


def test_cap_goes_on_from_its_stored_state(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, rng.choice("aaab"), rng.choice([None, 0, 1, 2]), rng.choice([None, 5, 6])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_ordinal long, author string, likes int, user_post_count int")
    whole = sorted(r.row_ordinal for r in capping.displaced_posts(df, 20, 1).collect())
    for part in ("row_ordinal < 150", "row_ordinal BETWEEN 150 AND 151", "row_ordinal > 151"):
        table = capping.CapTable(spark, str(tmp_path / "cap")).update(capping.contributors(df.where(part)), 20)
    again = capping.CapTable(spark, str(tmp_path / "cap"))
    assert again.version == table.version == 3 and again.seen == 400 and again.kept().count() == 40
    assert sorted(r.id for r in again.displaced().collect()) == whole
    # A version that was not finished doesn't count; a higher cap takes records back, a lower one is refused.
    (tmp_path / "cap" / "v4" / "kept").mkdir(parents=True)
    raised = again.update(capping.contributors(df.where("false")), 30)
    assert sorted(r.id for r in raised.displaced().collect()) == sorted(r.row_ordinal for r in capping.displaced_posts(df, 30, 1).collect())
    with pytest.raises(ValueError, match="the cap was 30"):
        raised.update(capping.contributors(df), 20)


# --- 8 ------------------------------------------------------------------------------------------------------------------------


def test_packing_fills_and_loses_nothing(spark):
    rng = random.Random(13)
    sizes = [rng.choice([0, rng.randrange(1, 60), rng.randrange(1, 101), 100, 250]) for _ in range(800)]
    df = spark.createDataFrame([(i, s if i else None, 1) for i, s in enumerate(sizes)], "id long, n int, part int")
    out, proof = packing.pack(df, "id", "n", capacity=100, partition_items=200)
    rows = out.toPandas()
    filled = rows[rows.tokens > 0].groupby("container_id").tokens.sum()
    assert filled.max() <= 100 and rows.groupby("id").tokens.sum().to_dict() == {i: s if i else 0 for i, s in enumerate(sizes)}
    cut_items = rows.groupby("id").size()
    assert all((cut_items[i] > 1) == (s > 100) for i, s in enumerate(sizes) if i)
    proofs = {r.step: r for r in proof.collect()}
    assert proofs["all"].containers == len(filled) >= proofs["all"].bound and proofs["all"].containers - proofs["all"].bound <= 4
    assert packing.pack(df.where("false"), "id", "n")[0].count() == 0


def test_bound_is_below_and_best_fit_is_a_packing():
    rng = np.random.default_rng(14)
    for _ in range(60):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins = packing.best_fit_decreasing(sizes, 100)
        used = np.bincount(bins, sizes)
        assert used.max() <= 100 and packing.lower_bound(sizes, 100) <= len(used)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 9), 100) == 5 and packing.lower_bound(np.array([], int), 100) == 0


def test_token_counts_are_the_tokenizers():
    import tiktoken

    tokens_of = tokens.counter()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(15)
    for _ in range(500):
        text = "".join(rng.choice(["سلام", " ", " ", "\n", "  ", "a", "don't", "12", "؟", ".", "🌸", "\t", "<|endoftext|>"]) for _ in range(rng.randrange(0, 30)))
        assert tokens_of(text) == len(whole.encode_ordinary(text)), text
    assert tokens_of(None) == 0


# --- 9 ------------------------------------------------------------------------------------------------------------------------


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(16)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", "other", None]), rng.randrange(0, 40), "x") for i in range(6000)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.18, None), ("none", 0.02, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int, place string")
    out, report = mixing.mix(df, targets)
    chosen = out.toPandas()
    shares = {r.source: r for r in report.collect()}
    assert set(chosen.source) == {"a", "b", "c"} and (chosen.tokens > 0).all() and chosen.doc_id.is_unique
    assert chosen[chosen.source == "c"].times.max() == 1 and chosen[chosen.source == "b"].times.max() <= 3
    for s, t in (("a", 0.4), ("b", 0.4), ("c", 0.18)):
        assert abs(shares[s].reached_share - t / 0.98) < 0.01
    assert shares["none"].reached_tokens == 0
    # A smaller budget's documents are among a larger one's.
    small, large = (set(mixing.mix(df, targets.where("source = 'a'"), total_tokens=n)[0].toPandas().doc_id) for n in (20_000, 60_000))
    assert small < large
    for n in (1, 777, 20_000):
        got = mixing.mix(df, targets.where("source = 'a'").withColumn("target_share", F.lit(1.0)), total_tokens=n)[0].toPandas().tokens.sum()
        assert n - 40 < got <= n
    assert mixing.mix(df.where("false"), targets)[0].count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------------------


def test_spam_pages_are_told_from_sentences(spark):
    rng = random.Random(17)
    subjects, verbs, places = [f"s{i}" for i in range(30)], [f"v{i}" for i in range(30)], [f"p{i}" for i in range(30)]
    sentence = lambda: f"the {rng.choice(subjects)} {rng.choice(verbs)} near the old {rng.choice(places)} every day"
    keywords = [f"cheap k{i}" for i in range(12)]
    rows, spam = [], set()
    for i in range(400):
        if i % 10 == 0:
            some = rng.sample(keywords, 4)
            text = rng.choice([
                ", ".join(rng.choice(some) for _ in range(40)), " ".join(f"https://shop.example/p/{rng.randrange(9999)}" for _ in range(8)), " ".join(f"#tag_{rng.randrange(99)}" for _ in range(9)),
                "\n".join(f"item {rng.randrange(99)} code {rng.randrange(9999)} price {rng.randrange(999)}" for _ in range(6)), sentence() + ". " + " | ".join(rng.choice(some) for _ in range(30)),
            ])
            spam.add(i)
        else:
            refrain = sentence()
            text = ". ".join([sentence() for _ in range(8)] + [refrain] * 2 + (["see https://a.example/x #tag"] if i % 3 == 0 else []))
        rows.append((i, text, 1))
    rows += [(900, None, 1), (901, "", 1), (902, "hi", 1), (903, ". ".join(sentence() for _ in range(5000)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = {r.doc_id: r for r in webspam.spam_scores(df).collect()}
    assert len(out) == len(rows) and {i for i, r in out.items() if r.is_spam} == spam
    assert out[900].n_words == 0 and not out[900].is_spam and out[903].n_words > 40_000
    assert webspam.spam_scores(df.where("false")).count() == 0


def test_repeats_of_a_collocation_that_ordinary_pages_hold_are_spam(spark):
    rng = random.Random(19)
    word = lambda: f"w{rng.randrange(3000)}"
    sentence = lambda: " ".join(word() for _ in range(9))
    # The repeated pairs stand in every second ordinary page, so the corpus takes them for language.
    rows = [(i, ". ".join([sentence() for _ in range(6)] + (["we bought the baby carriage here", "in the carriage baby blankets"] if i % 2 else [])), i < 0) for i in range(300)]
    rows += [(1000 + i, sentence() + ". " + "baby carriage " * 30, True) for i in range(5)]
    refrain = "we bought the baby carriage here. "
    rows += [(2000 + i, ". ".join(sentence() for _ in range(8)) + ". " + refrain * 4, False) for i in range(5)]
    out = {r.doc_id: r.is_spam for r in webspam.spam_scores(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()}
    assert {i for i, spam in out.items() if spam} == {i for i, _, spam in rows if spam}


def test_word_salad_has_low_information():
    # Common words that never stand side by side.
    common = webspam.Common(np.arange(50, dtype=np.int64), np.full(50, 2_000.0), 10_000)
    common.pairs = np.zeros(webspam.COMMON**2, np.int32)
    page = webspam.Pages(np.arange(50, dtype=np.int32), np.zeros(50, bool), np.array([0, 50]))
    assert page.information(common)[0] < webspam.SALAD
    at, pair = common.of(page.codes, page.at)
    common.pairs[pair] = 500
    assert page.information(common)[0] > 0


def test_spam_of_many_pairs_sent_or_joined(spark):
    rng = random.Random(41)
    word = lambda: f"w{rng.randrange(200_000)}"
    keywords = [f"k{i} k{i}b" for i in range(10, 22)]
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(1500)]
    # Keyword pages, of which two thirds repeat their keywords and so are suspected first.
    for i in range(90):
        picked = sorted(rng.sample(keywords, 10))
        rows.append((5000 + i, " ".join(picked + (picked[:2] * 14 if i % 3 else []))))
    rows += [(7000, "https://a.example/x www.b.example/y"), (7001, "https://a.example/p/1"), (7002, "two words"), (7003, "#one #two")]
    rows += [(1, rows[1][1]), (5000, rows[1500][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = sorted(tuple(r) for r in webspam.spam_scores(df).select("doc_id", "n_words", "spam_share", "form_share", "loss_share", "is_spam").collect())
    joined = sorted(tuple(r) for r in webspam.spam_scores(df, broadcast_rows=0).select("doc_id", "n_words", "spam_share", "form_share", "loss_share", "is_spam").collect())
    assert sent == joined and len(sent) == len(rows)
    assert {r[0] for r in sent if r[-1]} == {*range(5000, 5090), 7000, 7001, 7003}


def test_word_salad_of_words_beyond_the_commonest(spark):
    rng = random.Random(61)
    # 1,024 words fill all pages in one order; 40 others are a little rarer, so they aren't among the commonest.
    rare = [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(f"c{(140 * i + j) % webspam.COMMON}" for j in range(140)) + (" " + " ".join(rare) if i < 90 else "")) for i in range(1000)]
    rows += [(5000 + i, " ".join(rng.sample(rare, 40))) for i in range(40)]
    rows += [(6000, rows[1000][1]), (6001, "r1 r2"), (6002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # All is sent; the words are sent and their pairs joined; all is joined.
    every = [sorted(((r.doc_id, r.is_spam, round(r.information, 5) if r.information is not None else None) for r in webspam.spam_scores(df, broadcast_rows=n).collect())) for n in (2_000_000, 1_100, 0)]
    assert every[0] == every[1] == every[2]
    assert {i for i, spam, _ in every[0] if spam} == {*range(5000, 5040), 6000}
    # By brute force over all pairs.
    words = {i: (t or "").split() for i, t in rows}
    held = Counter(w for x in words.values() for w in set(x))
    pairs = Counter(p for x in words.values() for p in set(zip(x, x[1:])))
    for i, _, information in every[0]:
        told = [np.log((pairs[p] - 1 + 0.1) / e) for p in zip(words[i], words[i][1:]) if (e := held[p[0]] * held[p[1]] / len(rows)) >= webspam.EXPECTED]
        assert (information is None) == (len(told) < webspam.SALAD_PAIRS) and (information is None or abs(information - np.mean(told)) < 1e-4)
