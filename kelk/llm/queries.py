"""Queries of the training-data problems, by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelk.llm import capping, confusables, consensus, mixing, overlap, packing, personal, splits, webspam
from kelk.llm.tokens import token_count
from kelk.session import table

POSTS = "ninisite_cleaned_enriched"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose content or unique_post_id looks the same but is stored differently."""
    return confusables.look_alike_pairs(table(spark, sf_dir, POSTS), "row_ordinal", ["content", "unique_post_id"])


def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with content and unique_post_id in their consistent form."""
    return confusables.consistent_form(table(spark, sf_dir, POSTS), ["content", "unique_post_id"]).select("row_ordinal", "unique_post_id", "content")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose content or unique_post_id looks like another one stored differently, with the key of its group, one row each."""
    return confusables.look_alike_groups(table(spark, sf_dir, POSTS), "row_ordinal", ["content", "unique_post_id"]).select("field", F.col("row").alias("row_ordinal"), "k1", "k2", "group_rows")


def _split_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "modeling_manifest_v2"), table(spark, sf_dir, "duplicate_content_audit")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a validation or test record with the same text."""
    pairs = overlap.cross_split_overlaps(*_split_texts(spark, sf_dir))
    return pairs.select(F.least("eval_id", "train_id").alias("post_a"), F.greatest("eval_id", "train_id").alias("post_b")).distinct()


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the splits with the key of its text and the number of texts of the other side that it overlaps with."""
    records, links = overlap.overlapping_texts(*_split_texts(spark, sf_dir))
    ends = links.select(F.lit(False).alias("trains"), F.col("e1").alias("k1"), F.col("e2").alias("k2")).unionByName(links.select(F.lit(True).alias("trains"), F.col("t1").alias("k1"), F.col("t2").alias("k2")))
    counts = ends.groupBy("trains", "k1", "k2").agg(F.count("*").alias("links"))
    return records.join(counts, ["trains", "k1", "k2"], "left").select("unique_post_id", "model_role", "k1", "k2", F.coalesce("links", F.lit(0)).alias("links"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records per model_role and label_source."""
    return overlap.overlap_report(*_split_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of related sets that the present roles or folds tear apart."""
    out = splits.assign_splits(table(spark, sf_dir, "modeling_manifest_v2"))
    return out.where("mixed").select("unique_post_id", "related_min_id")


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split and fold of every record."""
    return splits.assign_splits(table(spark, sf_dir, "modeling_manifest_v2")).drop("mixed")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in each split and fold of the new assignment against what their shares ask for, over all and by class."""
    manifest = table(spark, sf_dir, "modeling_manifest_v2")
    return splits.split_report(splits.assign_splits(manifest), manifest)


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "annotation_history"), table(spark, sf_dir, "canonical_labels")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose final_stress the labels of their reliable annotators contradict."""
    return consensus.contradicted(*_labels(spark, sf_dir)).select("unique_post_id")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, certainty and agreement per post."""
    return consensus.consensus(*_labels(spark, sf_dir))[0]


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator."""
    return consensus.consensus(*_labels(spark, sf_dir))[1]


def p5_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each annotator gives each label, by the true stress."""
    return consensus.consensus(*_labels(spark, sf_dir))[2]


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of all usable labels."""
    return consensus.krippendorff_alpha(consensus.usable_labels(*_labels(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the types of personal information in their content."""
    return personal.find_personal(table(spark, sf_dir, POSTS)).select(F.col("row").alias("row_ordinal"), "pii_type").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with typed placeholders for the personal information in its content."""
    return personal.redact(table(spark, sf_dir, POSTS).select("row_ordinal", "content"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the first 25 of their contributor."""
    return capping.displaced_posts(table(spark, sf_dir, POSTS)).select("row_ordinal")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts that stay when each contributor keeps the best 25."""
    posts = table(spark, sf_dir, POSTS)
    return capping.kept_posts(posts)


def p7_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond a hundredth of all posts with an author of their contributor."""
    return capping.displaced_posts(table(spark, sf_dir, POSTS), None, share=0.01).select("row_ordinal")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut only if it is larger than 2,048 tokens, and the container of each piece."""
    return packing.pack(_sized(spark, sf_dir), "doc_id", "tokens")[0]


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and containers needed at least, by partition and as a whole."""
    return packing.pack(_sized(spark, sf_dir), "doc_id", "tokens")[1]


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources reach."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are spam."""
    return webspam.spam_scores(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of spam words and the mean information of neighbouring words of every document."""
    return webspam.spam_scores(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_normalised": p1_normalised, "p1_groups": p1_groups, "p2_found": p2_found, "p2_report": p2_report, "p2_texts": p2_texts, "p4_found": p4_found, "p4_assignment": p4_assignment, "p4_report": p4_report, "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_annotators": p5_annotators, "p5_confusions": p5_confusions, "p5_agreement": p5_agreement, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_kept": p7_kept, "p7_share": p7_share, "p8_containers": p8_containers, "p8_certificate": p8_certificate, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores}
_RELATED = """
WITH RECURSIVE rec AS (SELECT DISTINCT unique_post_id AS id, group_id, author, thread_id, content_hash, model_role, oof_fold FROM modeling_manifest_v2),
held AS (SELECT id, 'g' AS k, group_id AS v FROM rec UNION ALL SELECT id, 'a', author FROM rec UNION ALL SELECT id, 't', thread_id FROM rec UNION ALL SELECT id, 'c', content_hash FROM rec),
val AS (SELECT DISTINCT id, k, v FROM held WHERE v IS NOT NULL AND trim(v) <> ''),
edge AS (SELECT DISTINCT a.id AS x, b.id AS y FROM val a JOIN val b USING (k, v)),
reach AS (SELECT DISTINCT id AS a, id AS b FROM rec UNION SELECT r.a, e.y FROM reach r JOIN edge e ON e.x = r.b),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
bad AS (SELECT c FROM comp JOIN rec USING (id) GROUP BY c
  HAVING count(DISTINCT CASE WHEN model_role IN ('train', 'validation', 'test') THEN model_role END) > 1 OR count(DISTINCT CASE WHEN model_role = 'train' THEN oof_fold END) > 1)
"""
_CAP = """
SELECT CAST(row_ordinal AS BIGINT) AS row_ordinal FROM (
  SELECT row_ordinal, row_number() OVER (PARTITION BY who ORDER BY likes DESC NULLS LAST, user_post_count DESC NULLS LAST, row_ordinal) AS r, count(*) OVER () AS n
  FROM (SELECT *, translate(nfc_normalize(translate(regexp_replace(nfc_normalize(author), '[­​‌‎‏⁠﻿]', '', 'g'),
        'يىكﺎﺮﻪﯽﻢﻦﮏａｂｄｅｇｈｉｊｋｌｍｎｏｐｒｓｔｖｚ０１２３４５６７８９\u00a0\u202f\u2007\u2009\u3000аеіорѕο',
        'ییکارهیمنکabdeghijklmnoprstvz0123456789     aeiopso')), '', '') AS who FROM ninisite_cleaned_enriched WHERE trim(coalesce(author, '')) <> '')) WHERE r > 25
"""
ORACLE: dict[str, str] = {
    "p4_found": _RELATED + "SELECT id AS unique_post_id, c AS related_min_id FROM comp WHERE c IN (SELECT c FROM bad)",
    "p5_agreement": """
WITH u AS (SELECT unique_post_id AS item, annotator, stress AS v FROM annotation_history WHERE observed
  UNION SELECT unique_post_id, 'person1', person1_raw FROM canonical_labels UNION SELECT unique_post_id, 'person2', person2_raw FROM canonical_labels),
l AS (SELECT item, annotator, avg(v) AS v FROM u WHERE v BETWEEN 1 AND 10 GROUP BY ALL),
i AS (SELECT item, count(*) AS m, sum(v) AS s, sum(v * v) AS q FROM l GROUP BY item HAVING count(*) > 1),
t AS (SELECT count(*) AS k, sum(m) AS n, sum(2 * (m * q - s * s) / (m - 1)) AS w, sum(s) AS s, sum(q) AS q FROM i)
SELECT k AS n_items, CAST(n AS BIGINT) AS n_labels, 1 - (w / n) / (2 * (n * q - s * s) / (n * (n - 1))) AS alpha FROM t""",
    "p7_found": _CAP,
    "p7_share": _CAP.replace("WHERE r > 25", "WHERE r > greatest(1, floor(0.01 * n + 1e-9))"),
    "p7_kept": f"SELECT row_ordinal, likes, user_post_count FROM ninisite_cleaned_enriched WHERE row_ordinal NOT IN ({_CAP})",
}
