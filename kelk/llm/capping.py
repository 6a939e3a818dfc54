"""A cap on the records of each contributor, kept up to date batch by batch.

The state is a table that is stored, one version a batch: the records that each contributor keeps, with their place in the order, and
its cutoff, the place of the last one once it is full. A batch is first filtered against the cutoffs, so of a dominant
contributor's rows hardly any get any further; the rest are merged with the kept ones, and those that fall out are logged as
displaced. Any later session goes on from the latest version. The cap is a count, or a share of all records seen so far; a share's
count grows with the records, and when it does, displaced records come back from the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kelk.llm.confusables import key_of, skeleton_of
from kelk.session import cut, shared_folder


def _place() -> Column:
    """The place in the order: both qualities descending with nulls last, then id ascending. Smaller for a better record."""
    return F.struct(F.col("q1").isNull(), -F.col("q1"), F.col("q2").isNull(), -F.col("q2"), F.col("id"))


def _ranked(df: DataFrame, limit: int) -> DataFrame:
    """The first limit of each contributor. Spark cuts each group to limit in every input partition before it shuffles."""
    by = Window.partitionBy("k1", "k2").orderBy("place")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


_RANKED = ("k1", "k2", "q1", "q2", "id")


class CapTable:
    """The stored state in a folder that all executors share; versions are complete or don't count."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.version, self.limit, self.seen, self.logs = 0, 0, 0, []
        files = self._files(folder)
        if files.exists(self._path(folder)):
            done = [int(x.getPath().getName()[1:]) for x in files.listStatus(self._path(folder)) if files.exists(self._path(f"{x.getPath()}/about/_SUCCESS"))]
            if done:
                about = spark.read.parquet(f"{folder}/v{max(done)}/about").first()
                self.version, self.limit, self.seen, self.logs = max(done), about["limit"], about["seen"], list(about["logs"])

    def _path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):  # noqa: ANN202
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def kept(self) -> DataFrame | None:
        """k1, k2, q1, q2, id, place, rank of the kept records."""
        return self.spark.read.parquet(f"{self.folder}/v{self.version}/kept") if self.version else None

    def displaced(self) -> DataFrame | None:
        """k1, k2, q1, q2, id of the records that were left out, in whichever batch."""
        return self.spark.read.parquet(*self.logs) if self.logs else None

    def update(self, batch: DataFrame, limit: int | None = None, share: float | None = None) -> CapTable:
        """The next version, after a batch with the columns k1, k2, q1, q2, id; a count or a share is the cap, never less than one record.

        A cap must not fall from one batch to the next: what has been displaced for a lower one comes back, the reverse is an error.
        """
        if (limit is None) == (share is None) or (limit or 1) < 1 or not 0 < (share or 1) <= 1:
            raise ValueError("either a positive limit or a share up to 1")
        batch = cut(batch.select(*_RANKED).withColumn("place", _place()))
        seen = self.seen + batch.count()
        most = limit if limit is not None else max(1, int(share * seen + 1e-9))
        if most < self.limit:
            raise ValueError(f"the cap was {self.limit} already")
        kept, gone = self.kept(), self.displaced()
        out = f"{self.folder}/v{self.version + 1}"
        if kept is None:
            pool = every = batch
        elif most == self.limit:
            cutoffs = kept.where(F.col("rank") == most).select("k1", "k2", F.col("place").alias("cutoff"))
            every = batch.unionByName(kept.drop("rank"))
            pool = batch.join(cutoffs, ["k1", "k2"], "left").where("cutoff IS NULL OR place < cutoff").drop("cutoff").unionByName(kept.drop("rank"))
        else:
            pool = every = batch.unionByName(kept.drop("rank"))
            if gone is not None:
                pool = every = every.unionByName(gone.withColumn("place", _place()))
        _ranked(pool, most).write.mode("overwrite").parquet(f"{out}/kept")
        full = self.spark.read.parquet(f"{out}/kept").where(F.col("rank") == most).select("k1", "k2", F.col("place").alias("cutoff"))
        every.join(full, ["k1", "k2"]).where("place > cutoff").select(*_RANKED).write.mode("overwrite").parquet(f"{out}/log")
        # While the cap stays, the log grows by what the batch displaced; a higher cap writes it anew.
        logs = [*(self.logs if most == self.limit else []), f"{out}/log"]
        self.spark.createDataFrame([(most, seen, logs)], "limit long, seen long, logs array<string>").coalesce(1).write.mode("overwrite").parquet(f"{out}/about")
        return CapTable(self.spark, self.folder)


POST_LIMIT = 25


def contributors(posts: DataFrame, author: str = "author", first: str = "likes", second: str = "user_post_count", row: str = "row_ordinal") -> DataFrame:
    """k1, k2, q1, q2, id of the posts that have an author; authors that look the same are one contributor."""
    shown = posts.select(skeleton_of(F.col(author)).alias("who"), F.col(first).cast("double").alias("q1"), F.col(second).cast("double").alias("q2"), F.col(row).alias("id"))
    shown = shown.where(F.regexp_replace("who", r"(?U)\s+", "") != "")
    return shown.select(*[h.alias(n) for n, h in zip(("k1", "k2"), key_of(F.col("who")))], "q1", "q2", "id")


def displaced_posts(posts: DataFrame, limit: int | None = POST_LIMIT, batches: int = 2, share: float | None = None, folder: str | None = None) -> DataFrame:
    """row_ordinal of the posts that their contributor's cap leaves out; the posts come in batches, in the order of row_ordinal.

    The cap is a count or, with share, a part of the posts that have an author. The state goes into folder, by default a new one below the
    checkpoint folder; posts of a folder used before are added to those it has seen. Posts without an author (null, empty or blank)
    are under no cap and never left out. A null likes or user_post_count ranks after every number. Rows that agree in
    likes, user_post_count and row_ordinal are ties of one record: they stay or go together. An empty table gives no rows.
    Columns other than the four used are ignored.
    """
    rows = cut(contributors(posts))
    state = CapTable(posts.sparkSession, folder or shared_folder(posts.sparkSession, "cap"))
    ends = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("ends")).first()["ends"] if batches > 1 else []
    for low, high in zip([None, *(ends or [])], [*(ends or []), None]):
        # A null id comes with the last batch.
        above, upto = F.lit(True) if low is None else F.col("id") > low, F.lit(True) if high is None else F.col("id") <= high
        part = rows.where(above & upto if high is not None else above | F.col("id").isNull())
        state = state.update(part, None if share else limit, share)
    return state.displaced().select(F.col("id").alias("row_ordinal"))


def kept_posts(posts: DataFrame, limit: int | None = POST_LIMIT, batches: int = 2, share: float | None = None) -> DataFrame:
    """row_ordinal, likes, user_post_count of the posts that stay, those without an author included."""
    gone = displaced_posts(posts, limit, batches, share)
    return posts.select("row_ordinal", "likes", "user_post_count").join(gone, "row_ordinal", "left_anti")
