"""Reading and writing: CSV of any origin, fragments, partitions, manifests of files, incremental ingest."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BOM = "\ufeff"


def _path(spark: SparkSession, path: str) -> Any:
    """The path and the file system it lies in, whichever that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return bool(files.exists(target))


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system, in order."""
    target, files = _path(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(target))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes, plain or .gz. Without schema all columns are strings; a byte order mark is dropped."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', **options)
    df = (reader.schema(schema) if schema is not None else reader).csv(list(path) if not isinstance(path, str) else path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_fragments(spark: SparkSession, folder: str, needed: Sequence[str], skip: Sequence[str] = ("manifest", "status"), source: str | None = None) -> DataFrame:
    """All CSV fragments of a folder that have the needed columns, united by name; names that contain a word of skip are left out.

    Fragments of one header are read together. Broken files are left out; with source, a column of that name tells each row's file.
    """
    names = [n for n in listing(spark, folder) if n.endswith((".csv", ".csv.gz")) and not any(s in n for s in skip)]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        # The first line only.
        header = spark.read.options(escape='"', ignoreCorruptFiles=True).csv(f"{folder}/{name}").limit(1).collect()
        columns = tuple(str(c or "").lstrip(BOM) for c in header[0]) if header else ()
        if set(needed) <= set(columns):
            by_header.setdefault(columns, []).append(f"{folder}/{name}")
    if not by_header:
        raise FileNotFoundError(f"no fragment in {folder} has the columns {list(needed)}")
    out = None
    for paths in by_header.values():
        df = read_csv(spark, paths, ignoreCorruptFiles="true")
        if source:
            df = df.withColumn(source, F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_numbered(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """number, line: the lines of a text file with their physical number, from first; one file is one task, as its lines have an order."""
    lines = spark.read.text(path, wholetext=True)
    split = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    rows = lines.select(F.posexplode(split).alias("n", "line"), F.size(split).alias("all"))
    # The end of the last line begins no other.
    return rows.where(~((F.col("n") == F.col("all") - 1) & (F.col("line") == ""))).select((F.col("n") + first).cast("long").alias("number"), "line")


def load_json(spark: SparkSession, path: str) -> Any:
    """What a JSON file of any file system holds: settings or word lists."""
    return json.loads(spark.sparkContext.wholeTextFiles(path).first()[1].lstrip(BOM))


def save_json(spark: SparkSession, path: str, report: dict | DataFrame) -> None:
    """A report as one JSON file: a dict, or the rows of a small table. Numbers that JSON has no form for become null."""
    clean = lambda v: None if isinstance(v, float) and v != v or v in (float("inf"), float("-inf")) else v
    walk = lambda v: {str(k): walk(x) for k, x in v.items()} if isinstance(v, dict) else [walk(x) for x in v] if isinstance(v, list | tuple) else clean(v)
    content = [row.asDict(recursive=True) for row in report.collect()] if isinstance(report, DataFrame) else report
    target, files = _path(spark, path)
    stream = files.create(target, True)
    stream.write(bytearray(json.dumps(walk(content), ensure_ascii=False, indent=2, default=str).encode()))
    stream.close()


def export_handoff(spark: SparkSession, folder: str, tables: dict[str, DataFrame], by: str | None = None) -> None:
    """Each table as parquet below a folder, and manifest.json with its columns, rows and, with by, rows of each value of that column."""
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        stored = spark.read.parquet(f"{folder}/{name}")
        rows = stored.groupBy(by).count().collect() if by and by in stored.columns else [(None, stored.count())]
        manifest[name] = {"columns": stored.columns, "rows": sum(r[1] for r in rows), **({"by": {str(r[0]): r[1] for r in rows}} if by and by in stored.columns else {})}
    save_json(spark, f"{folder}/manifest.json", manifest)


def verify_handoff(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with an exported folder: tables that are missing or don't have the rows or columns of the manifest."""
    wrong = []
    for name, told in load_json(spark, f"{folder}/manifest.json").items():
        if not exists(spark, f"{folder}/{name}/_SUCCESS"):
            wrong.append(f"{name}: missing")
            continue
        df = spark.read.parquet(f"{folder}/{name}")
        if df.columns != told["columns"] or df.count() != told["rows"]:
            wrong.append(f"{name}: other rows or columns")
    return wrong


def demo_posts(spark: SparkSession, repeats: int = 60) -> DataFrame:
    """Invented posts, four kinds repeated: a starter and an answer of two threads, with emoji, likes and times of day."""
    kinds = [("1", "اضطراب بارداری", "سارا", "خیلی نگران هستم 😔 لطفا کمک کنید؟", 4, None, True), ("1", "اضطراب بارداری", "مینا", "نگران نباش عزیزم 🌸 همه چیز خوبه", 9, "0", False), ("2", "خرید سیسمونی", "نگار", "از کجا خرید کنیم؟ قیمت‌ها عالی نیست!", 1, None, True), ("2", "خرید سیسمونی", "الهه", "ما از بازار گرفتیم و راضی بودیم 🙏", 2, "2", False)]
    four = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "kind int, thread string, thread_title string, author string, content string, likes int, answers string, is_starter boolean")
    rows = spark.range(repeats).withColumnRenamed("id", "i").join(F.broadcast(four))  # four rows
    return rows.select(
        F.concat_ws("_", "thread", "i").alias("thread_id"), "thread_title", F.when(~F.col("is_starter"), F.concat_ws("_", "kind", "i")).alias("post_id"), "author", F.concat(F.lit("https://forum.example/user/"), F.col("kind") + 1).alias("profile_url"),
        F.format_string("1404/01/%02d %02d:00", F.pmod("i", F.lit(28)) + 1, F.pmod(F.col("i") + F.col("kind"), F.lit(24))).alias("posted_at"), "content", "likes", (F.col("kind") * 10).alias("user_post_count"),
        F.when(F.col("answers").isNotNull(), F.concat_ws("_", "answers", "i")).alias("reply_to"), "is_starter", F.lit("demo").alias("section_name"),
    )


def first_source(spark: SparkSession, sources: Sequence[tuple[str, Callable[[str], DataFrame]]]) -> DataFrame:
    """What the first reader whose path exists, in any file system, gives."""
    for path, read in sources:
        if exists(spark, path):
            return read(path)
    raise FileNotFoundError("none of: " + ", ".join(p for p, _ in sources))


def load_bundle(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The parquet tables of a bundle by name; fails before any is read if one is missing."""
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.options(header=True, escape='"', **({"compression": "gzip"} if gzip else {})).mode("overwrite").csv(path)


def append(df: DataFrame, path: str) -> None:
    """Append to a parquet table whose columns may have grown; read it with mergeSchema."""
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_dimension(df: DataFrame, key: str, path: str) -> None:
    """The distinct values of a key as a parquet table, null and blank ones left out."""
    df.select(key).where(F.trim(key) != "").distinct().write.mode("overwrite").parquet(path)


def read_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A stored dimension, if it has just this column and no value twice."""
    df = spark.read.parquet(path)
    if df.columns != [key] or df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path} is no table of distinct {key}")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file below a folder; files are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType | str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Process the parquet files that have come since the last call, once each, and append the result to the target."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
