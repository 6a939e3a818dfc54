"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

DEFAULTS: Mapping[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", memory: str = "16g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(master).appName("kelk")
    settings = {**DEFAULTS, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer; work that follows would wait for the few else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one Spark already has, else spark.checkpoint.dir, else (tests only) a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="kelk-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; removed when the session ends."""
    path = f"{ensure_checkpoint_dir(spark)}/kelk-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def spill(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written as a compressed table in the shared checkpoint folder and read back; removed when the session ends."""
    path = f"{shared_folder(df.sparkSession, 'table')}/rows"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.parquet(path)
