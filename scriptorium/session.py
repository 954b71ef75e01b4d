"""Session helpers: a tuned local session, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own configuration."""
    builder = (
        SparkSession.builder.master(master)
        .appName("scriptorium")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where it is unset."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scriptorium-")
    context.setCheckpointDir(configured)
    return context._jsc.sc().getCheckpointDir().get()


def stage_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete this application's staged tables; call it when no result that reads them is still to be computed."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(df: DataFrame, partition_cols: tuple[str, ...] = ()) -> str:
    """Write a columnar intermediate to the shared folder; several of one schema are read together by their paths."""
    path = f"{stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return path


def stage_table(df: DataFrame, partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Write a columnar intermediate to the shared folder and read it back (column pruning, no lineage)."""
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, partition_cols))


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
