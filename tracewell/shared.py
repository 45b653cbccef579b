"""Tables in the folder that all machines of a cluster share: what follows them survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one for a session of one machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = local_folder(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_folder(master: str) -> str:
    """A new folder of this machine, if the session runs on it alone."""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def store(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with shuffles_dropped(spark):
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(tables: list[DataFrame]) -> None:
    """Empty stored tables from which nothing will be read any more, as what came of them has been stored."""
    for t in tables:
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(t.stored_at)
    tables.clear()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files behind when it is done: its result is a table, from which all goes on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
