"""Written intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a folder of this machine, once per context; on a cluster that raises.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        path = sc.getCheckpointDir()
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage,
    survives lost executors, and gives the optimizer real sizes.

    narrow: of a few numbers a row where texts are dealt out in ``spark.sql.shuffle.partitions``. The stage that makes it keeps all
    partitions; its rows are dealt anew by their size afterwards (adaptive rebalancing), so that the table has few files.
    """
    path = fresh_path(df.sparkSession, tag)
    if narrow:
        df = df.hint("rebalance")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders below a path are listed by some tasks a core: Spark's own setting has up to 10,000, mostly one for each folder of a log."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(16, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete written tables that no plan reads any more."""
    for df in tables:
        path, fs = hadoop_path(df.sparkSession, df.written_path)
        fs.delete(path, True)
