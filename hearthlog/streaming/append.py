"""Logs as a stream: the lines of every new file become turns, each file once.

Spark's file source reads a file when it first sees it and never again, so this is for files that are complete when they
appear. Logs that grow in place are resumed by ``operators.ingest.append_ingest``, run after run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Write one batch of (file, line, role, text) with msg_index continued; a repeated batch id replaces its own rows."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(out).where(F.col("batch_id") < batch_id)
        last = known.groupBy("file").agg(F.max("msg_index").alias("last"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        last = spark.createDataFrame([], "file string, last long")
    index = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    rows = batch.where(F.trim("text") != "").withColumn("n", index).join(last, "file", "left")
    rows = rows.select("file", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("msg_index"), "role", "text")
    rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def stream_turns(spark: SparkSession, source: str, out: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Ingest all files now in ``source`` and stop. parse: (file, line, value) to (file, line, role, text)."""
    lines = spark.readStream.text(source).select(F.col("_metadata.file_path").alias("file"), "value")
    write = lambda batch, batch_id: append_batch(parse(batch.withColumn("line", F.monotonically_increasing_id())), batch_id, out)
    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
