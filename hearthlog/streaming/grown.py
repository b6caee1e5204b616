"""Logs that grow in place, as a stream: new bytes become turns, each once, numbered on from what a file had before.

``discover`` compares an inventory with what was seen before and writes the byte ranges that came as one *step*: a folder with the
new ranges and with all files as seen, which appears by one rename. The stream reads the ranges of all steps as a
file source, each range's lines (``sources.ranges``), and numbers their turns per file with a stateful operator, whose
state is the last index and the epoch of the file. So a batch costs what is new, however much was
written before, and a restart from the checkpoint repeats nothing.

A file that shrank, or changed at the same size, starts a new ``epoch``: it is read from its start and numbered from one.
Readers of the output take the last epoch of each file (``last_epochs``). A step takes at most ``file_bytes`` of a file, so that the
rows of one file in a step fit a task; the rest comes with the next steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hearthlog.sources.ranges import plan_ranges, range_lines
from hearthlog.sources.written import hadoop_path

SEEN = "file string, mtime timestamp, size long, epoch int"
_RANGES = "file string, epoch int, start long, stop long"
_ROWS = "provider string, file string, epoch int, msg_index long, role string, ts_raw string, text string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _steps(spark: SparkSession, home: str) -> list[int]:
    folder, fs = hadoop_path(spark, home)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("step=")) for n in names if n.startswith("step="))


def discover(spark: SparkSession, files: DataFrame, home: str, file_bytes: int = 64 << 20, range_bytes: int = 32 << 20) -> int | None:
    """Write what is new in an inventory (path, mtime, size) as the next step; its number, or none if nothing is new.

    Vanished files are forgotten. Only the last step's table of seen files is read, and older ones are deleted.
    """
    steps = _steps(spark, home)
    last = steps[-1] if steps else 0
    seen = spark.read.schema(SEEN).parquet(f"{home}/step={last:09d}/seen") if steps else spark.createDataFrame([], SEEN)
    old = seen.select("file", F.col("mtime").alias("old_mtime"), F.col("size").alias("upto"), "epoch")
    now = files.select(F.col("path").alias("file"), "mtime", "size").join(old, "file", "left")
    again = (F.col("size") < F.col("upto")) | (F.col("size") == F.col("upto")) & (F.col("mtime") != F.col("old_mtime"))
    offset = F.when(F.col("upto").isNull() | again, 0).otherwise(F.col("upto")).cast("long")
    epoch = F.coalesce(F.col("epoch") + again.cast("int"), F.lit(0)).cast("int")
    todo = now.select("file", "mtime", offset.alias("offset"), F.least("size", offset + file_bytes).alias("size"), epoch.alias("epoch"))
    staging = f"{home}/.staging-{uuid.uuid4().hex}"
    todo.select("file", "mtime", "size", "epoch").write.parquet(f"{staging}/seen")
    plan_ranges(todo.drop("mtime"), range_bytes).select("file", "epoch", "start", "stop").write.parquet(f"{staging}/ranges")
    if spark.read.schema(_RANGES).parquet(f"{staging}/ranges").isEmpty():
        hadoop_path(spark, staging)[1].delete(hadoop_path(spark, staging)[0], True)
        return None
    target, fs = hadoop_path(spark, f"{home}/step={last + 1:09d}")
    if fs.exists(target) or not fs.rename(hadoop_path(spark, staging)[0], target):
        raise RuntimeError(f"another run wrote {target}")
    for step in steps[-3:-1]:
        fs.delete(hadoop_path(spark, f"{home}/step={step:09d}/seen")[0], True)
    return last + 1


class _Numbering(StatefulProcessor):
    """Numbers the rows of a file on from its last ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "epoch int, msg_index long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts = list(rows)  # most files have few rows: numpy's part of a call is small
        new = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        new = new.iloc[np.lexsort((new["at"].to_numpy(), new["end"].to_numpy(), new["epoch"].to_numpy()))]
        epoch, index = self._last.get() or (-1, 0)
        epochs = new["epoch"].to_numpy()
        number = np.arange(1, len(epochs) + 1) - np.searchsorted(epochs, epochs, "left")
        new = new.assign(msg_index=np.where(epochs == epoch, number + index, number).astype("int64"))
        self._last.update((int(epochs[-1]), int(new["msg_index"].iloc[-1])))
        yield new[["provider", "file", "epoch", "msg_index", "role", "ts_raw", "text"]]

    def close(self) -> None:
        pass


def stream_grown_logs(spark: SparkSession, home: str, out: str, checkpoint: str, provider: str, parse: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 64, partitions: int = 8) -> StreamingQuery:
    """Ingest all steps so far as turns (provider, file, epoch, msg_index, role, ts_raw, text) in ``out`` and stop.

    parse: (file, line, v) to (file, line, ts_raw, at, role, text); the search flavour of the provider if none is given. State needs
    the RocksDB store, which is set for this query alone.
    """
    from hearthlog.sources.logs import _objects, raw_rows

    ranges = spark.readStream.schema(_RANGES).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/step=*/ranges")
    lines = range_lines(ranges, partitions).withColumn("line", F.struct("start", "end", "epoch"))
    rows = (parse or (lambda x: raw_rows(x, provider)))(_objects(lines)).where(F.trim("text") != "")
    rows = rows.select(F.lit(provider).alias("provider"), "file", "line.epoch", "line.end", "at", "role", "ts_raw", "text")
    numbered = rows.groupBy("file").transformWithStateInPandas(_Numbering(), _ROWS, "append", "none")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    try:
        return numbered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if kept is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def last_epochs(turns: DataFrame) -> DataFrame:
    """The turns of the last epoch of each file. Earlier epochs of a file that was rewritten into nothing but blank lines stay."""
    last = turns.groupBy("file").agg(F.max("epoch").alias("epoch"))
    return turns.join(last, ["file", "epoch"], "left_semi")
