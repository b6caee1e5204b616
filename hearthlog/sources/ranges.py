"""Lines of files by byte ranges: what is read is what was asked for, however long the files are.

A table of files with offsets becomes a table of ranges (``plan_ranges``), and the ranges become lines (``range_lines``),
read on the executors: no path comes to the driver. A line belongs to the range that holds its line feed, so that any
ranges that cover a file without overlap give each complete line once, and one without a line feed at the end of the
file waits for the range that brings it. The start of a range's first line is looked for backwards, in steps that grow; where
a range starts at a line, that is 64 bytes. A byte-order mark is no part of the first line, but counts in offsets.

Paths of the local file system (or one mounted on all executors) are opened as files, others by pyarrow's file systems. Stores that only
Spark's readers open are not ``readable``; ``sources.logs`` reads these with Spark, from their start.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
#: Most partitions that ranges are dealt into; beyond it partitions have several ranges each.
MOST_PARTITIONS = 20_000
_CHUNK, _BATCH = 1 << 20, 4 << 20
_MARK = b"\xef\xbb\xbf"


def _scheme(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def open_file(path: str) -> BinaryIO:
    """A path or URI opened for reading."""
    if _scheme(path) in ("", "file"):
        local = path.removeprefix("file:") if _scheme(path) else path
        return open("/" + local.lstrip("/") if _scheme(path) else local, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def readable(path: str) -> bool:
    """Whether Python can open the path's store."""
    if _scheme(path) in ("", "file"):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def plan_ranges(todo: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of ``todo`` (file, offset, size and more), one for each range [start, stop) of at most ``range_bytes``."""
    starts = F.sequence(F.col("offset"), F.col("size") - 1, F.lit(range_bytes))
    each = todo.where(F.col("size") > F.col("offset")).withColumn("start", F.explode(starts))
    return each.withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size"))).drop("offset", "size")


class _Counted:
    """A file that adds up what is read from it."""

    def __init__(self, file: BinaryIO):
        self._file, self.count = file, 0

    def read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(n)
        self.count += len(data)
        return data


def _head(file: _Counted, start: int) -> bytes:
    """The bytes before ``start`` back to the last line feed."""
    parts: list[bytes] = []
    at, step = start, 64
    while at:
        step = min(step, at)
        at -= step
        data = file.read(at, step)
        cut = data.rfind(b"\n")
        parts.append(data[cut + 1 :])
        if cut >= 0:
            break
        step = min(16 * step, _CHUNK)
    return b"".join(reversed(parts))


def lines_of(file: _Counted, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset after it, line) of the lines whose line feed lies in [start, stop)."""
    rest: list[bytes] = []
    at, first = start, True
    while at < stop:
        data = file.read(at, min(_CHUNK, stop - at))
        if not data:
            break
        *whole, last = data.split(b"\n")
        for line in whole:
            at += len(line) + 1
            if rest:
                line = b"".join([*rest, line])
                rest.clear()
            if first:
                line, first = _head(file, start) + line, False
                if at == len(line) + 1:
                    line = line.removeprefix(_MARK)
            yield at, line
        at += len(last)
        rest.append(last)


def range_lines(ranges: DataFrame, partitions: int | None = None, counted: Accumulator | None = None) -> DataFrame:
    """file, start, end, value and the other columns of ``ranges`` but stop: the lines of each range, with the offset after each.

    partitions: into how many the ranges are dealt. If none is given, a small job counts ranges and bytes: one for each
    ``RANGE_BYTES``, or enough for all cores (20,000 at most). counted: adds up the bytes that were read.
    """
    if partitions is None:
        n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
        least = 2 * ranges.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, min(n, max(least, -(-size // RANGE_BYTES)), MOST_PARTITIONS))
    more = [c for c in ranges.columns if c not in ("file", "start", "stop")]
    fields = ranges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []  # of the range of each line
            ends: list[int] = []
            values: list[str] = []
            held = 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                told = batch.select(["file", "start", *more]).take(pa.array(rows, pa.int64()))  # noqa: B023
                columns = [told.column(0), told.column(1), pa.array(ends, pa.int64()), pa.array(values, pa.string()), *(told.column(i) for i in range(2, told.num_columns))]  # noqa: B023
                return pa.record_batch(columns, names=["file", "start", "end", "value", *more])

            for row, (path, start, stop) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True)):
                with open_file(path) as opened:
                    file = _Counted(opened)
                    for end, line in lines_of(file, start, stop):
                        rows.append(row)
                        ends.append(end)
                        values.append(line.decode("utf-8", "replace"))
                        held += len(line) + 64
                        if held > _BATCH:  # lines of many short ranges go together
                            yield out()
                            rows, ends, values, held = [], [], [], 0
                    if counted is not None:
                        counted.add(file.count)
            yield out()

    schema = "file string, start long, end long, value string" + "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in more)
    return ranges.repartition(partitions, "file", "start").mapInArrow(run, schema)
