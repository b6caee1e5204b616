"""Incremental ingest: which files changed, and their turns replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.sources.store import Commit, Store
from hearthlog.sources.written import materialise, release


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the state doesn't have with this mtime and size."""
    known = state.select(F.col("file").alias("path"), "mtime", "size")
    return files.join(known, ["path", "mtime", "size"], "left_anti")


def file_changes(files: DataFrame, state: DataFrame) -> DataFrame:
    """path, change: new, grown (append-only, may be resumed), rewritten (shrunk, or same size and newer), vanished, same."""
    s = state.select(F.col("file").alias("path"), F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
    kind = (
        F.when(F.col("old_size").isNull(), "new").when(F.col("size").isNull(), "vanished")
        .when((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), "same")
        .when((F.col("size") > F.col("old_size")) & (F.col("mtime") >= F.col("old_mtime")), "grown").otherwise("rewritten")
    )
    return files.join(s, "path", "full").select("path", kind.alias("change"))


def merge_turns(old: DataFrame, changed: DataFrame, new: DataFrame, vanished: DataFrame | None = None) -> DataFrame:
    """The turn table after a run: turns of changed (and, if given, vanished) files go, new turns come."""
    gone = changed.select(F.col("path").alias("file"))
    gone = gone if vanished is None else gone.unionByName(vanished.select(F.col("path").alias("file")))
    return old.join(gone.distinct(), "file", "left_anti").unionByName(new.select(*old.columns))


def next_state(files: DataFrame, turns: DataFrame) -> DataFrame:
    """file, mtime, size, msg_index: the state to keep after a run."""
    top = turns.groupBy("file").agg(F.max("msg_index").alias("msg_index"))
    return files.select(F.col("path").alias("file"), "mtime", "size").join(top, "file", "left").withColumn("msg_index", F.coalesce("msg_index", F.lit(0).cast("long")))


def incremental_ingest(files: DataFrame, state: DataFrame, turns: DataFrame, read: Callable[[DataFrame], DataFrame], purge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, state) after ingesting what changed. read: changed files to their turns. purge: forget vanished files."""
    changed = changed_files(files, state)
    vanished = state.select(F.col("file").alias("path")).join(files.select("path"), "path", "left_anti") if purge else None
    after = merge_turns(turns, changed, read(changed), vanished)
    return after, next_state(files, after)


def append_ingest(files: DataFrame, state: DataFrame, turns: DataFrame, resume: Callable[[DataFrame], tuple[DataFrame, DataFrame]], purge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(turns, state) after ingesting append-only logs: a grown file is read on from its stored offset and its turns numbered on,
    a new or rewritten one is read from its start; only complete lines count, the rest waits for the next run.

    state: file, mtime, size, offset, msg_index. resume: (file, offset, size, msg_index) of what is to be read, to (turns, ends), as
    ``sources.logs.resumed_turns`` does it. purge: forget vanished files. The results should be written before the next run; ``ingest_logs``
    keeps them in a store.
    """
    change, todo, gone = _to_do(files, state, purge)
    new, ends = resume(todo)
    after = turns.join(gone, "file", "left_anti").select(*turns.columns).unionByName(new.select(*turns.columns))

    rest = state.join(todo, "file", "left_anti")
    rest = rest.join(gone, "file", "left_anti") if purge else rest
    return after, _read_state(files, todo, new, ends).unionByName(rest.select("file", "mtime", "size", "offset", "msg_index"))


def _to_do(files: DataFrame, state: DataFrame, purge: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The changes; what is to be read (file, offset, size, msg_index); the files whose turns go."""
    change = file_changes(files, state).withColumnRenamed("path", "file")
    known = change.join(state.select("file", "offset", "msg_index"), "file", "left").join(files.select(F.col("path").alias("file"), "size"), "file", "left")
    grown = F.col("change") == "grown"
    from_ = lambda c: F.when(grown, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    todo = known.where(F.col("change").isin("new", "grown", "rewritten")).select("file", from_("offset"), "size", from_("msg_index"))
    return change, todo, change.where(F.col("change").isin(*["rewritten", *["vanished"] * purge])).select("file")


def _read_state(files: DataFrame, todo: DataFrame, new: DataFrame, ends: DataFrame) -> DataFrame:
    """The state of the files that were read."""
    top = new.groupBy("file").agg(F.max("msg_index").alias("top"))
    read = todo.drop("size").join(ends.withColumnRenamed("offset", "end"), "file", "left").join(top, "file", "left")
    read = read.select("file", F.greatest("offset", F.coalesce("end", F.lit(0))).alias("offset"), F.coalesce("top", "msg_index").alias("msg_index"))
    return files.select(F.col("path").alias("file"), "mtime", "size").join(read, "file").select("file", "mtime", "size", "offset", "msg_index")


#: What ``ingest_logs`` keeps in a store.
TURNS = "provider string, file string, msg_index long, role string, ts timestamp, ts_raw string, text string"
STATE = "file string, mtime timestamp, size long, offset long, msg_index long"


def ingest_logs(store: Store, files: DataFrame, resume: Callable[[DataFrame], tuple[DataFrame, DataFrame]], purge: bool = False) -> Commit:
    """One run of ``append_ingest`` over the tables ``turns`` and ``state`` of a store, as one commit: buckets of files that only grew
    are added to, those of rewritten (and, if asked for, vanished) files are rewritten, all others stay. The last commit
    comes back if nothing changed."""
    base = store.latest()
    change, todo, gone = _to_do(files, store.read("state", STATE, base), purge)
    todo, gone = materialise(todo, "files-to-read"), materialise(gone, "files-gone")
    if todo.isEmpty() and gone.isEmpty():
        return base
    new, ends = resume(todo)
    new = materialise(new.select("provider", "file", "msg_index", "role", "ts", "ts_raw", "text"), "new-turns")
    state = _read_state(files, todo, new, ends)
    out = store.replace({"turns": (gone, new), "state": (gone.unionByName(todo.select("file")), state)}, base)
    release(todo, gone, new)
    return out
