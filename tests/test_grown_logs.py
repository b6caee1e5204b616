"""Byte ranges, the store of turns and the stream of growing logs: bytes counted, runs killed, steps repeated."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import ingest, mentions
from hearthlog.sources import logs, ranges
from hearthlog.sources.store import Store
from hearthlog.streaming.grown import discover, last_epochs, stream_grown_logs


def event(text):
    return (json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": text}}) + "\n").encode()


def inventory(spark, root):
    return logs.session_inventory(spark, {"codex": f"file://{root}"}).select("path", "mtime", "size")


def test_any_cover_of_a_file_gives_each_line_once(tmp_path):
    rng = random.Random(1)
    for n in range(300):
        data = b"".join(rng.choice([b"\n", b"ab", b"\xc3\xa9", b"\r", b"x" * 90]) for _ in range(rng.randint(0, 60)))
        data = (b"\xef\xbb\xbf" if n % 3 == 0 else b"") + data
        path = tmp_path / "f"
        path.write_bytes(data)
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(rng.randint(0, 6)))})
        with path.open("rb") as f:
            got = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in ranges.lines_of(ranges._Counted(f), a, b)]
        whole = data.split(b"\n")[:-1]
        ends = [sum(len(x) + 1 for x in whole[: i + 1]) for i in range(len(whole))]
        want = [(e, x.removeprefix(b"\xef\xbb\xbf") if i == 0 else x) for i, (e, x) in enumerate(zip(ends, whole, strict=True))]
        assert got == want


def test_a_long_file_is_split_and_only_new_bytes_are_read(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    with path.open("wb") as f:
        for i in range(40_000):
            f.write(event(f"turn {i} " + "x" * 100))
    size = path.stat().st_size
    todo = spark.createDataFrame([(f"file:{path}", 0, size, 0)], "file string, offset long, size long, msg_index long")
    plan = ranges.plan_ranges(todo, 1 << 20)
    assert plan.count() == -(-size // (1 << 20)) and ranges.range_lines(plan).rdd.getNumPartitions() > 1
    counted = spark.sparkContext.accumulator(0)
    turns, ends = logs.resumed_turns(spark, todo, "codex", range_bytes=1 << 20, counted=counted)
    assert turns.agg(F.count("*"), F.min("msg_index"), F.max("msg_index"), F.count_distinct("msg_index")).first() == (40_000, 1, 40_000, 40_000)
    assert turns.where("text NOT LIKE concat('turn ', msg_index - 1, ' %')").isEmpty()
    assert size <= counted.value < 1.05 * size and ends.first().offset == size
    with path.open("ab") as f:
        f.write(event("new") + event("cut")[:-1])
    counted = spark.sparkContext.accumulator(0)
    todo = spark.createDataFrame([(f"file:{path}", size, path.stat().st_size, 40_000)], "file string, offset long, size long, msg_index long")
    turns, ends = logs.resumed_turns(spark, todo, "codex", counted=counted)
    assert [(r.msg_index, r.text) for r in turns.collect()] == [(40_001, "new")] and counted.value < 400
    assert ends.first().offset == size + len(event("new"))


def test_byte_order_mark_and_cut_off_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + event("one") + event("cut")[:-1])
    todo = inventory(spark, tmp_path).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("offset"), "size", F.lit(0).cast("long").alias("msg_index"))
    turns, ends = logs.resumed_turns(spark, todo, "codex")
    assert [r.text for r in turns.collect()] == ["one"] and ends.first().offset == 3 + len(event("one"))


def held(store):
    return sorted((r.file.rsplit("/", 1)[1], r.msg_index, r.text) for r in store.read("turns", ingest.TURNS).collect())


def test_ingest_into_a_store(spark, tmp_path, monkeypatch):
    root, clock = tmp_path / "logs", [1000]
    root.mkdir()

    def put(name, data):
        (root / name).write_bytes(data)
        clock[0] += 10
        os.utime(root / name, (clock[0], clock[0]))

    def run(purge=False):
        return ingest.ingest_logs(store, inventory(spark, root), lambda todo: logs.resumed_turns(spark, todo, "codex"), purge)

    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    assert store.latest().number == 0 and held(store) == []
    names = [f"{c}.jsonl" for c in "abcdefgh"]
    for n in names:
        put(n, event(n) + event("two"))
    assert run().number == 1
    want = sorted((n, i, t) for n in names for i, t in ((1, n), (2, "two")))
    assert held(store) == want and run().number == 1
    before = store.latest()

    put("a.jsonl", event("a.jsonl") + event("two") + event("three") + event("fo")[:9])
    put("b.jsonl", event("other"))
    (root / "c.jsonl").unlink()
    want = sorted([w for w in want if w[0] not in ("b.jsonl", "c.jsonl")] + [("a.jsonl", 3, "three"), ("b.jsonl", 1, "other")])
    with monkeypatch.context() as m:  # a run that dies between write and commit
        m.setattr("hearthlog.sources.store.publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            run(True)
    assert store.latest() == before and len(held(store)) == 16
    assert run(True).number == 2 and held(store) == want
    old, new = before.tables["turns"], store.latest().tables["turns"]
    grown = sum(old[b] == new.get(b, [])[: len(old[b])] for b in old)
    assert grown >= 2  # buckets of b and c alone were rewritten
    with pytest.raises(Exception, match="exist"):
        store.replace({"turns": (None, store.read("turns", ingest.TURNS).limit(0))}, before)
    assert store.vacuum() > 0 and held(store) == want and store.vacuum() == 0
    for i in range(10):  # generations of a bucket are few
        put("a.jsonl", (root / "a.jsonl").read_bytes() + b"\n" + event(f"more {i}"))
        run()
    assert max(len(g) for g in store.latest().tables["turns"].values()) <= store.most
    assert [t for f, _, t in held(store) if f == "a.jsonl"][-10:] == [f"more {i}" for i in range(10)]
    assert {r.file.rsplit("/", 1)[1]: r.msg_index for r in store.read("state", ingest.STATE).collect()}["a.jsonl"] == 13


def test_stream_of_growing_logs(spark, tmp_path):
    root, home, out, checkpoint = tmp_path / "logs", f"file://{tmp_path}/home", f"{tmp_path}/out", f"{tmp_path}/check"
    root.mkdir()

    def put(name, data, at):
        (root / name).write_bytes(data)
        os.utime(root / name, (at, at))

    def step():
        number = discover(spark, inventory(spark, root), home, file_bytes=300, range_bytes=70)
        stream_grown_logs(spark, home, out, checkpoint, "codex", partitions=2).awaitTermination()
        return number

    def turns():
        rows = last_epochs(spark.read.parquet(out)).collect()
        return sorted((r.file.rsplit("/", 1)[1], r.epoch, r.msg_index, r.text) for r in rows)

    put("a.jsonl", event("one") + event("two")[:30], 1000)
    put("b.jsonl", event("x"), 1000)
    assert step() == 1 and turns() == [("a.jsonl", 0, 1, "one"), ("b.jsonl", 0, 1, "x")]
    assert step() is None and len(spark.read.parquet(out).collect()) == 2
    put("a.jsonl", event("one") + event("two") + b"{broken\n" + event(" ") + event("three"), 1010)
    put("b.jsonl", event("y"), 1010)
    assert step() == 2
    assert turns() == [("a.jsonl", 0, 1, "one"), ("a.jsonl", 0, 2, "two"), ("a.jsonl", 0, 3, "three"), ("b.jsonl", 1, 1, "y")]
    put("a.jsonl", b"".join(map(event, ("one", "two", "three", *map(str, range(12))))), 1020)  # shrunk by the odd lines, then long
    put("b.jsonl", event("y") + event("z"), 1020)
    steps = 0
    while step():
        steps += 1
    assert steps > 2  # no more than some bytes of a file come in a step
    assert [t for f, _, _, t in turns() if f == "b.jsonl"] == ["y", "z"]
    texts = [t for f, _, _, t in turns() if f == "a.jsonl"]
    assert len(texts) == len(set(texts)) and texts[-1] == "11"


def test_nearest_mention_is_linear(spark):
    n = 60_000
    hits = spark.range(1, n + 1).select(F.lit("p").alias("provider"), F.lit("f").alias("file"), F.col("id").alias("msg_index"))
    marks = hits.where(f"msg_index = {n} OR msg_index = 1")
    start = time.time()
    got = mentions.nearest_mention(hits, marks, span=0)
    assert got.groupBy("mention_index").count().collect() and {tuple(r) for r in got.groupBy("mention_index").count().collect()} == {(1, 1), (n, n - 1)}
    both = mentions.between_mention(hits, marks, auto=True)
    assert {(r.previous_index, r.next_index): r["count"] for r in both.groupBy("previous_index", "next_index").count().collect()} == {(None, 1): 1, (1, n): n - 1}
    assert time.time() - start < 30


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    """One log a folder: listing takes some tasks a core, not one a folder; the setting comes back."""
    for i in range(120):
        (tmp_path / f"conv={i}").mkdir()
        (tmp_path / f"conv={i}" / "a.jsonl").write_text('{"a": 1}\n')
    name, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name)
    sc.setJobGroup("listing", "")
    try:
        files = logs.session_inventory(spark, {"codex": str(tmp_path)})
        tracker = sc.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= max(16, 4 * sc.defaultParallelism) and spark.conf.get(name) == before
    assert files.count() == 120
    short = ranges.plan_ranges(files.select(files.path.alias("file"), (files.size * 0).alias("offset"), "size"), 4)
    assert ranges.range_lines(short, 2).selectExpr("sum(end)", "count(*)", "count(DISTINCT file)").first()[:] == (120 * 9, 120, 120)
