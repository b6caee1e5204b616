"""Append-only ingest, query grammar, written index, snippets, chunks, reports, runs."""

import json
import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.operators import clean, ingest, mentions, search, summarise, windows
from hearthlog.plans import recall
from hearthlog.sources import logs

TURNS = "provider string, file string, msg_index long, role string, text string"
STATE = "file string, mtime timestamp, size long, offset long, msg_index long"
RAW = "provider string, file string, msg_index long, role string, ts timestamp, ts_raw string, text string"


def event(text):
    return json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": text}}) + "\n"


def test_append_ingest_resumes(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    grown, shrunk, replaced, gone = (root / f"{n}.jsonl" for n in ("grown", "shrunk", "replaced", "gone"))
    clock = [1000]

    def put(path, text):
        path.write_bytes(text.encode())
        clock[0] += 10
        os.utime(path, (clock[0], clock[0]))

    def run(turns, state):
        files = logs.session_inventory(spark, {"codex": f"file://{root}"}).select("path", "mtime", "size")
        after, known = ingest.append_ingest(files, state, turns, lambda todo: logs.resumed_turns(spark, todo, "codex"), purge=True)
        rows, kept = after.collect(), known.collect()  # written tables in real runs
        return spark.createDataFrame(rows, RAW), spark.createDataFrame(kept, STATE)

    def held(turns):
        out = {}
        for r in sorted(turns.collect(), key=lambda r: r.msg_index):
            out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.msg_index, r.text))
        return out

    put(grown, event("one") + "{broken\n" + event("zwei é") + event("three")[:20])
    put(shrunk, event("a") + event("b"))
    put(replaced, event("old"))
    put(gone, event("g"))
    turns, state = run(spark.createDataFrame([], RAW), spark.createDataFrame([], STATE))
    assert held(turns) == {"grown.jsonl": [(1, "one"), (2, "zwei é")], "shrunk.jsonl": [(1, "a"), (2, "b")], "replaced.jsonl": [(1, "old")], "gone.jsonl": [(1, "g")]}
    again, same = run(turns, state)
    assert held(again) == held(turns) and sorted(map(tuple, same.collect())) == sorted(map(tuple, state.collect()))

    put(grown, event("one") + "{broken\n" + event("zwei é") + event("three") + event("four") + event("five")[:-1])
    put(shrunk, event("c"))
    put(replaced, event("new"))
    gone.unlink()
    turns, state = run(turns, state)
    assert held(turns) == {"grown.jsonl": [(1, "one"), (2, "zwei é"), (3, "three"), (4, "four")], "shrunk.jsonl": [(1, "c")], "replaced.jsonl": [(1, "new")]}
    put(grown, grown.read_text() + "\n" + event("six"))
    turns, state = run(turns, state)
    assert held(turns)["grown.jsonl"][2:] == [(3, "three"), (4, "four"), (5, "five"), (6, "six")]
    assert {r.file.rsplit("/", 1)[1]: (r.msg_index, r.offset == r.size) for r in state.collect()} == {"grown.jsonl": (6, True), "shrunk.jsonl": (1, True), "replaced.jsonl": (1, True)}


WORDS = "alpha beta gamma delta epsilon zeta alp bet café v0 the".split()
GRAMMAR = ["alpha NOT beta gamma", "alpha NOT beta AND gamma", "alpha NOT beta NOT gamma", "alpha beta NOT gamma the OR delta", "alpha OR zeta", "alpha OR beta NOT the zeta gamma", 'alpha NOT "beta gamma"', "alpha NOT beta gamma NOT the zeta"]


def small_turns(spark, n=90):
    rng = random.Random(3)
    rows = [("codex", f"f{i // 7}", i % 7 + 1, "user", " ".join(rng.choices(WORDS, k=rng.randint(1, 15)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, TURNS).selectExpr("*", "timestamp_seconds(msg_index) AS ts")


def test_grammar_is_that_of_fts(spark):
    rows, df = small_turns(spark)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, file UNINDEXED, msg_index UNINDEXED)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(r[4], r[1], r[2]) for r in rows])
    queries = spark.createDataFrame(list(enumerate(GRAMMAR)), "query_id int, query string")
    cooked = {r.query_id: r.c for r in queries.select("query_id", search.cook_query(queries["query"]).alias("c")).collect()}
    index = search.written_index(df)
    got = search.bm25_scores(index, search.normalise_queries(queries)).collect()
    for i, q in enumerate(GRAMMAR):
        want = {(f, m): -s for f, m, s in con.execute("SELECT file, msg_index, bm25(t) FROM t WHERE t MATCH ?", (cooked[i],))}
        mine = {(r.file, r.msg_index): r.score for r in got if r.query_id == i}
        assert mine.keys() == want.keys(), q
        if "NOT" not in q:
            assert all(abs(mine[k] - want[k]) < 1e-6 for k in want), q
    for bad in ("(alpha OR beta) gamma", "NEAR(alpha beta)", "NEAR"):
        with pytest.raises(Exception, match="not supported"):
            search.normalise_queries(spark.createDataFrame([(0, bad)], "query_id int, query string")).collect()
    assert search.normalise_queries(spark.createDataFrame([(0, '"(a)" b'), (1, None)], "query_id int, query string")).count() == 2


def test_written_and_updated_index(spark, tmp_path):
    rows, df = small_turns(spark)
    key = lambda d: sorted(map(str, d.collect()))
    index = search.write_index(search.build_index(df), str(tmp_path / "v1"))
    assert key(index.postings) == key(search.build_index(df).postings)
    changed = df.withColumn("text", F.when(F.col("file") == "f2", F.lit("alpha newword")).otherwise(F.col("text"))).where("file <> 'f3'")
    new = search.update_index(index, spark.createDataFrame([("f2",), ("f3",)], "file string"), changed.where("file = 'f2'"))
    new = search.write_index(new, str(tmp_path / "v2"))
    want = search.build_index(changed)
    assert key(new.postings) == key(want.postings) and key(new.turn_stats) == key(want.turn_stats) and new.turns.count() == changed.count()


def test_snippets_show_the_text_as_written(spark):
    text = "Zero, One two-Three FOUR five! Café au lait; one two again six"
    df = spark.createDataFrame([("p", "f", 1, "user", text)], TURNS).selectExpr("*", "timestamp_seconds(1) AS ts")
    index = search.build_index(df)
    for query, n, want in (
        ('"two three"', 4, "…[two-Three] FOUR five…"), ("cafe", 2, "…[Café] au…"), ('"one two" three', 6, "…[One two]-[Three] FOUR five! Café…"),
        ('"one two" "two three"', 20, "…[One two-Three] FOUR five! Café au lait; [one two] again six"), ("zero", 3, "[Zero], One two…"),
    ):
        q = search.normalise_queries(spark.createDataFrame([(0, query)], "query_id int, query string"))
        got = search.snippets(search.bm25_topk(index, q, 1), index, q, n).collect()
        assert [r.snip for r in got] == [want], query


def test_chunks_by_brute_force(spark):
    def slow(text, most):  # a chunk is a line that does not fit anywhere, or as many lines as fit
        lines, out = text.splitlines(), []
        while lines:
            n = max((k for k in range(1, len(lines) + 1) if sum(len(x) + 1 for x in lines[:k]) <= most), default=1)
            whole = "\n".join(lines[:n])
            out += [whole[i : i + most] for i in range(0, max(len(whole), 1), most)]
            lines = lines[n:]
        return out

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["\n", "ab", "c", "", "\r\n", "x" * 15]) for _ in range(rng.randint(0, 40)))
        assert summarise.chunk_text(text, 10) == slow(text, 10)
    assert summarise.chunk_text("", 5) == [] and summarise.chunk_text("ab\ncd\nefghijk\nl", 6) == ["ab\ncd", "efghij", "k", "l"]
    assert summarise.chunk_bounds(np.array([3, 3, 9, 1, 1]), 6) == [0, 2, 3, 5]


def test_reduce_asks_once(spark, tmp_path):
    asked = tmp_path / "asked"

    def model(prompts):
        with asked.open("a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return prompts.str.len().astype(str) + ":" + prompts.str[:30]

    df = spark.createDataFrame([("p", "a", "short"), ("p", "b", "\n".join(f"line {i}" for i in range(400)))], "provider string, file string, text string")
    out = summarise.map_reduce_summarise(df, model, 120, "reduce", "{{chunk_index}}{{transcript}} .md")
    got = {r.file: r.summary for r in out.collect()}
    calls = asked.read_text().splitlines()
    assert got["a"] == "9:short .md" and got["b"].split(":", 1)[1].startswith("Chunk 1/")
    assert len(calls) == len(set(calls))


@pytest.mark.parametrize("mode", ["chrono", "reduce"])
def test_a_failed_run_goes_on(spark, tmp_path, mode):
    asked, broken = tmp_path / "asked", tmp_path / "broken"

    def model(prompts):
        for p in prompts:
            if "line 150" in p and broken.exists():
                raise RuntimeError("the model is gone")
            with asked.open("a") as f:
                f.write(json.dumps(p) + "\n")
        return prompts.str.len().astype(str) + ":" + prompts.str[:30]

    df = spark.createDataFrame([("p", c, "\n".join(f"{c} line {i}" for i in range(200))) for c in "ab"], "provider string, file string, text string")
    run = lambda **k: sorted(map(tuple, summarise.map_reduce_summarise(df, model, 120, mode, "{{chunk_index}}{{transcript}} .md", **k).collect()))
    want = run()
    asked.unlink()
    broken.touch()
    with pytest.raises(Exception, match="the model is gone"):
        run(answers=str(tmp_path / "answers"), prompts_per_task=1)
    before = asked.read_text().splitlines()
    assert len(before) > 5
    broken.unlink()
    assert run(answers=str(tmp_path / "answers"), prompts_per_task=1) == want
    calls = asked.read_text().splitlines()
    assert len(calls) == len(set(calls)) > len(before)
    assert run(answers=str(tmp_path / "answers")) == want and asked.read_text().splitlines() == calls


def test_report_with_inline_commands(spark):
    data = [(1, "user", "x\n```sh\n$ ls\nls\n```\n> make it"), (2, "user", "x\n```sh\n$ ls\nls\n```\n> make it"), (3, "assistant", "done <system-reminder>y</system-reminder>"), (4, "cmd", "$ no")]
    df = spark.createDataFrame([("codex", "f", i, r, t) for i, r, t in data], TURNS)
    got = recall.clean_report(df, include_inline=True).first().text
    assert got == "user:\n" + data[0][2] + "\n\ncmd: ls\ncmd: make it\ncmd: ls\ncmd: make it\ncodex:\n" + data[2][2] + "\n\ncmd: $ no"
    assert recall.clean_report(df, "MAKE", include_inline=True).first().text == "user:\n" + data[0][2] + "\n\ncmd: make it\ncmd: make it"


def test_tails_runs_and_turns(spark, tmp_path):
    df = spark.createDataFrame([(p, f"{p}{i}", i, "user", f"t{i}") for p in "abc" for i in range(4)], TURNS).selectExpr("*", "timestamp_seconds(msg_index) AS ts")
    some = spark.createDataFrame([("a1",), ("b2",), ("c3",)], "file string")
    assert [r.file for r in search.tail_turns(df, 2, providers=("a", "b"), files=some).collect()] == ["a1", "b2"]
    assert [r.file for r in search.tail_turns_per_provider(df, 1, providers=("b", "c")).collect()] == ["b3", "c3"]
    logs.write_turns(df, str(tmp_path / "turns"))
    logs.write_turns(df.where("provider = 'a' AND msg_index = 1"), str(tmp_path / "turns"))
    back = spark.read.parquet(str(tmp_path / "turns"))
    assert {r["provider"]: r["count"] for r in back.groupBy("provider").count().collect()} == {"a": 1, "b": 4, "c": 4}
    logs.write_run({"hits": df, "final": df.select("text")}, str(tmp_path / "runs"), "r1", {"k": 2})
    assert spark.read.parquet(str(tmp_path / "runs/run_id=r1/hits")).count() == 12 and spark.read.parquet(str(tmp_path / "runs/run_id=r1/final")).columns == ["text"]
    assert spark.read.json(str(tmp_path / "runs/run_id=r1/manifest")).select("kinds", "parameters", "run_id").first() == (["final", "hits"], '{"k": 2}', "r1")


def test_small_rules(spark):
    assert windows.window_for(6) == 8 and windows.window_for(99) == 6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["pushed abc1234", "commit abc1234", "we committed it as commit abc1234", None])], "i int, text string")
    got = {r.i: r.h for r in df.select("i", mentions.hashes(F.col("text"), action_only=True).alias("h")).collect()}
    assert got[0] == ["abc1234"] and not got[1] and got[2] == ["abc1234"] and not got[3]
    text = " a \t\r\n\x0b b  \n\n c" + " " * 5000 + "d  \n\n"
    tidy = spark.createDataFrame([(text,)], "t string").select(clean.tidy_lines(F.col("t")).alias("t")).first().t
    assert tidy == "\n".join(x.rstrip() for x in text.splitlines()).strip("\n")
    paths = spark.createDataFrame([("/h/.claude/projects/-x-y/s.jsonl",), ("/h/.gemini/tmp/chats/a.json",), ("/z",)], "file string")
    assert [r[0] for r in paths.select(windows.project_of()).collect()] == ["-x-y", "gemini-session", ""]


def test_mention_modes(spark):
    hits = spark.createDataFrame([("p", "f", i) for i in (1, 5, 9)], "provider string, file string, msg_index long")
    marks = spark.createDataFrame([("p", "f", i) for i in (3, 9)], "provider string, file string, msg_index long")
    near = lambda **k: {r.msg_index: r.mention_index for r in mentions.nearest_mention(hits, marks, **k).collect()}
    assert near(span=0) == {1: 3, 5: 9, 9: 9} and near(span=1) == {1: None, 5: None, 9: 9}
    assert near(direction="backward", span=0) == {1: None, 5: None, 9: 9} and near(direction="backward", span=2) == {1: None, 5: 3, 9: 9}
    between = lambda **k: {r.msg_index: (r.previous_index, r.next_index) for r in mentions.between_mention(hits, marks, **k).collect()}
    assert between(auto=True) == {1: (None, 3), 5: (3, 9), 9: (3, 9)}
    assert between(span=1) == {1: (None, None), 5: (None, None), 9: (None, None)}
    commits = spark.createDataFrame([("r", "abc1234" + "0" * 33, True, "s"), ("q", "abc1234" + "1" * 33, False, "off")], "repo string, sha string, on_branch boolean, summary string")
    found = spark.createDataFrame([("p", "f", 1, ["abc1234"])], "provider string, file string, msg_index long, hashes array<string>")
    assert [r.repo for r in mentions.resolve_commits(found, commits).collect()] == ["q"]
    assert [r.repo for r in mentions.resolve_commits(found, commits, branch_only=True).collect()] == ["r"]


def test_summaries_take_few_texts_at_a_time(spark):
    """What Python holds of a batch is bounded by rows and bytes, whatever Spark's batches are."""
    df = spark.createDataFrame([("p", f"f{i}", "line\n" * (1 + i % 400) + "x" * (20_000 if i % 9 == 0 else 0)) for i in range(1500)], "provider string, file string, text string").coalesce(1)
    sizes = lambda s: s.str.len().astype(str) + f" {len(s)} {s.str.len().sum()}"
    got = [r.summary.split() for r in summarise.map_reduce_summarise(df, sizes, 1_000_000, "reduce", "{{transcript}} .md").collect()]
    assert len(got) == 1500 and sum(int(n) for n, *_ in got) == sum(5 * (1 + i % 400) + (20_000 if i % 9 == 0 else 0) + 4 for i in range(1500))
    assert max(int(rows) for _, rows, _ in got) <= 256 and max(int(chars) for *_, chars in got) <= 1 << 20
    assert summarise.chunk_transcripts(df, 600).groupBy("file").count().count() == 1500
