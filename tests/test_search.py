"""Search against the full-text engine of the standard library's sqlite3, and queries against DuckDB."""

import os
import random
import sqlite3

import pytest

from hearthlog.operators import mentions, search, summarise

WORDS = "alpha beta gamma delta epsilon zeta alp bet café v0 the".split()


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(3)
    rows = [("codex", f"f{i // 7}", i % 7 + 1, "user", " ".join(rng.choices(WORDS, k=rng.randint(1, 15)))) for i in range(90)]
    df = spark.createDataFrame(rows, "provider string, file string, msg_index long, role string, text string").selectExpr("*", "timestamp_seconds(msg_index) AS ts")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, file UNINDEXED, msg_index UNINDEXED)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(r[4], r[1], r[2]) for r in rows])
    return search.build_index(df), con


CASES = ["alpha", "alpha beta", "alpha OR zeta", "alpha NOT beta", '"alpha beta"', "CAFE the", "v0.beta"]


def test_match_and_rank(spark, index):
    ours, con = index
    queries = spark.createDataFrame(list(enumerate(CASES)), "query_id int, query string")
    cooked = {r.query_id: r.c for r in queries.select("query_id", search.cook_query(queries["query"]).alias("c")).collect()}
    got = search.bm25_scores(ours, search.normalise_queries(queries)).collect()
    for i, q in enumerate(CASES):
        want = {(f, m): -s for f, m, s in con.execute("SELECT file, msg_index, bm25(t) FROM t WHERE t MATCH ?", (cooked[i],))}
        mine = {(r.file, r.msg_index): r.score for r in got if r.query_id == i}
        assert mine.keys() == want.keys(), q
        assert all(abs(mine[k] - want[k]) < 1e-6 for k in want), q


def test_empty_query_has_no_hits(spark, index):
    queries = spark.createDataFrame([(0, "..."), (1, "")], "query_id int, query string")
    assert search.normalise_queries(queries).isEmpty()


def test_action_words(spark):
    rows = [("pushed abc1234", True), ("committed abc1234", False), ("commit abc1234 ABCDEF1 abc123 abc1234", True), ("commit " + "a" * 41, False)]
    df = spark.createDataFrame([("p", "f", i, "user", t) for i, (t, _) in enumerate(rows)], "provider string, file string, msg_index long, role string, text string")
    got = {r.msg_index: r.hashes for r in mentions.commit_mentions(df).collect()}
    assert got == {0: ["abc1234"], 2: ["abc1234"]}


def test_reduce(spark):
    df = spark.createDataFrame([("p", "a", "short"), ("p", "b", "\n".join(["line"] * 100))], "provider string, file string, text string")
    got = {r.file: r.summary for r in summarise.map_reduce_summarise(df, lambda s: s.str[:10], 120, "reduce", "{{transcript}} .md").collect()}
    assert got["a"] == "short .md" and got["b"].startswith("Chunk 1/")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", ["normalise_queries", "match_boolean", "window_spans", "nearest_mention_forward", "between_mention", "collapse_repeats", "clean_turns"])
def test_against_duckdb(spark, name):
    import duckdb

    from hearthlog.plans.registry import ORACLES, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("conversations", "documents", "events", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
