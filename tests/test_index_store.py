"""Index generations, hot terms in parts, phrases from their rarest word, snippets of long turns."""

import os
import random
import time

from pyspark.sql import functions as F

from hearthlog.operators import search
from hearthlog.operators.index_store import IndexStore

TURNS = "provider string, file string, msg_index long, role string, text string"
WORDS = "alpha beta gamma delta epsilon zeta alp bet café v0 the".split()


def some_turns(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [("codex", f"f{i // 7}", i % 7 + 1, "user", "the " + " ".join(rng.choices(WORDS, k=rng.randint(1, 15))) + f" w{rng.randrange(400)}") for i in range(n)]
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "timestamp_seconds(msg_index) AS ts")


def batch(spark, *queries):
    return search.normalise_queries(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"))


QUERIES = ("alpha beta", '"beta gamma the"', "the NOT zeta", "w1 OR w22", '"the alp"', "caf", "none", "w", "")


def scores(index, q):
    return sorted((r.query_id, r.file, r.msg_index, round(r.score, 9)) for r in search.bm25_scores(index, q).collect())


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_generations_score_like_a_full_build(spark, tmp_path):
    q, turns = batch(spark, *QUERIES), some_turns(spark)
    store = IndexStore(spark, str(tmp_path / "index"), most_generations=3)
    store.update(turns)
    (first,) = store.generations()
    changed = turns.where("file IN ('f2', 'f30', 'f77')").withColumn("text", F.concat(F.lit("alpha newword "), "text"))
    files = spark.createDataFrame([("f2",), ("f30",), ("f77",), ("f5",)], "file string")  # f5 vanished
    store.update(changed, files)
    after = turns.join(files, "file", "left_anti").unionByName(changed)
    want = scores(search.build_index(after), q)
    assert scores(store.read(), q) == want and len(want) > 100
    second = store.generations()[1]
    written = spark.read.parquet(str(tmp_path / f"index/{second}/postings")).count()
    assert written < 0.02 * spark.read.parquet(str(tmp_path / f"index/{first}/postings")).count()
    assert size_of(tmp_path / f"index/{second}/postings") < 0.2 * size_of(tmp_path / f"index/{first}/postings")
    store.merge()
    assert len(store.generations()) == 1 and scores(store.read(), q) == want
    assert store.vacuum() == 2 and scores(store.read(), q) == want
    for i in range(4):
        store.update(after.where("file = 'f9'").withColumn("text", F.lit(f"only {i}")))
    assert len(store.generations()) <= 3
    assert scores(store.read(), q) == scores(search.build_index(after.withColumn("text", F.when(F.col("file") == "f9", "only 3").otherwise(F.col("text")))), q)


def test_hot_terms_in_parts(spark):
    q, index = batch(spark, *QUERIES), search.written_index(some_turns(spark))
    want = sorted(map(tuple, search.match_atoms(index, q).collect()))
    assert sorted(map(tuple, search.match_atoms(index, q, part_postings=50).collect())) == want


def test_dictionary_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 3)
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcé0", k=rng.randint(1, 6))) for _ in range(400)})
    postings = spark.createDataFrame([(w,) for w in words] + [("a",)], "term string").repartition(4)
    terms = search.build_terms(postings).cache()
    prefixes = sorted({w[:k] for w in words for k in (1, 2, 3, 6)} | {"zz", ""})
    atoms = spark.createDataFrame([(i, 0, p) for i, p in enumerate(prefixes)], "query_id int, atom_id int, prefix string")
    got = sorted((r.query_id, r.term, r.n) for r in search.prefix_terms(terms, atoms).collect())
    assert got == sorted((i, w, 1 + (w == "a")) for i, p in enumerate(prefixes) if p for w in words if w.startswith(p))
    plan = search.prefix_terms(terms, atoms)._jdf.queryExecution().toString()
    assert terms.select("block").distinct().count() > 50 and "posting" not in plan


def slow_window(toks, atoms, n):
    starts = [[i for i in range(1, len(toks) - len(t) + 2) if all(toks[i - 1 + k].startswith(w) if p and k == len(t) - 1 else toks[i - 1 + k] == w for k, w in enumerate(t))] for t, p in atoms]
    heads = sorted({i for s in starts for i in s})
    first = max(heads, key=lambda h: (sum(any(h <= x and x + len(t) <= h + n for x in s) for (t, _), s in zip(atoms, starts, strict=True)), -h), default=1)
    last = min(first + n - 1, len(toks))
    cover = lambda i, more: any(x <= i and i + more < x + len(t) for (t, _), s in zip(atoms, starts, strict=True) for x in s)
    spans = []
    for i in range(first, last + 1):
        if cover(i, 0):
            if spans and spans[-1][1] == i - 1 and cover(i - 1, 1):
                spans[-1] = (spans[-1][0], i)
            else:
                spans.append((i, i))
    return first, last, spans


def test_window_sweep_by_brute_force():
    rng = random.Random(5)
    for _ in range(2000):
        toks = [rng.choice(["a", "b", "c", "ab", "abc"]) for _ in range(rng.randint(1, 25))]
        atoms = [([rng.choice(["a", "b", "c", "ab"]) for _ in range(rng.randint(1, 3))], rng.random() < 0.5) for _ in range(rng.randint(1, 4))]
        n = rng.randint(1, 8)
        assert search.best_window(toks, atoms, n) == slow_window(toks, atoms, n), (toks, atoms, n)


def test_snippet_of_a_long_turn(spark):
    text = " ".join(("alpha beta" if i % 20 == 0 else f"w{i}") for i in range(200_000))
    df = spark.createDataFrame([("p", "f", 1, "user", text)], TURNS).selectExpr("*", "timestamp_seconds(1) AS ts")
    q = batch(spark, "alpha beta w199999")
    hits = spark.createDataFrame([(0, 1, "p", "f", 1)], "query_id int, rank int, provider string, file string, msg_index long")
    index = search.Index(df, None, None)
    start = time.time()
    snip = search.snippets(hits, index, q, 50).first().snip
    assert time.time() - start < 30 and snip.startswith("…") and "[alpha] [beta]" in snip and snip.endswith("[w199999]")
