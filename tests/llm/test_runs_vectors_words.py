"""Periodic runs, near vectors and spelling variants against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.llm import embedding_copies, periodic_runs, spelling
from hearthlog.llm.registry import misspelt, with_periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least_words=6, periods=4):
    out = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, periods * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_lyndon(s):
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] <= s[i:]), len(s) - i) for i in range(len(s))]


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        assert periodic_runs.lyndon_lengths(s) == slow_lyndon(s)


def test_runs_by_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        words = []
        for _ in range(rng.randint(1, 5)):
            part = [str(rng.randrange(rng.choice([1, 2, 3, 30]))) for _ in range(rng.randint(1, 8))] * rng.randint(1, 8)
            words += part[: len(part) - rng.randint(0, 4)]
        assert periodic_runs.find_runs(words) == slow_runs(words)
        assert periodic_runs.find_runs(words, 9, 3) == slow_runs(words, 9, 3)


def test_runs_of_a_long_text_take_linear_time():
    rng = random.Random(3)
    period = [f"w{rng.randrange(50)}" for _ in range(20_000)]
    assert periodic_runs.find_runs(period * 5) == [(0, 100_000, 20_000)]
    assert periodic_runs.find_runs(["again"] * 300_000) == [(0, 300_000, 1)]


def test_runs_of_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4, "é b é b " * 5, "a b c " * 9 + "b a " * 9, " ".join(["line of text"] * 5000)]
    texts += [" ".join(rng.choices("abc", k=200)) for _ in range(30)] * 2
    rows = [(i // 2, t, "x", "y", 3) for i, t in enumerate(texts)] + [(None, "z " * 8, "x", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, id long").repartition(3)
    got = sorted(periodic_runs.periodic_runs(df).collect(), key=str)
    want = []
    for id_, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = None if text is None else " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((id_, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None, runs, kept))
    assert sorted([(*r[:7], [tuple(x) for x in r.runs], r.collapsed) for r in got], key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_planted_periods(spark):
    df = with_periods(spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40 + i))) for i in range(60)] + [(None, "a b"), (61, None), (62, "")], "doc_id long, text string"))
    for id_, text in ((r.doc_id, r.text) for r in df.collect()):
        import zlib

        h, n = zlib.crc32(str(id_).encode()), len((text or "").split())
        if id_ is not None and id_ < 60 and h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            assert text.split() == [f"w{i if i < a else a + (i - a) % p}" for i in range(n)]
        elif id_ is not None and id_ < 60:
            assert text.split() == [f"w{i}" for i in range(n)]


def planted_vectors(seed=5, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1500, dim))
    for i in range(300):  # copies near the threshold, on either side of it
        x[1000 + i] = x[i] / np.linalg.norm(x[i]) + rng.normal(size=dim) / dim**0.5 * rng.uniform(0.05, 0.4)
    crowd = x[7] / np.linalg.norm(x[7])
    x[1300:1400] = crowd + rng.normal(size=(100, dim)) * 0.02
    x[1400:1450] = x[0]
    x[1450:1460] = 2 * x[1]
    return x


def slow_links(x, ids, similarity=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= similarity
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("how", [{"spread": float("inf")}, {"spread": float("inf"), "base_rows": 40, "query_rows": 60}])
def test_near_vectors_that_probe_all_lists_are_exact(spark, how):
    x = planted_vectors()
    ids = list(range(3, 3 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 1, "d", 2) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, id long, digest string, node int").repartition(5)
    links, label = slow_links(x, ids)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_copies.near_vectors(df, list_rows=100, **how).collect()}
    assert got == {i: (int(n), int(c), i == c) for i, n, c in zip(ids, links, label, strict=True)}


def test_recall_of_the_margin(spark):
    x = planted_vectors(6, 64).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links, _ = slow_links(x.astype(float), list(range(len(x))))
    got = {r.id: r.n_links for r in embedding_copies.near_vectors(df, list_rows=32).collect()}
    assert all(got[i] <= n for i, n in enumerate(links))
    single = [i for i in range(1000, 1300) if links[i]]
    assert sum(got[i] for i in single) >= 0.97 * links[single].sum()
    assert sum(got.values()) >= 0.97 * links.sum()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1e300, 0.0]), (None, [3.0, 0.01]), (None, None), (10, [-0.0, 1e-310]), (11, [0.0, 5.0]), (9, [0.0, 7.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in embedding_copies.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, None)]
    want = [*alone, (1, 2, None, False), (2, 2, None, False), (None, 2, None, True), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True), (10, 1, 10, True), (11, 1, 10, False)]
    assert got == sorted(want, key=str)
    assert embedding_copies.near_vectors(df.limit(0)).count() == 0


def test_distances_by_table_are_those_to_decoded_vectors():
    rng = np.random.default_rng(3)
    x = embedding_copies.unit(rng.normal(size=(600, 10)))
    codec = embedding_copies.Codec.fit(x, 4, 4, 0.1)
    own, codes, error = codec.encode(x)
    rows = np.flatnonzero(own == 2)
    decoded = codec.centres[2] + codec.books[np.arange(3), codes[rows]].reshape(len(rows), -1)[:, :10]
    want = np.linalg.norm(x[:50, None] - decoded, axis=2)
    assert np.allclose(codec.distances(x[:50], 2, codes[rows]), want)
    assert np.allclose(np.linalg.norm(x[rows] - decoded, axis=1), error[rows])


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_search_schemes_by_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        letters = "ab" + rng.choice(["", "é", "cdefgh"])
        words = sorted({"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(rng.randint(1, 120))})
        base, queries = (sorted(rng.sample(words, rng.randint(1, len(words)))) for _ in range(2))
        found = [(queries[i], base[k]) for right in (True, False) for i, k in zip(*spelling.near_in(base, queries, right), strict=True)]
        assert sorted(found) == sorted((q, b) for q in queries for b in base if near(q, b))


def slow_variants(counts, least=5, times=5):
    voc = {w: n for w, n in counts.items() if n >= least}
    forms, out = {}, {}
    for w in voc:
        close = sorted((-voc[x], x) for x in voc if near(w, x))
        forms[w] = close[0][1] if close and -close[0][0] >= times * voc[w] else None
        out[w] = [voc[w], len(close), forms[w], voc.get(forms[w])]
    for w in voc:
        root = w
        while forms[root]:
            root = forms[root]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


@pytest.mark.parametrize("how", [{}, {"index_words": 8, "query_words": 5}])
def test_spelling_variants(spark, how):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcé", k=rng.randint(6, 8))) for _ in range(40)]
    counts = Counter()
    for s in stems:
        counts[s] += rng.choice([5, 30, 700, 20_000])
        for _ in range(6):
            i = rng.randrange(len(s))
            counts[rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcéz") + s[i:], s[:i] + rng.choice("abcz") + s[i + 1 :]])] += rng.choice([1, 5, 6, 30, 140])
    counts = {w: n for w, n in counts.items() if len(w) >= 6} | {"zzzzzz": 5, "zzzzzza": 30, "zzzzzzab": 700}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(df, **how).collect()}
    assert got == slow_variants(counts)
    assert any(r[4] != r[2] and r[2] for r in got.values()) and spelling.spelling_variants(df.limit(0)).count() == 0


def test_word_counts(spark):
    texts = [None, "", "Straße STRASSE straße ÄRGER Ärger-ärger", "Abcdef abcdefg1abcdefg", "x" * 100_000, "abcdef " * 500]
    rows = [(i, t, "w", 1) for i, t in enumerate(texts * 3)] + [(None, "abcdef", "w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(2)
    want = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = misspelt(i, "".join(c.lower() if c.isascii() else c for c in w))
            want[w] += len(w) >= 6
    assert {r.word: r.n for r in spelling.word_counts(df, change=misspelt).collect()} == {w: n for w, n in want.items() if n}
    with pytest.raises(Exception, match="shorter"):
        spelling.near_words(df.select(F.lit("abc").alias("word"), F.lit(9).cast("long").alias("n"))).count()
