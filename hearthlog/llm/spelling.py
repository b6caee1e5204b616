"""Groups of spelling variants: words one edit apart, found by search schemes over bidirectional FM-indexes.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word is cut into halves; one
error leaves a half exact (pigeonhole), and that half holds the word's first or last ``anchor`` characters. So:

* The vocabulary is dealt out twice: by the first ``anchor`` characters and by the last ones. What shares them and is
  near by an error in the other half meets there. Buckets of many words are split by hashes, each part of the words
  searched in each part of the vocabulary, so that no index holds more than some ``index_words`` words.
* In a bucket the words stand in one text, each between delimiters (``FmIndex``). Suffix ranks of that text give intervals of the places
  where a pattern starts; one search step (LF mapping) extends the pattern by a character to the left. An index of
  the reversed words does the same to the right. Both directions together are the bidirectional index. As a word
  is searched from one of its delimiters on, through its exact half and then across the other one, each of the two schemes walks
  one direction only, and the other's interval need not be kept in step.
* Scheme one (right): the first half exactly, then up to the closing delimiter with one error. Scheme two (left): the second half exactly, then down to
  the opening delimiter with one error. All words of a bucket are searched at once; where an error may be, only characters
  that occur before the interval's suffixes are tried. Intervals at the end give the words.
* Scheme two leaves out words that share the first half, which scheme one has found, so that every near pair counts once.
  A bucket returns, for each word, how many near words it has and the most frequent of them: no pairs.

Defined cases: null and empty texts have no words; repeated rows count again; an empty table gives an empty result; words of fewer than
twice ``anchor`` characters are refused by ``near_words``. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces, release

#: Latin letters and what stands among them in Latin-1 (fixed values), capitals of ASCII lower-cased.
LETTERS = re.compile("[a-zÀ-ÿ]+")
_KEPT = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): how often the words of at least ``least_length`` code points occur. change: (id, word) to the word that counts instead."""

    def emit(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in pieces(batches):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                for word, n in Counter(LETTERS.findall((text or b"").lower().decode())).items():
                    word = word if change is None else change(id_, word)
                    if len(word) >= least_length:
                        total[word] += n
            if len(total) > _KEPT:
                yield emit(total)
                total.clear()
        yield emit(total)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class FmIndex:
    """Suffix ranks of delimited words, and steps to the left over them. Characters are numbers from one; zero is the delimiter."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """words: one row of characters a word, filled up with zeros."""
        rows, width = words.shape
        inside = np.arange(width) < lengths[:, None]
        text = np.zeros(int(lengths.sum()) + rows + 1, np.int64)
        self._begins = np.concatenate([[0], np.cumsum(lengths + 1)])  # of each word its opening delimiter
        text[np.repeat(self._begins[:-1] + 1, lengths) + np.nonzero(inside)[1]] = words[inside]
        self.size, rank, span = len(text), text, 1
        while True:
            after = np.zeros(self.size, np.int64)
            after[: self.size - span] = rank[span:] + 1
            key = rank * (self.size + 2) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(self.size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if rank[order[-1]] == self.size - 1:
                break
            span *= 2
        self._places = order
        self.before = text[order - 1]  # the character before each suffix, by rank
        self._sorted = np.sort(self.before * self.size + np.arange(self.size))

    def step(self, chars: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """LF mapping: smaller characters before all suffixes, and the same character before suffixes of smaller rank."""
        return np.searchsorted(self._sorted, chars * self.size + ranks)

    def words_at(self, ranks: np.ndarray) -> np.ndarray:
        """The word whose opening delimiter is the suffix of this rank."""
        return np.searchsorted(self._begins, self._places[ranks])

    def search(self, words: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of words, found word) with one error, the last ``exact`` characters without any; repeats may occur."""
        n = len(words)
        zeros = np.zeros(n, np.int64)
        q, low, high = np.arange(n), self.step(zeros, zeros), self.step(zeros, np.full(n, self.size))
        for t in range(int(exact.max(initial=0))):
            go = exact[q] > t
            chars = words[q[go], lengths[q[go]] - 1 - t]
            low[go], high[go] = self.step(chars, low[go]), self.step(chars, high[go])
            q, low, high = (x[low < high] for x in (q, low, high))
        left = lengths[q] - exact[q]
        free = (q, left, low, high)  # no error yet; left: characters still to come
        used = tuple(x[:0] for x in free)
        found = []
        while len(free[0]) or len(used[0]):
            q, left, low, high = free
            c, state = self._characters(low, high)
            more = (self.step(c, low[state]), self.step(c, high[state]))
            wanted = words[q, np.maximum(left - 1, 0)]
            other = (left[state] > 0) & (c != wanted[state])
            inserted = (q[state], left[state], *more)
            replaced = (q[state][other], left[state][other] - 1, more[0][other], more[1][other])
            dropped = (q[left > 0], left[left > 0] - 1, low[left > 0], high[left > 0])
            free = self._matched(words, free)
            ended = used[1] == 0
            done = tuple(x[ended] for x in used)
            close = np.zeros(len(done[0]), np.int64)
            first, last = self.step(close, done[2]), self.step(close, done[3])
            sizes = last - first
            found.append((np.repeat(done[0], sizes), self._run(first, sizes)))
            used = tuple(np.concatenate(x) for x in zip(self._matched(words, used), inserted, replaced, dropped, strict=True))
        rows, ranks = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (zeros[:0], zeros[:0])
        return rows, self.words_at(ranks)

    def _matched(self, words: np.ndarray, states: tuple) -> tuple:
        q, left, low, high = (x[states[1] > 0] for x in states)
        chars = words[q, left - 1]
        low, high = self.step(chars, low), self.step(chars, high)
        keep = low < high
        return q[keep], left[keep] - 1, low[keep], high[keep]

    @staticmethod
    def _run(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """first, first + 1, ... of each, ``sizes`` numbers."""
        begins = np.cumsum(sizes) - sizes
        return np.arange(int(sizes.sum())) - np.repeat(begins - first, sizes)

    def _characters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(character, row): the characters before the suffixes of each interval, delimiters left out."""
        size, most = high - low, int(self.before.max(initial=0)) + 1
        small = np.flatnonzero(size <= most)
        state = np.repeat(small, size[small])
        key = np.unique(state * most + self.before[self._run(low[small], size[small])])
        state, c = key // most, key % most
        large = np.flatnonzero(size > most)
        state, c = np.concatenate([state, np.repeat(large, most)]), np.concatenate([c, np.tile(np.arange(most), len(large))])
        keep = (c > 0) & (self.step(c, low[state]) < self.step(c, high[state]))
        return c[keep], state[keep]


def _characters(words: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character numbers (code points among ``numbers``; others get one beyond), and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    table = np.zeros((len(words), int(lengths.max(initial=1))), np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    at = np.searchsorted(numbers, points)
    known = numbers[np.minimum(at, len(numbers) - 1)] == points
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.where(known, at + 1, len(numbers) + 1)
    return table, lengths


def _turned(table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The rows with their words reversed."""
    at = lengths[:, None] - 1 - np.arange(table.shape[1])
    return np.where(at >= 0, np.take_along_axis(table, np.maximum(at, 0), axis=1), 0)


def near_in(base: list[str], queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, base word), each pair once: near words that share the first half of the query (right), or its second half but
    not the first one (left)."""
    numbers = np.unique(np.frombuffer("".join(base).encode("utf-32-le"), "<u4"))
    table, lengths = _characters(base, numbers)
    index = FmIndex(_turned(table, lengths) if right else table, lengths)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(queries), 2048):
        asked, sizes = _characters(queries[at : at + 2048], numbers)
        half = sizes // 2
        r, f = index.search(_turned(asked, sizes) if right else asked, sizes, half if right else sizes - half)
        pair = np.unique((r + at) * len(base) + f)
        rows.append(pair // len(base))
        found.append(pair % len(base))
    rows, found = np.concatenate(rows), np.concatenate(found)
    keep = [q != b and (right or not b.startswith(q[: len(q) // 2])) for q, b in ((queries[i], base[k]) for i, k in zip(rows.tolist(), found.tolist(), strict=True))]
    return rows[keep], found[keep]


def near_words(vocabulary: DataFrame, anchor: int = 3, index_words: int = 16384, query_words: int = 16384) -> DataFrame:
    """(word, n_near, near_n, near): of each word that has near ones, how many, and the one with the largest n (ties: the smallest word).

    vocabulary: (word, n), distinct words of twice ``anchor`` characters or more; read several times, so it should be a written table.
    """
    words = vocabulary.select(F.when(F.length("word") >= 2 * anchor, F.col("word")).otherwise(F.raise_error(F.lit("a word is shorter than two anchors"))).alias("word"), "n")
    ends = F.array(F.struct(F.lit(True).alias("right"), F.substring("word", 1, anchor).alias("end")), F.struct(F.lit(False).alias("right"), F.substring("word", -anchor, anchor).alias("end")))
    dealt = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    split = lambda rows: F.ceil(F.col("held") / F.lit(rows)).cast("int")
    held = materialise(dealt.groupBy("right", "end").agg(F.count("*").alias("held")), "word-ends")
    total = max(1, held.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0])
    # ends of few words share an index; those of many have parts of their own
    shared = F.when(F.col("held") * 4 < index_words, F.concat(F.lit("#"), F.pmod(F.xxhash64("end"), F.lit(-(-total // index_words))).cast("string"))).otherwise(F.col("end"))
    parts = held.select("right", "end", shared.alias("bucket"), split(index_words).alias("nb"), split(query_words).alias("nq"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = dealt.join(parts, ["right", "end"])
    base = dealt.select("right", "bucket", F.pmod(F.xxhash64("word"), "nb").cast("int").alias("b"), each("nq").alias("q"), "word", "n")
    ask = dealt.select(F.col("right").alias("to"), F.col("bucket").alias("into"), each("nb").alias("at"), F.pmod(F.xxhash64("word", F.lit(1)), "nq").cast("int").alias("of"), F.col("word").alias("asked"))

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = left.sort_by("word") if left.num_rows else left
        base, queries = order.column("word").to_pylist(), right.column("asked").to_pylist()
        rows, found = near_in(base, queries, key[0].as_py()) if base and queries else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = order.column("n").to_numpy()[found]
        best = np.lexsort((found, -n, rows))
        rows, found, n = rows[best], found[best], n[best]
        some, first, count = np.unique(rows, return_index=True, return_counts=True)
        return pa.table({"word": pa.array([queries[i] for i in some.tolist()], pa.string()), "n_near": pa.array(count, pa.int64()), "near_n": pa.array(n[first], pa.int64()), "near": pa.array([base[i] for i in found[first].tolist()], pa.string())})

    found = base.groupBy("right", "bucket", "b", "q").cogroup(ask.groupBy("to", "into", "at", "of")).applyInArrow(compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    out = materialise(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.near").alias("near")), "near-words")
    release(held)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling the way; forms have no cycles."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        release(at)
        path, at = new.written_path, new.select("word", "root")
        at.written_path = path
        if new.where("moved").isEmpty():
            return at


def spelling_variants(counts: DataFrame, least_count: int = 5, times: int = 5, **how) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words that occur ``least_count`` times: a word's form is the most frequent near word,
    if that is at least ``times`` as frequent."""
    vocabulary = materialise(counts.where(F.col("n") >= least_count).select("word", "n"), "vocabulary")
    near = near_words(vocabulary, **how)
    clear = F.col("near_n") >= times * F.col("n")
    known = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("near_n")).alias("form_n"))
    known = materialise(known, "word-forms")
    last = roots(known.where("form IS NOT NULL"))
    release(vocabulary, near)
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
