"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with each run of white space as one space. An item of
n characters has a budget of ``error_rate`` * n edits, k. It is cut into k + 1 pieces; wherever a text
holds the item with k edits at most, one of its pieces stands there unchanged. One automaton over all
pieces finds exact hits in a single pass over a text; each hit gives a window, overlapping windows of an
item are merged, and Myers' bit-parallel algorithm gives the least edit distance in the window.

The items travel to the tasks in blocks of about ``block_bytes`` of text, each block one pass over the
documents, so what a task or the driver holds doesn't grow with the benchmark: with several blocks each pass is
written before the next block is read.

Defined cases: null texts and items match nothing, nor do items without words; items shorter than
``min_chars`` must stand unchanged between word boundaries; an item that occurs several times in a text
is reported once, at its best place (the first of equals); repeated rows are reported each; item ids of
repeated items are all reported. Only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of text, end of the first such substring)."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    get = pattern_bits.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


class Matcher:
    """Finds a block of items, (item_id, text), in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        import ahocorasick

        self._items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = int(error_rate * len(text)) if len(text) >= min_chars else 0
            index, cuts = len(self._items), [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(text[a:b], []).append((index, a))
            self._items.append((item_id, text, k, len(text) < min_chars, bits_of(text), bits_of(text[::-1])))
        self._automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self._automaton.add_word(piece, (len(piece), places))
        if found:
            self._automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item in a normalised text."""
        if not self._items or not text:
            return []
        hits: dict[int, list[int]] = {}
        for last, (length, places) in self._automaton.iter(text):
            for index, offset in places:
                hits.setdefault(index, []).append(last + 1 - length - offset)
        out = []
        for index, starts in hits.items():
            item_id, item, k, short, bits, reverse = self._items[index]
            m = len(item)
            if short:
                at = next((s for s in starts if s >= 0 and not text[s - 1 : s].isalnum() and not text[s + m : s + m + 1].isalnum()), None)
                if at is not None:
                    out.append((item_id, 0, at, at + m))
                continue
            exact = next((s for s in sorted(starts) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out.append((item_id, 0, exact, exact + m))
                continue
            best = (k + 1, 0, 0)
            windows: list[list[int]] = []
            for s in sorted(set(starts)):
                a, b = max(0, s - k), min(len(text), s + m + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                if b - a < m - k:
                    continue
                distance, end = myers(bits, m, text[a:b])
                if distance < best[0]:
                    back = text[max(a, a + end - m - k) : a + end]
                    best = (distance, a + end - myers(reverse, m, back[::-1])[1], a + end)
            if best[0] <= k:
                out.append((item_id, *best))
        return out


def item_blocks(items: DataFrame, block_bytes: int, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash of the text, and whether there are several."""
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(size // block_bytes) + 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r.item, r.text) for r in part.orderBy("item").collect()], n > 1


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, min_chars: int = 50, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text): each document with each item it holds."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block, several in item_blocks(items, block_bytes, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate, min_chars)
            for batch in pieces(batches):
                rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matcher.match(normal(text))]
                yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = chosen.mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        part = materialise(part, "leaks") if several else part
        found = part if found is None else found.unionByName(part)
    return found


def _leaks(text: Column, block: list[tuple[int, str]], error_rate: float, min_chars: int) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, error_rate, min_chars)
        for batch in batches:
            yield pd.Series([bool(matcher.match(normal(t))) for t in batch], dtype=bool)

    return run(text.cast("string"))


def without_leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.08, min_chars: int = 50, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    for block, several in item_blocks(items, block_bytes, item_col, item_text_col):
        docs = docs.where(~_leaks(F.col(text_col), block, error_rate, min_chars))
        docs = materialise(docs, "without-leaks") if several else docs
    return docs


def leaked_ids(leaks: DataFrame) -> DataFrame:
    """The distinct doc_ids of ``find_leaks``."""
    return leaks.select("doc_id").distinct()
