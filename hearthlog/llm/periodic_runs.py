"""Periodic runs of words in a text, from Lyndon arrays that a suffix sorter's first phase yields.

A run is a stretch of consecutive words with smallest period q, ``least_periods`` times q and ``least_words`` words long
at least, that no neighbouring word extends. Each document is judged by itself, as a whole.

* Lyndon arrays (``lyndon_lengths``): Baier's grouping. Suffixes start in groups by their first word; groups are taken
  from the highest down, and each suffix of the group taken lifts its nearest lower suffix to the left, out of that
  one's group into a new group right above it, in order of how many suffixes lift it. The text that a group is known
  to share when it is taken is the longest Lyndon word at each of its suffixes.
* This is done under the words' order and under the reverse one. Every run has a Lyndon root in one of them
  (the runs theorem): a longest Lyndon word that is as long as the period. A run of three periods or more has
  that root twice side by side, and longest common extensions (LCE) to both sides of it give the run.
* The sorter is a loop in Python, so it is given only stretches that can hold a run. In a run of ``least_periods`` >= 3
  and ``least_words`` >= 6, every five words but the last few come again, a period later. So the starts of all five-word
  windows that come again later in the document are marked; a run starts in a stretch of marks and ends at most
  (marks + 4) / 2 + 5 words behind it. Equal windows have equal hashes, so that nothing is lost; hashes that are equal by
  chance only lengthen a stretch. The LCE reads the whole document.

Defined cases: null and empty texts have no words, no runs, and null and empty collapsed texts; repeated rows and ids are judged row by
row; an empty table gives an empty result; only the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Words of the windows that mark where runs can be.
_MARK = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place (the end of the text counts as less than any code)."""
    n = len(codes)
    group = [0, *codes]  # places count from one; 0 stands for none
    up = list(range(n + 1))  # leads to the nearest place to the left that was not taken yet
    length = [0] * (n + 1)
    names = sorted(set(codes))
    items: dict[int, list[int]] = {c: [] for c in names}
    for i, c in enumerate(codes, 1):
        items[c].append(i)
    shared = dict.fromkeys(names, 1)
    below = dict(zip(names[1:], names[:-1], strict=True))
    above = {b: a for a, b in below.items()}
    new = (names[-1] + 1) if names else 0
    at = names[-1] if names else None
    while at is not None:
        members = [p for p in items.pop(at) if group[p] == at]
        size = shared[at]
        for p in members:
            up[p] = p - 1
            length[p] = size
        lifted: dict[int, int] = {}
        for p in members:
            x = p - 1
            while up[x] != x:
                up[x] = x = up[up[x]]
            up[p] = x
            if x:
                lifted[x] = lifted.get(x, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in lifted.items():
            parts.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(parts, reverse=True):
            moved = parts[times, old]
            for p in moved:
                group[p] = new
            items[new], shared[new] = moved, shared[old] + times * size
            higher = above[old]
            below[new], above[old], above[new], below[higher] = old, new, higher, new
            new += 1
        at = below.get(at)
    return length[1:]


def common_extension(w: np.ndarray, i: int, j: int, step: int = 1) -> int:
    """How many words from i and from j on are the same, to the right (step 1) or to the left (step -1); i < j."""
    most = len(w) - j if step == 1 else i + 1
    done, take = 0, 32
    while done < most:
        take = min(2 * take, 1 << 16, most - done)
        if step == 1:
            same = w[i + done : i + done + take] == w[j + done : j + done + take]
        else:
            same = (w[i - done - take + 1 : i - done + 1] == w[j - done - take + 1 : j - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done += take
    return done


def _stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: stretches (from, to) of words that overlap no other."""
    n = len(hashes)
    h = np.zeros(n - _MARK + 1, np.uint64)
    for i in range(_MARK):
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + hashes[i : n - _MARK + 1 + i]
    order = np.argsort(h, kind="stable")
    again = order[:-1][h[order[:-1]] == h[order[1:]]]
    if not len(again):
        return []
    marked = np.zeros(len(h) + 2, np.int8)
    marked[again + 1] = 1
    edge = np.diff(marked)
    out: list[tuple[int, int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        end = min(n, b + (b - a + 4) // 2 + _MARK + 2)
        a = max(0, a - 1)
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


def find_runs(words: list, least_words: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if least_periods < 3 or least_words < 6:
        raise ValueError("runs have six words and three periods at least")
    n = len(words)
    if n < least_words:
        return []
    stretches = _stretches(np.fromiter(map(hash, words), np.int64, n).view(np.uint64))
    if not stretches:
        return []
    numbers: dict = {}
    codes = [numbers.setdefault(w, len(numbers)) for w in words]
    w, most, found = np.array(codes, np.int64), len(numbers), set()
    for a, b in stretches:
        part = codes[a:b]
        for order in (part, [most - c for c in part]):
            lyndon = np.array(lyndon_lengths(order), np.int64)
            i = np.flatnonzero(np.arange(b - a) + lyndon < b - a)
            i = i[lyndon[i] == lyndon[i + lyndon[i]]]
            i = i[w[a + i] == w[a + i + lyndon[i]]]
            reached: dict[int, int] = {}  # by period, the end of its last run
            for at, period in zip((i + a).tolist(), lyndon[i].tolist(), strict=True):
                if at + period < reached.get(period, 0):
                    continue
                right = common_extension(w, at, at + period)
                left = common_extension(w, at - 1, at + period - 1, -1)
                length = left + period + right
                if right >= period:
                    reached[period] = at + period + right
                if length >= max(least_words, least_periods * period):
                    found.add((at - left, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [x for x, gone in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """Of every row: its id, n_words, n_runs, the run with the greatest length / period (start, length, period, exponent_milli; ties: smallest
    start, then period; nulls without a run), all runs by start and period, and the text without the repetitions (``collapsed``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((name, pa.int64()) for name in ("id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")), ("runs", pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))), ("collapsed", pa.string())])
        for batch in pieces(batches, 1024, 8 << 20):
            out: dict[str, list] = {name: [] for name in schema.names}
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                runs = find_runs(words, least_words, least_periods)
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
                kept = None if text is None else b" ".join(collapsed(words, runs)).decode()
                values = (id_, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept)
                for name, value in zip(schema.names, values, strict=True):
                    out[name].append(value)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
