"""Substring de-duplication by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. The minimiser of a window is the smallest hash
among its ``m``-word grams. Consecutive windows with the same minimiser travel together, as one
packed string of words, to the bucket of that minimiser; every occurrence of a window content
therefore meets in one bucket, where sorting finds the first one exactly.

Jobs:

1. *hot minimisers*: super-k-mers per minimiser, counted over all texts. A batch reports those with half a
   share of ``hot_share`` = 1 / (8 * buckets) or more; what is hot overall loses less than half of its count
   to batches that don't report it, so half the share of the reported counts finds all. There are
   2 / hot_share such minimisers at most, and 2 * ``max_hot`` however large the input.
2. *partition*: super-k-mers go to ``minimiser mod buckets``, with as many buckets as the octets of all texts
   need for about ``bucket_bytes`` of packed strings each (that is what a task holds at once); windows of hot minimisers are cut to
   single windows that go to the bucket of their own content hash, so that a line or phrase standing
   in a third of the documents is spread over all buckets. Equal packed strings of a batch are sent once.
3. *buckets*: sort window hashes, compare the words of equal hashes, keep the first place of each content.
4. *apply*: a window without a "first" mark repeats earlier text; words under such windows go.

Defined cases: null text has no words and stays null; texts under ``k`` words never lose any; a null
doc_id counts as the smallest id; rows with the same doc_id count as one document, and lose the same
words at the same places; empty tables give empty results; only the id and text column are read, so
other columns cannot clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, materialise, pieces

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_LONGEST_RUN = 64
#: Words of super-k-mers by words of texts: neighbours share k - 1 words and hold some 9 windows of 20 words.
_REPEATED = 3


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Longest part of a word that is hashed eight bytes at a time, all words together.
_LANES = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from begin to end in the bytes."""
    size = ends - begins
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h, live = size.astype(np.uint64) * np.uint64(_MULTIPLIERS[1]), None
    for j in range(_LANES):
        at, rest = (begins, size) if live is None else (begins[live] + 8 * j, size[live] - 8 * j)
        x = lanes[at]
        short = rest < 8
        x[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        if live is None:
            h = _mix((h ^ x) * np.uint64(_MULTIPLIERS[0]))
            live = np.flatnonzero(rest > 8)
        else:
            h[live] = _mix((h[live] ^ x) * np.uint64(_MULTIPLIERS[0]))
            live = live[rest > 8]
        if not len(live):
            return h
    for i in live:
        h[i] ^= np.uint64(xxhash.xxh64_intdigest(data[begins[i] + 8 * _LANES : ends[i]]))
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every k consecutive values, from prefix sums."""
    n = len(values)
    powers = np.cumprod(np.full(n + 1, _BASE, np.uint64))
    inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])
    return _mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _superkmers(h: np.ndarray, lengths: np.ndarray, k: int, m: int, hot: np.ndarray):
    """(first word, number of windows, bucket key, hash of the first window) of each super-k-mer.

    h: hashes of the words of some documents, one after the other; lengths: words of each document.
    """
    n = len(h)
    if n < k:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = sum((h[j : n - m + 1 + j] * np.uint64(_MULTIPLIERS[j]) for j in range(1, m)), h[: n - m + 1] * np.uint64(_MULTIPLIERS[0]))
    key = _sliding_min(_mix(grams), k - m + 1)
    whole = _window_hashes(h, k)
    ends = np.repeat(np.cumsum(lengths), lengths)[: n - k + 1]
    at = np.flatnonzero(np.arange(k, n + 1) <= ends)
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(np.uint64)
    key, whole = key[at], whole[at]
    alone = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | alone[1:]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > _LONGEST_RUN:
        parts = -(-size // _LONGEST_RUN)
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, rest = np.repeat(first, parts) + offset * _LONGEST_RUN, np.repeat(size, parts) - offset * _LONGEST_RUN
        size = np.minimum(rest, _LONGEST_RUN)
    return at[first], size, np.where(alone[first], whole[first], key[first]), whole[first]


def _documents(batch: pa.RecordBatch):
    """ids, bytes of all texts in id order with one space after each word, begin and end of each word, words of each text."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"").take(pa.array(order))
    texts = pc.binary_join_element_wise(texts, pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    lengths = np.diff(np.searchsorted(np.flatnonzero(keep & space), offsets - offsets[0], "left"))
    data, space = data[keep], space[keep]
    data[space] = 32
    ends = np.flatnonzero(space)
    return ids[order], data, np.append(0, ends[:-1] + 1)[: len(ends)], ends, lengths


def _hot_minimisers(docs: DataFrame, k: int, m: int, buckets: int, max_hot: int = 2_000_000) -> np.ndarray:
    share, least = max(1 / (8 * buckets), 1 / max_hot), 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in pieces(batches, 1 << 14, 6 << 20):
            _, data, begins, ends, lengths = _documents(batch)
            _, _, key, whole = _superkmers(_word_hashes(data, begins, ends), lengths, k, m, none)
            pairs = key[np.unique(key * np.uint64(_MULTIPLIERS[0]) + whole, return_index=True)[1]]  # equal texts of a batch count once
            values, counts = np.unique(pairs, return_counts=True)
            often = counts >= max(least, share / 2 * len(pairs))
            yield pa.record_batch(
                [pa.array(np.append(values[often], np.uint64(0)).view(np.int64)), pa.array(np.append(counts[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(pairs)))],
                names=["minimiser", "n", "of"],
            )

    counted = materialise(docs.mapInArrow(count, "minimiser long, n long, of long"), "minimiser-counts")
    total = counted.agg(F.sum("of")).first()[0] or 0
    rows = counted.groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, share / 2 * total)).select("minimiser").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


_HEAD = struct.Struct("<qq")


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second bytes, and so on: high bytes are mostly alike and compress to little."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _pack(ids, starts, sizes, texts: list[bytes], codec) -> bytes:
    """ids (ascending, as differences modulo 2**64), starts and sizes in byte planes, then the strings."""
    body = b" ".join(texts)
    ids = np.diff(ids.astype("<u8"), prepend=np.uint64(0))
    return codec.compress(b"".join([_HEAD.pack(len(ids), len(body)), _planes(ids), _planes(starts.astype("<u4")), _planes(sizes.astype("<u1")), body]))


def _unpack(blob: bytes, codec):
    raw = codec.decompress(blob)
    n, size = _HEAD.unpack_from(raw)
    at = _HEAD.size
    ids = np.cumsum(_from_planes(raw, "<u8", n, at), dtype=np.uint64).view(np.int64)
    return ids, _from_planes(raw, "<u4", n, at + 8 * n).astype(np.int64), _from_planes(raw, "<u1", n, at + 12 * n).astype(np.int64), raw[at + 13 * n : at + 13 * n + size]


def _partition(docs: DataFrame, k: int, m: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """One row per batch and bucket: its packed super-k-mers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=5)
        for batch in pieces(batches, 1 << 14, 6 << 20):
            ids, data, begins, ends, lengths = _documents(batch)
            at, size, key, _ = _superkmers(_word_hashes(data, begins, ends), lengths, k, m, hot)
            if not len(at):
                continue
            joined = data.tobytes()
            strings = [joined[a:b] for a, b in zip(begins[at].tolist(), ends[at + size + k - 2].tolist(), strict=True)]
            seen: set[bytes] = set()
            once = np.fromiter((s not in seen and not seen.add(s) for s in strings), bool, len(strings))
            doc = np.searchsorted(np.cumsum(lengths), at, side="right")
            start = at - (np.cumsum(lengths) - lengths)[doc]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            keep = np.flatnonzero(once)
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[keep])) + 1
            parts = np.split(keep, cuts)
            blobs = [_pack(ids[doc[p]], start[p], size[p], [strings[i] for i in p], codec) for p in parts]
            yield pa.record_batch([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    return docs.mapInArrow(send, "bucket long, packed binary")


def first_places(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: bytes, k: int):
    """Runs (id, start, length) of windows whose content stands at no earlier place, of packed super-k-mers."""
    data = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    begins = np.append(0, ends[:-1] + 1)
    values = _word_hashes(data, begins, ends)
    begin = np.cumsum(sizes + k - 1) - (sizes + k - 1)
    order = np.lexsort((starts, ids))
    ids, starts, sizes, begin = ids[order], starts[order], sizes[order].astype(np.int64), begin[order]
    segment = np.repeat(np.arange(len(ids)), sizes)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = begin[segment] + inside
    hashes = _window_hashes(values, k)[place]
    by_hash = np.argsort(hashes, kind="stable")
    equal = np.flatnonzero(hashes[by_hash[1:]] == hashes[by_hash[:-1]])
    first = np.ones(len(place), bool)
    first[by_hash[equal + 1]] = False
    left, right = begins[place], ends[place + k - 1]
    pairs = zip(*(x[by_hash[y]].tolist() for y in (equal, equal + 1) for x in (left, right)), strict=True)
    clash = equal[np.fromiter((text[a:b] != text[c:d] for a, b, c, d in pairs), bool, len(equal))]
    for value in np.unique(hashes[by_hash[clash]]):  # different words, one hash: decide by the words
        seen = set()
        for i in np.flatnonzero(hashes == value):
            content = text[left[i] : right[i]]
            first[i] = content not in seen
            seen.add(content)
    kept = np.flatnonzero(first)
    if not len(kept):
        return ids[:0], starts[:0], sizes[:0]
    new = np.ones(len(kept), bool)
    new[1:] = (kept[1:] != kept[:-1] + 1) | (segment[kept[1:]] != segment[kept[:-1]])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(kept)))
    head = kept[at]
    return ids[segment[head]], starts[segment[head]] + inside[head], runs


def _buckets_to_first(packed: DataFrame, k: int) -> DataFrame:
    def firsts(group: pa.Table) -> pa.Table:
        codec = zstandard.ZstdDecompressor()
        parts = [_unpack(x.as_py(), codec) for x in group.column("packed")]
        ids, starts, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
        out = first_places(ids, starts, sizes, b" ".join(p[3] for p in parts), k)
        return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(("id", "start", "n"), out, strict=True)})

    return packed.groupBy("bucket").applyInArrow(firsts, "id long, start long, n long")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 3, buckets: int | None = None, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of every row.

    A word goes if a window of ``k`` words over it has the same words as a window that starts earlier
    (smaller id, or same id and earlier start). ``buckets``: from the octets of all texts unless given.
    """
    pairs = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if buckets is None:
        octets = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = 1 + _REPEATED * octets // bucket_bytes
    hot = _hot_minimisers(pairs, k, m, buckets)
    firsts = _buckets_to_first(_partition(pairs, k, m, buckets, hot), k)
    runs = firsts.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return pairs.join(runs, "id", "left").mapInArrow(lambda batches: _apply(batches, k), "id long, text string, n_words long, n_removed long").select(id_back("id").alias("doc_id"), "text", "n_words", "n_removed")


def _apply(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out: list[bytes | None] = []
        n_words, n_removed = [], []
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        runs = batch.column("runs")
        for i, text in enumerate(texts):
            words = (text or b"").split()
            n = len(words)
            kept = words
            if n >= k:
                mark = np.zeros(n - k + 2, np.int64)
                if runs[i].is_valid:
                    at, size = (np.asarray(runs[i].values.field(x)) for x in ("start", "n"))
                    np.add.at(mark, np.minimum(at, n - k + 1), 1)
                    np.add.at(mark, np.minimum(at + size, n - k + 1), -1)
                repeated = np.cumsum(mark[:-1]) == 0
                if repeated.any():
                    edge = np.zeros(n + 1, np.int64)
                    edge[: n - k + 1] += repeated
                    edge[k:] -= repeated
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [words[j] for j in np.flatnonzero(~gone)]
            out.append(None if text is None else b" ".join(kept))
            n_words.append(n)
            n_removed.append(n - len(kept))
        yield pa.record_batch([batch.column("id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["id", "text", "n_words", "n_removed"])

