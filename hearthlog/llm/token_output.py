"""Token ids as Parquet list columns.

Documents are dealt into sorted ranges of the id before they are encoded (so texts are shuffled once and
encoded once), and Spark's Parquet writer makes the files: row groups of ``row_group_bytes``, pages of
``page_rows`` rows with column and offset indexes, ids in dictionary or delta encoding. Readers of the
metadata columns (doc_id, part, row, inside, n_tokens) never touch the ids, and a filter on doc_id skips row
groups and pages.

Encoding is that of the ``tokenizers`` library over the whole text. Its byte-level pre-tokenizer always
starts a new piece at a single space or line feed between two other characters, so texts are cut there,
the distinct cuts of a few megabytes of text into the pieces of that pre-tokenizer, each distinct piece is
encoded once by the library, and the ids are gathered with numpy. Texts with other runs of white space, texts with white
space beside an added token (the library cuts at those first), and all texts of other kinds of tokenizers, go to the library whole.

Defined cases: null text is empty (only the end id); a null doc_id sorts first; rows with the same
doc_id are ordered by a hash of the text, then the text; an empty table gives an empty one. Only id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, id_back, id_key, pieces

_NO_BREAK = r"\t\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Runs of white space that texts are not cut in: all but one or two line feeds before a word.
_RUN = rf"[{_NO_BREAK}\n][{_NO_BREAK}]|[{_NO_BREAK}]\n|\n\n\n|\n\n\z"
#: Cuts that don't go to the pattern as one text with others: with white space inside, of white space alone, or with parts of special tokens.
_ODD = rf"(?s)\A.?\z|.[{_NO_BREAK}\n]|<\|"
#: What the byte-level pre-tokenizer makes pieces of (fixed value: the pattern of that pre-tokenizer).
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces that are encoded alone: those that end in white space, or hold parts of special tokens.
_ALONE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\z|<\|"
#: Pieces lined up for one call of the library.
_LINE = 20_000


def _joined(strings: pa.Array) -> str:
    """All strings of an array (large strings without nulls) as one: what its data buffer holds."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8)
    return str(memoryview(data)[at[0] : at[-1]], "utf-8") if len(strings) and data is not None else ""


def _gather(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat`` that start at ``begins``, one after the other, and where each ends."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    return flat[np.repeat((begins - ends + counts).astype(kind), counts) + np.arange(total, dtype=kind)], ends


class Encoder:
    """Whole texts to ids. Pieces of the last chunks are remembered: all up to ``remembered``, else those of one chunk."""

    def __init__(self, tokenizer_path: str, end_id: int, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._end, self._remembered = end_id, remembered
        # the remembered pieces, and the ids of all of them with begin and count of each
        self._pieces, self._flat = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self._begins, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = json.loads(Path(tokenizer_path).read_text())
        pre, added = kind.get("pre_tokenizer") or {}, kind.get("added_tokens") or []
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer")
        plain = all(a["content"].startswith("<|") and " " not in a["content"] and not (a.get("lstrip") or a.get("rstrip") or a.get("single_word")) for a in added)
        tokens = "|".join(re.escape(a["content"]) for a in added)
        self._whole = _RUN + (rf"|[{_NO_BREAK}\n](?:{tokens})|(?:{tokens})[{_NO_BREAK}\n]" if tokens else "")
        new_line = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._break = new_line[0] if byte_level and plain and len(new_line) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Remembers distinct new pieces. A line feed between two pieces is always a piece of its own, so they are encoded as lines of one text."""
        alone = pc.match_substring_regex(new, _ALONE)
        single, lined = new.filter(alone), new.filter(pc.invert(alone))
        flats = self._ids(single.to_pylist())
        counts = [np.array([len(x) for x in flats], np.int64)]
        for start in range(0, len(lined), _LINE):
            part = pc.binary_join_element_wise(lined.slice(start, _LINE), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            (flat,) = self._ids([_joined(part)[:-1]])
            breaks = np.flatnonzero(flat == self._break)
            counts.append(np.diff(np.concatenate([[-1], breaks, [len(flat)]])) - 1)
            flats.append(np.delete(flat, breaks))
        added = np.concatenate(counts)
        self._pieces = pa.concat_arrays([self._pieces, single, lined])
        self._begins = np.append(self._begins, len(self._flat) + np.cumsum(added) - added)
        self._flat, self._counts = np.concatenate([self._flat, *flats]), np.append(self._counts, added)

    def _found(self, distinct: pa.Array) -> np.ndarray:
        """Where each distinct piece is remembered."""
        at = pc.index_in(distinct, value_set=self._pieces)
        if at.null_count:
            self._learn(distinct.filter(at.is_null()))
            at = pc.index_in(distinct, value_set=self._pieces)
        return at.to_numpy()

    def _forget_but(self, held: np.ndarray) -> None:
        self._flat, ends = _gather(self._flat, self._begins[held], self._counts[held])
        self._pieces, self._counts = self._pieces.take(pa.array(held)), self._counts[held]
        self._begins = ends - self._counts

    def _encode_cuts(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct cuts, one after the other, and how many each has. A cut but the odd ones starts with its only white space,
        so that such cuts are one text whose pieces tell where cuts start; those with parts of special tokens are pieces themselves."""
        odd = np.flatnonzero(pc.match_substring_regex(cuts, _ODD).to_numpy(zero_copy_only=False))
        plain = np.ones(len(cuts), bool)
        plain[odd] = False
        rest = cuts.filter(pa.array(plain))
        listed = _PIECE.findall(_joined(rest))
        more = [[c] if "<|" in c else _PIECE.findall(c) for c in cuts.take(pa.array(odd)).to_pylist()]
        coded = pa.array(listed + [p for x in more for p in x], pa.large_string()).dictionary_encode()
        heads = pc.or_(pc.starts_with(coded.dictionary, " "), pc.starts_with(coded.dictionary, "\n")).to_numpy(zero_copy_only=False)
        at = coded.indices.to_numpy()
        first = np.flatnonzero(heads[at[: len(listed)]])
        n_pieces = np.zeros(len(cuts), np.int64)
        n_pieces[plain] = np.diff(np.append(first, len(listed)))
        n_pieces[odd] = [len(x) for x in more]
        held = self._found(coded.dictionary)
        flat, ends = _gather(self._flat, self._begins[held[at]], self._counts[held[at]])
        if len(self._pieces) > self._remembered:
            self._forget_but(held)
        # ids stand in the order plain, odd; put them in the order of the cuts
        order = np.append(np.flatnonzero(plain), odd)
        upto = np.append(0, ends)[np.append(0, np.cumsum(n_pieces[order]))]
        counts, begins = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        counts[order], begins[order] = np.diff(upto), upto[:-1]
        return _gather(flat, begins, counts)[0], counts

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self._break is None:
            ids = self._ids(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.int32), *(np.append(x, np.int32(self._end)) for x in ids)]), np.array([len(x) + 1 for x in ids], np.int64)
        whole = pc.match_substring_regex(texts, self._whole)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), " ")
        first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        # the entries: cuts after a space or with their line feed, cuts that start a text, whole texts, the end id
        after = pc.if_else(pc.starts_with(coded.dictionary, "\n"), coded.dictionary, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())))
        starts = pc.take(coded.dictionary, pa.array(at[first])).dictionary_encode()
        flat, counts = self._encode_cuts(after)
        heads = [_PIECE.findall(x) if "<|" not in x else [x] for x in starts.dictionary.to_pylist()]
        head_pieces = pa.array([p for x in heads for p in x], pa.large_string()).dictionary_encode()
        place = self._found(head_pieces.dictionary)[head_pieces.indices.to_numpy()]
        head_flat, head_ends = _gather(self._flat, self._begins[place], self._counts[place])
        head_counts = np.diff(np.append(0, head_ends)[np.append(0, np.cumsum([len(x) for x in heads], dtype=np.int64))])
        whole_at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        wholes = self._ids(texts.take(pa.array(whole_at)).to_pylist())
        flat = np.concatenate([flat, head_flat, *wholes, np.array([self._end], np.int32)])
        counts = np.concatenate([counts, head_counts, np.array([len(x) for x in wholes], np.int64), [1]])
        begins = np.cumsum(counts) - counts
        at[first] = len(after) + starts.indices.to_numpy()
        at[first[whole_at]] = len(after) + len(heads) + np.arange(len(whole_at))
        at = np.insert(at, np.append(first[1:], len(at)), len(counts) - 1) if len(first) else at
        out, ends = _gather(flat, begins[at], counts[at])
        last = ends[np.append(first[1:], len(at) - len(first)) + np.arange(len(first))] if len(first) else ends
        return out, np.diff(last, prepend=0)


@lru_cache(2)
def _encoder(tokenizer_path: str, end_id: int, remembered: int) -> Encoder:
    return Encoder(tokenizer_path, end_id, remembered)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.Table]:
    """Batches of any size as tables of about ``chunk_bytes``; a longer text is not cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in pieces(batches, 1 << 20, chunk_bytes // 4):
        held.append(batch)
        size += batch.nbytes
        if size >= chunk_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, remembered: int = 400_000) -> DataFrame:
    """id, part, row, inside (ids of the part's documents before it), n_tokens, ids: in ascending order of id over parts and rows.

    chunk_bytes of text are encoded together and about ``remembered`` cuts kept: memory of a task against time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, inside = _encoder(tokenizer_path, end_id, remembered), 0, 0
        for chunk in _chunks(batches, chunk_bytes):
            ids, n = encoder.encode_all(chunk["text"].combine_chunks())
            ends = np.cumsum(n)
            size = len(n)
            done = 0
            while done < size:  # pieces whose lists fit 32-bit offsets and little memory
                base = int(ends[done - 1]) if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
                lists = pa.ListArray.from_arrays(pa.array(np.append(base, ends[done:upto]).astype(np.int64) - base, pa.int32()), pa.array(ids[base : ends[upto - 1]]))
                part = chunk.slice(done, upto - done)
                columns = [part["id"].combine_chunks(), part["part"].combine_chunks(), pa.array(np.arange(row + done, row + upto)), pa.array(inside + ends[done:upto] - n[done:upto]), pa.array(n[done:upto]), lists]
                yield pa.record_batch(columns, names=["id", "part", "row", "inside", "n_tokens", "ids"])
                done = upto
            row, inside = row + size, inside + int(ends[-1])
            del chunk, ids
            pa.default_memory_pool().release_unused()

    # the hash splits an id that many rows have
    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    return ordered.select("id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "id long, part long, row long, inside long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2000, compression: str = "zstd", id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, remembered: int = 400_000) -> None:
    """Write the token table. encoding: ``dictionary`` or ``delta`` (DELTA_BINARY_PACKED)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    delta = encoding == "delta"
    out = encoded(docs, tokenizer_path, end_id, id_col, text_col, chunk_bytes, remembered).write.option("compression", compression)
    out = out.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    out = out.option("parquet.enable.dictionary", str(not delta).lower()).option("parquet.writer.version", "v2" if delta else "v1")
    out.parquet(path)


def _before(tokens: DataFrame) -> DataFrame:
    """part, before: the ids of all parts before each; a row per partition of the writer."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("part", F.coalesce(before, F.lit(0)).alias("before")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of a token table."""
    tokens = spark.read.parquet(path)
    return tokens.join(_before(tokens), "part").select(id_back("id").alias("doc_id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a token table; the ids themselves are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(n) for n in ("id", "part", "inside")] + [pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["id", "part", "inside", "n_tokens", "crc"])

    tokens = spark.read.parquet(path)
    digests = tokens.select("id", "part", "inside", "ids").mapInArrow(run, "id long, part long, inside long, n_tokens long, crc long")
    return digests.join(_before(tokens), "part").select(id_back("id").alias("doc_id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def fresh_token_table(spark: SparkSession) -> str:
    return fresh_path(spark, "tokens")
