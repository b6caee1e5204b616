"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

Fingerprint: 64 bits; a bit is set if more than half of the XXH64 values (seed 42) of all ``n``-word
shingles, repeats included, have it set. Texts of fewer words have one shingle, the whole sequence;
texts without words (null, empty) have fingerprint zero and are linked like any other.

Join (two or fewer differing bits) over distinct fingerprints:

* A fingerprint is cut into three segments of 22, 21 and 21 bits. Two errors leave at least one
  segment without an error (pigeonhole), and any other segment with two at most.
* Each segment is read as a word of the perfect binary [23, 12] Golay code. Words at distance two or
  less have a codeword within distance four of both, so the indices of those codewords (1 or 6 of
  4096) are keys that such words share. A join key is an exact segment plus one index of the next one.
* Buckets of up to ``bucket_limit`` fingerprints are compared inside and verified by bit counts.
  Fuller buckets (masses of near copies) take an exact way without pairs: each of their fingerprints
  is put at the 65 points within one bit of it; fingerprints within two bits share such a point, and
  those that share a point are within two bits. A point has 65 neighbours at most, so groups are bounded.
* Components: hooking and pointer jumping over a table of labels, written in the shared folder each round.

Rows with a null doc_id take part with the smallest id; repeated rows are kept. Only the id and text
columns are read, so extra columns cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, materialise, pieces, release

#: Low and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the [23, 12, 7] Golay code.
_GENERATOR = 0b101011100011


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, n: int = 3) -> int:
    """SimHash of one text (UTF-8)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-n]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, (ends[n - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - n + 1)
    return majority_bits(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """id (null: smallest long), fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            values = np.fromiter((fingerprint(t or b"", n) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache(1)
def _codewords() -> np.ndarray:
    index = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(index >> np.uint32(bit) & np.uint32(1), np.uint32(_GENERATOR << bit), np.uint32(0))
    return words


def golay_indices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords within distance four of each 23-bit word."""
    words = _codewords()
    rows, found = [], []
    for at in range(0, len(values), 2048):
        near = np.bitwise_count(values[at : at + 2048, None].astype(np.uint32) ^ words[None, :]) <= 4
        r, c = np.nonzero(near)
        rows.append(r + at)
        found.append(c)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each fingerprint: an exact segment with the Golay indices of the next segment."""
    fps = fps.astype(np.int64).view(np.uint64)
    parts = [(fps >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        r, index = golay_indices(parts[(s + 1) % 3])
        rows.append(r)
        keys.append((np.uint64(s) << np.uint64(40)) | (parts[s][r] << np.uint64(12)) | index.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def _keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            fps = batch.column(0).to_numpy()
            rows, keys = golay_keys(fps)
            yield pa.record_batch([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])

    return distinct.mapInArrow(run, "key long, fp long")


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, bits: int = 2, bucket_limit: int = 48) -> DataFrame:
    """(a, b) with a < b: links that connect exactly what lies within ``bits`` (two at most) of each other.

    distinct: one column fp, without repeats.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the key scheme covers up to two differing bits")
    keys = materialise(_keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"))
    crowded = materialise(sizes.where(F.col("n") > bucket_limit).select("key"), "golay-crowded", narrow=True)

    small = keys.join(crowded, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    within = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (_differ(a, b) <= bits)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    few = small.where(F.size("fps") > 1).select(F.explode(within).alias("e")).select("e.*").distinct()

    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(2**63)).cast("long") for i in range(64)])
    points = keys.join(crowded, "key", "left_semi").select("fp").distinct().select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    if bits == 2:
        hubs = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), "fps")
        many = hubs.select("a", F.explode("fps").alias("b")).where("a != b").distinct()
    else:
        crowd = points.where(F.col("point") == F.col("fp")).select("fp")
        many = points.join(crowd.select(F.col("fp").alias("point")), "point", "left_semi").select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b")).where((F.col("a") != F.col("b")) & F.lit(bits == 1)).distinct()
    out = materialise(few.unionByName(many).distinct(), "golay-links", narrow=True)
    release(keys, crowded)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (a, b).

    Each round hooks labels over the edges and halves the paths; labels only fall, and the loop ends
    when a round changes none. The driver sees one count a round. A giant component or the hub of a star puts one key on many rows
    only on one side of a join whose other side has it once, which a skew join splits; minima are combined before the shuffle.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", narrow=True)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("f")), "labels", narrow=True)
    written = labels
    for _ in range(max_rounds):
        up = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        near = both.join(labels.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b").groupBy("a").agg(F.min("fb").alias("m"))
        seen = materialise(labels.join(up, "f").join(near.withColumnRenamed("a", "node"), "node").select("node", "f", F.least("g", "m").alias("v")), "seen", narrow=True)
        hooked = seen.groupBy("f").agg(F.min("v").alias("h")).select(F.col("f").alias("node"), "h")
        step = seen.join(hooked, "node", "left").select("node", F.least("f", "v", F.coalesce("h", "f")).alias("f"), F.col("f").alias("old"))
        step = materialise(step, "labels", narrow=True)
        release(seen, written)
        labels, written = step.select("node", "f"), step
        if step.where("f != old").isEmpty():
            release(both)
            labels.written_path = step.written_path
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, bits: int = 2, bucket_limit: int = 48) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every row."""
    fps = materialise(fingerprints(docs, id_col, text_col, n), "fingerprints")
    least = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints", narrow=True)
    labels = components(links(least.select("fp"), bits, bucket_limit))
    grouped = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("f", "fp").alias("f"))
    roots = grouped.groupBy("f").agg(F.min("least").alias("root"))
    member = materialise(grouped.join(roots, "f").select("fp", "root"), "members", narrow=True)
    return fps.join(member, "fp").select(id_back("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back("root").alias("component_id"))
