"""SimHash near-dedup at a shingle similarity: fuzzy-hash candidates, verified on whole shingle sets.

A text is the set of hashes (64 bits) of its ``n``-word shingles, lower case, words as in ``simhash_dedup``; a text
of fewer words has one shingle, the whole sequence. Two texts are near copies if the Jaccard similarity of their
sets is ``similarity`` or more; texts without words are copies of one another.

Equal sets are taken together first. Candidates among the others come from two kinds of keys:

* the Golay keys of ``simhash_dedup`` over SimHash fingerprints of the same shingles (two differing bits);
* texts of similarity 0.8 differ by some 10 of 64 bits, beyond what a usable number of Golay keys covers, so these
  meet by bands of min-hashes: ``bands`` keys of ``rows`` least hashes each. Texts of similarity s have no common
  band with probability (1 - s**rows) ** bands: 0.0004 at 0.8 and less above.

Rounds: first, in a bucket of up to three texts all pairs are candidates, and in a fuller one each text meets the
least row; what is a near copy of a smaller row leaves the full buckets, and so does that least row. What is left
there are texts that are alike but not similar enough, mostly: of each bucket the sets come together and common
shingles are counted for all pairs by a matrix product (of the similar ones some leave that connect the same, fewer than
the texts), as long as the bucket has up to ``group_rows`` texts and ``group_bytes`` of sets. Fuller ones go on in rounds, in which each text meets ``centres`` others (the least row of
each of so many hash classes). So any two texts that share a key have been compared, unless one was found to be a
near copy of a smaller row before. Such pairs matter only where they join two components: those that meet in a full bucket
are compared in the end (``_chained``). Components of near copies are the groups.

Defined cases: null and empty texts are one group; repeated rows and ties are near copies; an empty table gives an
empty result; only the named columns are read and the row number takes a name that no column has, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, pieces, release
from .simhash_dedup import components, links, majority_bits

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The fullest bucket whose pairs are all candidates in the first round (fixed: ``_small_pairs``).
_SMALL = 3


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The shingle hashes of one text (UTF-8), in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = h * _MULTIPLIER + w[i : len(w) - n + 1 + i]
        h ^= h >> np.uint64(29)
    return h * _MULTIPLIER ^ (h >> np.uint64(32))


def needed(a: int, b: int, similarity: float) -> int:
    """The least number of common shingles of similar sets of a and b."""
    return int(np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9))


class Bands:
    """Min-hash bands of a shingle set."""

    def __init__(self, bands: int, rows: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self._shape = (bands, rows)
        self._xor, self._times = rng.integers(0, 2**63, (2, bands * rows), np.uint64, endpoint=True)
        self._times |= np.uint64(1)
        self._mix = rng.integers(0, 2**63, rows, np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(len(self._xor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1024):
            least = np.minimum(least, ((hashes[at : at + 1024, None] ^ self._xor) * self._times).min(axis=0))
        mixed = (least.reshape(self._shape) * self._mix).sum(axis=1, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MULTIPLIER + np.arange(self._shape[0], dtype=np.uint64)
        return (mixed * _MULTIPLIER).view(np.int64)


def _sketches(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """row, digest of the set, its size, its SimHash fingerprint, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Bands(bands, rows)
        for batch in pieces(batches, 1024):
            digests, sizes, fps, keys = [], [], [], []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                all_, distinct = (h := shingles(t or b"", n)), np.unique(h)
                digests.append(xxhash.xxh3_128_digest(distinct.astype("<u8").tobytes()))
                sizes.append(len(distinct))
                fps.append(majority_bits(all_))
                keys.append(sketch.keys(distinct))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["row", "digest", "size", "fp", "keys"])

    return texts.mapInArrow(run, "row long, digest binary, size int, fp long, keys array<long>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """row, the sorted set (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            packed = [np.unique(shingles(t or b"", n)).astype("<u8").tobytes() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["row", "set"])

    return texts.mapInArrow(run, "row long, set binary")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar."""
    pairs = materialise(pairs, "near-pairs", narrow=True)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = materialise(_sets(texts.join(wanted, "row", "left_semi"), n), "shingle-sets")
    whole = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                few = needed(len(x), len(y), similarity)
                keep.append(min(len(x), len(y)) >= few and len(np.intersect1d(x, y, assume_unique=True)) >= few)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = materialise(whole.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")
    release(pairs, sets)
    return out


def common_members(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each pair of sets has in common: a matrix product, some columns at a time."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), sizes)
    several = held[column] > 1
    who, column = who[several], np.cumsum(held > 1)[column[several]] - 1
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        part = slice(*np.searchsorted(column, [at, at + 2048]))
        block = np.zeros((len(sets), 2048), np.float32)
        block[who[part], column[part] - at] = 1
        common += block @ block.T
    return common


def similar_pairs(sets: list[np.ndarray], similarity: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of similar sets of a group; similarity: one for all pairs, or a matrix."""
    sizes = np.array([len(x) for x in sets], np.int64)
    least = np.ceil(similarity / (1 + similarity) * (sizes[:, None] + sizes[None, :]) - 1e-9)
    return np.nonzero(np.triu(common_members(sets) >= least, 1))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs (i, j) of 0 to n - 1, fewer than n, that connect all that these connect."""
    near = np.zeros((n, n), bool)
    near[i, j] = near[j, i] = True
    fresh, found = np.ones(n, bool), []
    for root in range(n):
        reached = [root] if fresh[root] else []
        fresh[root] = False
        while reached:
            at = reached.pop()
            further = np.nonzero(near[at] & fresh)[0]
            fresh[further] = False
            reached += further.tolist()
            found.append((np.full(len(further), at), further))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _grouped(members: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Similar pairs (a, b) within each bucket of members (key, row) that connect all that are similar there, fewer than its rows."""
    wanted = members.select("row").distinct()
    sets = materialise(_sets(texts.join(wanted, "row", "left_semi"), n), "shingle-sets")

    def compare(group: pa.Table) -> pa.Table:
        rows = group.column("row").to_numpy()
        i, j = forest(*similar_pairs([np.frombuffer(x, "<u8") for x in group.column("set").to_pylist()], similarity), len(rows))
        return pa.table({"a": np.minimum(rows[i], rows[j]), "b": np.maximum(rows[i], rows[j])})

    pairs = members.select("key", "row").join(sets, "row").groupBy("key").applyInArrow(compare, "a long, b long")
    out = materialise(pairs.distinct(), "near-links")
    release(sets)
    return out


def _compared(members: DataFrame, texts: DataFrame, n: int, similarity: float, group_rows: int, group_bytes: int, between: str) -> DataFrame:
    """(key, a, b): what is linked by pairs of a group of members (key, row, part, slack, size) in different parts that are similar, or could
    be but for their slack: each step of slack stands for a distance of 1 - ``similarity``. between: "row", or "part" for links of their parts.
    Of a group's links come only some that connect the same, fewer than its rows; one over the limits is compared block by block."""
    sets = materialise(_sets(texts.join(members.select("row").distinct(), "row", "left_semi"), n), "shingle-sets")
    load = members.groupBy("key").agg(F.count("*").alias("rows"), (8 * F.sum("size")).alias("bytes"))
    fits = (F.col("rows") <= group_rows) & (F.col("bytes") <= group_bytes)
    blocks = F.when(fits, 1).otherwise(F.ceil(F.greatest(2 * F.col("rows") / group_rows, 2 * F.col("bytes") / group_bytes))).cast("int")
    dealt = members.join(load.select("key", blocks.alias("blocks")), "key").withColumn("mine", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "row", "part", "slack").join(sets, "row")

    def compare(group: pa.Table) -> pa.Table:
        part, slack = (group.column(c).to_numpy() for c in ("part", "slack"))
        least = np.maximum(1 - (1 - similarity) * (1 + slack[:, None] + slack[None, :]), 0.0)
        i, j = similar_pairs([np.frombuffer(x, "<u8") for x in group.column("set").to_pylist()], least)
        apart = part[i] != part[j]
        i, j = i[apart], j[apart]
        nodes, at = np.unique(group.column(between).to_numpy(), return_inverse=True)
        i, j = forest(at[i], at[j], len(nodes))
        return pa.table({"key": np.repeat(group.column("key").to_numpy()[:1], len(i)), "a": np.minimum(nodes[i], nodes[j]), "b": np.maximum(nodes[i], nodes[j])})

    out = materialise(dealt.groupBy("key", "i", "j").applyInArrow(compare, "key long, a long, b long").distinct(), "near-compared")
    release(sets)
    return out


def _chained(crowd: DataFrame, gone: DataFrame, labels: DataFrame, texts: DataFrame, n: int, similarity: float, group_rows: int, group_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) and its tables: components (the labels, or single rows) linked by similar pairs in one bucket that the rounds didn't compare, since one row had left as a near copy.

    crowd: (key, row, size) of full buckets; gone: links (a, b) by which b left. A bucket within the limits is compared as a whole, each
    set once. In a larger one a row stands for those that left over it: by the
    triangle inequality of the Jaccard distance, rows whose stand-ins differ too much can't be similar. So stand-ins of a bucket that
    lie in different components are compared first, and the rows only of those that are near enough: these make groups (components
    within the bucket), which are compared block by block, so that a row comes once a block and not once for each stand-in near its own.
    """
    over = gone.groupBy(F.col("b").alias("row")).agg(F.min("a").alias("over"))
    held = crowd.select("key", "row", "size").join(over, "row", "left").join(labels.select(F.col("node").alias("row"), "f"), "row", "left")
    held = held.select("key", "row", "size", F.coalesce("f", "row").alias("part"), F.coalesce("over", "row").alias("over"), F.col("over").isNotNull().cast("int").alias("left"))
    members = [F.count("*").alias("rows"), (8 * F.sum("size")).alias("bytes"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("g")]
    mixed = held.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.max("left").alias("left"), *members).where("x <> y AND left = 1")
    once = mixed.groupBy("rows", "bytes", "h", "g").agg(F.min("key").alias("key"))  # buckets of the same rows count once
    whole = (F.col("rows") <= group_rows) & (F.col("bytes") <= group_bytes)
    held = materialise(held.join(once.select("key", whole.alias("whole")), "key"), "near-mixed")
    found = _compared(held.where("whole").select("key", "row", "part", F.lit(0).alias("slack"), "size"), texts, n, similarity, group_rows, group_bytes, "part")
    crowded = held.where("NOT whole")
    if crowded.isEmpty():
        release(held)
        return found, [found]
    standing = crowded.groupBy("key", F.col("over").alias("row")).agg(F.min("part").alias("part"), F.max("left").alias("slack"), F.max("size").alias("size"))
    close = _compared(standing, texts, n, similarity, group_rows, group_bytes, "row")
    node = lambda row: F.xxhash64("key", row)  # noqa: E731  a chance collision compares more, never less
    linked = components(close.select(node("a").alias("a"), node("b").alias("b")))
    near = close.select("key", F.explode(F.array("a", "b")).alias("over")).distinct().withColumn("node", node("over")).join(linked, "node")
    rows = materialise(near.select("key", "over", "f").join(crowded, ["key", "over"]).select(F.col("f").alias("key"), "row", "part", F.lit(0).alias("slack"), "size"), "near-apart")
    apart = _compared(rows, texts, n, similarity, group_rows, group_bytes, "part")
    release(held, close, linked, rows)
    return found.unionByName(apart), [found, apart]


def _ordered(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _golay_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): rows whose fingerprints are equal or within two bits, over the least row of each fingerprint."""
    least = materialise(reps.groupBy("fp").agg(F.min("row").alias("least")), "near-fingerprints", narrow=True)
    same = reps.join(least, "fp").where("row <> least").select(*_ordered("row", "least"))
    linked = links(least.select("fp"))
    near = linked.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    out = materialise(same.unionByName(near.select(*_ordered("x", "y"))), "golay-pairs", narrow=True)
    release(least, linked)
    return out


def _star(crowd: DataFrame, centres: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b), centres (key, row)): each row of a bucket with the least row of each hash class."""
    centre = materialise(crowd.groupBy("key", F.pmod(F.xxhash64("row"), F.lit(centres)).alias("c")).agg(F.min("row").alias("row")).select("key", "row"), "near-centres")
    return crowd.join(centre.withColumnRenamed("row", "centre"), "key").where("row <> centre").select(*_ordered("row", "centre")), centre


def _small_pairs(counts: DataFrame) -> DataFrame:
    """(a, b): all pairs of buckets of two or three rows, from their least and greatest row and the exclusive or of all."""
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = F.when(F.col("n") == 2, F.array(pair(a, b))).otherwise(F.array(pair(a, b), pair(a, third), pair(third, b)))
    return counts.where(F.col("n") <= _SMALL).select(F.explode(pairs).alias("e")).select("e.*").where("a < b")


def near_copies(texts: DataFrame, n: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5, group_rows: int = 1024, group_bytes: int = 16 << 20, centres: int = 16) -> DataFrame:
    """row, group (the smallest row of its component) of every row, as a written table; all others that it writes go.

    texts: row (distinct longs) and text; read several times, so it should be a written table.
    """
    texts = texts.select("row", F.col("text").cast("string").alias("text"))
    sketches = materialise(_sketches(texts, n, bands, rows), "near-sketches")
    reps = materialise(sketches.groupBy("digest").agg(F.min(F.struct("row", "size", "fp", "keys")).alias("r")).select("digest", "r.*"), "distinct-sets")
    keys = reps.select("row", "size", F.explode("keys").alias("key"))
    counts = materialise(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), F.bit_xor("row").alias("x")).where("n > 1"), "near-counts")
    full = materialise(counts.where(F.col("n") > _SMALL).select("key", F.col("a").alias("centre")), "near-full", narrow=True)
    crowd = materialise(keys.join(full, "key"), "near-crowds")
    star, centre = crowd.where("row <> centre").select(*_ordered("row", "centre")), full.withColumnRenamed("centre", "row")
    buckets, written = crowd, []
    golay = _golay_pairs(reps.select("row", "fp"))
    new = _verified(golay.unionByName(_small_pairs(counts)).unionByName(star).distinct(), texts, n, similarity)
    found, gone, done = [new], [new], [sketches, reps, crowd, full]
    release(counts, golay)
    while True:
        rest = crowd.select("key", "row", "size").join(centre, ["key", "row"], "left_anti").join(new.select(F.col("b").alias("row")).distinct(), "row", "left_anti")
        left = materialise(rest, "near-crowds")
        release(*written)
        load = materialise(left.groupBy("key").agg(F.count("*").alias("n"), (8 * F.sum("size")).alias("bytes")).where("n > 1"), "near-counts")
        fits = (F.col("n") <= group_rows) & (F.col("bytes") <= group_bytes)
        found.append(_grouped(left.join(load.where(fits), "key", "left_semi"), texts, n, similarity))
        if load.where(~fits).isEmpty():
            release(left, load)
            break
        crowd = left.join(load.where(~fits), "key", "left_semi")
        star, centre = _star(crowd, centres)
        new, written = _verified(star.distinct(), texts, n, similarity), [left, load, centre]
        found.append(new)
        gone.append(new)

    labels = components(reduce(DataFrame.unionByName, found))
    chains, tables = _chained(buckets, reduce(DataFrame.unionByName, gone), labels, texts, n, similarity, group_rows, group_bytes)
    united = components(chains.select("a", "b"))  # of components, each by its smallest row
    member = reps.select("digest", "row").join(labels.select(F.col("node").alias("row"), F.col("f").alias("part")), "row", "left")
    member = member.select("digest", F.coalesce("part", "row").alias("part")).join(united.select(F.col("node").alias("part"), F.col("f").alias("group")), "part", "left")
    member = materialise(member.select("digest", F.coalesce("group", "part").alias("group")), "near-groups", narrow=True)
    out = materialise(sketches.select("row", "digest").join(member, "digest").select("row", "group"), "near-copies")
    release(*done, *found, *tables, labels, united, member)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False, **how) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each group the one with the smallest id (null last) stays.

    written: docs is a written table, whose rows are numbered where they stand; otherwise a copy is written first.
    """
    mark = free_name(docs, "__row")
    numbered = docs.withColumn(mark, F.monotonically_increasing_id())
    numbered = numbered if written else materialise(numbered, "rows")
    groups = near_copies(numbered.select(F.col(mark).alias("row"), F.col(text_col).alias("text")), **how)
    ids = numbered.select(F.col(mark).alias("row"), F.col(id_col).cast("long").alias("id")).join(groups, "row")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    kept = materialise(first.select(F.col("first.row").alias(mark)), "kept-rows", narrow=True)
    release(groups)
    return numbered.join(kept, mark, "left_semi").select(*docs.columns)
