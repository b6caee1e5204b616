"""Near-duplicate vectors by cosine: product quantisation over coarse inverted lists, exact cosines of what is near.

1. Vectors are scaled to length one; equal ones are one class, which carries how many rows it stands for.
2. The index is fitted on a bounded sample (``sample`` classes, taken by a hash; 64 MB at most): k-means centres for
   inverted lists, one for every ``list_rows`` classes but at most one for eight of the sample, and for each group of ``subspace``
   components a codebook of 256 residual parts. All classes are indexed: each is put in the list of its nearest centre
   and coded, and the length of its coding error is kept.
3. Each class probes its own list and all lists whose border is within ``margin`` of it. A copy lies within the
   ``radius`` that belongs to the cosine, in some direction; its offset along the normal of a border has a deviation of radius / sqrt(dim)
   where directions are random, and the margin is ``spread`` (2.5) times that. ``spread=inf`` probes all lists and is exact.
   A pair is found if either of the two probes the other's list.
4. Probing vectors and list members meet in groups of bounded size: lists of more than ``base_rows`` members or ``query_rows`` probing
   vectors are split by hashes and their parts paired. In a group, asymmetric distances (an exact vector against
   codes) come from tables by lookup. A distance above radius plus the coding error rules a pair out (triangle inequality, so
   nothing is lost); of the others the exact cosine is taken in double precision.
5. No pair leaves a group: it returns, for each class, how many rows it links with and the least class it is connected to inside
   the group. A pair that both probes find is counted for either side where it is the probing one, other pairs for both at
   once. Sums and connected components finish the work.

Defined cases: rows whose vector is null, empty, zero, or holds null or non-finite components link with nothing; so do
vectors of different lengths (one index is fitted per length). A null id counts as the smallest; rows with the same id are rows of
their own. An empty table gives an empty result. Only the id and vector columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_back, id_key, materialise, pieces, release
from .simhash_dedup import components

_SAMPLE_BYTES = 64 << 20
_CODES = 256


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision (rows that are zero or not finite: not finite)."""
    x = raw.astype(np.float64) + 0.0
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _classes(vectors: DataFrame, kind: str) -> DataFrame:
    """id, digest of the unit vector (null: links with nothing), dim, vec (components as given, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            lists = batch.column(1)
            sizes = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(sizes)
            digests, packed = [None] * len(sizes), [None] * len(sizes)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                where = np.flatnonzero(sizes == dim)
                raw = flat[(ends[where] - dim)[:, None] + np.arange(dim)]
                units = unit(raw)
                for i, ok, r, u in zip(where.tolist(), np.isfinite(units).all(axis=1).tolist(), raw, units, strict=True):
                    if ok:
                        digests[i], packed[i] = xxhash.xxh3_128_digest(u.tobytes()), r.tobytes()
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["id", "digest", "dim", "vec"])

    return vectors.mapInArrow(run, "id long, digest binary, dim long, vec binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """k centres; a centre that loses all rows stays where it was."""
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        held, begins = np.unique(own[order], return_index=True)
        centres[held] = np.add.reduceat(x[order], begins, axis=0) / np.diff([*begins, len(x)])[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[at : at + 1024] @ centres.T - half).argmax(axis=1) for at in range(0, len(x), 1024))])


@dataclass
class Codec:
    """Centres of the inverted lists and the codebooks of residual parts."""

    centres: np.ndarray
    books: np.ndarray  # (parts, codes, components of a part)
    margin: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspace: int, margin: float) -> Codec:
        centres = kmeans(x, lists)
        rest = cls._parts(x - centres[nearest(x, centres)], subspace)[:8192]
        return cls(centres, np.stack([kmeans(rest[:, j], _CODES, 6) for j in range(rest.shape[1])]), margin)

    @staticmethod
    def _parts(x: np.ndarray, subspace: int) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % subspace))).reshape(len(x), -1, subspace)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list, code and coding error of each row."""
        own = nearest(x, self.centres)
        rest = self._parts(x - self.centres[own], self.books.shape[2])
        codes = np.stack([nearest(rest[:, j], book) for j, book in enumerate(self.books)], axis=1)
        error = rest - self.books[np.arange(len(self.books)), codes]
        return own, codes.astype(np.uint8), np.sqrt((error * error).sum(axis=(1, 2)))

    def probes(self, x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """The lists that each row probes: those whose border with its own is within the margin."""
        out, square = [], (self.centres * self.centres).sum(axis=1)
        for at in range(0, len(x), 1024):
            mine = own[at : at + 1024]
            score = x[at : at + 1024] @ self.centres.T - square / 2
            apart = np.sqrt(np.maximum(square[mine][:, None] + square - 2 * self.centres[mine] @ self.centres.T, 1e-24))
            score -= score[np.arange(len(mine)), mine][:, None]
            out += [np.flatnonzero(near) for near in -score <= self.margin * apart]
        return out

    def distances(self, x: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows to coded members of a list, from tables of a row's parts against the codebooks."""
        rest = self._parts(x - self.centres[list_], self.books.shape[2])
        out = np.zeros((len(x), len(codes)))
        for j, book in enumerate(self.books):
            table = (rest[:, j] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * rest[:, j] @ book.T
            out += table[:, codes[:, j]]
        return np.sqrt(np.maximum(out, 0))


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least member of each member's component over the pairs (a, b) of 0 .. size - 1."""
    label = np.arange(size)
    while len(a):
        new, least = label.copy(), np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


_CODED = "node long, n long, list int, probes array<int>, code binary, error double, vec binary"
_FOUND = "node long, links long, root long"


def _coded(classes: DataFrame, codec: Codec, dim: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            x = unit(_rows(batch.column(2), dim, kind))
            own, codes, error = codec.encode(x)
            probes = codec.probes(x, own)
            ends = pa.array(np.cumsum([0, *map(len, probes)]), pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*probes, np.zeros(0, int)]), pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(2)]
            yield pa.record_batch(columns, names=["node", "n", "list", "probes", "code", "error", "vec"])

    return classes.select("node", "n", "vec").mapInArrow(run, _CODED)


def _group(list_: int, base: pa.Table, query: pa.Table, codec: Codec, dim: int, kind: str, similarity: float) -> pa.Table:
    """(node, links, root) of what a group of probing vectors finds among members of a list."""
    y, codes = unit(_rows(base.column("vec"), dim, kind)), np.frombuffer(b"".join(base.column("code").to_pylist()), np.uint8).reshape(base.num_rows, -1)
    members, weight, error = (base.column(c).to_numpy() for c in ("node", "n", "error"))
    asking, own, asking_weight = (query.column(c).to_numpy() for c in ("asker", "own", "weight"))
    lists = len(codec.centres)
    probes = base.column("probes").combine_chunks()
    probed = np.sort(np.repeat(np.arange(base.num_rows), probes.value_lengths().to_numpy()) * lists + probes.flatten().to_numpy())
    nodes, place = np.unique(np.concatenate([members, asking]), return_inverse=True)
    of_member, of_asking = place[: len(members)], place[len(members) :]
    links, a, b = np.zeros(len(nodes), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    radius = np.sqrt(2 - 2 * similarity)
    packed = query.column("asked")
    for at in range(0, len(asking), 512):
        x = unit(_rows(packed.slice(at, 512), dim, kind))
        near = codec.distances(x, list_, codes) <= radius + error + 1e-6
        i, k = np.nonzero(near)
        if len(i) * 8 > near.size:
            linked = (x @ y.T)[i, k] >= similarity
        else:
            linked = np.concatenate([np.zeros(0, bool), *((x[i[s : s + 8192]] * y[k[s : s + 8192]]).sum(axis=1) >= similarity for s in range(0, len(i), 8192))])
        i, k = i[linked] + at, k[linked]
        other = asking[i] != members[k]
        i, k = i[other], k[other]
        np.add.at(links, of_asking[i], weight[k])
        wanted = k * lists + own[i]
        found = np.searchsorted(probed, wanted)
        alone = probed[np.minimum(found, len(probed) - 1)] != wanted  # the member does not probe this list's vector by itself
        np.add.at(links, of_member[k[alone]], asking_weight[i[alone]])
        label = forest(np.concatenate([a, of_asking[i]]), np.concatenate([b, of_member[k]]), len(nodes))
        a = np.flatnonzero(label != np.arange(len(nodes)))
        b = label[a]
    root = np.arange(len(nodes))
    root[a] = b
    some = (links > 0) | (root != np.arange(len(nodes)))
    return pa.table({"node": nodes[some], "links": links[some], "root": nodes[root[some]]})


def _found(coded: DataFrame, codec: Codec, dim: int, kind: str, similarity: float, base_rows: int, query_rows: int) -> DataFrame:
    """(node, links, root) from all groups. Lists are as many as the index has, so their sizes are a table of bounded size."""
    split = lambda n, rows: F.ceil(n / F.lit(rows)).cast("int")
    members = coded.groupBy("list").agg(F.count("*").alias("members"))
    asking = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asking"))
    parts = F.broadcast(members.join(asking, "list").select("list", split(F.col("members"), base_rows).alias("nb"), split(F.col("asking"), query_rows).alias("nq")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = coded.join(parts, "list").select("list", F.pmod(F.xxhash64("node"), "nb").cast("int").alias("b"), each("nq").alias("q"), "node", "n", "probes", "code", "error", "vec")
    ask = coded.select(F.explode("probes").alias("probed"), F.col("node").alias("asker"), F.col("n").alias("weight"), F.col("list").alias("own"), F.col("vec").alias("asked"))
    ask = ask.join(parts.withColumnRenamed("list", "probed"), "probed").select("probed", each("nb").alias("at"), F.pmod(F.xxhash64("asker", F.lit(1)), "nq").cast("int").alias("of"), "asker", "weight", "own", "asked")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root")})
        return _group(key[0].as_py(), left, right, codec, dim, kind, similarity)

    return base.groupBy("list", "b", "q").cogroup(ask.groupBy("probed", "at", "of")).applyInArrow(compare, _FOUND)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = 0.95, sample: int = 32768, list_rows: int = 128,
    subspace: int = 4, spread: float = 2.5, base_rows: int = 1024, query_rows: int = 4096,
) -> DataFrame:
    """Per row: its id, n_links (other rows linked directly), component_id (least id reachable), kept (the row's id is that)."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    given = vectors.select(id_key(id_col).alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = materialise(_classes(given, kind), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = []
    for dim, count in classes.groupBy("dim").count().sort("dim").collect():  # as many as vectors have lengths
        own = classes.where(F.col("dim") == dim)
        rate = min(sample, _SAMPLE_BYTES // (8 * dim)) / count
        some = own if rate >= 1 else own.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)
        raw = [r.vec for r in some.select("vec").sort("vec").collect()] or [own.first().vec]
        x = unit(np.frombuffer(b"".join(raw), kind).reshape(-1, dim))
        codec = Codec.fit(x, max(1, min(round(count / list_rows), len(x) // 8)), min(subspace, dim), spread * float(np.sqrt(2 - 2 * similarity)) / dim**0.5)
        coded = materialise(_coded(own, codec, dim, kind), "coded-vectors")
        found.append(materialise(_found(coded, codec, dim, kind, similarity, base_rows, query_rows), "vector-links"))
        release(coded)
    nothing = classes.sparkSession.createDataFrame([], _FOUND)
    all_ = reduce(DataFrame.unionByName, found, nothing)
    labels = components(all_.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    linked = all_.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "least", "n", "node").join(linked, "node", "left").join(labels, "node", "left").select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("f", "node").alias("f"))
    roots = known.groupBy("f").agg(F.min("least").alias("root"))
    known = materialise(known.join(roots, "f").select("digest", "n_links", "root"), "vector-groups")
    release(classes, labels, *found)
    out = rows.where("digest IS NOT NULL").join(known, "digest").select("id", "n_links", "root")
    out = out.unionByName(rows.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root")))
    return out.select(id_back("id").alias("id"), "n_links", id_back("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
