"""URL rules held in a sorted digest array.

The rules (host, path, verdict) become one index file: their 64-bit xxhash keys in ascending order,
then the full strings. It is written to the shared folder, and ``SparkContext.addFile`` takes it to every executor,
whose Python workers memory-map it. A batch of urls gives all candidate keys (host suffixes of the numbers of
labels, with path prefixes of the lengths, that rules have), which are probed with one vectorised binary search; every key found is
confirmed against the stored strings, so that a collision can't decide.

A rule table over ``max_index_bytes`` isn't shipped: candidates are exploded and joined with the
rules instead, with the same results.

Defined cases: a null url or one without ``://`` has empty host and path, and no rule; rules with
a null part are left out; of repeated rules the block stays; of rules that fit, the longest host and path together wins,
then the longer host. Only the id and url columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, pieces

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestIndex:
    """A memory-mapped index file. Layout: counts, keys (8 bytes each, sorted), offsets, path lengths, numbers of labels, strings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, lengths, labels = struct.unpack_from("<qqq", self._map)
        self.keys = np.frombuffer(self._map, "<u8", n, 24)
        self.offsets = np.frombuffer(self._map, "<i8", n + 1, 24 + 8 * n)
        self.path_lengths = np.frombuffer(self._map, "<i8", lengths, 32 + 16 * n).tolist()
        self.label_counts = np.frombuffer(self._map, "<i8", labels, 32 + 16 * n + 8 * lengths).tolist()
        self._strings = 32 + 16 * n + 8 * (lengths + labels)

    @staticmethod
    def build(rules: list[tuple[str, str, str]], out) -> None:
        """rules: (host, path, verdict), unique by host and path; out: a binary stream."""
        rows = sorted((xxhash.xxh64_intdigest(s := f"{h}\0{p}\0".encode()), s + v.encode()) for h, p, v in rules)
        lengths, labels = sorted({len(p) for _, p, _ in rules}), sorted({h.count(".") + 1 for h, _, _ in rules})
        offsets = np.cumsum([0, *(len(s) for _, s in rows)])
        out.write(struct.pack("<qqq", len(rows), len(lengths), len(labels)))
        out.write(np.array([k for k, _ in rows], "<u8").tobytes() + offsets.astype("<i8").tobytes() + np.array(lengths + labels, "<i8").tobytes())
        for _, s in rows:
            out.write(s)

    def probe(self, candidates: list[bytes]) -> list[str | None]:
        """The verdict of each candidate (host, NUL, path, NUL), or None."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        out: list[str | None] = [None] * len(candidates)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)) if len(self.keys) else ():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                stored = self._map[self._strings + int(self.offsets[j]) : self._strings + int(self.offsets[j + 1])]
                if stored.startswith(candidates[i]) and stored.count(b"\0") == candidates[i].count(b"\0"):
                    out[i] = stored[len(candidates[i]) :].decode()
                    break
                j += 1
        return out


def host_suffixes(host: str, counts: list[int]) -> list[str]:
    """The last labels of a host, for each of the counts that it has."""
    out = []
    for n in counts:
        parts = host.rsplit(".", n)
        if len(parts) >= n:
            out.append(host if len(parts) == n else ".".join(parts[1:]))
    return out


def _clean(rules: DataFrame) -> DataFrame:
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    return rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_index_bytes: int = 256 << 20) -> DataFrame:
    """id, host, path, rule (host and path of the winning rule, or null), verdict of every row.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains where the
    url's path starts with the rule's.
    """
    rules = _clean(rules)
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("verdict") + 24)).first()[0] or 0
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if not size:
        found = urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    else:
        found = _by_index(urls, rules) if size <= max_index_bytes else _by_join(urls, rules)
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _by_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    path = fresh_path(urls.sparkSession, "url-rules")
    name = path.rsplit("/", 1)[1]
    fs, place = pafs.FileSystem.from_uri(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(place) as out:
        DigestIndex.build([tuple(r) for r in rules.collect()], out)
    urls.sparkSession.sparkContext.addFile(path)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        for batch in pieces(batches, 4096):
            candidates: list[bytes] = []
            rows: list[tuple[int, str, str]] = []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for h in host_suffixes(host, index.label_counts):
                    for n in index.path_lengths:
                        if n <= len(path):
                            rows.append((i, h, path[:n]))
                            candidates.append(f"{h}\0{path[:n]}\0".encode())
            best: dict[int, tuple] = {}
            for (i, h, p), verdict in zip(rows, index.probe(candidates), strict=True):
                if verdict is not None and (rank := (len(h) + len(p), len(h))) > best.get(i, ((-1, -1),))[0]:
                    best[i] = (rank, h + p, verdict)
            hits = [best.get(i, (None, None, None)) for i in range(batch.num_rows)]
            yield pa.record_batch([*batch.columns, pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string())], names=["id", "host", "path", "rule", "verdict"])

    schema = urls.schema.simpleString()[7:-1].split(",", 1)[0].split(":", 1)[1]
    return urls.mapInArrow(probe, f"id {schema}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by an equi-join of candidates; a row number is not needed, as equal (host, path) fare alike."""
    rows = rules.select(F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("m"))
    lengths, counts = ([r[0] for r in rows.select(c).distinct().collect()] for c in ("n", "m"))  # no longer than the longest rule
    each = urls.select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.filter(F.array(*map(F.lit, counts)), lambda n: n <= labels), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    candidates = each.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(starts))
    named = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict")
    rank = F.struct(F.length("h") + F.length("p"), F.length("h"))
    best = candidates.join(named, ["h", "p"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), rank).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("id", "host", "path", "b.rule", "b.verdict")
