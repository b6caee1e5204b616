"""Copies of images, cropped or edited, by local descriptors.

An image is a grayscale column: height, width and the pixels as bytes. Work per image: corners at several
scales (Harris response, the strict maximum of the places within ``spacing``: a local rule without a limit, so that a
crop keeps the corners of its original), an orientation from the intensity centroid, and 128 binary tests turned by
that orientation. Equal images are taken together first.

Hamming tables: with up to two differing bits one of three bands of a descriptor is unchanged, so the band values
are join keys. Images that share a key of up to ``bucket_limit`` images are candidates, all pairs of them. For
fuller keys (patches that a mass of copies or a common design has):

* A copy needs ``t`` matching descriptors of the smaller image (``min_inliers``, and ``min_share`` of them). So of its d
  descriptors some d - t + 1 hold a match, whichever these are; an image *probes* full keys only by the d - t + 1 whose
  keys are rarest. A design on under that share of the descriptors is thus never probed, and nothing is lost. Smaller images probe themselves,
  so they are left out except where few ask for many.
* Each probing image is compared with all images of the key while few probe it. Where many do, some of them (the least
  id of each of some hash classes) are compared with all; what is verified as a copy of a smaller id then probes no
  more (it is still compared by others), and so on until none is left.
* What was not compared since the image that probes for it had left matters only where it joins two components: in the end all such pairs of
  two components are compared (``_across``), without all pairs inside a mass of copies.

A candidate is a copy if ``min_inliers`` descriptor matches agree on one similarity transform (rotation, scale and
shift) and are ``min_share`` of the smaller image's descriptors. Components of copies are the classes.

Defined cases: null or empty pixels, and pixels that don't fit height times width, have no descriptors: such images
are copies only of equal ones; a null id counts as the smallest; repeated rows are of one class; rows of one id with
different pixels are images of their own, each with its row and class; an empty table gives an empty result. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, materialise, pieces, release
from .simhash_dedup import components

SCALES = (1.0, 0.5)
_R, _ANGLES, _TESTS = 5, 16, 128


def _patterns() -> np.ndarray:
    """Test offsets (angle, test, end, y/x), from seeded normal points turned by each angle."""
    points = np.clip(np.random.default_rng(7).normal(0, 2.2, (_TESTS, 2, 2)), -3.5, 3.5)
    turned = []
    for a in range(_ANGLES):
        c, s = np.cos(2 * np.pi * a / _ANGLES), np.sin(2 * np.pi * a / _ANGLES)
        turned.append(points @ np.array([[c, -s], [s, c]]))
    return np.rint(np.array(turned)).astype(np.int64)


_PATTERNS = _patterns()
_DY, _DX = (g.ravel() for g in np.mgrid[-3:4, -3:4])


def _box(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1, mode="edge")
    rows = p[:-2] + p[1:-1] + p[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def _half(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
    return (x[0:h:2, 0:w:2] + x[1:h:2, 0:w:2] + x[0:h:2, 1:w:2] + x[1:h:2, 1:w:2]) / 4


def describe(image: np.ndarray, spacing: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(y, x, scale, angle) and 128-bit descriptors (two unsigned longs) of the corners of one image."""
    places, bits = [], []
    level, scale = image.astype(np.float64), 1.0
    for want in SCALES:
        if want < scale:
            level, scale = _half(level), want
        h, w = level.shape
        if h < 2 * _R + 1 or w < 2 * _R + 1:
            break
        smooth = _box(level) / 9
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gy * gy), _box(gx * gx), _box(gy * gx)
        response = a * b - c * c - 0.05 * (a + b) ** 2
        inner = response[_R : h - _R, _R : w - _R]
        near = range(-spacing, spacing + 1)
        around = np.max([response[_R + dy : h - _R + dy, _R + dx : w - _R + dx] for dy in near for dx in near if dy or dx], axis=0)
        y, x = np.nonzero((inner > around) & (inner > 1e-6))
        y, x = y + _R, x + _R
        for part in range(0, len(y), 512):  # some corners at a time: each looks at 256 places
            v, u = y[part : part + 512], x[part : part + 512]
            patch = smooth[v[:, None] + _DY, u[:, None] + _DX]
            angle = np.rint(np.arctan2(patch @ _DY, patch @ _DX) / (2 * np.pi) * _ANGLES).astype(np.int64) % _ANGLES
            p = _PATTERNS[angle]
            at = smooth[v[:, None, None] + p[..., 0], u[:, None, None] + p[..., 1]]
            bits.append(np.packbits(at[..., 0] < at[..., 1], axis=1).reshape(-1, 16).view("<u8"))
            places.append(np.stack([v / scale, u / scale, np.full(len(v), scale), angle], axis=1))
    if not places:
        return np.zeros((0, 4)), np.zeros((0, 2), np.uint64)
    return np.concatenate(places), np.concatenate(bits)


def band_keys(bits: np.ndarray) -> np.ndarray:
    """Three keys of each descriptor: 43, 43 and 42 of its bits."""
    low, high = bits[:, 0], bits[:, 1]
    mask = np.uint64((1 << 43) - 1)
    bands = [low & mask, (low >> np.uint64(43)) | ((high & np.uint64((1 << 22) - 1)) << np.uint64(21)), high >> np.uint64(22)]
    return np.stack([(b << np.uint64(2)) | np.uint64(i) for i, b in enumerate(bands)], axis=1).view(np.int64)


def consensus(pa_: np.ndarray, ba: np.ndarray, pb: np.ndarray, bb: np.ndarray, max_bits: int = 2, tolerance: float = 3.0) -> int:
    """The most descriptor matches, different on both sides, that agree on one similarity transform."""
    if not len(ba) or not len(bb):
        return 0
    best = 0
    far = sum(np.bitwise_count(ba[:, None, i] ^ bb[None, :, i]).astype(np.int64) for i in range(2)) if len(ba) * len(bb) <= 1 << 22 else None
    if far is not None:
        i, j = np.nonzero(far <= max_bits)
    else:  # large images: equal bands give the candidates
        ka, kb = band_keys(ba), band_keys(bb)
        order = [np.argsort(kb[:, t], kind="stable") for t in range(3)]
        pairs = set()
        for t in range(3):
            s = kb[order[t], t]
            lo, hi = np.searchsorted(s, ka[:, t], "left"), np.searchsorted(s, ka[:, t], "right")
            pairs.update((x, int(order[t][y])) for x in range(len(ka)) for y in range(lo[x], hi[x]))
        i, j = (np.array(v, np.int64) for v in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        near = sum(np.bitwise_count(ba[i, t] ^ bb[j, t]).astype(np.int64) for t in range(2)) <= max_bits
        i, j = i[near], j[near]
    turn, zoom = (pb[j, 3] - pa_[i, 3]) % _ANGLES, pa_[i, 2] / pb[j, 2]
    for t, z in set(zip(turn.tolist(), zoom.tolist(), strict=True)):
        m = (turn == t) & (zoom == z)
        c, s = np.cos(2 * np.pi * t / _ANGLES) * z, np.sin(2 * np.pi * t / _ANGLES) * z
        y, x = pa_[i[m], 0], pa_[i[m], 1]
        shift = np.stack([pb[j[m], 0] - (s * x + c * y), pb[j[m], 1] - (c * x - s * y)], axis=1)
        for off in (0.0, tolerance / 2):
            cells = np.floor((shift + off) / tolerance)
            _, inverse = np.unique(cells, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            once = [np.bincount(np.unique(np.stack([inverse, k[m]], axis=1), axis=0)[:, 0]) for k in (i, j)]
            best = max(best, int(np.minimum(*once).max()))
    return best


def render_page(html: str, width: int = 32) -> np.ndarray:
    """A page as an image: one pixel per word, dark or light by the word, blocks on new rows."""
    rows: list[np.ndarray] = []
    for block in re.split(r"<(?:p|br|h\d|div|li|article|footer|nav|ul|title)\b[^>]*>", re.sub(r"(?s)<(script|style).*?</\1>", " ", html)):
        words = unescape(re.sub(r"<[^>]*>", " ", block)).split()
        if words:
            values = np.zeros(-(-len(words) // width) * width, np.uint8) + 128
            values[: len(words)] = [zlib.crc32(w.encode()) & 255 for w in words]
            rows.append(values.reshape(-1, width))
    return np.concatenate(rows) if rows else np.zeros((0, width), np.uint8)


def _encode(places: np.ndarray) -> bytes:
    """Places as integers, first the lowest byte of each y, then the next ones: most bytes are zero then, side by side, and compress well."""
    return np.ascontiguousarray((places * [1, 1, 100, 1]).astype("<i4")).view(np.uint8).T.tobytes()


def _descriptor_row(h: int | None, w: int | None, pixels: bytes | None) -> tuple[bytes, bytes, bytes]:
    """Digest of the image, packed places and bits of its descriptors."""
    digest = hashlib.sha256(f"{h}:{w}:".encode() + (b"null" if pixels is None else pixels)).digest()[:16]
    if pixels is None or not h or not w or h * w != len(pixels):
        return digest, b"", b""
    places, bits = describe(np.frombuffer(pixels, np.uint8).reshape(h, w))
    return digest, _encode(places), bits.tobytes()


def _rows(ids: pa.Array, rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([ids, *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], names=["id", "digest", "places", "bits"])


_FEATURES = "id long, digest binary, places binary, bits binary"


def image_features(images: DataFrame) -> DataFrame:
    """id, digest, places, bits of images (id, height, width, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _rows(batch.column(0), [_descriptor_row(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)])

    return images.select(id_key("id").alias("id"), "height", "width", "pixels").mapInArrow(run, _FEATURES)


def page_features(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The same of pages drawn as images; the pixels themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            images = [render_page(h or "") for h in batch.column(1).to_pylist()]
            yield _rows(batch.column(0), [_descriptor_row(*x.shape, x.tobytes()) for x in images])

    return pages.select(id_key(id_col).alias("id"), F.col(html_col).cast("string")).mapInArrow(run, _FEATURES)


def _decode(places: bytes, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(np.frombuffer(places, np.uint8).reshape(16, -1).T).view("<i4") / [1, 1, 100, 1], np.frombuffer(bits, "<u8").reshape(-1, 2)


def _keys(features: DataFrame) -> DataFrame:
    """(id, key, m): the distinct band keys of each image, and how many of its descriptors have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counted = [np.unique(band_keys(np.frombuffer(b, "<u8").reshape(-1, 2)), return_counts=True) for b in batch.column(1).to_pylist()]
            keys = [k for k, _ in counted]
            ids = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*(m for _, m in counted), np.zeros(0, np.int64)]))], names=["id", "key", "m"])

    return features.select("id", "bits").mapInArrow(run, "id long, key long, m long")


def _pairs(held: DataFrame, full: DataFrame, min_inliers: int) -> DataFrame:
    """(a, b) with a < b that share a key outside full buckets."""
    return _meeting(held.join(full, "key", "left_anti"), held.join(full, "key", "left_semi"), min_inliers)


def _meeting(few: DataFrame, crowded: DataFrame, min_inliers: int) -> DataFrame:
    """(a, b) with a < b that share a key of few, the rows (id, key, m) outside full buckets. Every inlier is a descriptor of a with a key that b
    has too, so pairs are left out only if a's descriptors with common keys, and all its crowded ones, are too few."""
    listed = few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "m"))).alias("ids")).where(F.size("ids") > 1)
    within = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b.id > a.id), lambda b: F.struct(a.id.alias("a"), b.id.alias("b"), a.m.alias("m")))))
    pairs = listed.select(F.explode(within).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum("m").alias("n"))
    more = crowded.groupBy(F.col("id").alias("a")).agg(F.sum("m").alias("more"))
    return pairs.join(more, "a", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_inliers).select("a", "b")


def _probes(features: DataFrame, crowd: DataFrame, min_inliers: int, min_share: float) -> DataFrame:
    """(key, id, size): the full keys of the rarest descriptors of each image, one of which any copy at least as large matches, and how many descriptors it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, sizes, found = [], [], [np.zeros(0, np.int64)]
            for id_, bits, full in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = band_keys(np.frombuffer(bits, "<u8").reshape(-1, 2))
                known, n = (np.array([x[f] for x in full], np.int64) for f in ("key", "n"))
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known[order], keys), len(known) - 1)
                held = np.where(known[order][at] == keys, n[order][at], 0)
                probing = len(keys) - max(min_inliers, int(np.ceil(min_share * len(keys) - 1e-9))) + 1
                rarest = np.argsort(held.max(axis=1), kind="stable")[: max(0, probing)]
                probes = np.unique(keys[rarest][held[rarest] > 0])
                ids.append(np.full(len(probes), id_))
                sizes.append(np.full(len(probes), len(keys)))
                found.append(probes)
            yield pa.record_batch([pa.array(np.concatenate(found)), *(pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (ids, sizes))], names=["key", "id", "size"])

    listed = crowd.groupBy("id").agg(F.collect_list(F.struct("key", "n")).alias("full"))
    return features.join(listed, "id").select("id", "bits", "full").mapInArrow(run, "key long, id long, size long")


def _verified(candidates: DataFrame, features: DataFrame, min_inliers: int, min_share: float) -> DataFrame:
    """The candidates (a, b), a written table, that are copies."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = []
            for r in batch.to_pylist():
                (p, x), (q, y) = _decode(r["pa"], r["ba"]), _decode(r["pb"], r["bb"])
                n = consensus(p, x, q, y)
                if n >= min_inliers and n >= min_share * min(len(x), len(y)):
                    found.append((r["a"], r["b"]))
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    wanted = materialise(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "image-wanted", narrow=True)
    chosen = materialise(features.join(wanted, "id", "left_semi").select("id", "places", "bits"), "image-chosen")
    half = materialise(candidates.join(chosen.select(F.col("id").alias("b"), F.col("places").alias("pb"), F.col("bits").alias("bb")), "b"), "image-half")
    whole = half.join(chosen.select(F.col("id").alias("a"), F.col("places").alias("pa"), F.col("bits").alias("ba")), "a")
    links = materialise(whole.select("a", "b", "pa", "ba", "pb", "bb").mapInArrow(verify, "a long, b long"), "image-links")
    release(wanted, chosen, half)
    return links


def _across(probes: DataFrame, crowd: DataFrame, links: DataFrame, compared: DataFrame) -> DataFrame:
    """(a, b): an image that left as a copy of a smaller id and one that its full keys probe for (of at least its size, where both have one), if they lie in
    different components and were not compared. Components meet in a key before their images do, so that a mass of copies is one of them."""
    labels = components(links)
    part = lambda ids, x: ids.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", F.col("id").alias(x), F.coalesce("f", "id").alias("of_" + x), (F.col("size") if "size" in ids.columns else F.lit(0)).alias("size_" + x))
    left = part(probes.join(links.select(F.col("b").alias("id")).distinct(), "id", "left_semi"), "x")
    other = part(crowd, "y")
    apart = left.select("key", "of_x").distinct().join(other.select("key", "of_y").distinct(), "key").where("of_x <> of_y")
    met = apart.join(left, ["key", "of_x"]).join(other, ["key", "of_y"]).where("size_x <= size_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.join(compared, ["a", "b"], "left_anti")


#: Probing images of a key that are compared with all at once, in each round: 1 of many at first (most are its copies), then more.
_CENTRES = (1, 4, 16)


def find_copies(features: DataFrame, min_inliers: int = 6, min_share: float = 0.3, bucket_limit: int = 24) -> DataFrame:
    """id, class_id (the smallest id of its class), n_links (of its distinct image; inside a mass of copies links that join nothing new are not looked for) of every row.

    features: of ``image_features`` or ``page_features``.
    """
    kept = materialise(features.withColumn("row", F.monotonically_increasing_id()), "descriptors")
    least = materialise(kept.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("r")).select("digest", F.col("r.id").alias("least"), F.col("r.row").alias("rep")), "distinct-images", narrow=True)
    # from here on an id is the row of a distinct image
    images = kept.drop("id").withColumnRenamed("row", "id").join(least.select(F.col("rep").alias("id")), "id", "left_semi")
    keys = _keys(images)
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    held = materialise(keys.join(shared, "key"), "image-keys")
    in_full = held.where(F.col("n") > bucket_limit)
    pairs = _meeting(held.where(F.col("n") <= bucket_limit), in_full, min_inliers)

    sizes = images.select("id", F.floor(F.length("bits") / 16).alias("size"))
    crowd = materialise(in_full.select("key", "id", "n").join(sizes, "id"), "image-crowds")
    probes = probing = materialise(_probes(images, crowd, min_inliers, min_share), "image-probes")
    turn, links, compared = 0, None, None
    while True:
        counts = materialise(probing.groupBy("key").agg(F.count("*").alias("n")), "image-probing", narrow=True)
        if turn and counts.isEmpty():
            break
        centres = _CENTRES[min(turn, len(_CENTRES) - 1)]
        many = counts.where(F.col("n") > max(centres, 4)).select("key")
        crowded = probing.join(many, "key", "left_semi")
        centre = materialise(crowded.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(centres)).alias("c")).agg(F.min("id").alias("id")).select("key", "id"), "image-centres", narrow=True)
        asking = probing.join(many, "key", "left_anti").unionByName(centre.withColumn("size", F.lit(0).cast("long"))).select("key", F.col("id").alias("x"), F.col("size").alias("least"))
        met = asking.join(crowd.select("key", "id", "size"), "key").where("x <> id AND least <= size").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
        pairs = materialise(pairs.distinct(), "image-candidates", narrow=True)
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = _verified(pairs, images, min_inliers, min_share)
        links, pairs = found if links is None else links.unionByName(found), None
        rest = crowded.join(centre, ["key", "id"], "left_anti").join(found.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        probing, turn = materialise(rest, "image-probes"), turn + 1

    links = materialise(links.distinct(), "all-image-links", narrow=True)
    across = materialise(_across(probes, crowd, links, compared), "image-candidates", narrow=True)
    if not across.isEmpty():
        links = materialise(links.unionByName(_verified(across, images, min_inliers, min_share)), "all-image-links", narrow=True)
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = least.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").withColumn("f", F.coalesce("f", "rep"))
    smallest = classes.groupBy("f").agg(F.min("least").alias("class_id"))
    member = materialise(classes.join(smallest, "f").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "image-classes", narrow=True)
    return kept.select("id", "digest").join(member, "digest").select(id_back("id").alias("id"), id_back("class_id").alias("class_id"), "n_links")
