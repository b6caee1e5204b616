"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and clashing columns."""

import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthlog.llm import decontaminate, html_extract, image_copies, mixing, quality, simhash_dedup, substring_dedup, token_output, url_filter, warc
from hearthlog.llm.common import fresh_path
from hearthlog.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, bucket string, id long, n_words string, fp string"


def fixture_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["é\u00a0x", "THE", "the", "\u2028z"]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", "   \n", "a", "a b", "A B", "x y z", " ".join(rng.choices(words, k=3000)), "again " * 200]
    for i in range(60):
        body = " ".join(rng.choices(words, k=rng.randint(1, 150)))
        texts.append(f"{body}\n\t{passage if i % 3 == 0 else ''} tail{i}")
    texts += texts[10:20] + [passage] * 30
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "b", "a", "c"][i % 4], "b", 7, "n", "f") for i, t in enumerate(fixture_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(spark, docs):
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs, k=20).collect()}
    seen = set()
    for i, text in enumerate(fixture_texts()):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone.update(range(s, s + 20))
            seen.add(window)
        kept = None if text is None else " ".join(w for j, w in enumerate(words) if j not in gone)
        assert got[i] == (kept, len(words), len(gone)), i
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substrings_hot_minimiser(spark):
    rng = random.Random(1)
    line = "the one very common line of them all stands here"
    rows = [(i, " ".join(rng.choices("abcdefgh", k=25)) + f" {line} " + " ".join(rng.choices("abcdefgh", k=25))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(substring_dedup._hot_minimisers(df.selectExpr("doc_id AS id", "text"), 20, 3, 4))
    seen, want = set(), {}
    for i, text in rows:
        words, gone = text.split(), set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            gone.update(range(s, s + 20) if w in seen else ())
            seen.add(w)
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df, buckets=4).collect()} == want


def test_window_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_window_hashes", lambda v, k: np.zeros(len(v) - k + 1, np.uint64))
    ids, starts, sizes = np.array([1, 2, 3]), np.array([0, 0, 0]), np.array([1, 1, 1])
    out = substring_dedup.first_places(ids, starts, sizes, b"a b a c a b", 2)
    assert sorted(out[0].tolist()) == [1, 2]


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


@pytest.mark.parametrize("limit", [48, 2])
def test_simhash(spark, docs, limit):
    prints = [slow_fingerprint(t) for t in fixture_texts()]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs, bucket_limit=limit).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in enumerate(prints)}
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [48, 3])
def test_links_join_all_within_two_bits(spark, limit):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(30)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    labels = {r.node: r.f for r in simhash_dedup.components(simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, limit)).collect()}
    group = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] < group[b]:
                    group[b], changed = group[a], True
    assert {x: labels.get(x, x) for x in signed} == group


def test_golay_keys_meet():
    rng = random.Random(4)
    values = np.array([rng.getrandbits(63) for _ in range(300)], np.int64)
    near = values ^ np.array([(1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in values])
    r1, k1 = simhash_dedup.golay_keys(values)
    r2, k2 = simhash_dedup.golay_keys(near)
    assert all(set(k1[r1 == i]) & set(k2[r2 == i]) for i in range(300))


def test_leaks(spark, docs):
    rng = random.Random(6)
    item = " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(15))
    spoilt = item[:30] + "X" + item[31:60] + item[62:]
    far = "".join(c if i % 4 else "#" for i, c in enumerate(item))
    texts = [f"before {item} after", f"x {item.upper()} y", f"a {spoilt} b", f"{far}", None, "", item]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, item), (10, None), (11, " "), (12, "short"), (9, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(df, items).collect()}
    assert got == {(0, 9): 0, (1, 9): 0, (2, 9): 3, (6, 9): 0}
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            row = _next(row, i, a, t)
        return min(row)

    def _next(row, i, a, t):
        out = [i]
        for j, b in enumerate(t, 1):
            out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (a != b)))
        return out

    for _ in range(200):
        p, t = ("".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(2))
        assert decontaminate.myers(decontaminate.bits_of(p), len(p), t)[0] == slow(p, t)


def test_quality(spark):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + rng.choice("abcde") for _ in range(80)) + "."
    junk = lambda: " | ".join(rng.choice("###$$$%%%") + rng.choice("QWE") for _ in range(80))
    kinds = [rng.random() < 0.8 for _ in range(1500)]
    rows = [(i, clean() if k else junk()) for i, k in enumerate(kinds)] + [(5000, None), (None, ""), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if i % 2] + [(None, 1), (7, None), (99999, 1)], "doc_id long, quality int")
    scorer = quality.train(df, labels)
    assert 0.6 < scorer.prior < 0.9
    got = [(r.doc_id, r.score) for r in quality.score(df, scorer).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    right = [(s >= 0.3) == kinds[i] for i, s in got if i is not None and i < 1500 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.97
    with pytest.warns(UserWarning):
        blind = quality.train(df, labels.where("quality = 0"))
    assert {r.score for r in quality.score(df, blind).collect()} == {0.5}
    with pytest.warns(UserWarning):
        assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).count() == 0
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(df, turned)  # labels of the held-out fold are not learned from
    assert sorted(map(str, quality.score(df, again).collect())) == sorted(map(str, quality.score(df, scorer).collect()))


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://EXAMPLE.com/en/x?q", "https://a.www.example.com/en/", "x.com/en/", None, "http://example.com", "http://badexample.com/en/", "ftp://u.net/es/#f", "http://net/es/", "a://b://c.com/", "http://x.net?/es/"]
    want = {0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/", "allow"), 6: ("net/es/", "block"), 7: ("net/es/", "block"), 8: (None, "allow"), 9: (None, "allow")}
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for size in (1 << 20, 0):
        out = url_filter.filter_urls(df, rules, max_index_bytes=size).collect()
        assert {r.page_id: (r.rule, r.verdict) for r in out} == want
        assert {r.page_id: r.host for r in out}[8] == "b:"
    assert url_filter.filter_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0
    for size in (1 << 20, 0):
        assert url_filter.filter_urls(df.limit(0), rules, max_index_bytes=size).count() == 0
        far = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "net/es/x" + "y" * 100_000, "c")], "page_id long, url string, rule string")
        assert [r.rule for r in url_filter.filter_urls(far, rules, max_index_bytes=size).collect()] == ["net/es/"]
    assert url_filter.host_suffixes("a.b.c", [1, 2, 3, 4]) == ["c", "b.c", "a.b.c"]


def test_mixing(spark, docs):
    out = mixing.plan_mix(docs).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t in enumerate(fixture_texts())}
    assert {r.doc_id: r.size for r in out} == sizes
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault([None, "b", "a", "c"][r.doc_id % 4], []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= len(rows) and rows[0].target <= 2 * rows[0].source_size + 1e-9
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert sorted(map(str, out)) == sorted(map(str, mixing.plan_mix(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert n == sum(r.taken for r in out)
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_warc(spark):
    pages = [(i, f"http://h/{i}\r\n", ["same", "<p>é</p>" * 50, "", None][i % 4], "x") for i in range(40)] + [(99, None, "z" * 100_000, "x"), (None, "u", "same", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(3)
    out = warc.read_warc(warc.write_warc(df, fresh_path(spark, "t"), archive_bytes=2000), payloads=True).collect()
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    assert len(out) == len(pages)
    for r in out:
        html = next(h or "" for i, _, h, _ in pages if i == r.page_id)
        first = last[html] == r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html.encode()), warc.base32_sha1(html.encode()), "response" if first else "revisit", None if first else last[html])
        assert r.payload == (html.encode() if first else b"")
    assert warc.read_warc(warc.write_warc(df.limit(0), fresh_path(spark, "t"))).count() == 0


def test_warc_damage_is_found():
    good = warc.make_record("6ba7b810-9dad-11d1-80b4-00c04fd430c8", 1, "http://h/", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["page"] == 1
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload", b"paiload"), good[:-1], good.replace(b"WARC-Date", b"X"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    out = io.BytesIO()
    writer = warc.Writer(out, warc.train_dictionary([b"payload %d " % (i * i) * 50 for i in range(500)]))
    for _ in range(3):
        writer.write(good)
    raw = out.getvalue()
    assert raw[:4] == warc.SKIPPABLE_MAGIC.to_bytes(4, "little")
    assert list(warc.read_archive(io.BytesIO(raw), chunk=7)) == [good] * 3
    for bad in (raw[4:], raw[:-3], raw[:6]):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(bad)))


def test_warc_of_others(spark, tmp_path):
    """No dictionary, a compressed dictionary, other record types, folded and repeated fields, chunked bodies, missing digests."""
    import zstandard

    def record(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    records = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "X-Long: a", " b"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
        record("response", b"HTTP/1.1 200 OK\r\nserver:x\r\nContent-Length: 3\r\n\r\nabc", http, "WARC-Target-URI: http://h/1"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", http, "WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"abc")),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"abc")),
        record("metadata", b"", "Content-Type: text/plain"),
        record("resource", b"file", "Content-Type: text/plain"),
    ]
    samples = [b"payload %d " % (i * i) * 50 for i in range(500)]
    dictionary = zstandard.ZstdCompressionDict(warc.train_dictionary(samples))
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    heads = {"plain": (b"", None), "packed": (warc.SKIPPABLE_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed, dictionary)}
    for name, (head, d) in heads.items():
        codec = zstandard.ZstdCompressor(dict_data=d) if d else zstandard.ZstdCompressor()
        skipped = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
        (tmp_path / f"{name}.warc.zst").write_bytes(head + skipped * bool(d) + b"".join(codec.compress(r) for r in records))
    manifest = warc.archives(spark, f"file://{tmp_path}")
    got = warc.read_warc(manifest, payloads=True).collect()
    assert sorted(((r.record_type, r.payload_bytes) for r in got), key=str) == sorted([("response", 3), ("response", 13), ("revisit", None)] * 2, key=str)
    assert {r.payload_digest for r in got if r.payload_bytes == 3} == {warc.base32_sha1(b"abc")}
    every = warc.read_warc(manifest, kinds=None).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in every} == {"warcinfo": 2, "request": 2, "response": 4, "revisit": 2, "metadata": 2, "resource": 2}


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    extra = spark.createDataFrame([(1000 + i, x, None, None, None, None, None) for i, x in enumerate(["a  b", " it's  x\n\n\ny", "<|endoftext|> z", "x_y, z. q\n w"])], SCHEMA)
    both = docs.unionByName(extra)
    texts = sorted((r.doc_id, r.text) for r in both.select("doc_id", "text").collect())
    for encoding in ("dictionary", "delta"):
        path = fresh_path(spark, "tokens")
        token_output.write_tokens(both, path, tokenizer_path(), encoding=encoding)
        got = sorted((r.doc_id, r.start, r.ids) for r in token_output.read_tokens(spark, path).collect())
        digests = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_digests(spark, path).collect()}
        start = 0
        for (i, text), (j, at, ids) in zip(texts, got, strict=True):
            want = t.encode(text or "", add_special_tokens=False).ids + [0]
            assert (i, start, want) == (j, at, ids)
            assert digests[i] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
            start += len(want)
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(empty(spark), path, tokenizer_path())
    assert token_output.token_digests(spark, path).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, really, all of them.</div><div id=main><h1>Head &amp; line</h1><p>First, a long   paragraph,
with <b>bold</b> words, commas, and more text than the rest.<p>Second paragraph &eacute;, also with <a href=y>a link</a>, and commas, yes.
<div class="sidebar"><p>Side, bar, text, with, many, commas, in, it, all, over.</p></div><p>Short.</div>
<div class="comments"><p>Reader, comment, that, is, long, and, has, commas, everywhere, in, it.</p></div><form>f</form><footer>&copy; F</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst, a long paragraph, with bold words, commas, and more text than the rest.\nSecond paragraph é, also with a link, and commas, yes.\nShort."
    deep = "<div>" * 5000 + "<p>deep, text, here</p>"
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>", 5), (5, "u", "just text", 5), (6, "u", deep, 5), (None, "u", "<p>a<!-- b", 5), (1, "u", PAGE, 5)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    texts = {r.page_id: r.text for r in out}
    assert len(out) == 8 and texts == {1: want, 2: "", 3: "", 4: "", 5: "just text", 6: "deep, text, here", None: "a"}
    assert all(r.n_chars == len(r.text) for r in out)


def test_images(spark):
    rng = np.random.default_rng(0)

    def smooth(h, w):
        x = rng.integers(0, 256, (h // 2 + 1, w // 2 + 1)).repeat(2, 0).repeat(2, 1)[:h, :w].astype(float)
        return image_copies._box(x) / 9

    base = [smooth(64, 80) for _ in range(8)]
    edited = base[6].copy()
    edited[20:40, 20:50] = 0
    images = [*enumerate(base), (100, base[0][8:60, 10:74]), (101, base[1][4:, 6:]), (102, np.clip(base[2] * 0.8 + 20, 0, 255)), (103, np.rot90(base[3])), (104, edited), (105, base[5])]
    rows = [(i, *x.shape, bytearray(np.ascontiguousarray(x).astype(np.uint8).tobytes())) for i, x in images] + [(900, 0, 0, None), (None, 3, 3, bytearray(b"abc"))]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    want = {i: i for i in range(8)} | {100: 0, 101: 1, 102: 2, 103: 3, 104: 6, 105: 5, 900: 900, None: None}
    for limit in (24, 1):  # crowded buckets take the other way
        assert {r.id: r.class_id for r in image_copies.find_copies(image_copies.image_features(df), bucket_limit=limit).collect()} == want
    assert image_copies.find_copies(image_copies.image_features(df.limit(0))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(len(counts))))
        docs = spark.read.parquet(str(tmp_path / str(len(counts))))
        counts.append(docs.count())
        if len(counts) < 6:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4]
