"""WARC archives in per-record Zstandard frames (.warc.zst).

Writing: each task writes archives of at most ``archive_bytes`` into the folder given, under names of
its own, and reports the finished ones; the report is written as a manifest table. Files of lost or
repeated attempts are in no manifest and are never read. An archive starts with a skippable frame that
holds a dictionary trained on a bounded sample (``sample_bytes``) of its own first payloads (none where
they are too few to train on), then one frame per record. Of records with equal payloads the one with the
largest page id is a response, the others are revisits that refer to it and carry its HTTP head but no body.
Record ids are UUIDs; the page ids travel in header fields of their own.

Reading: the dictionary (plain or itself compressed) is loaded from the leading skippable frame if there is
one, frames are decoded one at a time, and every record is validated: version line, header syntax, mandatory
fields, block length against Content-Length, end of record, and for responses and revisits the HTTP head, the
payload's length (unless it is chunked or truncated) and SHA-1 digest where given. What is wrong raises
``ValueError`` with file and record. Records of other types (warcinfo, request, metadata, resource, ...) are
validated and left out, or returned without HTTP fields with ``kinds=None``.

Files are opened by URI with ``pyarrow.fs``, so the folder may lie in any store it knows.

Defined cases: a null html is an empty payload; null and odd urls are percent-encoded or left out; a
null page id counts as smaller than all others; rows with the same page id and payload are all responses if that
id is the largest; an empty table writes no archive. Only id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, id_back, id_key, materialise, pieces

SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEFT = frozenset("%!#$&'()*+,/:;=?@[]~-._")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_PAGE, _REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
_REPEATABLE = frozenset({"warc-concurrent-to"})
_HTTP_KINDS = ("response", "revisit")


def _page(n: int) -> str:
    return "null" if n == NULL_ID else str(n)


def _page_of(name: str | None) -> int | None:
    return None if name is None else NULL_ID if name == "null" else int(name)


def make_record(record: str, page: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record with the id ``record``. A revisit's block is the HTTP head alone; its Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(_LEFT)))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"{_REFERS}: {_page(refers_to)}"]
    head += [f"{_PAGE}: {_page(page)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str], need) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t"):
            need(bool(name), f"header line {line[:40]!r}")
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        need(bool(colon) and bool(name), f"header line {line[:40]!r}")
        need(name not in fields or name in _REPEATABLE, f"repeated {name}")
        fields[name] = value.strip()
    return fields


def parse_record(raw: bytes, where: str = "") -> dict:
    """record, page, type, url, refers_to, payload_bytes, digest, payload (empty for revisits) of one validated record."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"bad WARC record {where}: {what}")

    end = raw.find(b"\r\n\r\n")
    need(end > 0, "no end of header")
    version, *lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    need(version in ("WARC/1.0", "WARC/1.1"), f"version {version[:20]!r}")
    fields = _fields(lines, need)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        need(name in fields, f"no {name}")
    need(fields["content-length"].isdigit(), "Content-Length is no number")
    length = int(fields["content-length"])
    need(len(raw) == end + 4 + length + 4, f"Content-Length {length}, block {len(raw) - end - 8}")
    need(raw.endswith(b"\r\n\r\n"), "no end of record")
    block, kind = raw[end + 4 : end + 4 + length], fields["warc-type"]
    page, refers = fields.get(_PAGE.lower()), fields.get(_REFERS.lower())
    out = {"record": fields["warc-record-id"].strip("<>"), "page": _page_of(page), "type": kind, "url": fields.get("warc-target-uri"), "refers_to": _page_of(refers), "payload_bytes": len(block), "digest": None, "payload": block}
    if kind not in _HTTP_KINDS or not fields.get("content-type", "application/http").startswith("application/http"):
        return out

    cut = block.find(b"\r\n\r\n")
    need(cut > 0, "no HTTP head")
    http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in block[:cut].decode("utf-8", "replace").split("\r\n")[1:])}
    payload, size = block[cut + 4 :], http.get("content-length", "")
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    known = algorithm == "sha1" and len(digest) == 32
    if kind == "response":
        whole = size.isdigit() and "transfer-encoding" not in http and "warc-truncated" not in fields
        need(not whole or len(payload) == int(size), f"HTTP length {size}, payload {len(payload)}")
        need(not known or "transfer-encoding" in http or base32_sha1(payload) == digest.upper(), "payload does not match its digest")
        out |= {"payload_bytes": len(payload), "digest": digest.upper() if known else base32_sha1(payload), "payload": payload}
    else:
        need(bool(digest) and not payload, "revisit without digest, or with payload")
        out |= {"payload_bytes": int(size) if size.isdigit() else None, "digest": digest.upper() if known else digest, "payload": b""}
    return out


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A dictionary for payloads like the samples; empty where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """One archive: leading dictionary frame if there is a dictionary, then a frame per record."""

    def __init__(self, stream, dictionary: bytes, level: int = 3):
        self._stream, self.records = stream, 0
        self.bytes = stream.write(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary) if dictionary else 0
        self._codec = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)

    def write(self, record: bytes) -> None:
        self.bytes += self._stream.write(self._codec.compress(record))
        self.records += 1

    def close(self) -> None:
        self._stream.close()


def _read(stream, n: int) -> bytes:
    """n bytes, fewer only at the end."""
    parts, left = [], n
    while left and (data := bytes(stream.read(left))):
        parts.append(data)
        left -= len(data)
    return b"".join(parts)


def read_archive(stream, where: str = "", chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded records of one archive, one frame at a time."""
    rest, dictionary = _read(stream, 8), b""
    if int.from_bytes(rest[:4], "little") == SKIPPABLE_MAGIC:
        size = int.from_bytes(rest[4:], "little")
        dictionary, rest = _read(stream, size), b""
        if len(dictionary) != size:
            raise ValueError(f"bad archive {where}: cut off in its leading frame")
        if dictionary[:4] == zstandard.FRAME_HEADER:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest, frame, parts, n = rest or bytes(stream.read(chunk)), codec.decompressobj(), [], 0
    while rest:
        try:
            parts.append(frame.decompress(rest))
        except zstandard.ZstdError as e:
            raise ValueError(f"bad archive {where}: frame {n}: {e}") from e
        if frame.eof:
            if record := b"".join(parts):  # other skippable frames hold none
                yield record
            rest, frame, parts, n = frame.unused_data, codec.decompressobj(), [], n + 1
        else:
            rest = b""
        if not (rest := rest or bytes(stream.read(chunk))) and parts:
            raise ValueError(f"bad archive {where}: cut off in frame {n}")


def write_warc(pages: DataFrame, folder: str, min_dedup_bytes: int = 0, archive_bytes: int = 128 << 20, sample_bytes: int = 2 << 20, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows as records; returns the manifest (path, records), a written table."""
    rows = pages.select(id_key(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    key = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    several = key.where(F.col("size") >= min_dedup_bytes).groupBy("sha1", "size").agg(F.max("page").alias("last"), F.min("page").alias("least")).where("least < last").select("sha1", "size", "last")
    joined = key.join(materialise(several, "warc-equal"), ["sha1", "size"], "left").select("page", "url", "payload", F.when(F.col("page") < F.col("last"), F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, done, archive = None, "", [], uuid.UUID(int=0)
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in pieces(batches):
            payloads = batch.column("payload").to_pylist()
            for page, url, payload, refers in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), payloads, batch.column("refers_to").to_pylist(), strict=True):
                if writer is None:
                    archive = uuid.uuid4()
                    name = f"pages-{archive.hex}.warc.zst"
                    fs.create_dir(base, recursive=True)
                    samples, size = [], 0
                    for p in payloads:
                        if p and size < sample_bytes:
                            samples.append(p[: sample_bytes - size])
                            size += len(samples[-1])
                    writer, path = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), train_dictionary(samples)), f"{folder}/{name}"
                writer.write(make_record(str(uuid.uuid5(archive, str(writer.records))), page, url, payload, refers, date))
                if writer.bytes >= archive_bytes:
                    writer.close()
                    done.append((path, writer.records))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, writer.records))
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return materialise(joined.mapInArrow(write, "path string, records long"), "warc-manifest")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest (path, records: null) of all .warc.zst files below a folder, whoever wrote them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", F.lit(None).cast("long").alias("records"))


def read_warc(manifest: DataFrame, payloads: bool = False, kinds: tuple[str, ...] | None = _HTTP_KINDS) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload) of every record of the archives that is of
    one of the kinds (None: of all). page_id and refers_to are null in archives of others."""
    names = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held, n = [], 0, 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for raw in read_archive(stream, path):
                        r = parse_record(raw, f"{path}, {n}")
                        n += 1
                        if kinds is not None and r["type"] not in kinds:
                            continue
                        rows.append((r["page"], r["url"], r["type"], r["refers_to"], r["payload_bytes"], r["digest"], r["payload"]))
                        held += payloads * len(raw)
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield _batch(rows, names, types)
                            rows, held = [], 0
                if records is not None and n != records:
                    raise ValueError(f"bad archive {path}: {n} records, {records} in the manifest")
                if rows:
                    yield _batch(rows, names, types)

    files = max(1, manifest.count())
    schema = "page long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    out = manifest.select("path", "records").repartition(files, "path").mapInArrow(read, schema)
    return out.withColumn("page", id_back("page")).withColumn("refers_to", id_back("refers_to")).withColumnRenamed("page", "page_id")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
