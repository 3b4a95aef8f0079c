"""WARC archives in Zstandard: a skippable frame with the dictionary, then one frame for each record.

Pages with equal payloads are written once, as the response of the smallest id; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from .common import attach, materialize
from .exact_dedup import filter_bits, maybe_repeated, repeated_slots

#: Magic number of the dictionary's skippable frame, the first of the 16 of skippable frames, and that of a frame of data.
DICT_MAGIC, SKIP_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 64 << 10
#: The dictionary is trained on at most so many pages of at most so many bytes.
DICT_PAGES, DICT_PAGE_BYTES = 256, 64 << 10
#: High half of the ids of records; the low half is the page's id.
ID_PREFIX = 0x6F1D_7C52_93A8_4E0B << 64
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
FALLBACK_DICT = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n" + HTTP_HEAD
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int) -> str:
    h = f"{ID_PREFIX | page_id & (1 << 64) - 1:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _page_id(record_id: str) -> int | None:
    """The page of one of our ids; None of any other."""
    whole = re.fullmatch(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})>", record_id)
    n = int("".join(whole.groups()), 16) if whole else 0
    low = n & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if n >> 64 == ID_PREFIX >> 64 else None


def _foreign_id(*parts: str) -> str:
    """The id of a record without a page: a name made of what it holds."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _line(value: str) -> str:
    """A header's value cannot hold line ends or edge blanks: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC record; one that refers to another has the HTTP head only."""
    block = HTTP_HEAD % size + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Record-ID: {_record_id(page_id) if page_id is not None else _foreign_id(digest, url or '')}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# The record types of the standard.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")


def _unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; ValueError if it is cut."""
    out, at = [], 0
    while True:
        line, sep, _ = body[at : at + 4096].partition(b"\r\n")
        size = int(line.split(b";")[0].strip() or b"x", 16)
        at += len(line) + 2
        if not sep or at + size > len(body):
            raise ValueError("cut chunk")
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size + 2


def parse_record(data: bytes) -> dict:
    """Fields of a record of any type; ValueError if a header, a length or a digest is not as it should be.

    What the standard demands of every record must be there. Payload digests, block digests and the length in an HTTP head
    are checked where they are given; a digest that is not SHA-1 is taken as it is. The payload of a record with an HTTP
    head is what follows it, chunks put together; that of any other record is its block.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if line[:1] in (" ", "\t"):  # a header goes on
            continue
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise ValueError(f"bad or repeated header {name[:40]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-record-id", "warc-type", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    kind, size = fields["warc-type"], int(fields["content-length"])
    if kind not in TYPES:
        raise ValueError(f"no record type {kind[:40]!r}")
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit")
    block_digest = fields.get("warc-block-digest", "")
    if block_digest.startswith("sha1:") and block_digest != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    payload, told, bodies = block, None, [block]
    if kind in ("response", "request", "revisit") and fields.get("content-type", "application/http").startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep or kind != "request" and not http.startswith(b"HTTP/"):
            raise ValueError("bad HTTP head")
        bodies = [payload]
        if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", http):
            if kind == "response":
                bodies.append(payload := _unchunked(payload))
        elif length := re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http):
            told = int(length[1])
    digest = fields.get("warc-payload-digest", "")
    if kind == "response" and (told is not None and len(payload) != told or digest.startswith("sha1:") and digest[5:] not in map(sha1_base32, bodies)):
        raise ValueError("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields and "warc-refers-to-target-uri" not in fields):
        raise ValueError("bad revisit")
    to = fields.get("warc-refers-to")
    return {
        "page_id": _page_id(fields["warc-record-id"]), "payload_bytes": told if kind == "revisit" else len(payload), "payload_digest": digest.removeprefix("sha1:") or (None if kind == "revisit" else sha1_base32(payload)), "record_type": kind,
        "refers_to": _page_id(to) if kind == "revisit" and to else None, "url": fields.get("warc-target-uri"), "payload": None if kind == "revisit" else payload,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends: past its header, its blocks and its checksum."""
    if len(data) - at < 8 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame here")
    head = bytes(data[at : at + 18])
    checksum = 4 * zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        if at + 3 > len(data):
            raise ValueError("cut frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            if at + checksum > len(data):
                raise ValueError("cut frame")
            return at + checksum


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, each with ``error`` null or what is wrong with it.

    Frames need not tell the size of their content, and skippable ones may stand between records. What is
    damaged gives one row with an error; reading goes on at the next frame that can be read.
    """
    view, at, dictionary = memoryview(data), 0, None
    magic = lambda: struct.unpack_from("<I", view, at)[0] if len(view) - at >= 8 else 0
    if magic() == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    none = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"))
    bad = None
    while at < len(view):
        try:
            if magic() & ~15 == SKIP_MAGIC:
                end, text = at + 8 + struct.unpack_from("<I", view, at + 4)[0], None
                if end > len(view):
                    raise ValueError("cut frame")
            else:
                end = frame_end(view, at)
                text = unzip.decompressobj().decompress(view[at:end])
        except (ValueError, zstandard.ZstdError) as e:
            bad = bad or f"at byte {at}: {e}"
            at = data.find(struct.pack("<I", FRAME_MAGIC), at + 1) % (len(view) + 1)  # none left: the end
            continue
        if bad:
            yield none | {"error": bad}
            bad = None
        if text is not None:
            try:
                yield parse_record(text) | {"error": None}
            except ValueError as e:
                yield none | {"error": f"at byte {at}: {e}"}
        at = end
    if bad:
        yield none | {"error": bad}


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str) -> bytes:
    """A dictionary of up to DICT_BYTES from a bounded sample by a hash of the id; a fixed one if there is too little to learn from."""
    short = pages.filter(F.octet_length(payload_col).between(1, DICT_PAGE_BYTES))
    ids = short.select(id_col).orderBy(F.xxhash64(id_col)).limit(DICT_PAGES)  # ids alone are sorted; each task hands on so many of them
    some = short.join(F.broadcast(ids), id_col, "left_semi").select(payload_col).limit(2 * DICT_PAGES)
    samples = sorted(r[0].encode() for r in some.collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return FALLBACK_DICT


def _opened(path: str):
    """A file to write in the shared folder, whatever store it is in, and the move that puts it in its place."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        draft = f"{parts.path}.{os.getpid()}-{TaskContext.get().taskAttemptId()}.tmp"
        return open(draft, "wb"), lambda: os.replace(draft, parts.path)  # noqa: SIM115
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    draft = f"{inner}.{TaskContext.get().taskAttemptId()}.tmp"
    return store.open_output_stream(draft), lambda: store.move(draft, inner)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as archives under ``path``; returns (archive, records) of what was written.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least ``min_bytes``
    that with the smallest id is the response, and pages with another id revisit it. Null ids give records
    without an id that are never referred to; repeated rows are repeated records; null urls are left out;
    other columns are ignored. A task writes its pages in the order of their ids, each archive under a
    temporary name first, so a task that runs again replaces its archives by the same ones.
    """
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("payload"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("key"))
    keys = materialize(rows.select(F.col("key").alias("text_sha256")), "payloads")
    n_rows = keys.count()
    dictionary = train_dictionary(rows, "page_id", "payload")
    # only pages that may have a copy move to meet it; the others are written where they are read
    bits, _ = filter_bits(n_rows)
    seen = maybe_repeated(rows.withColumnRenamed("key", "text_sha256"), repeated_slots(keys, bits), bits)
    alone = seen.filter(~F.col("maybe")).drop("maybe", "text_sha256").withColumn("first_id", F.lit(None).cast("long"))
    apart = materialize(seen.filter("maybe").drop("maybe"), "maybe_repeated")
    same = apart.groupBy("text_sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    told = alone.unionByName(attach(apart, same, "text_sha256", "n", n_rows).select(*alone.columns))
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.col("size") >= min_bytes)
    told = told.select("page_id", "url", "size", F.sha1("payload").alias("sha1"), F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        task, n, out, size, held, put = TaskContext.get().partitionId(), 0, None, 0, 0, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    out, put = _opened(name := f"{path}/part-{task:06d}-{n:05d}.warc.zst")
                    size = out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                    held = 0
                to = None if pd.isna(r.refers_to) else int(r.refers_to)
                digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                size += out.write(zip_.compress(record(None if pd.isna(r.page_id) else int(r.page_id), r.url, None if to is not None else r.payload.encode(), digest, r.size, to)))
                held += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    put()
                    yield pd.DataFrame({"archive": [name], "records": [held]})
                    out, n = None, n + 1
        if out is not None:
            out.close()
            put()
            yield pd.DataFrame({"archive": [name], "records": [held]})

    # ids as text: a column of longs with nulls would pass through floating point
    text_ids = told.sortWithinPartitions("page_id").withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialize(text_ids.mapInPandas(write, "archive string, records long"), "manifest")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, in the columns of RECORD_SCHEMA; ``error`` says what is wrong with a bad one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
        for pdf in batches:
            for content in pdf["content"]:
                held, size = [], 0
                for x in read_archive(content):
                    held.append(x)
                    size += len(x["payload"] or b"")
                    if size > ARCHIVE_BYTES:
                        yield pd.DataFrame(held).astype(kinds)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held).astype(kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInPandas(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """`write_archives` into the shared folder, then `read_archives`: a row a page, without the payload."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    if write_archives(pages, path, min_bytes, **columns).isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA).drop("url", "payload", "error")
    told = read_archives(spark, path)
    good = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record "), "error"))).otherwise(F.col("page_id"))
    return told.select(good.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
