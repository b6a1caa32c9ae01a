"""WARC records in Zstandard archives with a shared dictionary, and their reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame per record. Archives are the binary rows of a table, so that Spark writes
and reads them wherever the table is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Fit bounds: payloads taken for the dictionary, bytes of each, and the dictionary's size.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 256, 32_768, 16_384
ARCHIVE_BYTES = 8_000_000
SALTS = 16


_DATE = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z")
_URI, _PAGE = re.compile(r"<[a-z][a-z0-9+.-]*:\S+>"), re.compile(r"<urn:page:(-?\d+)>")


class WarcError(ValueError):
    """An archive or a record that is not as it should be."""


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample payloads; their plain bytes where there are too few to train on, b"" where none."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[:DICT_BYTES]
        return raw if len(raw) >= 8 else b""


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archive(records: Iterable[bytes], dictionary: bytes, level: int = 3) -> bytes:
    loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    out = [struct.pack("<II", DICT_MAGIC, len(dictionary)), dictionary] if dictionary else []
    press = zstandard.ZstdCompressor(level=level, dict_data=loaded)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frames(data: bytes) -> Iterator[bytes]:
    """The records' bytes, frame by frame; the leading skippable frame's dictionary is used, later ones are skipped."""
    at, loaded = 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError(f"{len(data) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(data):
                raise WarcError("a skippable frame is cut short")
            if at == 0 and magic == DICT_MAGIC:
                body = data[8 : 8 + size]
                if body[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
                    body = zstandard.ZstdDecompressor().decompress(body)
                loaded = zstandard.ZstdCompressionDict(body)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        one, parts = zstandard.ZstdDecompressor(dict_data=loaded).decompressobj(), []
        while not one.eof:
            piece = data[at : at + 65_536]
            if not piece:
                raise WarcError("a frame is cut short")
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and block, with version, length and ends checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise WarcError("a record lacks its length or type")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, not {size}")
    return headers, rest[:size]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_pages(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A table of archives (content binary) with one record for each row of `pages` (page_id, url, html).

    Of the rows whose payloads (html in UTF-8; null: empty) are equal and have `min_bytes` at
    least, that with the smallest page_id is a response and the others revisit it, without a
    payload of their own. A row without page_id is always a response. Rows that share a
    page_id each get a record, under one record id. Records have `date`, as the rows have none of
    their own. No rows make no archive. The dictionary is fitted on SAMPLE_ROWS rows at most, chosen
    by a hash.
    """
    rows = pages.select("page_id", F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    large = rows.filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    shared = large.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = shared.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(shared, ["digest", "salt"], "left")
    refers = F.when((F.octet_length("payload") >= min_bytes) & (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))
    hashed = pages.select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("s"), F.xxhash64("page_id").alias("h"))
    least = hashed.select("h").orderBy("h").limit(SAMPLE_ROWS)
    taken = hashed.join(F.broadcast(least.distinct()), "h").orderBy("h", "s").limit(SAMPLE_ROWS)
    dictionary = fit_dictionary([r["s"].encode() for r in taken.collect() if r["s"]])

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(b["page_id"], b["url"], b["payload"], b["refers_to"]):
                payload, revisit = bytes(payload), pd.notna(refers_to)
                count += 1
                name = str(int(page_id)) if pd.notna(page_id) else f"none-{part}-{count}"
                named = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date)]
                named += [("WARC-Target-URI", " ".join(str(url).split()))] if isinstance(url, str) else []
                named += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
                named += [("WARC-Refers-To", f"<urn:page:{int(refers_to)}>")] if revisit else []
                held.append(record_bytes(named, b"" if revisit else payload))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"content": [write_archive(held, dictionary)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"content": [write_archive(held, dictionary)]})

    return written(in_batches(rows, archives, "content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of a table of archives; a malformed one raises WarcError.

    A response's payload is checked against its digest and length; `payload` is null for a revisit.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out, size = [], 0
                for raw in frames(bytes(content)):
                    h, block = parse_record(raw)
                    kind, named = h["warc-type"], h.get("warc-payload-digest", "")
                    if not named.startswith("sha1:"):
                        raise WarcError("a record lacks its payload digest")
                    if not _DATE.fullmatch(h.get("warc-date", "")) or not _URI.fullmatch(h.get("warc-record-id", "")):
                        raise WarcError("a record lacks its date or id")
                    full = int(h.get("warc-payload-length", len(block)))
                    if kind == "response" and (digest(block) != named[5:] or full != len(block)):
                        raise WarcError("a payload does not have its digest or length")
                    ids = [int(m[1]) if (m := _PAGE.fullmatch(h.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to")]
                    out.append((ids[0], full, named[5:], kind, ids[1], h.get("warc-target-uri"), None if kind == "revisit" else block))
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield _frame(out)
                        out, size = [], 0
                if out:
                    yield _frame(out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return in_batches(archives, records, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})
