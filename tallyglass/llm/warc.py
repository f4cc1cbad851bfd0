"""Zstandard WARC archives of pages: written by tasks to a shared folder, read back record by record.

An archive starts with a skippable frame that holds the dictionary of its records; each record is a frame of
its own. The dictionary is trained by the task that writes the archive on the first records it sees. The reader
takes the dictionary from the leading skippable frame, decodes one frame at a time in bounded memory, and
checks frames, version lines, headers, block lengths, record ends and payload digests.

Every attempt of a task writes files of its own name and only the attempt that Spark commits enters the list of
archives, so lost executors and repeated attempts leave no record twice and none out. Archives are opened
through pyarrow's file systems, which serve local, HDFS and object-store addresses.

Defined cases: a null payload is empty; a null address is written as a name made of the page's id; line breaks
and control characters in an address are escaped; rows equal in id and payload are each a response; a null id
comes last where the least id of a payload is sought; empty tables give an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import join_spread, small_batches, text_or_empty
from tallyglass.plans.staging import new_path, stage

#: Payloads below this size are always stored whole.
LEAST_REVISIT = 100
#: An archive is closed when it has reached this size.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

_control = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive that doesn't keep the format."""


# ---------------------------------------------------------------- records


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit record where refers_to names the page that holds the payload."""
    target = _control.sub(lambda m: urllib.parse.quote(m.group()), url or "") or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes, what: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: malformed header line {line[:80]!r}")
        if name.lower() in found:
            raise WarcError(f"{what}: header {name} stands twice")
        found[name.lower()] = value.strip()
    return found


def _number(fields: dict[str, str], name: str, what: str) -> int:
    value = fields.get(name.lower(), "")
    if not value.isascii() or not value.isdigit():
        raise WarcError(f"{what}: {name} is {value[:40]!r}")
    return int(value)


def parse(raw: bytes, what: str = "record") -> dict:
    """The fields and payload of one decoded record; raises WarcError where it doesn't keep the format."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{what}: no version line")
    fields = _headers(lines, what)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if not fields.get(name.lower()):
            raise WarcError(f"{what}: {name} is missing")
    length = _number(fields, "Content-Length", what)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{what}: {len(rest) - 4} bytes where Content-Length says {length}")
    out = {"type": fields["warc-type"], "fields": fields, "payload": rest[:length]}
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = rest[:length].partition(b"\r\n\r\n")
        if not gap:
            raise WarcError(f"{what}: the HTTP header has no end")
        size = _number(_headers(http.partition(b"\r\n")[2], what), "Content-Length", what)
        if out["type"] == "response" and size != len(payload):
            raise WarcError(f"{what}: a payload of {len(payload)} bytes where its header says {size}")
        out |= {"payload": payload, "payload_bytes": size}
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if out["type"] == "response" and kind == "sha256" and hashlib.sha256(out["payload"]).hexdigest() != digest:
        raise WarcError(f"{what}: the payload doesn't have its digest")
    return out | {"digest": digest}


# ---------------------------------------------------------------- archives


def open_address(path: str):
    """(file system, path in it) of an address or a local path."""
    from pyarrow import fs

    address = re.sub(r"^s3[an]:", "s3:", path)
    address = re.sub(r"^file:/*", "/", address)
    return fs.FileSystem.from_uri(address) if ":" in address.split("/", 1)[0] else (fs.LocalFileSystem(), address)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples; empty where they are too few or too plain to learn from."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """An archive being written."""

    def __init__(self, folder: str, dictionary: bytes):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, inner = open_address(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(inner, compression=None)
        self.records = self.bytes = 0
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        if dictionary:
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def add(self, raw: bytes) -> None:
        self._write(self.compressor.compress(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        return self.path, self.records, self.bytes


def frames(read) -> Iterator[bytes]:
    """The decoded records of an archive; `read(n)` gives its next bytes."""
    held, decoder, first, number = b"", None, True, 0
    while True:
        while len(held) < 8 and (more := read(READ_BYTES)):
            held += more
        if not held:
            return
        if len(held) < 8:
            raise WarcError("the archive ends within a frame")
        magic, size = struct.unpack("<II", held[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            while len(held) < 8 + size and (more := read(READ_BYTES)):
                held += more
            if len(held) < 8 + size:
                raise WarcError("the archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and first:
                content = held[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
                decoder = zstandard.ZstdDecompressor(dict_data=known)
            held, first = held[8 + size :], False
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"frame {number}: unknown magic {magic:#x}")
        decoder = decoder or zstandard.ZstdDecompressor()
        part, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(part.decompress(held))
            except zstandard.ZstdError as error:
                raise WarcError(f"frame {number}: {error}") from error
            if part.eof:
                held = part.unused_data
                break
            held = read(READ_BYTES)
            if not held:
                raise WarcError(f"frame {number}: the archive ends within it")
        yield b"".join(parts)
        first, number = False, number + 1


# ---------------------------------------------------------------- operators


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and, for records that revisit another, the page_id that they refer to.

    Equal payloads are found by their digests; the least id is aggregated before the shuffle, and a payload
    that is very frequent is joined where its rows lie.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_or_empty("html").alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = F.octet_length("payload") >= LEAST_REVISIT
    least = own.filter(large).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    joined = join_spread(own, stage(least.filter("n > 1"), "payloads"), ["digest"], "n", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))).drop("least")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives under `folder`; returns the list of archives (path, records, bytes)."""
    small_batches(pages.sparkSession)

    def run(batches):
        archive, dictionary, done = None, None, []
        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")]
            rows = [
                record(
                    None if pd.isna(page) else int(page),
                    url if isinstance(url, str) else None,
                    payload.encode("utf-8", "surrogatepass"),
                    digest,
                    None if pd.isna(to) else int(to),
                )
                for page, url, payload, digest, to in zip(*columns, strict=True)
            ]
            if dictionary is None:
                dictionary = train_dictionary(rows)
            for raw in rows:
                archive = archive or Archive(folder, dictionary)
                archive.add(raw)
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # ids travel as text: a missing one among numbers would turn them into floats
    chosen = classified(pages).select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return stage(chosen.mapInPandas(run, ARCHIVES), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (path): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    n = archives.count()

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                system, inner = open_address(path)
                rows = []
                with system.open_input_stream(inner, compression=None) as stream:
                    for k, raw in enumerate(frames(stream.read)):
                        got = parse(raw, f"{path}, record {k}")
                        page, to = (got["fields"].get(h) for h in ("x-page-id", "x-refers-to-page-id"))
                        size = got.get("payload_bytes", len(got["payload"]))
                        rows.append((page, size, got["digest"], got["type"], to))
                        if len(rows) == 5000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    def frame(rows):
        made = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("path").repartition(max(n, 1)).mapInPandas(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder as archives and read them back."""
    return read_archives(write_archives(pages, new_path(spark, "warc")))
