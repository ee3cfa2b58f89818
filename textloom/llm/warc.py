"""WARC archives compressed with Zstandard: writing, and a validating reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or as a Zstandard frame of
its own. Every record is one further frame compressed with it. The reader loads the dictionary, finds each frame's
end from its block headers, decodes one frame per record, and validates the version line, the required headers, the
block's length, the two closing line breaks and the payload digest.

Archives are rows (path, content), as ``spark.read.format("binaryFile")`` gives them; ``write`` makes such rows of
at most about ``ARCHIVE_BYTES`` each, so a task holds one archive at a time and a repeated task makes the same ones.

Which records revisit others is settled beforehand by ``plan``: a group of equal payloads is one (digest, length) pair,
aggregated before the shuffle; only keys of 40 bytes and ids are joined back, by a join that adaptive execution
can split where a group is hot.

Defined cases: a null or empty payload gives a record with an empty payload; null urls give an empty target; a null page
id never wins a group that has others, and is written as no id; where the largest id of a group occurs in several rows
all of them are responses; an empty table gives no archive; further columns are ignored.

The reader takes archives of other makers too: all record types, any record ids, continued header lines, missing digests, digests by
other functions or in hexadecimal, chunked bodies, records whose block is no HTTP message. A damaged archive or record raises ``WarcError`` with
path and offset, or, if the reader isn't strict, becomes a row that says what is wrong.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch
from .workers import mapped

#: Magic numbers of the Zstandard and WARC-Zstandard formats.
FRAME_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0xEC30A437
SKIPPABLE_FIRST, SKIPPABLE_LAST, WARC_DICTIONARY_MAGIC = 0x184D2A50, 0x184D2A5F, 0x184D2A5D

ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many payloads, of at most so many bytes each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
#: Equal payloads of at least so many bytes are stored once.
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


# Writing


def _printable(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. refers_to: the page whose payload this one repeats; the payload is then left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_printable(url)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading frame: the dictionary, itself compressed."""
    import zstandard

    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", WARC_DICTIONARY_MAGIC, len(body)) + body


def train_dictionary(df: DataFrame, payload: str = "html") -> bytes:
    """A dictionary trained on a bounded sample of payloads; empty if there are too few to train on."""
    import zstandard

    # Which rows is left to the scan, which so ends early; archives of two runs can differ, but not what is read back from them.
    rows = df.where(F.length(payload) >= 64).select(F.encode(F.substring(payload, 1, SAMPLE_BYTES), "UTF-8")).limit(SAMPLE_ROWS).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r[0]) for r in rows], threads=0).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def plan(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, html, payload_digest, refers_to: which pages are stored as revisits of which."""
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "b", "first")
    # The pages keep their place; only those in a group of several get a partner, and the join's hot keys can be split.
    joined = rows.join(groups, (rows.payload_digest == groups.d) & (rows.payload_bytes == groups.b), "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(planned: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) of a planned table; one record per row."""
    rows = planned.select("page_id", "url", "html", "payload_digest", "refers_to")

    def run(batches):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        head = dictionary_frame(dictionary) if dictionary else b""
        held, size, first = [], 0, None

        def archive():
            name = f"page-{'none' if first is None else first}-{hashlib.sha1(held[0]).hexdigest()[:12]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([head + b"".join(held)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for page, url, html, digest, to in zip(*batch.columns, strict=True):
                page = page.as_py()
                frame = compressor.compress(record(page, url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", digest.as_py(), to.as_py()))
                if held and size + len(frame) > archive_bytes:
                    yield archive()
                    held, size = [], 0
                if not held:
                    first = page
                held.append(frame)
                size += len(frame)
        if held:
            yield archive()

    return mapped(rows, run, "path string, content binary")


# Reading


def _word(data: memoryview, at: int) -> int:
    if at + 4 > len(data):
        raise WarcError("a frame's magic number is cut off")
    return struct.unpack_from("<I", data, at)[0]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and its blocks' headers."""
    if at + 5 > len(data):
        raise WarcError("a frame header is cut off")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size = flags >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0) if size == 0 else 1 << size)
    while True:
        if at + 3 > len(data):
            raise WarcError("a block header is cut off")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        kind, length = head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("a block has a reserved type")
        at += 3 + (1 if kind == 1 else length)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("a block is cut off")
    return at


def load_dictionary(data: memoryview) -> tuple[bytes, int]:
    """The dictionary in the leading skippable frame, or none, and where the records begin."""
    import zstandard

    if not len(data) or _word(data, 0) != WARC_DICTIONARY_MAGIC:
        return b"", 0
    size = _word(data, 4)
    if 8 + size > len(data):
        raise WarcError("the dictionary is cut off")
    body = bytes(data[8 : 8 + size])
    if len(body) >= 4 and _word(memoryview(body), 0) == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=zstandard.frame_content_size(body) if zstandard.frame_content_size(body) > 0 else 1 << 24)
    if len(body) < 8 or _word(memoryview(body), 0) != DICTIONARY_MAGIC:
        raise WarcError("the leading frame holds no dictionary")
    return body, 8 + size


#: Headers that a record has once at most (of the others, repeated ones are joined).
ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length", "content-type", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-block-digest"}


def parse(raw: bytes) -> Record:
    """One record from a frame's content, which must hold that record and nothing more."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the headers don't end")
    lines = raw[:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a version line: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:  # a continued line
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"not a header: {line[:40]!r}")
        if name in headers and name in ONCE:
            raise WarcError(f"header {name} is repeated")
        headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + length]
    if len(block) != length or raw[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError(f"the block isn't {length} bytes long and closed by two line breaks")
    return Record(headers, block)


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded content of each record's frame; other skippable frames are passed over."""
    import zstandard

    data = memoryview(content)
    dictionary, at = load_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        magic = _word(data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            at += 8 + _word(data, at + 4)
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        end = frame_end(data, at)
        try:
            if zstandard.frame_content_size(data[at:end]) >= 0:
                raw = reader.decompress(data[at:end])
            else:
                raw = reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        yield at, raw
        at = end


def _page(record_id: str | None) -> int | None:
    """The page id in a record id of ours; null for others."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", record_id or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _digest(given: str) -> tuple[str, bytes] | None:
    """Function and bytes of a digest header, in base 32 or hexadecimal; none if the function isn't known."""
    name, _, value = given.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        return name, bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError as e:
        raise WarcError(f"a digest is malformed: {given[:80]!r}") from e


def _unchunked(body: bytes) -> bytes | None:
    """The body that a chunked transfer carries; none if it isn't well formed."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            return None
        if not int(size, 16):
            return b"".join(out)
        at = end + 2 + int(size, 16)
        out.append(body[end + 2 : at])
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2
    return None


def http_payload(rec: Record) -> tuple[int | None, bytes | None]:
    """The payload's length, and the payload itself if the record holds it, checked against its lengths and digests. Where the block is
    no HTTP message, it is the payload."""
    h = rec.headers
    block = _digest(h.get("warc-block-digest", ""))
    if block and hashlib.new(block[0], rec.block).digest() != block[1]:
        raise WarcError("the block doesn't match its digest")
    revisit = h["warc-type"].lower() == "revisit"
    body, size, chunked = rec.block, None, False
    if rec.block.startswith(b"HTTP/") or h["warc-type"].lower() in ("response", "request") and "application/http" in h.get("content-type", "").lower():
        head, gap, body = rec.block.partition(b"\r\n\r\n")
        if not gap and not revisit:
            raise WarcError("the block has no HTTP headers")
        fields = [x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x]
        sizes = {v.strip() for k, v in fields if k.strip().lower() == b"content-length"}
        chunked = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, v in fields)
        if len(sizes) > 1 or any(not x.isdigit() for x in sizes):
            raise WarcError("the HTTP headers give no length")
        size = int(sizes.pop()) if sizes else None
    if revisit:
        if body:
            raise WarcError("a revisit holds a payload")
        return size, None
    if size is not None and not chunked and len(body) != size and "warc-truncated" not in h and h["warc-type"].lower() == "response":
        raise WarcError(f"the payload has {len(body)} bytes, not {size}")
    given = _digest(h.get("warc-payload-digest", ""))
    if given and "warc-truncated" not in h:
        # Some makers digest a chunked body as it came, others what it carries.
        forms = [body, _unchunked(body)] if chunked else [body]
        if not any(x is not None and hashlib.new(given[0], x).digest() == given[1] for x in forms):
            raise WarcError("the payload doesn't match its digest")
    return len(body), body


_READ = {
    "path": ("string", pa.string()), "offset": ("long", pa.int64()), "record_type": ("string", pa.string()), "record_id": ("string", pa.string()), "page_id": ("long", pa.int64()),
    "target_uri": ("string", pa.string()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "refers_to_id": ("string", pa.string()), "refers_to": ("long", pa.int64()),
    "payload": ("binary", pa.binary()), "problem": ("string", pa.string()),
}


def _read_record(path: str, at: int, raw: bytes, payloads: bool) -> tuple:
    rec = parse(raw)
    length, body = http_payload(rec)
    if body is not None:
        digest = hashlib.sha1(body).hexdigest()
    else:
        given = _digest(rec.headers.get("warc-payload-digest", ""))
        digest = given[1].hex() if given and given[0] == "sha1" else None
    own, to = rec.headers["warc-record-id"], rec.headers.get("warc-refers-to")
    return path, at, rec.headers["warc-type"], own, _page(own), rec.headers.get("warc-target-uri", ""), length, digest, to, _page(to), body if payloads else None, None


def read(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row for each record of archives (path, content): path, offset, record_type, record_id, page_id, target_uri, payload_bytes,
    payload_digest (hex SHA-1), refers_to_id, refers_to (a page id), payload, problem.

    strict: a damaged record is an error; otherwise its row has only path, offset and problem, and reading goes on as far as frames
    can be told apart."""

    def batch(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), _READ.values(), strict=True)], names=list(_READ))

    def records(path: str, content: bytes):
        at = 0
        try:
            for at, raw in frames(content):  # noqa: B020
                try:
                    yield len(raw), _read_record(path, at, raw, payloads)
                except WarcError as e:
                    if strict:
                        raise
                    yield 0, (path, at, *[None] * 9, str(e))
        except WarcError as e:
            if strict:
                raise WarcError(f"{path}, at {at}: {e}") from e
            yield 0, (path, at, *[None] * 9, str(e))

    def run(batches):
        for whole in batches:
            for path, content in zip(*whole.columns, strict=True):
                held, size = [], 0
                for n, row in records(path.as_py(), content.as_buffer().to_pybytes() if content.is_valid else b""):
                    held.append(row)
                    size += n
                    if size > 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return mapped(archives.select("path", "content"), run, ", ".join(f"{name} {kind}" for name, (kind, _) in _READ.items()))


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of its own, named by its path, into a folder (a URI of a file system that pyarrow knows and all
    machines share); path and bytes of the files. A file is written aside and then moved, so a repeated task does no harm."""

    def run(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        for whole in batches:
            sizes = []
            for path, content in zip(*whole.columns, strict=True):
                data = content.as_buffer()
                aside = f"{top}/.{path.as_py()}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, f"{top}/{path.as_py()}")
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return scratch.table(mapped(archives.where(F.col("content").isNotNull()).select("path", "content"), run, "path string, bytes long"), "archives")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = scratch.table(write(plan(pages), train_dictionary(pages)), "warc")
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(url, '') AS target_uri FROM pages),
g AS (SELECT payload_digest AS d, max(page_id) AS f FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f IS NOT NULL AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to, target_uri
FROM p LEFT JOIN g ON payload_digest = d AND payload_bytes >= 1000
"""
