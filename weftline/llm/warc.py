"""WARC archives in Zstandard: written with a dictionary in the leading skippable frame, one frame a record.

The reader loads the dictionary, decodes frame by frame, and validates each record's version line, headers,
lengths and, of responses, the payload's digest. A payload that occurs more than once is stored once, in the
response of the largest page_id; the other records are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_hot, shared_path, sift, stored

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 16 << 10
#: Records of a file that its dictionary is trained on.
DICTIONARY_SAMPLES = 300
ARCHIVE_BYTES = 64 << 20
#: Repeated payloads that are broadcast to the writers (some 60 bytes each); beyond, they are joined by shuffle.
MOST_BROADCAST = 400_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Invalid(ValueError):
    """An archive that isn't as the format says."""


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    record_type: str
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    d = digest(payload)
    target = urllib.parse.quote(url or "", safe="/:?#[]@!$&'()*+,;=%-._~") or "urn:x-none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_id(page_id, d)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{d}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to, d)}", f"X-Refers-To-Page-Id: {refers_to}"]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(headers).encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> Record:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Invalid("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Invalid(f"not a header: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise Invalid(f"missing headers: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Invalid(f"a block of {length} bytes and its end don't fit the record's {len(rest)}")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise Invalid("no HTTP head in the block")
    stated = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), -1)
    kind, d = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != stated:
            raise Invalid(f"payload of {len(payload)} bytes where {stated} are stated")
        if d != digest(payload):
            raise Invalid("payload and digest differ")
    elif kind != "revisit" or payload or stated < 0:
        raise Invalid(f"a {kind} record with {len(payload)} bytes of payload")
    number = lambda s: int(s) if s else None
    return Record(number(fields.get("x-page-id", "")), fields.get("warc-target-uri", ""), kind, payload, stated, d, number(fields.get("x-refers-to-page-id", "")))


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; none (empty) where they are too few or too small to train on."""
    import zstandard

    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: Iterator[bytes], dictionary: bytes, level: int = 3) -> int:
    """The skippable frame with the (compressed) dictionary, then a frame with its size and checksum a record."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    c = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options)
    n = 0
    for r in records:
        out.write(c.compress(r))
        n += 1
    return n


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, in order; Invalid says what is wrong with it and where."""
    import zstandard

    if len(data) < 8:
        raise Invalid("shorter than a skippable frame's head")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise Invalid("no leading dictionary frame")
    dictionary = data[8 : 8 + size]
    if dictionary[:4] == FRAME:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    d = zstandard.ZstdDecompressor(**options)
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if data[at : at + 4] != FRAME:
            raise Invalid(f"no frame at byte {at}")
        one = d.decompressobj()
        raw, fed = [], at
        try:
            while not one.eof:
                if fed >= len(data):
                    raise Invalid(f"the frame at byte {at} is cut off")
                step = view[fed : fed + (64 << 10)]
                raw.append(one.decompress(step))
                fed += len(step)
            yield decode_record(b"".join(raw))
        except (zstandard.ZstdError, UnicodeDecodeError, Invalid) as e:
            raise Invalid(f"record at byte {at}: {e}") from e
        at = fed - len(one.unused_data)


def repeats(pages: DataFrame, least_bytes: int) -> DataFrame:
    """payload digest and largest page_id of payloads of least_bytes at least that occur more than once."""
    narrow = pages.select("page_id", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    groups = narrow.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
    return groups.filter((F.col("copies") > 1) & F.col("first_id").isNotNull()).select(F.col("sha1").alias("copy_sha1"), "first_id", "copies")


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives below root (a folder that all executors reach) and returns their paths and record counts.

    The list is itself a table below root: only files of tasks that succeeded are in it, so that what a lost
    executor left behind isn't read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    copies = stored(repeats(rows, least_bytes), "copies")
    hashed = rows.withColumn("copy_sha1", F.sha1("payload"))
    if copies.count() <= MOST_BROADCAST:
        marked = hashed.join(F.broadcast(copies), "copy_sha1", "left")
    else:  # payloads that occur once stay where they are, but for a few that marks don't tell apart
        maybe, once = sift(hashed, "copy_sha1", copies)
        marked = join_hot(maybe, copies, "copy_sha1", "copies", "left").unionByName(once.withColumn("first_id", F.lit(None).cast("long")), allowMissingColumns=True)
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    marked = marked.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    yield encode_record(page_id, url, payload, refers_to, refers_to is not None, date)

        source = records()
        paths, counts = [], []
        while True:
            held, size = [], 0
            for r in source:
                held.append(r)
                size += len(r)
                if len(held) >= DICTIONARY_SAMPLES or size >= ARCHIVE_BYTES:
                    break
            if not held:
                break

            def upto(held=held, size=size) -> Iterator[bytes]:
                yield from held
                for r in source if size < ARCHIVE_BYTES else ():
                    yield r
                    size += len(r)
                    if size >= ARCHIVE_BYTES:
                        return

            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{base}/{name}") as out:
                counts.append(write_archive(out, upto(), make_dictionary(held)))
            paths.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["name", "n_records"])

    marked.mapInArrow(write, "name string, n_records long").write.parquet(f"{root}/manifest")
    return spark.read.schema("name string, n_records long").parquet(f"{root}/manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """Records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def batch_of(held: list[Record]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([getattr(r, c) for r in held], t) for c, t in zip(names, types)], names=list(names))

        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                held, seen = [], 0
                for r in read_archive(data):
                    held.append(r)
                    seen += 1
                    if len(held) >= 500:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)
                if seen != count:
                    raise Invalid(f"{name}: {seen} records where {count} were written")

    return manifest.repartition(max(1, n)).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back, one row a page.

    A null html is an empty payload. Payloads of least_bytes at least that are equal are stored once: the row
    with the largest page_id is the response, others revisit it; rows that share that page_id are all responses,
    and null ids revisit, unless no copy has an id. Smaller payloads are all responses. An empty table gives no
    rows; extra columns aren't read.
    """
    root = shared_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, root, least_bytes), root)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, sha1(encode(html)) AS hex, max(page_id) OVER (PARTITION BY sha1(encode(html))) AS first_id FROM p
)
SELECT page_id,
  CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substr(hex, 1 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 16
      + (strpos('0123456789abcdef', substr(hex, 2 + CAST(i * 5 // 4 AS INT), 1)) - 1)) >> (3 - (i * 5) % 4)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM d
"""
