"""WARC archives in Zstandard frames.

An archive begins with a skippable frame that holds the compression dictionary; each record is one frame of its own, so a
reader can begin at any record. Writing groups equal payloads: of those of at least `LEAST` bytes, that of the largest page_id
is a response and the others are revisits that refer to it and carry its HTTP headers without the payload. Reading checks the
version line, the mandatory headers, both lengths and, for responses, the payload's SHA-1; anything else raises ValueError.

Equal payloads are those of equal SHA-256; SHA-1 is only written to the headers. Reading checks besides that every revisit refers to a
response of its digest and length. Record ids are named after page_ids, so rows of one page_id have one record id. Null html is an empty payload. Rows that share the largest page_id of their payload
are all responses. A null page_id is never the largest; it is written and read as null; if a payload has only such rows, they
are responses. Archives are written under names of their own, and only those of tasks that ended are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_dir

LEAST = 0
#: The magic number of the skippable frame that holds a dictionary, and the profile of a revisit by digest.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Pages that the dictionary is trained on, about, and the characters of each and bytes of the dictionary, at most.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 * 1024
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
RECORD_PREFIX = "urn:page:"
FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: each five hexadecimal digits are four letters."""
    hexed = F.sha1(payload)
    letters = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(hexed, start, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*letters)


def train(pages: DataFrame) -> bytes:
    """A dictionary from a sample of about DICTIONARY_PAGES pages, picked by a hash; raw content where there is too little to train on."""
    import zstandard

    some = pages.where("html is not null and html <> ''")
    share = min(1.0, DICTIONARY_PAGES / max(1, some.count()))
    picked = some.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    # Copies of a page that was picked are all picked: only one of them is fetched
    texts = sorted(r.html.encode() for r in picked.select(F.substring("html", 1, DICTIONARY_CHARS).alias("html")).distinct().limit(2 * DICTIONARY_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES] or b"WARC/1.1\r\nContent-Length: "


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to of pages(page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", digest(F.col("payload"))).withColumn("same", F.unhex(F.sha2("payload", 256)))
    # One row for each payload that more than one page has; pages are joined with these alone
    again = rows.where(F.length("payload") >= LEAST).groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
    again = again.where("copies > 1").select(F.col("same").alias("of"), "kept")
    rows = rows.join(again, F.col("same") == F.col("of"), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.select(
        "page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to")
    )


def record(page_id, url, payload: bytes, sha: str, kind: str, refers_to) -> bytes:
    """The bytes of a record."""
    name = lambda i: f"<{RECORD_PREFIX}{'' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"no header line: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """The fields of a record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no record: {raw[:40]!r}")
    h = headers(lines)
    if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in h]:
        raise ValueError(f"a record lacks {missing}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest)} bytes with its end; its header says {h['content-length']}")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    size = headers(lines).get("content-length", "") if gap and status.startswith(b"HTTP/") else ""
    algorithm, _, sha = h.get("warc-payload-digest", "").partition(":")
    if not size.isdigit() or algorithm != "sha1":
        raise ValueError("a record without a payload's length or digest")
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(RECORD_PREFIX)) else None
    kind, refers_to = h["warc-type"], None
    if kind == "response":
        if len(payload) != int(size) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha:
            raise ValueError("a payload that differs from its length or digest")
    elif kind == "revisit":
        if h.get("warc-profile") != PROFILE or "warc-refers-to" not in h or payload:
            raise ValueError("a revisit without profile or reference, or with a payload")
        refers_to, payload = number(h["warc-refers-to"]), None
    else:
        raise ValueError(f"a record of type {kind}")
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(size), "payload_digest": sha,
        "refers_to": refers_to, "payload": payload,
    }


def opened(uri: str, mode: str):
    """A stream on a file of any store that pyarrow knows."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path)
    return where.open_input_stream(path)


def write(rows: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes with_types() rows as archives; path and records of each."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                raw = record(*(x.as_py() for x in row))
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = opened(path, "w")
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out.write(compressor.compress(raw))
                records, size = records + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records))
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, records))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    named = rows.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return checkpoint(named.mapInArrow(run, "path string, records long"))


def records_of(stream, chunk: int = 1 << 20):
    """The records of an archive, one after the other; at most one and a chunk are held."""
    import zstandard

    first = stream.read(8)
    magic, size = struct.unpack("<II", first) if len(first) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive does not begin with its dictionary")
    raw = stream.read(size)
    if len(raw) != size:
        raise ValueError("an archive ends within its dictionary")
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    left = stream.read(chunk)
    while left:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not left:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else stream.read(chunk)
        left = left or stream.read(chunk)
        yield b"".join(parts)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives(path, records), one task for each partition of the list; FIELDS, without payload if not asked for."""

    def run(batches):
        import pyarrow as pa

        columns = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(path, "r") as stream:
                    rows, size, seen = [], 0, 0
                    for raw in records_of(stream):
                        rows.append(parse(raw))
                        size, seen = size + len(raw), seen + 1
                        if size >= 1 << 23 or len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds)], columns)
                            rows, size = [], 0
                    if expected is not None and seen != expected:
                        raise ValueError(f"{path} has {seen} records, not {expected}")
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds)], columns)

    return archives.select("path", "records").mapInArrow(run, FIELDS if payloads else FIELDS.rpartition(",")[0])


def verified(records: DataFrame) -> DataFrame:
    """Records as read, whose revisits must refer to a response of their digest and length."""
    known = records.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes")).distinct()
    out = records.join(known, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")) & (F.col("payload_bytes") == F.col("of_bytes")), "left")
    lost = F.raise_error(F.concat(F.lit("a revisit refers to no response of its payload: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))).cast("long")
    checked = F.when((F.col("record_type") == "revisit") & F.col("of").isNull(), lost).otherwise(F.col("refers_to"))
    return out.select(*[checked.alias(c) if c == "refers_to" else c for c in records.columns])


def round_trip(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return verified(read(write(with_types(pages), folder, train(pages)), payloads))
