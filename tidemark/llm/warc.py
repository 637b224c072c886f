"""WARC records in ZIP packages: writer, and a reader that fetches records by range without extraction.

An archive is a ZIP file with two stored members: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdx`, one line per record with its offset and length in the first. Every task of the writer streams one
archive to the shared folder and returns a line of the manifest. The manifest is written as a table, so that it names
exactly the archives of the tasks that succeeded; a file left by a lost or repeated attempt is never read.

The reader takes the end of each file, finds the central directory (also by its ZIP64 records), the data offset of the
stored members and the index, cuts the index into ranges of about `RANGE_BYTES`, deals the ranges out and reads each by
one range request. An archive of any size is so read by many tasks.

Payloads of at least `REVISIT_BYTES` that are equal are written once: the page with the smallest id is a `response`, the
others are `revisit` records that name it and carry digest and length, but no payload.

Cases: a null payload is empty; payloads below the limit are all responses; a null id is larger than any other, and if
all ids of a group are null, all its records are responses, as are repeated rows with the smallest id; a null URL writes
no target; an empty table writes no archive and gives an empty result. Only id, URL and payload are read. As the input
has no crawl date, records carry the epoch.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.session import scratch_path

REVISIT_BYTES = 100
RANGE_BYTES, MOST_TASKS = 4 << 20, 20_000
SALTS = 32
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

#: Fixed values of the ZIP format: signatures, record layouts and the markers of values moved to ZIP64 fields.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FORM, END64_FORM, LOCATOR64_FORM = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
ENTRY_FORM, LOCAL_FORM = "<4s6H3L5H2L", "<4s5H3L2H"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ------------------------------------------------------------------ records

def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def write_record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; a revisit (`refers_to` set) has the header of the answer but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
              ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ------------------------------------------------------------------ ZIP packages

def open_store(path: str):
    """File system and path of a location that driver and executors share."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def package(out, records: Iterator[tuple[str, bytes]]) -> tuple[int, int]:
    """Stream (index key, record) pairs into a ZIP package; returns the number of records and of data bytes."""
    index, at, count = [], 0, 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as pack:
        with pack.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for key, record in records:
                member = gzip_member(record)
                data.write(member)
                index.append(f"{key} {at} {len(member)}\n")
                at, count = at + len(member), count + 1
        with pack.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as lines:
            lines.write("".join(index).encode())
    return count, at


def central_directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file: name -> (compression method, size, offset of the local header). `file` reads by range."""
    def at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    tail_at = max(0, size - struct.calcsize(END_FORM) - FULL16)
    tail = at(tail_at, size - tail_at)
    end_at = tail.rfind(END)
    if end_at < 0:
        raise ValueError("no ZIP file: it has no end record")
    *_, entries, length, start, _ = struct.unpack_from(END_FORM, tail, end_at)
    if FULL16 == entries or FULL32 in (length, start):
        locator_at = tail_at + end_at - struct.calcsize(LOCATOR64_FORM)
        mark, _, end64_at, _ = struct.unpack(LOCATOR64_FORM, at(locator_at, struct.calcsize(LOCATOR64_FORM)))
        if mark != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        end64 = struct.unpack(END64_FORM, at(end64_at, struct.calcsize(END64_FORM)))
        if end64[0] != END64:
            raise ValueError("the ZIP64 end record is missing")
        entries, length, start = end64[7:10]
    directory, members, pos = at(start, length), {}, 0
    for _ in range(entries):
        entry = struct.unpack_from(ENTRY_FORM, directory, pos)
        if entry[0] != ENTRY:
            raise ValueError("the central directory is damaged")
        method, packed, plain = entry[4], entry[8], entry[9]
        name_n, extra_n, comment_n, offset = entry[10], entry[11], entry[12], entry[16]
        pos += struct.calcsize(ENTRY_FORM)
        name = directory[pos:pos + name_n].decode()
        extra = directory[pos + name_n:pos + name_n + extra_n]
        while len(extra) >= 4:  # the ZIP64 field holds, in order, the values that are marked as moved
            tag, n = struct.unpack_from("<2H", extra)
            if tag == 1:
                moved = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain, packed, offset = (moved.pop(0) if v == FULL32 else v for v in (plain, packed, offset))
            extra = extra[4 + n:]
        members[name] = (method, packed, offset)
        pos += name_n + extra_n + comment_n
    return members


def stored_member(file, members: dict, name: str) -> tuple[int, int]:
    """Offset and size of the bytes of a stored member."""
    method, size, offset = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; only stored members can be read by range")
    file.seek(offset)
    local = struct.unpack(LOCAL_FORM, file.read(struct.calcsize(LOCAL_FORM)))
    if local[0] != LOCAL:
        raise ValueError(f"{name} has no local header")
    return offset + struct.calcsize(LOCAL_FORM) + local[9] + local[10], size


def index_ranges(file, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Runs of consecutive records: offset in the file of the first, and the lengths of all."""
    members = central_directory(file, size)
    base, _ = stored_member(file, members, DATA)
    at, length = stored_member(file, members, INDEX)
    file.seek(at)
    first, lengths, total, after = None, [], 0, None
    for line in file.read(length).decode().splitlines():
        _, start, n = line.rsplit(" ", 2)
        start, n = base + int(start), int(n)
        if lengths and (total + n > most or start != after):
            yield first, lengths
            lengths, total = [], 0
        if not lengths:
            first = start
        lengths.append(n)
        total, after = total + n, start + n
    if lengths:
        yield first, lengths


# ------------------------------------------------------------------ Spark jobs

def with_first_of_payload(pages: DataFrame) -> DataFrame:
    """Add digest, size and `refers_to`. Groups are summed before they meet the rows, under salted keys."""
    sized = pages.withColumns({
        "digest": F.sha2(F.col("payload"), 256), "size": F.octet_length("payload").cast("bigint"),
        "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    groups = sized.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        "digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return sized.join(groups, ["digest", "salt"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "salt")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload: Column | None = None) -> DataFrame:
    """Write a record per page below `folder`; returns the stored manifest (path, records, bytes)."""
    body = F.encode(F.col("html"), "UTF-8") if payload is None else payload
    rows = with_first_of_payload(pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(body, F.lit(b"")).alias("payload")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "size", "digest", "refers_to"))):
                    page, url, data, size, digest, first = (v.as_py() for v in row)
                    yield str(page), write_record(page, url, data, size, digest, first)

        todo = records()
        head = next(todo, None)
        if head is None:
            return
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            count, size = package(out, (r for part in ([head], todo) for r in part))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": count, "bytes": size}])

    return stored(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of the archives of a manifest: page_id, url, record_type, refers_to, size, digest, payload.

    `payload` of a revisit is null; the digest of a response is checked against its payload.
    """
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    ranges = [{"path": path, "start": s, "lengths": n} for s, n in index_ranges(file, file.size())]
                yield pa.RecordBatch.from_pylist(ranges)

    def number(name: str | None):
        name = name and name.removeprefix("<urn:x-page:").removesuffix(">")
        return None if name in (None, "null") else int(name) if id_type in ("bigint", "int") else name

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kind = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
        schema = pa.schema([("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", kind),
                            ("size", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for run in batch.to_pylist():
                store, place = open_store(run["path"])
                with store.open_input_file(place) as file:
                    file.seek(run["start"])
                    data = memoryview(file.read(sum(run["lengths"])))
                rows, at, held = [], 0, 0
                for length in run["lengths"]:
                    fields, payload = read_record(zlib.decompress(data[at:at + length], 31))
                    at += length
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                    rows.append({"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
                                 "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
                                 "size": int(fields["warc-payload-length"]), "digest": digest,
                                 "payload": None if revisit else payload})
                    held += len(payload)
                    if held > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = manifest.select("path").mapInArrow(locate, "path string, start bigint, lengths array<bigint>")
    # the rows of the ranges are tiny, so adaptive execution would put them all into one task: the number is set
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, 1 + total // RANGE_BYTES)
    return ranges.repartition(tasks, F.col("path"), F.col("start")).mapInArrow(
        fetch, f"page_id {id_type}, url string, record_type string, refers_to {id_type}, size bigint, digest string, "
               "payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    records = read_archives(manifest, pages.schema["page_id"].dataType.simpleString())
    whole = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("bigint")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", "refers_to")
