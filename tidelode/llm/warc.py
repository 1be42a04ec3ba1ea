"""WARC archives, index first: every record's file, offset, length, URL and digest are written as it is.

Writing: equal payloads of ``least`` bytes or more get one response record, that of the largest
page_id, and a revisit record for each other; smaller payloads are all responses. Each task writes
its rows as gzip records into files of its own, under names that no other attempt uses, and returns
their index entries; the index is a stored table, so what it names was written by the attempt that
counts. Files begin with a name that this call alone uses; those of them that the index doesn't name, of other
attempts, are deleted, and nothing else in the folder is: it may hold other archives and files.

Reading: entries of one file and stretch meet in a task, sorted by offset; ranges with little
between them become one read; each record is unpacked, parsed, and a response's payload held against
its digest.

The folder is a URI that pyarrow's file systems reach from all executors.

Cases: null payload is empty; null url leaves out the target; control characters in it are
percent-encoded. A null page_id is always a response. Rows with equal page_id and payload are each a
response, if it is the largest. No pages give no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_spread, scratch_path, stored
from .url_filter import bloom_blocks, maybe_listed

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20
#: Two ranges no further apart are read at once, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Entries of one file that are this many bytes apart may go to different tasks.
STRETCH_BYTES = 64 << 20
_INDEX = "page_id long, url string, file string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def record_id(page_id: int | None) -> str:
    """A page's record has always the same ID, one without page_id has one of its own."""
    return (uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id}")).urn


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """An uncompressed record; of a revisit (refers_to is given) payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <{record_id(page_id)}>")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What record() was given, read from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: None if s is None else int(s)
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields.get("Page-ID")),
        "url": url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "refers_to": number(fields.get("Refers-To-Page-ID")),
        "payload": payload,
    }


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to, size, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        path, at = f"{root}/{own}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None)
                    body = payload or b""
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    packed = gzip.compress(record(page_id, url, body, digest, size, refers_to), 6, mtime=0)
                    out.write(packed)
                    rows.append((page_id, url, path.rsplit("/", 1)[1], at, len(packed), "response" if refers_to is None else "revisit", digest, size, refers_to))
                    at += len(packed)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return run


def write_archive(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages into WARC files under folder; returns the stored index."""
    body = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    equal = p.select("page_id", "size", "sha1").where(F.col("size") >= least).groupBy("sha1", "size")
    equal = stored(equal.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "payloads")
    if (n := equal.count()) <= BROADCAST_ROWS:
        p = p.join(F.broadcast(equal.drop("n")), ["sha1", "size"], "left")
    else:  # payloads that may be repeated are moved by digest, those of hot ones by page_id; all others stay where they are
        filt, blocks = bloom_blocks(equal.select(F.col("sha1").alias("key")), n)
        p = maybe_listed(p, F.col("sha1"), filt, blocks, "maybe")
        moved = join_spread(p.where("maybe").drop("maybe"), equal, ["sha1", "size"], ["first"], "n", ["page_id", "url"], "left")
        p = moved.unionByName(p.where("not maybe").drop("maybe").withColumn("first", F.lit(None).cast("long")))
    refers_to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = p.select("page_id", "url", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), refers_to.alias("refers_to"), "size", "sha1")
    own = uuid.uuid4().hex[:12]
    index = stored(rows.mapInArrow(_writer(folder, own), _INDEX), "warc-index")
    _delete_unlisted(index, folder, own)
    return index


def _delete_unlisted(index: DataFrame, folder: str, own: str) -> None:
    """Files of this call's attempts that didn't count go; only names of files come to the driver."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = {f.base_name for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.startswith(f"{own}-")}
    for name in found - {r[0] for r in index.select("file").distinct().toLocalIterator()}:
        fs.delete_file(f"{root}/{name}")


def _reader(folder: str, payloads: bool):
    names = [f.split()[0] for f in _READ.split(", ")]
    schema = pa.schema([_SCHEMA.field(n) for n in names] + ([pa.field("payload", pa.binary())] if payloads else []))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """Neighbouring ranges of a file as (file, from, to, ranges)."""
        file, start, end, parts = None, 0, 0, []
        for batch in batches:
            for f, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and (f != file or at > end + GAP_BYTES or at + n - start > READ_BYTES):
                    yield file, start, end, parts
                    parts = []
                if not parts:
                    file, start = f, at
                parts.append((at, n))
                end = at + n
        if parts:
            yield file, start, end, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        source, opened = None, None
        for file, start, end, parts in runs(batches):
            if file != opened:
                if source is not None:
                    source.close()
                source, opened = fs.open_input_file(f"{root}/{file}"), file
            data = source.read_at(end - start, start)
            found = []
            for at, n in parts:
                r = parse(zlib.decompress(data[at - start : at - start + n], 31))
                if r["record_type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or payload_digest(r["payload"]) != r["payload_digest"]):
                    raise ValueError(f"{file}, offset {at}: the payload isn't what its digest says")
                found.append({k: r[k] for k in schema.names})
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if source is not None:
            source.close()

    return run


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index entries, which may be any part of an index; with their payloads (null: revisit)."""
    ranges = index.select("file", "offset", "length").withColumn("stretch", F.expr(f"offset div {STRETCH_BYTES}"))
    ranges = ranges.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return ranges.mapInArrow(_reader(folder, payloads), _READ + ", payload binary" * payloads)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return scratch_path(spark, "warc")
