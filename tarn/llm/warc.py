"""WARC archives, index first.

Every task writes one archive of gzip members (one per record) into the shared folder,
under a name of its own, and returns an index row per record: file, offset, length, URL,
digest, type.  Reading starts from the index: the selected rows of a file are sorted by
offset, neighbouring ranges are coalesced into reads of ``READ_BYTES`` at most, and only
those bytes are fetched.  A retried task writes another file; only files named in the
index are ever read.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the
largest id is a response and the others are revisits without a payload that refer to it
(rows that repeat the largest id are responses too).  Null payloads are empty, null URLs
leave the header out, a null id leaves its header out and reads back as null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, scratch_path

READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
SPLIT_BYTES = 16 << 20  # of an archive that one task reads
SALTS = 16
_HEAD = "WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"


def _open(folder: str):
    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def _record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    head = _HEAD.format(kind=kind, uid=uuid.uuid5(uuid.NAMESPACE_OID, f"{page}|{digest}|{kind}"))
    if url is not None:
        head += "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    if page is not None:
        head += f"X-Page-Id: {page}\r\n"
    head += f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-Id: {refers}\r\n"
        body = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write the archives into ``folder`` and return the stored index."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    groups = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # payloads that repeat very often are dealt over SALTS keys; payloads too small to refer to another have keys of their own
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    own = F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url")))
    groups = groups.select(F.col("digest").alias("key"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumns({"key": F.when(large, F.col("digest")).otherwise(own), "salt": salt}).join(groups, ["key", "salt"], "left")
    again = large & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(again, F.col("last")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name, out, at, held = f"{uuid.uuid4().hex}.warc.gz", None, 0, []
        for batch in batches:
            got = []
            for page, link, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kind = "response" if refers is None else "revisit"
                raw = _record(page, link, payload, digest, kind, refers)
                out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                got.append((name, at, len(raw), page, link, digest, kind))
                at += len(raw)
            if got:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                held.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], [x.split()[0] for x in INDEX.split(", ")]))
        if out:
            out.close()  # before any index row leaves the task
        yield from held

    return materialize(map_arrow(rows, write, INDEX), "warc-index")


def _parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def read_records(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, digest, payload_bytes, payload`` of the records that ``index``
    (or any selection of its rows) names.  ``digest`` is recomputed from the bytes of responses
    and the header's for revisits, whose payload is null."""
    names = ["file", "offset", "length"]
    total = index.agg(F.sum("length")).first()[0] or 0
    split = F.floor(F.col("offset") / SPLIT_BYTES)
    ordered = index.select(*names).repartition(-(-total // SPLIT_BYTES) + 1, "file", split).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            names, starts, sizes = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(names):
                j, stop = i + 1, starts[i] + sizes[i]
                while j < len(names) and names[j] == names[i] and starts[j] - stop <= GAP_BYTES and starts[j] + sizes[j] - starts[i] <= READ_BYTES:
                    stop, j = starts[j] + sizes[j], j + 1
                with system.open_input_file(f"{base}/{names[i]}") as file:
                    block = file.read_at(stop - starts[i], starts[i])
                rows = []
                for k in range(i, j):
                    fields, payload = _parse(block[starts[k] - starts[i] : starts[k] - starts[i] + sizes[k]])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if not revisit and digest != (digest := hashlib.sha1(payload).hexdigest()):
                        raise OSError(f"{names[k]} at {starts[k]}: the payload does not match its digest")
                    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], refers and int(refers), digest, None if revisit else len(payload), payload if payloads and not revisit else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                columns = ["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], columns)
                i = j

    return map_arrow(ordered, read, "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Archive ``pages`` in the shared folder, read everything back, and resolve revisits by the
    response they refer to: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, **options)
    back = materialize(read_records(index, folder, payloads=False).drop("payload", "url"), "warc-read")
    named = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    responses, revisits = back.filter("record_type = 'response'"), back.filter("record_type = 'revisit'")
    full = responses.groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    return responses.select(*named).unionAll(revisits.drop("payload_bytes").join(full, "digest", "left").select(*named))
