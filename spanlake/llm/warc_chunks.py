"""WARC archives by a chunked record table (operator 7).

Payloads are handled as rows (record id, chunk number, bytes) of at most ``CHUNK`` bytes, in
order, with an incremental digest next to them: whoever writes or reads a record holds one
chunk of it, never the whole record.

1. ``chunk_table`` writes each payload as chunk rows with the running length, streaming it
   through SHA-1; the last chunk of a record carries the digest of the whole.
2. Among equal payloads (digest and length) the smallest page_id is the response and the
   others revisit it: one aggregation with partial sums and a join, so a payload that a third
   of all pages share is no hot task.
3. ``write_archives`` deals header rows and chunk rows out by record, sorted by chunk number,
   and lets every task write one archive of gzip members (one per record, the usual layout of
   ``.warc.gz``) to the shared folder, one chunk at a time; it returns a table of record places
   (file, offset, length) that Spark commits. A task that is run again writes a new file, and
   only committed places are read, so lost executors leave no double or half record.
4. ``read_archives`` deals the places out, streams every record back as chunk rows with the
   running length and digest, and checks them against the record's headers.

Defined cases: a null html is an empty payload; payloads under ``least`` bytes are all responses;
null page ids stay null, are responses and are not revisited; rows that repeat a page_id are
separate records, of equal payload the first is the response and the others revisit it (by
its page_id); characters that UTF-8 can't hold are replaced by ``?``; a null url is an empty target.
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

from spanlake.llm.common import written
from spanlake.session import shared_dir

CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"


def _bare(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunks_of(col: pa.Array, row: int) -> Iterator[bytes]:
    """The UTF-8 bytes of one row, ``CHUNK`` at a time, without a copy of the whole."""
    cell = col[row]
    if cell.is_valid:
        view = memoryview(cell.as_buffer())
        for i in range(0, len(view), CHUNK):
            yield bytes(view[i : i + CHUNK])


def chunk_table(pages: DataFrame) -> DataFrame:
    """Chunk rows of (page_id, url, html): row, chunk_no, data, n_bytes (up to here), last, and on the
    last chunk of a record page_id, url and digest. An empty payload is one chunk of no bytes."""
    schema = "row long, chunk_no int, data binary, n_bytes long, last boolean, page_id long, url string, digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, rows, held = b.column(3).cast(pa.large_string()), [], 0
            for i, (row, page, url) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                h, n, number, last = hashlib.sha1(), 0, 0, b""
                for number, c in enumerate(chunks_of(col, i)):
                    if number:
                        rows.append((row, number - 1, last, n, False, None, None, None))
                    h.update(c)
                    n, last, held = n + len(c), c, held + len(c)
                    if held > 64 * CHUNK and rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                rows.append((row, number, last, n, True, page, url, _bare(h.digest())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
    ).mapInArrow(run, schema)


def plan_records(payloads: DataFrame, least: int = 0) -> DataFrame:
    """(row, page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    same = ["payload_digest", "payload_bytes"]
    first = payloads.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).groupBy(*same).agg(
        F.min(F.struct("page_id", "row")).alias("first"))
    first = first.select(*[F.col(c).alias(f"f_{c}") for c in same], "first")
    both = payloads.join(first, (F.col("payload_digest") == F.col("f_payload_digest")) & (F.col("payload_bytes") == F.col("f_payload_bytes")), "left")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("row") != F.col("first.row"))
    return both.select(
        "row", "page_id", "url", *reversed(same), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.page_id")).alias("refers_to"))


# --- writing ------------------------------------------------------------------------


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _header(row: int, page_id, url: str, kind: str, digest: str, size: int, refers) -> bytes:
    """Headers of a record. Content-Length is that of the HTTP head and the payload it carries."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{row}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else "%20" for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body) + (size if kind == 'response' else 0)}", f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        lines += [f"X-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def write_archives(chunks: DataFrame, plan: DataFrame, root: str) -> DataFrame:
    """Writes the planned records with their chunks and returns their places: file, offset, length."""
    about = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    heads = plan.select("row", F.lit(-1).alias("chunk_no"), F.lit(None).cast("binary").alias("data"), *about)
    rows = heads.unionByName(chunks.select("row", "chunk_no", "data"), allowMissingColumns=True)
    rows = rows.repartition("row").sortWithinPartitions("row", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, z, start, response = None, f"{uuid.uuid4().hex}.warc.gz", 0, None, 0, False
        places: list[tuple[int, int]] = []

        def end():
            nonlocal at
            at += out.write(z.compress(b"\r\n\r\n") + z.flush())
            places.append((start, at - start))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*places)) or [(), ()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(places), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["file", "offset", "length"])
            places.clear()
            return batch

        try:
            for b in batches:
                if out is None and b.num_rows:
                    store, base = _open(root)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                row, number, page, url, kind, digest, size, refers = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7, 8))
                data = b.column(2)
                for i in range(b.num_rows):
                    if number[i] < 0:
                        if z is not None:
                            end()
                        z, start, response = zlib.compressobj(1, zlib.DEFLATED, 31), at, kind[i] == "response"
                        at += out.write(z.compress(_header(row[i], page[i], url[i], kind[i], digest[i], size[i], refers[i])))
                    elif response:
                        at += out.write(z.compress(data[i].as_py()))
                if places:
                    yield flush()
            if z is not None:
                end()
                yield flush()
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(run, "file string, offset long, length long")


# --- reading ------------------------------------------------------------------------


#: Archive bytes that one task reads.
READ_BYTES = 32 << 20


def stream_record(source, offset: int, length: int) -> Iterator[bytes]:
    """Decompressed pieces (at most ``CHUNK`` bytes) of the gzip member at ``offset``."""
    source.seek(offset)
    z, left = zlib.decompressobj(31), length
    data = b""
    while not z.eof:
        if not data and left:
            data = source.read(min(CHUNK, left))
            left -= len(data)
            if not data:
                raise ValueError("archive is cut short")
        piece = z.decompress(data, CHUNK)
        data = z.unconsumed_tail
        if piece:
            yield piece
        elif not data and not left and not z.eof:
            raise ValueError("record is cut short")


def parse_record(pieces: Iterator[bytes]) -> Iterator[dict | bytes]:
    """First the headers of a record, then its payload chunk by chunk."""
    head = b""
    for p in pieces:
        head += p
        if head.count(b"\r\n\r\n") >= 2:
            break
    warc, http, rest = head.split(b"\r\n\r\n", 2)
    fields = dict(line.split(": ", 1) for line in warc.decode().split("\r\n")[1:])
    yield fields
    left = int(fields["Content-Length"]) - len(http) - 4
    while left > 0:
        yield rest[:left]
        left -= len(rest[:left])
        if left:
            rest = next(pieces)


def read_archives(places: DataFrame, root: str) -> DataFrame:
    """Chunk rows of all records: row, chunk_no, n_bytes (so far), digest (of the whole, on the last
    row only), data, and the header columns page_id, record_type, refers_to, head_digest,
    head_bytes. A record without payload has one row of no bytes."""
    schema = ("row long, chunk_no int, n_bytes long, digest string, data binary, "
              "page_id long, record_type string, refers_to long, head_digest string, head_bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        name, source = None, None
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    name, source = file, store.open_input_file(f"{base}/{file}")
                record = parse_record(stream_record(source, offset, length))
                f = next(record)
                page, refers = f.get("X-Page-ID"), f.get("X-Refers-To-Page")
                about = (page and int(page), f["WARC-Type"], refers and int(refers), f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]))
                number, h, n, last, chunk = int(f["WARC-Record-ID"][12:-1]), hashlib.sha1(), 0, None, 0
                for piece in record:
                    if last is not None:
                        rows.append((number, chunk, n, None, last, *about))
                        chunk += 1
                    h.update(piece)
                    n += len(piece)
                    last = piece
                    held += len(piece)
                    if held > 64 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
                        rows, held = [], 0
                rows.append((number, chunk, n, _bare(h.digest()), last or b"", *about))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return places.select("file", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to archives, reads them back: one row per page row with page_id,
    payload_bytes, payload_digest, record_type, refers_to, n_chunks, verified. The figures of a
    response are those of the payload read back, those of a revisit come from the response that
    it refers to; ``verified`` says that they equal the record's own headers."""
    chunks = written(chunk_table(pages), "warc-chunks")
    payloads = chunks.where("last").select(
        "row", "page_id", "url", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    plan = written(plan_records(payloads, least), "warc-plan")
    root = shared_dir(pages.sparkSession, "warc")
    places = written(write_archives(chunks, plan, root), "warc-places")
    # the places are few bytes, what they stand for is not: as many tasks as the archives need
    size = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-int(size) // READ_BYTES))
    places = places.repartitionByRange(tasks, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    back = read_archives(places, root).drop("data").groupBy("row", "page_id", "record_type", "refers_to", "head_digest", "head_bytes").agg(
        F.max("n_bytes").alias("n"), F.max("digest").alias("d"), F.count(F.lit(1)).alias("n_chunks"))
    back = written(back, "warc-back")
    target = back.where("record_type = 'response' and page_id is not null").groupBy("page_id", "d", "n").agg(F.count(F.lit(1)).alias("_c")).select(
        F.col("page_id").alias("t_id"), F.col("d").alias("t_d"), F.col("n").alias("t_n"))
    both = back.join(target, (F.col("refers_to") == F.col("t_id")) & (F.col("head_digest") == F.col("t_d")) & (F.col("head_bytes") == F.col("t_n")), "left")
    again = F.col("record_type") == "revisit"
    size, digest = F.when(again, F.col("t_n")).otherwise(F.col("n")), F.when(again, F.col("t_d")).otherwise(F.col("d"))
    return both.select(
        "page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "n_chunks",
        (digest.eqNullSafe(F.col("head_digest")) & size.eqNullSafe(F.col("head_bytes"))).alias("verified"))
