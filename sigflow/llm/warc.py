"""WARC archives as a chunked record table: streamed writing and reading with running digests."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import cut, internal, shared_dir

CHUNK = 1 << 18
SEGMENT = 4 << 20
HEAD = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, start long, end long, records long"
CHUNKS = "record_key string, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean, record_type string, target_uri string, page_id long, refers_to long"


def open_stream(uri: str, mode: str):
    """A byte stream of a file in shared storage: plain paths and file: by the system, others by pyarrow's file systems."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path) if parts.scheme else uri
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """No header value may hold line ends or other control characters."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(out, page_id, url, payload: memoryview, digest: str, refers_to, date: str) -> int:
    """Write one record as a gzip member, the payload a chunk at a time; returns its bytes. A revisit holds no payload: its
    headers name the digest, the length and the original."""
    kind = "response" if refers_to is None else "revisit"
    ident = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}')}>"
    held = payload if kind == "response" else payload[:0]
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(HTTP) + len(held))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    member, n = zlib.compressobj(1, zlib.DEFLATED, 31), 0
    n += out.write(member.compress(text.encode() + HTTP))
    for k in range(0, len(held), CHUNK):
        n += out.write(member.compress(held[k : k + CHUNK]))
    return n + out.write(member.compress(b"\r\n\r\n") + member.flush())


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at, start, n, done = "", None, 0, 0, 0, []
        for batch in batches:
            cols = [batch.column(k) for k in range(5)]
            for i in range(batch.num_rows):
                page_id, url, digest, refers_to = (cols[k][i].as_py() for k in (0, 1, 3, 4))
                payload = memoryview(cols[2][i].as_buffer())  # no copy: a view of the batch
                if out is None:  # a name of its own for each attempt: what a lost attempt wrote is never read
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    out = open_stream(path, "wb")
                at += write_record(out, page_id, url, payload, base32_sha1(bytes.fromhex(digest)), refers_to, date)
                n += 1
                if at - start >= SEGMENT:
                    done.append((path, start, at, n))
                    start, n = at, 0
        if out is not None:
            out.close()
            if n:
                done.append((path, start, at, n))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["path", "start", "end", "records"]).astype({"path": object, "start": "int64", "end": "int64", "records": "int64"}), preserve_index=False)

    return write


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row under folder (default: the session's shared folder); returns the table of segments.

    Of the records with equal payloads (equal SHA-256) of at least `least` bytes that with the smallest page_id is
    a response, the others revisit it; rows that repeat that page_id and payload are responses too, as are all rows
    of a payload that has no page_id. Null html is an empty payload. Null page_id or url leave their headers out.
    An empty table writes no file. Other columns are not archived.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = pages.select(F.col(page_id).alias("page_id"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    first = first.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first_id")
    rows = rows.join(first, "sha", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers_to"))
    return cut(rows.mapInArrow(_writer(folder, date), MANIFEST))


def read_records(stream, size: int, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, payload pieces of at most chunk bytes) of each record in size bytes of gzip members, as they stream by."""
    state = {"left": size, "raw": b"", "z": zlib.decompressobj(31), "buf": bytearray()}

    def fill() -> bool:
        while True:
            if not state["raw"]:
                if not state["left"]:
                    return False
                state["raw"] = stream.read(min(1 << 16, state["left"]))
                if not state["raw"]:
                    raise ValueError("the archive ends inside a record")
                state["left"] -= len(state["raw"])
            got = state["z"].decompress(state["raw"], chunk)
            state["raw"] = state["z"].unconsumed_tail
            if state["z"].eof:
                state["raw"], state["z"] = state["z"].unused_data, zlib.decompressobj(31)
            if got:
                state["buf"] += got
                return True

    def take(n: int) -> bytes:
        while len(state["buf"]) < n:
            if not fill():
                raise ValueError("the archive ends inside a record")
        out = bytes(state["buf"][:n])
        del state["buf"][:n]
        return out

    def head() -> dict[str, str] | None:
        while (end := state["buf"].find(b"\r\n\r\n")) < 0:
            if len(state["buf"]) > HEAD:
                raise ValueError("a record's header does not end")
            if not fill():
                if state["buf"]:
                    raise ValueError("the archive ends inside a header")
                return None
        lines = take(end + 4).decode("utf-8").split("\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}

    while (h := head()) is not None:
        left = int(h["content-length"])
        if "application/http" in h.get("content-type", ""):  # the payload follows the message's own header
            skipped = bytearray()
            while not skipped.endswith(b"\r\n\r\n"):
                skipped += take(1)
                left -= 1

        def pieces(left=left) -> Iterator[bytes]:
            while left > 0:
                n = min(chunk, left)
                yield take(n)
                left -= n

        body = pieces()
        yield h, body
        for _ in body:
            pass
        if take(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")


def _reader(chunk: int):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def table(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for seg in batch.to_pylist():
                with open_stream(seg["path"], "rb") as stream:
                    stream.seek(seg["start"])
                    for k, (h, body) in enumerate(read_records(stream, seg["end"] - seg["start"], chunk)):
                        sha, total, no = hashlib.sha1(), 0, 0
                        page, ref = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        fixed = (h["warc-type"], h.get("warc-target-uri"), int(page) if page else None, int(ref) if ref else None)
                        key = f"{seg['path'].rsplit('/', 1)[1]}:{seg['start']}:{k}"
                        if h["warc-type"] == "revisit":
                            size, digest = h.get("x-payload-length"), h.get("warc-payload-digest", "")
                            rows.append((key, 0, b"", int(size) if size else None, digest.partition(":")[2] or None, True, *fixed))
                            continue
                        piece = next(body, b"")
                        while True:  # one piece is held back to know which is the last
                            after = next(body, None)
                            sha.update(piece)
                            total += len(piece)
                            rows.append((key, no, piece, total, base32_sha1(sha.copy().digest()), after is None, *fixed))
                            held += len(piece)
                            if held >= 4 << 20 or len(rows) >= 2000:
                                yield table(rows)
                                rows, held = [], 0
                            if after is None:
                                break
                            piece, no = after, no + 1
        if rows:
            yield table(rows)

    return read


def read_chunks(segments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives: a row per record_key and chunk_no.

    data holds at most chunk bytes; payload_bytes and payload_digest (bare base32 SHA-1) cover the payload up to and
    with that chunk, so the last row of a record has its full length and digest. A revisit is one row without data
    whose length and digest come from its headers (null where an archive from elsewhere has none). Nulls and empty
    payloads are one chunk of no bytes; a table without segments gives none. A damaged archive raises ValueError. No
    task holds a whole payload.
    """
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(n).mapInArrow(_reader(chunk), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunked table, without data."""
    return chunks.where("last").drop("data", "chunk_no", "last")
