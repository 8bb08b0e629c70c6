"""WARC files of pages, and their payloads as a table of chunks with running digests."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import partitions_of, prepare, table
from tillroll.session import new_path

#: Payloads below this many bytes are always stored themselves.
LEAST_BYTES = 100
#: Bytes of one chunk row, of one read from a file, and of one file, about.
CHUNK = 256 << 10
READ = 64 << 10
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least LEAST_BYTES bytes the smallest page_id is the
    response. Minima are folded before the shuffle and joined back, so a payload
    that a third of the pages share is split like any other skewed join. Rows
    that repeat the smallest page_id are responses as well; null ids are larger
    than all others, and responses among themselves.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    joined = rows.join(firsts, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _line(value: str | None) -> str:
    """A header value: one line, no blanks at its ends."""
    return "".join(" " if c in "\r\n" else c for c in value or "").strip()


def _record(row: dict, payload: pa.BinaryScalar) -> tuple[bytes, memoryview]:
    """Headers of one record, and its payload without a copy (empty for a revisit)."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    response = row["record_type"] == "response"
    name = "" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:x-page:{name}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (row['payload_bytes'] if response else 0)}",
    ]
    if _line(row["url"]):
        lines.append(f"WARC-Target-URI: {_line(row['url'])}")
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>"]
    body = memoryview(payload.as_buffer()) if response and row["payload_bytes"] else memoryview(b"")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, body


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write with_roles rows as gzip WARC files, a member per record; the list of files.

    The list is a table in folder/files. A file gets its name when it is
    whole; a task that runs again writes the same records under the same name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        store, top = _store(folder)
        store.create_dir(f"{top}/warc", recursive=True)
        number, out, draft, records = 0, None, "", 0

        def close() -> pa.RecordBatch:
            nonlocal number, out, records
            out.close()
            name = f"{partition:06d}-{number:06d}.warc.gz"
            store.move(draft, f"{top}/warc/{name}")
            done = pa.RecordBatch.from_pylist([{"name": name, "records": records}])
            number, out, records = number + 1, None, 0
            return done

        for batch in batches:
            heads = batch.drop_columns(["payload"]).to_pylist()
            for row, payload in zip(heads, batch["payload"], strict=True):
                if out is None:
                    draft = f"{top}/warc/.{partition:06d}-{number:06d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                head, body = _record(row, payload)
                squeeze = zlib.compressobj(1, wbits=31)
                out.write(squeeze.compress(head))
                for at in range(0, len(body), CHUNK):
                    out.write(squeeze.compress(body[at : at + CHUNK]))
                out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                records += 1
                if out.tell() >= FILE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    pages.mapInArrow(run, "name string, records long").write.parquet(f"{folder}/files")
    return pages.sparkSession.read.parquet(f"{folder}/files")


class _Stream:
    """The unpacked bytes of a gzip WARC file, a bounded buffer at a time."""

    def __init__(self, file) -> None:
        self.file, self.buffer, self.packed = file, bytearray(), b""
        self.unpack = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        if self.unpack.eof:
            self.packed = self.unpack.unused_data or self.packed
            self.unpack = zlib.decompressobj(wbits=31)
        if not self.packed:
            self.packed = self.file.read(READ)
            if not self.packed:
                rest = self.unpack.decompress(b"", CHUNK)
                self.buffer += rest
                return bool(rest)
        self.buffer += self.unpack.decompress(self.packed, CHUNK)
        self.packed = b"" if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return None
        line = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return line

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size and self._more():
            pass
        if len(self.buffer) < size:
            raise EOFError("the file ends within a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def headers(self) -> tuple[dict[str, str], int]:
        """Fields up to the empty line, and the bytes they took."""
        found, size = {}, 0
        while line := self.line():
            size += len(line) + 2
            name, _, value = line.partition(b":")
            found[name.decode().lower()] = value.strip().decode()
        return found, size + 2


def _number(urn: str | None) -> int | None:
    text = (urn or "").rpartition(":")[2].rstrip(">")
    return int(text) if text else None


def records(file) -> Iterator[dict]:
    """The chunks of every record of an open file, in order.

    Each has page_id, record_type, refers_to, declared_digest, declared_bytes,
    chunk, last, data, and digest: the SHA-256 of the payload up to and with
    this chunk. A record without payload has one chunk without data.
    """
    stream = _Stream(file)
    while (line := stream.line()) is not None:
        if not line:
            continue
        head, _ = stream.headers()
        block = int(head["content-length"])
        status = stream.line()
        http, size = stream.headers()
        left = block - size - len(status or b"") - 2
        digest, chunk = hashlib.sha256(), 0
        shared = {
            "page_id": _number(head["warc-record-id"]), "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")),
            "declared_digest": head["warc-payload-digest"].rpartition(":")[2],
            "declared_bytes": int(http.get("content-length", 0)),
        }
        while True:
            data = stream.take(min(left, CHUNK))
            digest.update(data)
            left -= len(data)
            yield shared | {"chunk": chunk, "last": not left, "data": data, "digest": digest.hexdigest()}
            chunk += 1
            if not left:
                break


CHUNKS = (
    "page_id long, record_type string, refers_to long, declared_digest string, "
    "declared_bytes long, chunk long, last boolean, data binary, digest string"
)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of all files: one row per record and chunk, never a whole payload.

    A file is one unit of work; rows leave it in groups of a few megabytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        kinds = pa.schema([
            ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk", pa.int64()),
            ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.string())])
        for batch in batches:
            for name in batch["name"].to_pylist():
                with store.open_input_stream(f"{top}/warc/{name}", compression=None) as file:
                    rows, size = [], 0
                    for row in records(file):
                        rows.append(row)
                        size += len(row["data"]) + 200
                        if size >= 16 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    names = prepare(spark).read.parquet(f"{folder}/files").select("name")
    # Given a number, so that small files aren't put together into one task.
    return names.repartition(partitions_of(spark), "name").mapInArrow(run, CHUNKS)


def summary(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk, checked against what its headers declare.

    A revisit carries no payload, so it has the size and digest of its headers.
    """
    response = F.col("record_type") == "response"
    done = chunks.filter("last").select(
        "page_id",
        F.when(response, F.col("chunk") * CHUNK + F.octet_length("data")).otherwise(
            F.col("declared_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", "refers_to", "declared_digest", "declared_bytes")
    whole = (F.col("payload_bytes") == F.col("declared_bytes")) & (
        F.col("payload_digest") == F.col("declared_digest"))
    return done.withColumn("whole", whole).drop("declared_digest", "declared_bytes")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    out = new_path(prepare(spark), "warc")
    write(with_roles(table(spark, folder, "pages")), out)
    return summary(read_chunks(spark, out))


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES}
    THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_page FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_page <> page_id THEN first_page END AS refers_to, TRUE AS whole
FROM f
"""
