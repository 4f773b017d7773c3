"""WARC archives as a table of chunks.

Payloads become rows of (record, chunk number, chunk) as they leave the scan, cut where
they lie, and travel so to the archive and back; neither writer nor reader makes a whole
record again. A running SHA-256 goes along with the chunks, and that of the last one
is the payload's.

Archives are files of gzip members, one a record, written and read as streams through
Arrow's file systems; their folder's URI must be one that Arrow opens (a local path,
hdfs, s3, gs). A task writes under a name of its own and lists it only when it is
closed, so a task that is lost and run again leaves a file that no one reads.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.shared import passing, scratch, written

CHUNK = 1 << 16
#: An archive is closed once it has so many bytes.
ARCHIVE = 1 << 28
#: Bytes of chunks that go from the cutting task to the table at a time.
PASSED = 1 << 23
#: Up to so many revisits (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = "page_id long, record_type string, refers_to long, target_uri string, chunk_no long, chunk_bytes long, running_digest string, last boolean, payload_bytes long, payload_digest string"


_ROWS = "rid long, page_id long, url string, bytes long, digest string, whole boolean, chunk_no long, running_digest string, chunk binary"


def cut(payloads: pa.Array, chunk: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each chunk of a column of payloads its payload's place and its number there, and the chunks.

    The chunks are the column's own bytes under more offsets, so nothing is copied. An empty payload is one empty chunk.
    """
    _, offsets, data = payloads.buffers()
    kind = np.dtype(np.int64 if pa.types.is_large_binary(payloads.type) else np.int32)
    at = np.frombuffer(offsets, kind, len(payloads) + 1, payloads.offset * kind.itemsize)
    times = np.maximum(1, -(-np.diff(at) // chunk)).astype(np.int64)
    place = np.repeat(np.arange(len(payloads)), times)
    number = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    begins = np.append(at[place] + number * chunk, at[-1]).astype(kind)
    return place, number, pa.Array.from_buffers(payloads.type, len(place), [None, pa.py_buffer(begins), data])


def chunk_table(df: DataFrame, id_col: str, url_col: str, payload_col: str, chunk: int = CHUNK) -> DataFrame:
    """(rid, page_id, url, bytes, digest, whole, chunk_no, running_digest, chunk): payloads as rows of chunks.

    rid numbers the records, running_digest is that of the payload up to the chunk's
    end, bytes and digest are those of the whole payload, and whole says that it is one chunk.
    """
    pages = df.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, number, chunks = cut(batch.column("payload"), chunk)
            running, digests, sizes = [], [], []
            for no, piece in zip(number.tolist(), chunks, strict=True):
                if no == 0:
                    digest, size = hashlib.sha256(), 0
                    digests.append(digest)
                    sizes.append(size)
                view = piece.as_buffer()
                digest.update(view)
                sizes[-1] += view.size
                running.append(digest.copy().hexdigest())
            each = pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("rid", "page_id", "url")), pa.array(sizes, pa.int64()), pa.array([d.hexdigest() for d in digests]), pa.array(np.bincount(place) == 1)], ["rid", "page_id", "url", "bytes", "digest", "whole"])
            made = pa.RecordBatch.from_arrays([*each.take(pa.array(place)).columns, pa.array(number), pa.array(running), chunks], [*each.schema.names, "chunk_no", "running_digest", "chunk"])
            few = max(1, PASSED // chunk)
            for i in range(0, made.num_rows, few):
                yield made.slice(i, few)

    return pages.mapInArrow(run, _ROWS)


def chunk_rows(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, chunk: int = CHUNK) -> DataFrame:
    """(rid, page_id, url, bytes, digest, refers_to, revisit, chunk_no, chunk), a record's chunks in order.

    Of equal payloads of ``least`` bytes or more, the record with the smallest page_id
    (null after all others; then the earlier row) is kept, and the others revisit it.
    Revisits have a single empty chunk. The chunk table is written once, so that a record has
    one rid whatever is run again; only records of several chunks are sorted.
    """
    table = written(chunk_table(df, id_col, url_col, payload_col, chunk), "warc-chunks")
    keys = table.where((F.col("chunk_no") == 0) & (F.col("bytes") >= least)).select("rid", "page_id", "digest")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("first")
    # Counting and taking the least are combined before the shuffle, whatever the number of equal payloads.
    groups = keys.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(keys.join(groups, "digest").where(F.col("rid") != F.col("first.rid")).select("rid", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit")), "warc-revisits")
    few = again.count() <= BROADCAST_ROWS

    def marked(rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(again) if few else again, "rid", "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
        content = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("chunk")).alias("chunk")
        return out.where("chunk_no = 0 OR NOT revisit").select("rid", "page_id", "url", "bytes", "digest", "refers_to", "revisit", "chunk_no", content)

    parts = marked(table.where("NOT whole")).repartition("rid").sortWithinPartitions("rid", "chunk_no")
    return marked(table.where("whole")).unionByName(parts)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


def head(page_id: int | None, url: str | None, size: int, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """The record's header and that of its HTTP response, up to the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"] if revisit else []),
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archive:
    """One open archive below the folder."""

    def __init__(self, folder: str):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.bytes, self.records, self.gzip = self.files.open_output_stream(self.path, compression=None), 0, 0, None

    def put(self, data: bytes) -> None:
        if data:
            self.bytes += len(data)
            self.out.write(data)

    def begin(self) -> None:
        self.gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.records += 1

    def add(self, data: bytes) -> None:
        self.put(self.gzip.compress(data))

    def end(self) -> None:
        self.put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.gzip = None

    def row(self) -> dict:
        self.out.close()
        return {"name": self.path.rsplit("/", 1)[1], "records": self.records, "bytes": self.bytes}


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows as archives below folder; returns (name, records, bytes), one row an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = current = None
        for batch in batches:
            names = ("rid", "page_id", "url", "bytes", "digest", "refers_to", "revisit", "chunk")
            for rid, page_id, url, size, digest, refers_to, revisit, chunk in zip(*(batch.column(n) for n in names), strict=True):
                if (rid := rid.as_py()) != current:
                    if current is not None:
                        archive.end()
                        if archive.bytes >= ARCHIVE:
                            yield pa.RecordBatch.from_pylist([archive.row()])
                            archive = None
                    archive, current = archive or _Archive(folder), rid
                    archive.begin()
                    archive.add(head(page_id.as_py(), url.as_py(), size.as_py(), digest.as_py(), revisit.as_py(), refers_to.as_py()))
                archive.add(chunk.as_buffer())
        if archive:
            archive.end()
            yield pa.RecordBatch.from_pylist([archive.row()])

    return written(chunks.mapInArrow(run, "name string, records long, bytes long"), "warc-manifest", lasting=True)


def _inflated(stream, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of all members of a gzip stream, some at a time."""
    gzip = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = gzip.decompress(data, size)
            if out:
                yield out
            if gzip.eof:
                data, gzip = gzip.unused_data, zlib.decompressobj(31)
            else:
                data = gzip.unconsumed_tail
    while out := gzip.decompress(b"", size):
        yield out


class _Bytes:
    """Reads lines and counted pieces off a stream of byte strings."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        if (piece := next(self.pieces, None)) is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without the mark; None at the end of the stream."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int, most: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of exactly ``most`` but for the last."""
        while n:
            want = min(n, most)
            while len(self.held) < want:
                if not self.more():
                    raise ValueError("the archive ends within a record")
            yield bytes(self.held[:want])
            del self.held[:want]
            n -= want


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive, one or more a record, each with the digest up to it.

    Raises ValueError where a payload isn't what its record's digest says.
    """
    data = _Bytes(_inflated(stream))
    while (block := data.until(b"\r\n\r\n")) is not None:
        warc = _fields(block.lstrip(b"\r\n"))
        http = data.until(b"\r\n\r\n")
        size, revisit = int(_fields(http)["content-length"]), warc["warc-type"] == "revisit"
        said, digest = warc["warc-payload-digest"].removeprefix("sha256:"), hashlib.sha256()
        row = {"page_id": _page(warc["warc-record-id"]), "record_type": warc["warc-type"], "refers_to": _page(warc["warc-refers-to"]) if revisit else None, "target_uri": warc.get("warc-target-uri")}
        left, k = int(warc["content-length"]) - len(http) - 4, 0
        for piece in data.take(left, chunk):
            digest.update(piece)
            left -= len(piece)
            if left:
                yield row | {"chunk_no": k, "chunk_bytes": len(piece), "running_digest": digest.copy().hexdigest(), "last": False, "payload_bytes": None, "payload_digest": None, "chunk": piece}
                k += 1
        if not revisit and digest.hexdigest() != said:
            raise ValueError(f"record {warc['warc-record-id']}: the payload isn't what its digest says")
        last = piece if size and not revisit else b""
        yield row | {"chunk_no": k, "chunk_bytes": len(last), "running_digest": digest.hexdigest(), "last": True, "payload_bytes": size, "payload_digest": said, "chunk": last}
        for _ in data.take(4, 4):
            pass


def read_archives(manifest: DataFrame, folder: str, content: bool = True) -> DataFrame:
    """The chunk table of the archives that the manifest lists.

    (page_id, record_type, refers_to, target_uri, chunk_no, chunk_bytes,
    running_digest, last, payload_bytes, payload_digest, chunk); the payload's size
    and digest, of revisits as well as responses, are on a record's last chunk. With
    content=False the chunks' bytes stay out.
    """
    n = max(1, manifest.count())
    kind = _CHUNKS + ", chunk binary" * content
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]]) for x in kind.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                files, base = fs.FileSystem.from_uri(folder)
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    held, size = [], 0
                    for row in records(stream):
                        if not content:
                            del row["chunk"]
                        held.append(row)
                        size += row["chunk_bytes"] if content else 0
                        if len(held) >= 2000 or size >= 1 << 23:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    spread = manifest.select("name").repartitionByRange(n, "name")
    return spread.mapInArrow(run, kind)


def archive(spark: SparkSession, df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Writes a record for each row, reads the archives back, and returns a row a record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). A null payload is
    empty; a null url has no target URI; rows that repeat a page_id are records of their
    own, and a null page_id stays null. No rows give no archive and no record.
    """
    folder = folder or scratch(spark, "warc")
    with passing(spark):
        manifest = write_archives(chunk_rows(df, id_col, url_col, payload_col, least), folder)
    return read_archives(manifest, folder, content=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
