"""Token ids as Arrow files of equal-length sequences.

Documents in order of their id become one stream of tokens, each document closed by an
end id, and the stream is cut into sequences of equal length. A file in Arrow's IPC file
format holds record batches of three fixed-size lists a sequence: ``ids`` (the smallest
unsigned type that holds the vocabulary), ``mask`` (true for a token, false for the padding of
a file's last sequence) and ``ends`` (true for the last token of a document). Nothing is
compressed, so a mapped file gives any sequence without a copy. Beside it lies a file of
its documents (id, first token within the file, number of tokens).

A task sorts a range of ids and writes files of bounded size, each under a name of its
own and listed in the manifest only when it is closed: what a lost task leaves behind
is never read. Folders are URIs that Arrow opens (a local path, hdfs, s3, gs).
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.shared import scratch, written

#: Tokens a sequence; tokens after which a file is closed with its document; about how many are written at a time.
LENGTH, FILE_TOKENS, BATCH_TOKENS = 2048, 1 << 27, 1 << 20
#: Bytes of text that are encoded at a time, and bytes that a range of ids is to have.
WINDOW, RANGE_BYTES = 1 << 22, 1 << 27
#: Pieces that a worker remembers (twice as many for a while), and their longest.
PIECES, LONGEST = 150_000, 48
_MANIFEST = "part int, no int, name string, docs long, tokens long, sequences long"


def cuts(data: np.ndarray, fine: bool = True) -> np.ndarray:
    """Places where byte-level pieces always end, whatever lies around them: whether each byte begins a piece.

    No piece of the pattern has a space after another character that isn't white space. The
    character before is looked at by its last two bytes: ASCII, or two bytes of which the first is C3 or more.
    With ``fine``, also where an ASCII letter comes before any other ASCII character, as letters end every piece that has them.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    last, this = data[:-1], data[1:]
    solid = (last > 0x20) & (last < 0x7F)
    solid[1:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & (last[1:] >= 0x80)
    out[1:] = solid & (this == 0x20)
    if fine:
        letter = (data | 0x20) - np.uint8(0x61) < 26
        out[1:] |= letter[:-1] & ~letter[1:] & (this < 0x80)
    return out


class Encoder:
    """Encodes UTF-8 with a byte-level tokenizer of the tokenizers library, each distinct piece once.

    Words recur, so a window of text is cut into pieces that the tokenizer would never
    join, and only pieces not yet remembered go through the library.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(m.split() != [m] for m in marks):
            raise ValueError("an added token holds white space")
        self.marks = re.compile(b"|".join(map(re.escape, marks))) if marks else None
        # What was used since the last turn, and what was used in the turn before: at the next one, the rest is forgotten.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encoded(self, distinct: list[bytes]) -> list[bytes]:
        """Token ids of pieces, packed; only those not remembered go through the library."""
        young, old = self.young, self.old
        found = [young.get(p) for p in distinct]
        missing = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in missing:
            found[i] = x = old.get(distinct[i])
            if x is None:
                new.append(i)
        made = self.tokenizer.encode_batch_fast([distinct[i].decode("utf-8", "replace") for i in new], add_special_tokens=False) if new else ()
        ids = [e.ids for e in made]
        flat = memoryview(np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes())
        at = 0
        for i, x in zip(new, ids, strict=True):
            to = at + 4 * len(x)
            found[i] = bytes(flat[at:to])
            at = to
        for i in missing:
            if len(distinct[i]) <= LONGEST:
                young[distinct[i]] = found[i]
        if len(young) >= PIECES:
            self.young, self.old = {}, young
        return found

    def window(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids of the bytes, begins of pieces, tokens of each piece); a text begins at each of ``begins``."""
        fine = self.marks is None or not self.marks.search(data)
        first = cuts(data, fine)
        first[begins] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._encoded(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        which = pieces.indices.to_numpy()
        counts = sizes[which]
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - at[which], counts)
        return flat[inner], starts, counts

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(place of the text, ids, is its last part) over a column of texts, long texts in several parts; null: empty."""
        texts = texts.cast(pa.large_binary())
        buffers, n = texts.buffers(), len(texts)
        offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
        first = 0
        while first < n:
            # As many whole texts as fit the window, or one long text by itself.
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WINDOW, "right")) - 1)
            begin, end = int(offsets[first]), int(offsets[last])
            while end - begin > WINDOW:
                where = _last_cut(data, begin, end)
                if where >= end:
                    break
                yield first, self.window(data[begin:where], np.zeros(1, np.int64))[0], False
                begin = where
            part, edges = data[begin:end], np.maximum(offsets[first : last + 1] - begin, 0)
            inside = edges[:-1][edges[:-1] < len(part)]
            ids, starts, counts = self.window(part, inside)
            upto = np.append(0, np.cumsum(counts))[np.searchsorted(np.append(starts, len(part)), edges)]
            for i in range(first, last):
                yield i, ids[upto[i - first] : upto[i - first + 1]], True
            first = last


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    """The encoder of a worker, which keeps what it has learnt from task to task."""
    return Encoder(content)


def _last_cut(data: np.ndarray, begin: int, end: int) -> int:
    """The last place for a cut within a window from ``begin``, or the first after it, or the end."""
    width = WINDOW
    while True:
        found = np.flatnonzero(cuts(data[begin : min(begin + width, end)], fine=False))
        if len(found):
            return begin + int(found[-1] if width == WINDOW else found[0])
        if begin + width >= end:
            return end
        width *= 2


def _schema(length: int, ids: pa.DataType) -> pa.Schema:
    flags = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", flags), ("ends", flags)])


class _File:
    """One open file of sequences with that of its documents."""

    def __init__(self, folder: str, length: int, ids: pa.DataType, id_type: pa.DataType):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base)
        self.name, self.length, self.kind = uuid.uuid4().hex, length, ids
        self.schema = _schema(length, ids)
        self.index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.files.open_output_stream(f"{base}/{self.name}.{x}.arrow", compression=None) for x in ("sequences", "documents")]
        self.out, self.docs_out = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.index)
        self.held, self.ends, self.waiting, self.rows = [], [], 0, []
        self.docs = self.tokens = self.sequences = self.begun = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.tokens += len(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH_TOKENS:
            self.flush()

    def close_document(self, doc_id: pa.Scalar) -> None:
        self.ends.append(self.tokens - 1)
        self.rows.append((doc_id, self.begun, self.tokens - self.begun))
        self.docs, self.begun = self.docs + 1, self.tokens
        if len(self.rows) >= 1 << 16:
            self.flush_rows()

    def flush_rows(self) -> None:
        if self.rows:
            ids, starts, sizes = zip(*self.rows, strict=True)
            self.docs_out.write_batch(pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], self.index.field(0).type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=self.index))
            self.rows = []

    def flush(self, last: bool = False) -> None:
        """Writes the whole sequences that wait; the last time, pads the rest.

        An end is known only when its document is closed, so one token stays back until then.
        """
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        first = self.tokens - len(ids)
        n = -(-len(ids) // self.length) if last else max(0, len(ids) - 1) // self.length
        take = min(n * self.length, len(ids))
        if n:
            values = np.zeros(n * self.length, ids.dtype)
            values[:take] = ids[:take]
            real = np.arange(n * self.length) < take
            closed = np.zeros(n * self.length, bool)
            ends = np.array(self.ends, np.int64) - first
            closed[ends[ends < take]] = True
            self.ends = (ends[ends >= take] + first).tolist()
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((values, real, closed), self.schema, strict=True)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.sequences += n
        self.held, self.waiting = [ids[take:]], len(ids) - take

    def row(self, part: int, no: int) -> dict:
        self.flush(last=True)
        self.flush_rows()
        for x in (self.out, self.docs_out, *self.sinks):
            x.close()
        return {"part": part, "no": no, "name": self.name, "docs": self.docs, "tokens": self.tokens, "sequences": self.sequences}


def _ranges(df: DataFrame, least: int = 1) -> int:
    """Ranges of about RANGE_BYTES each by Catalyst's estimate, at least as many as shuffles have."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 1_000_000))


def write(df: DataFrame, tokenizer: str, folder: str, end: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files below folder; returns their manifest (part, no, name, docs, tokens, sequences), in order by part and no.

    ``tokenizer`` is the path of a byte-level tokenizer file on the driver without normaliser;
    its content goes to the workers. Documents are in order of their id, null first; rows that repeat an id by the
    hash of their text. A null text is empty, so its document is the end id alone. No rows write no file.
    """
    with open(tokenizer, "rb") as f:
        content = f.read()
    from tokenizers import Tokenizer

    size = Tokenizer.from_buffer(content).get_vocab_size()
    kind = pa.uint16() if max(size, end + 1) <= 1 << 16 else pa.uint32()
    given = df.sparkSession.sparkContext.broadcast(content)
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange(_ranges(rows), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, file, no, part = encoder(given.value), None, 0, TaskContext.get().partitionId()
        closing = np.array([end], "<u4")
        for batch in batches:
            keys = batch.column("doc_id")
            for i, ids, last in made.texts(batch.column("text")):
                file = file or _File(folder, length, kind, keys.type)
                file.add(ids)
                if last:
                    file.add(closing)
                    file.close_document(keys[i])
                    if file.tokens >= FILE_TOKENS:
                        yield pa.RecordBatch.from_pylist([file.row(part, no)], _manifest())
                        file, no = None, no + 1
        if file:
            yield pa.RecordBatch.from_pylist([file.row(part, no)], _manifest())

    return written(rows.mapInArrow(run, _MANIFEST), "token-manifest", lasting=True)


def _manifest() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _MANIFEST.split(", ")])


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the tokens of all files before; a row a file of some 2 ** 27 tokens."""
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Sequences:
    """Random access to the sequences of one file: whatever of it isn't asked for isn't read, and a local file isn't copied."""

    def __init__(self, folder: str, name: str):
        files, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{name}.sequences.arrow"
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.first: list[int] | None = None

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, mask, ends) of each batch, flat; the sequences are its rows of ``length``."""
        for i in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(i)
            yield tuple(batch.column(n).flatten().to_numpy(zero_copy_only=n == "ids") for n in ("ids", "mask", "ends"))

    def __len__(self) -> int:
        if self.first is None:
            sizes = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
            self.first = np.append(0, np.cumsum(sizes)).tolist()
        return self.first[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = int(np.searchsorted(self.first, i, "right")) - 1
        row = i - self.first[at]
        batch = self.reader.get_batch(at).slice(row, 1)
        return tuple(batch.column(n).flatten().to_numpy(zero_copy_only=n == "ids") for n in ("ids", "mask", "ends"))


def _documents(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}.documents.arrow") as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def _tokens_of(folder: str, name: str) -> Iterator[tuple[pa.Scalar, int, int, list[np.ndarray]]]:
    """(id, start within the file, tokens, ids in parts) of each document of a file; raises ValueError where flags and index differ."""
    parts = Sequences(folder, name).batches()
    ids = ends = np.empty(0, np.uint32)
    for docs in _documents(folder, name):
        for doc_id, start, n in zip(docs.column("doc_id"), docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
            left, found, closed = n, [], 0
            while left:
                if not len(ids):
                    if (part := next(parts, None)) is None:
                        raise ValueError(f"file {name} ends within a document")
                    real = int(part[1].sum())
                    ids, ends = part[0][:real].astype("<u4"), part[2][:real]
                take = min(left, len(ids))
                found.append(ids[:take])
                closed += int(ends[:take].sum())
                left -= take
                at_end = bool(ends[take - 1])
                ids, ends = ids[take:], ends[take:]
            if closed != 1 or not at_end:
                raise ValueError(f"file {name}: the marks of the ends aren't those of its documents")
            yield doc_id, start, n, found
    if len(ids) or next(parts, None) is not None:
        raise ValueError(f"file {name} has tokens of no document")


def read(manifest: DataFrame, folder: str, id_type: str, tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files that the manifest lists.

    start counts the tokens of all documents before, end ids included; ids_crc32 is the CRC-32 of the ids, the
    end id included, as little-endian unsigned 32-bit integers. The ids themselves come with ``tokens``.
    """
    listed = placed(manifest).select("name", "base")
    kind = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows, size = [], 0
                for doc_id, start, n, found in _tokens_of(folder, name):
                    crc = 0
                    for x in found:
                        crc = zlib.crc32(x, crc)
                    rows.append((doc_id, base + start, n, crc, *([np.concatenate(found).astype(np.int64)] if tokens else [])))
                    size += n if tokens else 1
                    if size >= 1 << 18:
                        yield _rows(rows, tokens)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, tokens)

    files = max(1, manifest.count())
    return listed.repartitionByRange(files, "name").mapInArrow(run, kind)


def _rows(rows: list[tuple], tokens: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    ids = pa.array([i.as_py() for i in columns[0]], columns[0][0].type)
    numbers = [pa.array(c, pa.int64()) for c in columns[1:4]]
    return pa.RecordBatch.from_arrays([ids, *numbers, *([pa.array(columns[4], pa.list_(pa.int64()))] if tokens else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if tokens else [])])


def round_trip(spark: SparkSession, df: DataFrame, tokenizer: str, folder: str | None = None, end: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of all rows and reads them back: (doc_id, start, n_tokens, ids_crc32), see ``write`` and ``read``."""
    folder = folder or scratch(spark, "tokens")
    manifest = write(df, tokenizer, folder, end, length, id_col, text_col)
    return read(manifest, folder, df.schema[id_col].dataType.simpleString())
