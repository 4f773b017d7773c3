"""BPE encoding and decoding with a contiguous rank array for each short word.

A word is a list of part ids with, beside it, the rank of every adjacent pair. The
smallest rank is looked for again and again; its boundary goes, and the ranks of
the two neighbouring pairs are read anew. Long words take the same merges in the
same order from a heap over linked parts, as scanning them would be quadratic.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodeframe.llm.shared import released, rows_of

_NONE = 1 << 62
#: Words of more parts are merged by way of a heap.
LONG_WORD = 64
#: Rows whose results a worker holds at a time.
ROWS = 256
#: Unicode White_Space, which \s means in the tokenizer files.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What a word-ending BPE tokenizer file says."""

    tokens: dict[int, str]
    pairs: dict[int, tuple[int, int]]
    first: tuple[int, ...]
    last: tuple[int, ...]
    special: dict[str, int]
    split: str


@functools.lru_cache(maxsize=2)
def load(content: bytes) -> Vocabulary:
    """Reads a tokenizer file: BPE over byte symbols, with an end-of-word suffix.

    Raises ValueError for a file of another kind.
    """
    spec = json.loads(content)
    model = spec["model"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or model.get("unk_token") or spec["decoder"] or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        raise ValueError("not a lower-case byte-level BPE file with word ends")
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = {}
    for rank, (a, b) in enumerate(model["merges"]):
        pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
    symbols = byte_symbols()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(
        {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()},
        pairs,
        tuple(vocab[s] for s in symbols),
        tuple(vocab[s + end] for s in symbols),
        special,
        steps[0]["pattern"]["Regex"].replace(r"\s", _WHITE),
    )


def merge_short(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merges by rank, leftmost first among equals, on a contiguous rank array."""
    none = (_NONE, 0)
    get = pairs.get
    ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best is none:
            break
        at = ranks.index(best)
        ids[at] = new = best[1]
        del ids[at + 1], ranks[at]
        if at < len(ranks):
            ranks[at] = get(new << 32 | ids[at + 1], none)
        if at:
            ranks[at - 1] = get(ids[at - 1] << 32 | new, none)
    return ids


def merge_long(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The same merges from a heap, for words in which scanning would be quadratic."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(*hit, i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := pairs.get(ids[i] << 32 | ids[i + 1]))]
    heap = [(r, i, a, b, new) for r, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (hit := pairs.get(ids[left] << 32 | ids[right])):
                heapq.heappush(heap, (hit[0], left, ids[left], ids[right], hit[1]))
    return [x for x, there in zip(ids, alive, strict=True) if there]


class Encoder:
    """Encodes and decodes texts; remembers ``most`` words at the most."""

    def __init__(self, vocabulary: Vocabulary, most: int = 100_000):
        self.v = vocabulary
        self.split = regex.compile(vocabulary.split).findall
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.ids_of = _Words(self._packed, most)

    def _packed(self, word: str) -> bytes:
        return np.array(self.word(word), "<u4").tobytes()

    def word(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self.v.first[b] for b in data[:-1]] + [self.v.last[data[-1]]]
        return (merge_short if len(ids) <= LONG_WORD else merge_long)(ids, self.v.pairs)

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower-casing goes by single characters, so a final sigma stays a plain one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split(text.lower())

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text; a null text has none. Special tokens in the text are themselves."""
        if not text:
            return np.empty(0, "<u4")
        if self.marks is None or "<|" not in text:
            return np.frombuffer(b"".join(map(self.ids_of.__getitem__, self.pieces(text))), "<u4")
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += [np.array([self.v.special[part]], "<u4").tobytes()] if i % 2 else map(self.ids_of.__getitem__, self.pieces(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces as they stand."""
        return " ".join(map(self.v.tokens.__getitem__, ids))


class _Words(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text: (id, n_tokens, ids array<int>). Whole texts; null: no tokens.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content, some
    megabytes whatever the data, goes to the workers with the function.
    """
    return _mapped(df, vocabulary, id_col, text_col, "n_tokens long, ids array<int>", lambda e, text: [len(ids := e.encode(text)), ids.view("<i4")])


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes each list of token ids: (id, decoded). A null list becomes an empty text."""
    return _mapped(df, vocabulary, id_col, ids_col, "decoded string", lambda e, ids: [e.decode(ids or ())])


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, then decodes the ids: (id, n_tokens, ids_sha256, decoded_sha256).

    Digests are lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8. Null and empty texts have no tokens.
    Rows with equal ids each give a row; a null id stays null.
    """

    def one(e: Encoder, text: str | None) -> list:
        ids = e.encode(text)
        return [len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(e.decode(ids.tolist()).encode()).hexdigest()]

    return _mapped(df, vocabulary, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", one)


def encode_checked(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text, and says what the ids decode to: (id, n_tokens, ids array<int>, decoded_sha256)."""

    def one(e: Encoder, text: str | None) -> list:
        ids = e.encode(text)
        return [len(ids), ids.view("<i4"), hashlib.sha256(e.decode(ids.tolist()).encode()).hexdigest()]

    return _mapped(df, vocabulary, id_col, text_col, "n_tokens long, ids array<int>, decoded_sha256 string", one)


def _results(batches: Iterator[pa.RecordBatch], encoder: Encoder, id_col: str, in_col: str, names: list[str], types: list[pa.DataType], one) -> Iterator[pa.RecordBatch]:
    """The batches' rows with their results, ROWS at a time."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, len(batch), ROWS)):
            made = [one(encoder, x) for (x,) in rows_of(part, in_col)]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *columns], [id_col, *names])


def _mapped(df: DataFrame, vocabulary: str, id_col: str, in_col: str, outputs: str, one) -> DataFrame:
    with open(vocabulary, "rb") as f:
        content = f.read()
    load(content)
    given = df.sparkSession.sparkContext.broadcast(content)
    rows = df.select(df[id_col], df[in_col])
    names = [x.split()[0] for x in outputs.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[x.split()[1]] for x in outputs.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _results(batches, Encoder(load(given.value)), id_col, in_col, names, types, one)

    return rows.mapInArrow(released(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {outputs}")
