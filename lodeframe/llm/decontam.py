"""Benchmark decontamination by winnowed fingerprints.

A document keeps the least k-gram hash of every window of w consecutive k-grams, a test
item all of its k-grams; whatever run of w + k - 1 words both share, the document's
least hash within it is a fingerprint of both. Equal fingerprints are joined, and each
hit is extended word by word to both sides, so that only true runs count. An item
with fewer words than a window is looked for as one gram of its whole length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import released, rows_of, written
from lodeframe.llm.words import WordHashes, alnum_words, gram_hashes

WINDOW = 13
GRAM = 7
#: Test items of so many bytes of text at the most go to the workers as an index; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each run of n, in about log2(n) steps."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every window of w; all of equal ones."""
    if len(grams) <= w:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, int)
    least = _sliding(grams, w, np.minimum)
    edge = np.zeros(w - 1, grams.dtype)
    most = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(most == grams)


class Items:
    """Test items by fingerprint, for finding their windows in documents."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, hashes = window, gram, WordHashes()
        self.words = [(None if i is None else str(i), alnum_words(text)) for i, text in items]
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, words) in enumerate(self.words):
            k = gram if len(words) >= window else len(words)
            if k:
                for at, h in enumerate(gram_hashes(hashes.of(words), k).tolist()):
                    places[self.kind(len(words))][h].append((n, at))
        self.by_kind = {kind: (np.array(sorted(found), np.uint64), found) for kind, found in places.items()}

    def kind(self, n_words: int) -> int:
        """0 for items with whole windows, else the item's number of words."""
        return 0 if n_words >= self.window else n_words

    def grams(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each kind of item: the kind, its gram length, and a document's fingerprints and places."""
        for kind in self.by_kind:
            k = kind or self.gram
            g = gram_hashes(hashes, k)
            at = np.arange(len(g)) if kind else winnow(g, self.window - k + 1)
            yield kind, k, g[at], at

    def runs(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, from, to) of the runs of words that a document shares with items."""
        for kind, k, prints, places in self.grams(hashes):
            known, found = self.by_kind[kind]
            near = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            shared = np.flatnonzero(known[near] == prints)
            covered: dict[tuple[int, int], int] = {}
            for p, h in zip(places[shared].tolist(), prints[shared].tolist(), strict=True):
                for n, q in found[h]:
                    if covered.get((n, p - q), -1) > p:
                        continue
                    left, right = extend(words, self.words[n][1], p, q, k)
                    covered[n, p - q] = max(right, p + 1)
                    if right - left >= (kind or self.window):
                        yield n, left, right

    def hits(self, words: list[bytes], hashes: np.ndarray) -> tuple[int, list[str]]:
        """Number of words inside windows that a document shares with items, and those items' ids."""
        hit, ids = bytearray(len(words)), set()
        for n, left, right in self.runs(words, hashes):
            hit[left:right] = b"\1" * (right - left)
            ids.add(self.words[n][0])
        return sum(hit), sorted(x for x in ids if x is not None)


def extend(a: list[bytes], b: list[bytes], p: int, q: int, k: int) -> tuple[int, int]:
    """The run of words equal in both around a[p:p+k] and b[q:q+k], as places in a; empty if those differ."""
    if a[p : p + k] != b[q : q + k]:
        return p, p
    left, right = p, p + k
    while left and q - (p - left) and a[left - 1] == b[q - (p - left) - 1]:
        left -= 1
    while right < len(a) and q + right - p < len(b) and a[right] == b[q + right - p]:
        right += 1
    return left, right


_OUT = "n_words long, n_hit long, n_items long, items array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """How much of each document lies in windows of test items.

    Returns a row for each row of docs: (id, n_words, n_hit, n_items, items): number of
    words, of words inside any occurrence of an item's window of ``window`` words, and
    the items that have such windows, sorted as strings, each once. Null and empty texts have
    no words and no hits; items without words are in no document; an item whose id
    is null hits but isn't listed; repeated rows, of either table, are each looked at. Without
    items, nothing is hit.

    Items go to the workers as an index if their texts have at most
    ``broadcast_bytes``, else fingerprints, then windows, meet in shuffle joins.
    """
    texts = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    if size > broadcast_bytes:
        return _joined(rows, texts, id_col, text_col, window, gram)
    given = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in texts.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Items(given.value, window, gram), WordHashes()
        for batch in batches:
            made = []
            for (text,) in rows_of(batch, text_col):
                words = alnum_words(text)
                n, ids = index.hits(words, hashes.of(words))
                made.append((len(words), n, len(ids), ids))
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, "n_words", "n_hit", "n_items", "items"])

    return rows.mapInArrow(released(run), f"{kind}, {_OUT}")


def _joined(rows: DataFrame, texts: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """The same for items of any size, by joins alone.

    Fingerprints meet those of the items, each once; around those that do, the windows
    of documents meet the items' windows, word for word. Whatever many items share meets
    once for hits, and with the items' ids only where a whole window is shared.
    """
    docs = written(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "decontam-docs", lasting=True)
    n_words = F.expr("coalesce(size(regexp_extract_all(text, '[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]+', 0)), 0)")
    short = [r[0] for r in texts.select(F.least(n_words, F.lit(window)).alias("n")).distinct().collect() if 0 < r[0] < window]

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rid, text in rows_of(batch, "rid", "text"):
                h = hashes.of(alnum_words(text))
                for n in [0, *short]:
                    g = gram_hashes(h, n or gram)
                    g = np.unique(g if n else g[winnow(g, window - gram + 1)])
                    if len(g):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), rid)), pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64))], ["rid", "kind", "fp"])

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                words = alnum_words(text)
                n = 0 if len(words) >= window else len(words)
                g = np.unique(gram_hashes(hashes.of(words), n or gram)) if words else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64))], ["kind", "fp"])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in rows_of(batch, "item_id", "text"):
                words = alnum_words(text)
                n = min(window, len(words))
                found = sorted({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else []
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(found), pa.string()), pa.array(found, pa.binary())], ["item_id", "words"])

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for rid, text, prints in rows_of(batch, "rid", "text", "prints"):
                words = alnum_words(text)
                h = hashes.of(words)
                for n in sorted({p["kind"] for p in prints}):
                    known = np.array([p["fp"] for p in prints if p["kind"] == n], np.int64).view(np.uint64)
                    size = n or window
                    near = np.flatnonzero(np.isin(gram_hashes(h, n or gram), known))[:, None] - np.arange(size - (n or gram) + 1)
                    at = np.unique(near[(near >= 0) & (near <= len(words) - size)])
                    for i in range(0, len(at), 4096):
                        part = at[i : i + 4096].tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([size] * len(part), pa.int64()), pa.array([b" ".join(words[x : x + size]) for x in part], pa.binary())], ["rid", "at", "size", "words"])

    prints = docs.select("rid", "text").mapInArrow(doc_prints, "rid long, kind int, fp long")
    met = prints.join(texts.select("text").mapInArrow(item_prints, "kind int, fp long").distinct(), ["kind", "fp"], "left_semi")
    near = docs.select("rid", "text").join(met.groupBy("rid").agg(F.collect_list(F.struct("kind", "fp")).alias("prints")), "rid")
    windows = written(texts.mapInArrow(item_windows, "item_id string, words binary").distinct(), "decontam-windows", lasting=True)
    held = written(near.mapInArrow(doc_windows, "rid long, at long, size long, words binary").join(windows.select("words").distinct(), "words", "left_semi"), "decontam-hits", lasting=True)
    n_hit = held.select("rid", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    ids = held.select("rid", "words").distinct().join(windows.where("item_id IS NOT NULL"), "words").select("rid", "item_id").distinct().groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = docs.select("rid", "id", n_words.cast("long").alias("n_words")).join(n_hit, "rid", "left").join(ids, "rid", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def judged(found: DataFrame, twentieths: int = 1) -> DataFrame:
    """Adds contaminated: something is hit, and at least so many twentieths of the words."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= twentieths * F.col("n_words")))
