"""Language-model scores from a log-frequency Bloom filter.

The model is a bigram model with Dirichlet smoothing towards the unigrams. The counts of
all bigrams are quantised to powers of two, and a pair of level l is put into the filter
with every level up to l; a level is read back by probing one level after the other
until one is missing. The filter grows with the distinct pairs, so it is held in shards
by the pairs' hashes, and each shard is probed where it is built.

Unigram counts are exact. Documents are cut into batches of some megabytes; each
batch asks for the counts of its distinct words and for the levels of its distinct pairs
once, in packed arrays dealt out by hash, and the answers come back to the batch. A
frequent word or pair is thus a row a batch, not a row an occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import slices, written
from lodeframe.llm.words import WordHashes, mixed, space_words

#: Bits an entry and probes an entry: one false level in about a hundred.
BITS, PROBES = 10, 7
#: Weight of the unigrams, in tokens.
SMOOTHING = 500.0
#: Characters of a batch, and of the texts whose words, or whose pairs, are counted in one place.
BATCH, SHARD = 6 << 20, 4 << 20
_END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 60


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 by 7; a null id is none of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's ending with the end token, and the number of each text's."""
    parts = []
    for t in texts:
        parts += [hashes.of(space_words(t)), np.array([_END])]
    return np.concatenate(parts), np.array([len(parts[i]) + 1 for i in range(0, len(parts), 2)])


class LogFilter:
    """Quantised counts by key in a Bloom filter."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        """1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on; 0 for 0."""
        return np.frexp(counts.astype(np.float64))[1]

    @staticmethod
    def count(levels: np.ndarray) -> np.ndarray:
        """The middle of a level's counts."""
        return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)

    def places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mixed(keys * _ODD + np.uint64(level))
        step = mixed(h) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) % self.size).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> LogFilter:
        levels = cls.level(counts)
        out = cls(np.zeros(max(8, int(levels.sum()) * BITS // 8 + 1), np.uint8))
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in out.places(keys[levels >= level], level):
                np.bitwise_or.at(out.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probes level by level; a key's level is the last before one that is missing."""
        found, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(1, _LEVELS):
            there = np.ones(len(left), bool)
            for at in self.places(keys[left], level):
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[there]
            if not len(left):
                break
            found[left] = level
        return found


def _batches(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """(batch, rows): the same cuts whenever the same partition is read."""
    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names), strict=True))
    for i, part in enumerate(slices(rows, lambda r: len(r[0] or "") + 1, BATCH)):
        yield TaskContext.get().partitionId() << 32 | i, part


def _dealt(keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of sorted keys by shard, each sorted."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    # Only shards that have a key are looked at, however many there are.
    begins = np.flatnonzero(np.diff(ranked, prepend=-1))
    for a, b in zip(begins, np.append(begins[1:], len(order))[: len(begins)], strict=True):
        yield int(ranked[a]), keys[order[a:b]], counts[order[a:b]]


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a shard's packed rows, their counts, each entry's place among them, and the rows' cuts."""
    keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int64)
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(at, counts, len(known)).astype(np.int64), at, np.cumsum([0, *map(len, keys)])


_PACKED = "shard int, batch long, keys binary, counts binary"


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (2, 3))], ["shard", "batch", "keys", "counts"])


def pairs(all_tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: a hash of the pair with the one before, and the place of that one.

    A text's first token follows its end token, as if texts were a ring.
    """
    ends = np.cumsum(sizes)
    before = np.arange(len(all_tokens)) - 1
    before[ends - sizes] = ends - 1
    return mixed(mixed(all_tokens[before]) * _ODD + all_tokens), before


def answers(docs: DataFrame, shards: int) -> DataFrame:
    """What batches ask for, and the totals, as rows of three kinds.

    ``docs`` has text and train. kind 0: (batch, shard, counts) for the batch's distinct words
    of the shard, in order; kind 1: the same with a level in a byte for its distinct pairs; kind 2:
    number of tokens and of words of a shard in batch and shard.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, part in _batches(batches, "text", "train"):
            all_tokens, sizes = tokens([t for t, _ in part], hashes)
            learnt = np.repeat(np.array([t for _, t in part], np.float64), sizes)
            for first, keys in ((0, all_tokens), (shards, pairs(all_tokens, sizes)[0])):
                known, at = np.unique(keys, return_inverse=True)
                yield _packed([(first + k, batch, *x) for k, *x in _dealt(known, np.bincount(at, learnt, len(known)).astype(np.int64), shards)])

    def answer(table: pa.Table) -> pa.Table:
        known, counts, at, cuts = _counted(table)
        kind, shard = divmod(table["shard"][0].as_py(), shards)
        found = LogFilter.of(known, counts).levels(known).astype(np.uint8) if kind else counts
        rows = [{"kind": kind, "batch": b, "shard": shard, "counts": found[at[x:y]].tobytes()} for b, x, y in zip(table["batch"].to_pylist(), cuts, cuts[1:], strict=False)]
        if not kind:
            rows.append({"kind": 2, "batch": int(counts.sum()), "shard": int((counts > 0).sum()), "counts": None})
        return pa.Table.from_pylist(rows, pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary())]))

    asked = docs.select("text", "train").mapInArrow(ask, _PACKED)
    return written(asked.groupBy("shard").applyInArrow(answer, "kind int, batch long, shard long, counts binary"), "lm-answers")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Learns from the rows that aren't held out and scores every row.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score): tokens are
    the text's words and one end; base_score sums log10((c+1)/(N+V+1)) over them, score is the
    bigram model's log10 probability of the text. Null and empty texts are one end
    token. Rows that repeat an id are learnt from and scored each; a null id is learnt
    from. No rows give no rows. ``held`` defaults to a seventh of the ids.

    docs is read three times and must give the same rows in the same partitions each
    time, as files do; read a shuffled or sampled frame from a written table.
    """
    held = held_out(F.col(f"`{id_col}`")) if held is None else held
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), (~held).alias("train"))
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD))
    found = answers(rows, shards)
    total, distinct = found.where("kind = 2").agg(F.coalesce(F.sum("batch"), F.lit(0)), F.coalesce(F.sum("shard"), F.lit(0))).first()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _batches(batches, "text", "id", "train"):
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(part), pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.string()), pa.array([r[2] for r in part], pa.bool_())], ["batch", "id", "text", "train"])

    def answered(keys: np.ndarray, right: pa.Table, kind: int, of: type) -> np.ndarray:
        out, shard = np.zeros(len(keys), of), (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        given = right.filter(pc.equal(right["kind"], kind))
        place = given["shard"].to_numpy()
        begins, ends = (np.searchsorted(shard[order], place, side) for side in ("left", "right"))
        for a, b, c in zip(begins, ends, given["counts"].to_pylist(), strict=True):
            out[order[a:b]] = np.frombuffer(c, of)
        return out

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        all_tokens, sizes = tokens(left["text"].to_pylist(), WordHashes())
        known, at = np.unique(all_tokens, return_inverse=True)
        exact = answered(known, right, 0, np.int64)
        base = (exact + 1) / (total + distinct + 1)
        codes, before = pairs(all_tokens, sizes)
        asked, place = np.unique(codes, return_inverse=True)
        pair = LogFilter.count(answered(asked, right, 1, np.uint8).astype(np.int64))[place]
        context = exact[at][before]
        # A pair is counted no more often than its first word.
        smooth = (np.minimum(pair, context) + SMOOTHING * base[at]) / (context + SMOOTHING)
        starts = np.cumsum(sizes) - sizes
        added = lambda x: np.add.reduceat(x, starts)
        return pa.table({"id": left["id"], "held_out": pa.array([not t for t in left["train"].to_pylist()]), "n_tokens": sizes.astype(np.int64), "n_known": added((exact[at] > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), total, np.int64), "base_score": added(np.log10(base)[at]), "score": added(np.log10(smooth))})

    kind = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tagged = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(tag, "batch long, id long, text string, train boolean").groupBy("batch")
    asked = found.where("kind < 2").select("batch", "kind", "shard", "counts").groupBy("batch")
    return tagged.cogroup(asked).applyInArrow(evaluate, kind).withColumnRenamed("id", id_col)
