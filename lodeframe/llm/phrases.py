"""Phrases whose words stand together more often than apart, from suffix arrays of word ids.

Texts are cut into shards of some megabytes, each a row: a dictionary of its words and their ids
one after the other. Within a shard, prefix doubling sorts the suffixes by their first
words, and the intervals of the array of longest common prefixes are the shard's
distinct n-grams with their counts, which are merged by key over all shards.

No part of a phrase is rarer than the phrase, so the counting goes by length: the words
that are frequent over all shards bound the word pairs that are counted, and frequent
pairs the longer phrases. Each shard asks once for each of its words and pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.shared import discard, released, scratch

#: Bytes of text of a shard, and of all shards that a task has open.
SHARD_BYTES, OPEN_BYTES = 1 << 22, 1 << 24
#: Rows that a worker makes and hands over at a time.
ROWS = 1 << 14
#: Rows of text, and shards, that a worker is handed at a time: Spark's own bound of 10,000 rows would put all shards of a task into one batch.
TEXTS_A_BATCH, SHARDS_A_BATCH = 256, 1
#: Partitions of a shuffle: one a shard, up to so many times the session's number. What a task fetches, sorts and holds at a time goes by their size.
FINER = 3
#: Parts into which a language's phrases are dealt before its best are ranked.
DEALT = 64
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = bytes(1 if b in _BREAKS else 2 if b in _SPACES else 0 for b in range(256))
_SHARD = "shard long, lang string, n long, own long, words array<string>, counts array<long>, ids binary"


def split(data: bytes) -> tuple[np.ndarray, list[str]]:
    """Ids of the words of UTF-8 text in their order, -1 where a piece ends, and the words by id. A-Z are lower-cased."""
    data = data.lower()  # of bytes, this touches A-Z alone
    raw = np.frombuffer(data, np.uint8)
    kind = np.frombuffer(data.translate(_CLASS), np.uint8)
    word = kind == 0
    after = np.empty_like(word)
    after[:1], after[1:] = True, ~word[:-1]
    begins = (word & after) | (kind == 1)
    kept = kind != 2
    offsets = np.flatnonzero(begins[kept])
    raw = raw[kept]
    values = pa.Array.from_buffers(pa.large_binary(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
    words = values.dictionary.to_pylist()
    ids = values.indices.to_numpy(zero_copy_only=False)
    # A break is a piece of one byte of its own, and no word holds such a byte.
    new = np.full(len(words), -1, np.int32)
    real = [i for i, w in enumerate(words) if w not in _BREAKS]
    new[real] = np.arange(len(real), dtype=np.int32)
    return new[ids] if len(ids) else np.empty(0, np.int32), [words[i].decode("utf-8", "replace") for i in real]


def suffixes(names: np.ndarray, links: np.ndarray, depth: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of their first ``depth`` names, names shared with the place before, names that follow each place).

    ``links`` says whether a place's name is followed by another of the same run. Prefix doubling: an order by
    w names gives that by 2 w, as the rank w places on stands for the next w names. Only places before ``own`` are returned.
    """
    n = len(names)
    # Names from each place to the end of its run, up to the depth.
    reach = (names >= 0).astype(np.min_scalar_type(-depth - 1))
    for _ in range(1, depth):
        longer = reach.copy()
        longer[:-1][links[:-1]] = reach[1:][links[:-1]] + 1
        reach = np.minimum(longer, depth)
    rank, width = np.where(reach > 0, names, -1).astype(np.int64) + 1, 1
    place = np.flatnonzero(reach > 0).astype(np.int32)
    while True:
        if width < depth:
            second = np.zeros(n, np.int32)
            second[: max(0, n - width)] = rank[width:]
            second[reach <= width] = 0
            rank *= int(rank.max(initial=0)) + 1
            rank += second
            del second
        key = rank[place]
        by = np.argsort(key, kind="stable")
        order = place[by]
        if width >= depth:
            break
        key = key[by]
        rank[:] = 0
        rank[order] = 1 + np.cumsum(np.append(False, key[1:] != key[:-1])) if len(order) else 0
        del key, by
        width *= 2
    del rank, place, key, by
    order = order[order < own]
    lcp, same = np.zeros(len(order), reach.dtype), np.ones(max(0, len(order) - 1), bool)
    a, b = order[:-1], order[1:]
    for d in range(depth):
        same &= (reach[a] > d) & (reach[b] > d)
        same &= names[np.minimum(a + d, n - 1)] == names[np.minimum(b + d, n - 1)]
        lcp[1:] += same
    return order, lcp, reach


def intervals(order: np.ndarray, lcp: np.ndarray, reach: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram its first place in the order, and its count: the intervals of the array that share n names."""
    begins = np.flatnonzero(lcp < n)
    counts = np.diff(np.append(begins, len(order)))
    whole = reach[order[begins]] >= n
    return begins[whole], counts[whole]


def shards(df: DataFrame, text_col: str, lang_col: str, longest: int) -> DataFrame:
    """Rows of text as shards, one language each: (shard, lang, n, own, words, counts, ids).

    n counts the words, ids has -1 between pieces. A text beyond a shard's size is cut after any word; the shard
    then ends with the next ``longest`` - 1 words, which begin no phrase of its own: these places are beyond ``own``.
    """
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def made(lang: str, ids: np.ndarray, own: int, words: list[str], shard: int) -> pa.RecordBatch:
        mine = ids[:own]
        counts = np.bincount(mine[mine >= 0], minlength=len(words))
        row = {"shard": shard, "lang": lang, "n": int(counts.sum()), "own": own, "words": words, "counts": counts.tolist(), "ids": ids.astype("<i4").tobytes()}
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    def pieces(lang: str, data: bytes, next_no) -> Iterator[pa.RecordBatch]:
        ids, words = split(data)
        most = max(longest, SHARD_BYTES // 4)  # a word and its space have two bytes at least
        for at in range(0, len(ids), most):
            part = ids[at : at + most + longest - 1]
            used, local = np.unique(part[part >= 0], return_inverse=True)
            out = np.full(len(part), -1, np.int32)
            out[part >= 0] = local
            yield made(lang, out, min(most, len(ids) - at), [words[i] for i in used.tolist()], next_no())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held, sizes = defaultdict(list), defaultdict(int)

        def next_no() -> int:
            nonlocal count
            count += 1
            return part << 33 | count

        for batch in batches:
            texts = batch.column("text")
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                text = text.as_buffer().to_pybytes()
                held[lang].append(text)
                sizes[lang] += len(text) + 1
                while sizes[lang] >= SHARD_BYTES or sum(sizes.values()) >= OPEN_BYTES:
                    full = lang if sizes[lang] >= SHARD_BYTES else max(sizes, key=sizes.get)
                    del sizes[full]
                    yield from pieces(full, b"\n".join(held.pop(full)), next_no)
        for lang in list(held):
            yield from pieces(lang, b"\n".join(held.pop(lang)), next_no)

    return rows.mapInArrow(released(run), _SHARD)


_SCHEMA = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("own", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def _joined(words: pa.Array, names: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, with spaces between them."""
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*(words.take(pa.array(names[places + d])) for d in range(n)), " ")


class _Shard:
    """A shard of which only frequent words are left."""

    def __init__(self, row: dict):
        self.shard, self.lang, self.own, self.words = row["shard"], row["lang"], row["own"], row["words"]
        ids = np.frombuffer(row["ids"], "<i4")
        known = np.zeros(len(self.words) + 1, bool)  # the last is a break's
        known[np.frombuffer(row["frequent"], "<i4")] = True
        self.names = np.where(known[ids], ids, -1)
        self.links = np.append((self.names[:-1] >= 0) & (self.names[1:] >= 0), False) if len(ids) else np.empty(0, bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in order, begin of each pair's interval, counts of those before ``own``): pairs beyond it are asked about as well."""
        order, lcp, reach = suffixes(self.names, self.links, 2, len(self.names))
        begins, counts = intervals(order, lcp, reach, 2)
        mine = np.append(0, np.cumsum(order < self.own))
        return order, begins, mine[begins + counts] - mine[begins]

    def longer(self, frequent: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, counts) of phrases of three words and more whose pairs are all frequent; these are given by their numbers."""
        # Pairs that begin beyond ``own`` may still continue a phrase, so all places are looked at.
        links = self.links.copy()
        at = np.flatnonzero(links)
        links[at] = np.isin(_pair_keys(self.names, at), frequent)
        order, lcp, reach = suffixes(self.names, links, longest, self.own)
        for n in range(3, longest + 1):
            at, counts = intervals(order, lcp, reach, n)
            yield n, order[at], counts


def _pair_keys(names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A pair's number within its shard: its two local ids."""
    return names[places].astype(np.int64) << 32 | names[places + 1].astype(np.int64)


_ASKED = pa.schema([("shard", pa.int64()), ("no", pa.int64()), ("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])
_COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Shard, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            given = {n: (x.values if n == "words" else x.as_buffer() if n in ("ids", "frequent", "pairs") else x.as_py()) for n, x in row.items() if x.is_valid}
            if len(given.get("words", ())):
                yield _Shard(given), given


def _told(shard: _Shard, n: int, places: np.ndarray, counts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The n words from each place on with their counts; no more than ROWS of them are joined at a time."""
    for i in range(0, len(places), ROWS):
        few = places[i : i + ROWS]
        columns = {"gram": lambda few=few: _joined(shard.words, shard.names, few, n), "c": lambda i=i: counts[i : i + ROWS], "no": lambda few=few: _pair_keys(shard.names, few)}
        columns |= {name: lambda v=v, few=few: pa.repeat(pa.scalar(v), len(few)) for name, v in (("shard", shard.shard), ("lang", shard.lang))}
        made = [columns[f.name]() for f in schema]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip(made, schema, strict=True)], schema=schema)


def _ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, _ in _opened(batches):
        order, begins, counts = shard.pairs()
        places = order[begins]
        del order, begins
        yield from _told(shard, 2, places, counts, _ASKED)


def _count_longer(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, given in _opened(batches):
            for n, places, counts in shard.longer(np.frombuffer(given.get("pairs", b""), "<i8"), longest):
                yield from _told(shard, n, places, counts, _COUNTED)

    return run


def _frequent(asked: DataFrame, least: int) -> DataFrame:
    """What is asked, (shard, no, lang, gram, c), with ``f``, its count over all shards, where that is frequent.

    A shard has one row for a gram at the most, so a gram has no more rows than there are shards; a window that
    spills sums them, and no shard's question is shuffled twice.
    """
    return asked.withColumn("f", F.sum("c").over(Window.partitionBy("lang", "gram"))).where(F.col("f") >= least)


def _packed(answers: DataFrame, kind: str, name: str) -> DataFrame:
    """(shard, name): the numbers of a shard's frequent grams as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(x.values).astype(kind).tobytes() for x in batch.column("nos")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(packed, pa.binary())], ["shard", name])

    return answers.groupBy("shard").agg(F.collect_list("no").alias("nos")).mapInArrow(released(run), f"shard long, {name} binary")


#: Shuffle files go as soon as the query that made them ends, as every step is written and read again.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting, while what stands within runs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def counted(df: DataFrame, paths: list[str], text_col: str, lang_col: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, size, f) of all grams of one to ``longest`` words that occur ``least`` times, (lang, n)), written."""
    spark = df.sparkSession

    def saved(out: DataFrame, name: str, a_batch: int = SHARDS_A_BATCH) -> DataFrame:
        paths.append(scratch(spark, name))
        with _setting(spark, _BATCH, str(a_batch)):
            out.write.parquet(paths[-1])
        return spark.read.schema(out.schema).parquet(paths[-1])

    made = saved(shards(df, text_col, lang_col, longest), "phrase-shards", TEXTS_A_BATCH)
    usual, several = int(spark.conf.get(_PARTITIONS)), made.select("shard").count()
    with _setting(spark, _PARTITIONS, str(max(usual, min(several, FINER * usual)))):
        return _counted(made, saved, least, longest)


def _counted(made: DataFrame, saved: Callable[..., DataFrame], least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    totals = saved(made.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    asked = made.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("shard", F.col("pos").cast("long").alias("no"), "lang", F.col("col.words").alias("gram"), F.col("col.counts").alias("c"))
    words = saved(_frequent(asked, least), "phrase-words")
    kept = made.drop("counts", "n").join(_packed(words, "<i4", "frequent"), "shard")
    kept = saved(kept, "phrase-kept")
    pairs = saved(_frequent(kept.mapInArrow(released(_ask_pairs), "shard long, no long, lang string, gram string, c long"), least), "phrase-pairs")
    asks = kept.join(_packed(pairs, "<i8", "pairs"), "shard")
    more = asks.mapInArrow(released(_count_longer(longest)), "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    each = lambda rows: rows.groupBy("lang", "gram").agg(F.first("f").alias("f"))
    grams = saved(each(words).unionByName(each(pairs)).unionByName(more), "phrase-grams")
    return grams.withColumn("size", F.size(F.split("gram", " "))), totals


def scored(grams: DataFrame) -> DataFrame:
    """Candidates with their lowest cut: (lang, gram, a, l, r, score), those within a longer one that is nearly as frequent left out."""
    few = grams.where("size > 1").withColumnRenamed("f", "a").withColumn("w", F.split("gram", " "))
    part = lambda name, out: grams.select("lang", F.col("gram").alias(name), F.col("f").alias(out))
    cut = few.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("left", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn("right", F.expr("array_join(slice(w, k + 1, size), ' ')"))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Decimals of 38 digits, as the product may pass 64 bits; div cuts to a whole number.
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))").cast("long")
    best = cut.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = few.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    covered = inner.select("lang", F.expr("array_join(slice(w, i, m), ' ')").alias("gram"), "a").groupBy("lang", "gram").agg(F.max("a").alias("most"))
    free = best.join(covered, ["lang", "gram"], "left").where("most IS NULL OR 100 * CAST(most AS DECIMAL(20, 0)) < 80 * CAST(a AS DECIMAL(20, 0))")
    return free.select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")


def best(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank; each of DEALT parts of a language gives its own first ones before."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("gram")]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("gram"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= most)
    return dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("deal")


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, most: int = 2000) -> DataFrame:
    """Each language's strongest phrases: (lang, rank, phrase, a, l, r, n, score).

    A phrase has 2 to ``longest`` words within a piece, pieces ending at ``.,;:!?`` and at line ends, words at blanks and
    tabs; A-Z are lower-cased. a counts its occurrences, l and r those of the two parts of the cut with the lowest score
    floor(2000000 a / (l + r)), of equal cuts the first; n counts all words. Phrases within a longer one that has
    four fifths of their occurrences are left out. Counts are over all rows, repeated ones included; a null language is
    ``und``, a null text empty; a language without a phrase has no row. Other columns play no part.
    """
    if least < 1 or longest < 2 or most < 1:
        raise ValueError("least and most are 1 or more, longest 2 or more")
    spark, paths = df.sparkSession, []
    try:
        with _setting(spark, _TIDY, "true"):
            grams, totals = counted(df, paths, text_col, lang_col, least, longest)
            found = best(scored(grams), most).join(F.broadcast(totals), "lang")
            # At most ``most`` rows a language, which the result reads once the steps are gone.
            path = scratch(spark, "phrases")
            found.select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score").write.parquet(path)
            return spark.read.parquet(path)
    finally:
        for path in paths:
            discard(spark, path)
