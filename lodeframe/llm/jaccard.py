"""N-gram Jaccard join by signature trees, and its connected groups.

Documents with equal sets of word n-grams are one class. Classes that can reach the
threshold share one of their rarest grams (a set's prefix), so a gram's classes are the
bucket in which they meet. First every class is compared with a leader of its
buckets, which makes large groups of copies one component in a linear number of
comparisons. What buckets still hold of several components is joined exactly: a
signature tree, whose nodes hold OR-combined token bitmaps and size ranges, is
traversed against another, and pairs of nodes that can't reach the threshold are
left. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import components
from lodeframe.llm.shared import passing, released, rows_of, slices, written
from lodeframe.llm.words import gram_hashes, space_hashes

#: Frequent grams whose order is known (16 bytes each). They only order the prefixes; no order loses a link.
FREQUENT = 1 << 17
#: Entries of a shard of buckets, classes of a frequent gram in one place, and classes in a block of a bucket.
SHARD, SPREAD, BLOCK = 400_000, 200_000, 1_000
#: Bytes of bitmaps in a block of a bucket, and in the blocks that one task compares.
BLOCK_BYTES, CELL_BYTES = 8 << 20, 32 << 20
#: Ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Classes that meet a leader in one place.
MEET = 200
#: A leader is tried if it shares this part of a class's prefix; others are left to the exact join.
TRIED = 0.2
#: Links up to this number (16 bytes each) become components in one task; more in rounds of joins.
ONE_TASK = 500_000
#: Rounds in which classes are compared with leaders before the exact join.
ROUNDS = 2
#: Children of a tree's node.
FAN = 8
_SLICE = 8 << 20


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of a text's word n-grams as sorted hashes; all its words as one if they are fewer."""
    words = space_hashes(text)
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.empty(0, np.uint64)


def named(grams: np.ndarray, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(grams.tobytes(), seed)
    return h - (1 << 64) if h >= 1 << 63 else h


def class_of(grams: np.ndarray, taken: frozenset[int] = frozenset()) -> int:
    """The name of a set: a hash, or, where different sets have that one, another."""
    h = named(grams)
    return named(grams, 1) if h in taken else h


def prefix(grams: np.ndarray, percent: int, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest grams, as many as leave fewer than the threshold needs."""
    keep = len(grams) - -(-percent * len(grams) // 100) + 1
    if not len(known):
        return grams[:keep]
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    frequency = np.where(known[at] == grams, counts[at], 0)
    if not frequency.any():
        return grams[:keep]
    return grams[np.lexsort((grams, frequency))[:keep]]


def bitmap(grams: np.ndarray) -> np.ndarray:
    """A bit for each gram, in a power of two of bytes that leaves four to eight bits a gram."""
    size = max(8, 1 << (max(1, len(grams)) - 1).bit_length() >> 1)
    out = np.zeros(size * 8, np.uint8)
    out[(grams % np.uint64(size * 8)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same set's bitmap in fewer bytes."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


class Tree:
    """A signature tree over sets sorted by size: levels of nodes, each with OR-combined bitmaps and size ranges."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def possible(a: tuple, b: tuple, percent: int) -> bool:
    """Whether a set below node a and one below node b may reach the threshold.

    A set has a token of its own for each bit that the other node lacks, if the node
    is one set; for nodes of several the sizes decide with the bits both can share.
    """
    (bits_a, low_a, high_a, one_a), (bits_b, low_b, high_b, one_b) = a, b
    if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
        return False
    most = min(high_a, high_b)
    if one_a:
        most = min(most, high_a - int(_ONES[bits_a & ~bits_b].sum()))
    if one_b:
        most = min(most, high_b - int(_ONES[bits_b & ~bits_a].sum()))
    # A union is the least for the smallest sizes that still hold such an overlap.
    least = max(low_a, most) + max(low_b, most) - most
    return 100 * most >= percent * least


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of places, one from each tree, that may reach the threshold; one tree with itself gives i < j."""
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if a is b and la == lb and i > j:
            continue
        node = lambda t, level, k: (*(x[k] for x in t.levels[level]), level == 0)
        if not (a is b and la == lb and i == j) and not possible(node(a, la, i), node(b, lb, j), percent):
            continue
        if la == lb == 0:
            if a is not b or i < j:
                yield i, j
        else:
            below = lambda t, level, k: [(level - 1, x) for x in range(k * FAN, min(k * FAN + FAN, len(t.levels[level - 1][1])))] if level else [(0, k)]
            if la == lb:
                stack += [(x, m, y, n) for x, m in below(a, la, i) for y, n in below(b, lb, j)]
            elif la > lb:
                stack += [(x, m, lb, j) for x, m in below(a, la, i)]
            else:
                stack += [(la, i, y, n) for y, n in below(b, lb, j)]


def bucket_pairs(classes: np.ndarray, sizes: np.ndarray, comps: np.ndarray, bitmaps: list[bytes], left: np.ndarray, both: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket's classes that may reach the threshold and aren't of one component.

    ``left`` says on which of the two sides a class is; ``both`` that the right side is also joined
    with itself. Sets are compared in bitmaps of the smaller one's width: sizes that can reach
    the threshold are at most a power of two apart, so each width meets itself and the next.
    """
    order = np.lexsort((classes, comps, sizes))
    widths = np.array([len(b) for b in bitmaps])[order]
    groups: dict[tuple[bool, int], np.ndarray] = {}
    for side in (True, False):
        for w in np.unique(widths[left[order] == side]).tolist():
            groups[side, w] = order[(left[order] == side) & (widths == w)]

    def tree(side: bool, w: int, width: int) -> Tree:
        at = groups[side, w]
        return Tree(sizes[at], np.stack([folded(np.frombuffer(bitmaps[i], np.uint8), width) for i in at]))

    sides = [(True, False)] + [(False, False)] * both
    for x, y in sides:
        for w in sorted({w for _, w in groups}):
            jobs = [(w, w), (w, 2 * w)] + ([(2 * w, w)] if x != y else [])
            for a, b in jobs:
                if (x, a) in groups and (y, b) in groups:
                    first = tree(x, a, w)
                    second = first if x == y and a == b else tree(y, b, w)
                    for i, j in traverse(first, second, percent):
                        p, q = groups[x, a][i], groups[y, b][j]
                        if comps[p] != comps[q]:
                            yield int(min(classes[p], classes[q])), int(max(classes[p], classes[q]))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


class Join:
    """The steps of one join; ``groups`` runs them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, spread: int, block: int):
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.n, self.percent, self.spread, self.block, self.spark = n, percent, spread, block, docs.sparkSession
        self.taken: frozenset[int] = frozenset()

    def sketches(self) -> DataFrame:
        """Rows of two kinds from one pass.

        kind 0: (id, size, class) of every document, class null where there are no words; its second
        name is in other.
        kind 1: a gram as id with, as size, the number of classes that have it in a
        slice of documents, if that is more than one.
        """
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(kind: int, ids, sizes, classes, others) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (ids, sizes, classes, others))], ["kind", "id", "size", "class", "other"])

            for part in _parts(batches):
                sets = [shingles(t, n) for _, t in part]
                classes, others = ([named(s, seed) if len(s) else None for s in sets] for seed in (0, 1))
                yield out(0, [i for i, _ in part], [len(s) for s in sets], classes, others)
                if each := [s for c, s in dict(zip(classes, sets, strict=True)).items() if c is not None]:
                    grams, counts = np.unique(np.concatenate(each), return_counts=True)
                    keep = counts > 1
                    yield out(1, grams[keep].view(np.int64), counts[keep], *(np.zeros(int(keep.sum()), np.int64),) * 2)

        return written(self.docs.mapInArrow(released(run), "kind int, id long, size long, class long, other long"), "jaccard-sketches")

    def classes(self, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, size, class) of the documents, and (class, rep) of the classes.

        Different sets of one 64-bit name, some ten among 10^10, get their second ones.
        """
        docs = sketches.where("kind = 0").select("id", "size", "class", "other")
        names = docs.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.min("other").alias("x"), F.max("other").alias("y"))
        names = written(names, "jaccard-classes", lasting=True)
        self.taken = frozenset(r[0] for r in names.where("x <> y").select("class").collect())
        if not self.taken:
            return docs.drop("other"), names.select("class", "rep")
        docs = docs.withColumn("class", F.when(F.col("class").isin(list(self.taken)), F.col("other")).otherwise(F.col("class"))).drop("other")
        return docs, docs.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"))

    def frequent(self, sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent grams, sorted, and their counts."""
        found = sketches.where("kind = 1").groupBy(F.col("id").alias("gram")).agg(F.sum("size").alias("c"))
        rows = found.where("c > 3").orderBy(F.desc("c"), "gram").limit(FREQUENT).toPandas()
        grams = rows["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(grams)
        return grams[order], rows["c"].to_numpy(np.int64)[order]

    def buckets(self, entries: int, known: np.ndarray, counts: np.ndarray) -> DataFrame:
        """(gram, class, size, alike) of every prefix gram that several classes have.

        Of grams that exactly the same classes have, one stays, and alike is their number.
        """
        n, percent, most = self.n, self.percent, self.spread
        shards = max(1, math.ceil(entries / SHARD))
        given, taken = self.spark.sparkContext.broadcast((known, counts)), self.taken

        def spread(known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            many = counts > most
            return known[many], counts[many]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, counts = given.value
            wide, times = spread(known, counts)
            for part in _parts(batches):
                sets = {class_of(s, taken): s for _, t in part if len(s := shingles(t, n))}
                if not sets:
                    continue
                heads = [prefix(s, percent, known, counts) for s in sets.values()]
                lens = [len(h) for h in heads]
                grams = np.concatenate(heads)
                classes = np.repeat(np.fromiter(sets, np.int64, len(sets)), lens)
                sizes = np.repeat(np.fromiter(map(len, sets.values()), np.int32, len(sets)), lens)
                shard = (grams % np.uint64(shards)).astype(np.int64)
                if len(wide):
                    at = np.minimum(np.searchsorted(wide, grams), len(wide) - 1)
                    shard = np.where(wide[at] == grams, (shard + classes % -(-times[at] // most)) % shards, shard)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *(pa.array([x[at].tobytes() for _, at in rows], pa.binary()) for x in (grams, classes, sizes))], ["shard", "grams", "classes", "sizes"])

        def meet(table: pa.Table) -> pa.Table:
            wide, _ = spread(*given.value)
            grams, classes, sizes = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("grams", np.uint64), ("classes", np.int64), ("sizes", np.int32)))
            order = np.lexsort((classes, grams))
            grams, classes, sizes = grams[order], classes[order], sizes[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
            grams, classes, sizes = grams[new], classes[new], sizes[new]
            same = np.zeros(len(grams) + 1, bool)
            same[1:-1] = grams[1:] == grams[:-1]
            keep = same[1:] | same[:-1] | np.isin(grams, wide)
            return pa.table({"gram": grams[keep].view(np.int64), "class": classes[keep], "size": sizes[keep].astype(np.int64)})

        dealt = self.docs.mapInArrow(released(deal), "shard int, grams binary, classes binary, sizes binary")
        met = written(dealt.groupBy("shard").applyInArrow(meet, "gram long, class long, size long"), "jaccard-buckets")
        total = lambda seed: F.sum(F.xxhash64("class", F.lit(seed)).cast("decimal(20,0)"))
        kinds = met.groupBy("gram").agg(F.count("*").alias("n"), total(1).alias("x"), total(2).alias("y")).where("n > 1")
        kept = kinds.groupBy("n", "x", "y").agg(F.min("gram").alias("gram"), F.count("*").alias("alike"))
        return written(met.join(kept.select("gram", "alike"), "gram"), "jaccard-buckets")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """wanted (id, ...) with the texts of these ids."""
        wanted = written(wanted, "jaccard-wanted")
        few = wanted.count() <= BROADCAST_IDS
        return self.docs.join(F.broadcast(wanted) if few else wanted, "id")

    def bitmaps(self, classes: DataFrame) -> DataFrame:
        """(class, bits) of (class, id)."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([bitmap(shingles(t, n)).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], ["class", "bits"])

        # Texts that share the id, if ids repeat, are of other classes.
        return written(self.of_class(self.texts(classes.select("id", "class"))).mapInArrow(released(run), "class long, bits binary").dropDuplicates(["class"]), "jaccard-bitmaps")

    def of_class(self, texts: DataFrame) -> DataFrame:
        """(class, ..., text): the rows whose text is of the class that they name, where ids aren't unique."""
        if self.unique:
            return texts
        n, taken = self.n, self.taken

        @F.pandas_udf("long")
        def own(text):
            return text.map(lambda t: class_of(shingles(t, n), taken))

        return texts.where(own("text") == F.col("class"))

    def linked(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that reach the threshold, on their whole sets.

        The texts of both sides meet at b, a bounded number of a's in each place, and
        are read in order with b's own first, so a task holds one set and a row.
        """
        n, percent = self.n, self.percent
        pairs = written(pairs, "jaccard-pairs")
        places = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEET).cast("int").alias("places"))
        sent = pairs.join(places, "b").select(F.col("a").alias("class"), F.col("b").alias("key"), F.pmod(F.xxhash64("a"), "places").cast("int").alias("place"), F.lit(1).alias("role"))
        leads = places.select(F.col("b").alias("class"), F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"))
        texts = self.of_class(self.texts(sent.unionByName(leads).join(reps, "class"))).select("key", "place", "role", "class", "text")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / 5_000))
        met = texts.repartition(parts, "key", "place").sortWithinPartitions("key", "place", "role")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, lead = None, None
            for batch in batches:
                out = []
                for key, place, role, c, text in rows_of(batch, "key", "place", "role", "class", "text"):
                    grams = shingles(text, n)
                    if role == 0:
                        at, lead = (key, place), grams
                    elif at == (key, place) and similar(grams, lead, percent):
                        out.append((c, key))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        return written(met.mapInArrow(released(run), "a long, b long"), "jaccard-links")

    def led(self, buckets: DataFrame, turn: int) -> DataFrame:
        """For each class, its most frequent leader of another component: (a, b).

        A bucket's leader is first the class that shares most with others over all its
        buckets, as an original does among its copies; after that, one by a hash.
        """
        first = F.struct(F.xxhash64("class", F.lit(turn)).alias("o"), "class", "comp", "size")
        if turn == 0:
            full = buckets.groupBy("gram").agg(F.count("*").alias("n"), F.first("alike").alias("w"))
            central = buckets.join(full, "gram").groupBy("class").agg(F.sum(F.col("n") * F.col("w")).alias("c"))
            ranked = written(buckets.join(central, "class"), "jaccard-central")
            first = F.struct((-F.col("c")).alias("o"), "class", "comp", "size")
            leaders = ranked.groupBy("gram").agg(F.min(first).alias("lead"))
        else:
            leaders = buckets.groupBy("gram").agg(F.min(first).alias("lead"))
        near = (100 * F.col("size") >= self.percent * F.col("lead.size")) & (100 * F.col("lead.size") >= self.percent * F.col("size"))
        met = buckets.join(leaders, "gram").where((F.col("comp") != F.col("lead.comp")) & near)
        shared = met.groupBy("class", "size", F.col("lead.class").alias("leader")).agg(F.sum("alike").alias("n"))
        enough = F.col("n") >= TRIED * (100 - self.percent) / 100 * F.col("size")
        return shared.where(enough).groupBy(F.col("class").alias("a")).agg(F.max_by("leader", F.struct("n", "leader")).alias("b"))

    def crossing(self, buckets: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs of classes of different components that a bucket's signature trees leave: (a, b)."""
        # A bitmap has no more bytes than its set has grams; the rest of a row has about 64.
        held = F.col("size") + 64
        counts = buckets.groupBy("gram", "comp").agg(F.count("*").alias("n"), F.sum(held).alias("held"))
        of = counts.groupBy("gram").agg(F.max(F.struct("n", "comp", "held")).alias("most"), F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("*").alias("comps")).where("comps > 1")
        blocks = lambda n, held: F.ceil(F.greatest(n / self.block, held / BLOCK_BYTES)).cast("int")
        of = of.select("gram", F.col("most.comp").alias("major"), blocks(F.col("most.n"), F.col("most.held")).alias("mb"), blocks(F.col("n") - F.col("most.n"), F.col("held") - F.col("most.held")).alias("sb"))
        rows = written(buckets.join(of, "gram"), "jaccard-crossing")
        # The largest component of a bucket isn't joined with itself: its blocks meet those of the others alone.
        large = F.col("comp") == F.col("major")
        copies = F.when(large, F.col("sb")).otherwise(F.col("mb") + F.col("sb") - 1)
        total, sent = rows.agg(F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.sum(copies * held), F.lit(0))).first()
        if not total:
            return rows.select(F.col("class").alias("a"), F.col("class").alias("b"))
        own = F.pmod(F.xxhash64("class"), F.when(large, F.col("mb")).otherwise(F.col("sb"))).cast("int")
        every = lambda n: F.sequence(F.lit(0), n - 1)
        cell = lambda kind, i, j, left, both: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), both.alias("both"))
        yes, no = F.lit(True), F.lit(False)
        majors = F.transform(every(F.col("sb")), lambda j: cell(0, F.col("own"), j, yes, no))
        minors = F.concat(
            F.transform(every(F.col("mb")), lambda i: cell(0, i, F.col("own"), no, (i == 0))),
            F.transform(F.filter(every(F.col("sb")), lambda k: k != F.col("own")), lambda k: cell(1, F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.col("own") < k, no)),
        )
        cells = rows.withColumn("own", own).withColumn("cell", F.explode(F.when(large, majors).otherwise(minors)))
        shards = max(1, math.ceil(total / 20_000), math.ceil(sent / CELL_BYTES))
        dealt = cells.select(F.pmod(F.xxhash64("gram", "cell.kind", "cell.i", "cell.j"), F.lit(shards)).alias("shard"), F.xxhash64("gram", "cell.kind", "cell.i", "cell.j").alias("bucket"), "class", "comp", "size", "cell.left", "cell.both")
        dealt = dealt.join(self.bitmaps(rows.select("class").distinct().join(reps, "class")), "class")
        percent = self.percent

        def run(table: pa.Table) -> pa.Table:
            c = {k: table[k].to_numpy() for k in ("bucket", "class", "comp", "size", "left", "both")}
            bits, found = table["bits"].to_pylist(), set()
            order = np.argsort(c["bucket"], kind="stable")
            cuts = np.flatnonzero(np.diff(c["bucket"][order])) + 1
            for at in np.split(order, cuts):
                if len(at) > 1:
                    found.update(bucket_pairs(c["class"][at], c["size"][at], c["comp"][at], [bits[i] for i in at], c["left"][at].astype(bool), bool((c["both"][at] & ~c["left"][at].astype(bool)).any()), percent))
            pairs = sorted(found)
            return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        return dealt.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    return slices((r for batch in batches for r in rows_of(batch, "id", "text")), lambda r: len(r[1] or ""), _SLICE)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, rounds: int = ROUNDS, spread: int = SPREAD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) for each row of docs.

    Two documents link when 100 * shared >= percent * all of their sets' word n-grams;
    component_id is the smallest id that links reach, itself included, and class is the
    same for equal sets. A text with fewer than n words is one gram; one without
    words, empty or null, has an empty set and links with nothing. Rows that repeat an
    id with other texts are looked at each; rows with a null id have a null component.
    No rows give no rows.
    """
    join = Join(docs, id_col, text_col, n, percent, spread, block)
    sketches = join.sketches()
    docs, classes = join.classes(sketches)
    entries, n_ids, rows = docs.agg(F.coalesce(F.sum(F.floor(F.col("size") * (100 - percent) / 100) + 1), F.lit(0)), F.countDistinct("id"), F.count("*")).first()
    join.unique = n_ids == rows
    reps = classes.select("class", F.col("rep").alias("id"))
    with passing(docs.sparkSession):
        buckets = join.buckets(int(entries), *join.frequent(sketches)).withColumn("comp", F.col("class"))
        links, known = None, None
        for turn in range(rounds + 1):
            pairs = join.led(buckets, turn) if turn < rounds else join.crossing(buckets, reps)
            new = join.linked(pairs, reps)
            if links is not None and new.isEmpty():
                continue
            links = new if links is None else links.union(new)
            known = written(components(links, one_task=ONE_TASK), "jaccard-components", lasting=True)
            if turn < rounds:
                found = known.select(F.col("node").alias("class"), F.col("component").alias("c"))
                buckets = written(buckets.drop("comp").join(found, "class", "left").select("gram", "class", "size", "alike", F.coalesce("c", "class").alias("comp")), "jaccard-buckets")
    least = known.join(classes, known["node"] == classes["class"]).groupBy("component").agg(F.min("rep").alias("least"))
    named = known.join(least, "component").select(F.col("node").alias("class"), "least")
    first = classes.join(named, "class", "left").select("class", F.coalesce("least", "rep").alias("component_id"))
    out = docs.join(first, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), "class")
