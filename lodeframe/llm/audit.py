"""How filters of a corpus interact: what each removes in every order of applying them.

Duplicates are found by partition refinement. Rows are parted by their text's length in
code points, then by the hash of one block of the text after another; rows that are
alone in their part leave at once. The full texts of what survives are compared, and
every row whose text a smaller id also has is marked. Each row then has a mask of the
filters that it fails, and as no order changes a mask, counts of masks give every order.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import discard, scratch

#: Code points of the first block; each further block is four times as long, so even a text of a gigabyte has about twelve.
FIRST_BLOCK, GROWTH = 64, 4
#: Seeds tried until no two texts of one length share all block hashes.
SEEDS = 16
#: Up to so many keys (8 bytes each) of texts still to be compared are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def _edges(chars: Column) -> Column:
    """Numbers of the blocks that a text of so many code points has, from 0."""
    # Block r ends at FIRST_BLOCK * (GROWTH ** (r + 1) - 1) / (GROWTH - 1) code points.
    blocks = F.ceil(F.log(float(GROWTH), 1 + chars * (GROWTH - 1) / FIRST_BLOCK)).cast("int")
    return F.when(chars > 0, F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def block_hashes(text: Column, seed: int) -> Column:
    """One hash for each block of the text, all blocks together being the whole text."""

    def block(r: Column) -> Column:
        most = F.lit(float((1 << 31) - 2))
        size = F.least(FIRST_BLOCK * F.pow(F.lit(float(GROWTH)), r), most).cast("int")
        start = F.least(FIRST_BLOCK * (F.pow(F.lit(float(GROWTH)), r) - 1) / (GROWTH - 1), most).cast("int")
        return F.xxhash64(F.lit(seed), F.substring(text, start + 1, size))

    return F.transform(_edges(F.length(text)), block)


def refined(key: Column, block: Column) -> Column:
    """The part that a row of a part comes into by its next block; without one it stays."""
    return F.when(block.isNull(), key).otherwise(F.xxhash64(key, block))


def _whole(chars: Column, blocks: Column) -> Column:
    """The part after all blocks."""
    return F.aggregate(blocks, chars.cast("long"), lambda key, b: F.xxhash64(key, b))


def _saved(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    paths.append(scratch(df.sparkSession, name))
    df.write.parquet(paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(paths[-1])


def _not_alone(rows: DataFrame) -> DataFrame:
    """Rows whose part has another; counts are combined before the shuffle, whatever a part's size."""
    shared = rows.groupBy("key").agg(F.count("*").alias("__n")).where("__n > 1").select("key")
    return rows.join(shared, "key", "left_semi")


def firsts(sketches: DataFrame, texts: DataFrame, seed: int, paths: list[str]) -> DataFrame | None:
    """(whole, first): the smallest id of each text that several rows have; None if two texts have the same hashes.

    ``sketches`` has of each row the length ``chars`` and ``blocks``; ``texts`` has ``id`` (any ordered type) and ``text``.
    """
    rows = _not_alone(sketches.select(F.col("chars").alias("key"), "blocks", "whole"))
    r = 0
    while True:
        rows = _saved(rows, "audit-parts", paths)
        if not rows.where(F.size("blocks") > r).limit(1).count():
            break
        rows = _not_alone(rows.withColumn("key", refined(F.col("key"), F.get("blocks", F.lit(r)))))
        r += 1
    keyed = texts.select("id", "text", _whole(F.length("text"), block_hashes(F.col("text"), seed)).alias("whole"))
    alive = _saved(rows.select("whole").distinct(), "audit-alive", paths)
    full = keyed.join(F.broadcast(alive) if alive.count() <= BROADCAST_KEYS else alive, "whole", "left_semi").groupBy("whole", "text").agg(F.min("id").alias("first"))
    each = _saved(full.groupBy("whole").agg(F.count("*").alias("n"), F.min("first").alias("first")), "audit-firsts", paths)
    return None if each.where("n > 1").limit(1).count() else each.select("whole", "first")


def masks(df: DataFrame, fails: dict[str, Column], id_col: str, text_col: str, part: Column, duplicates: str | None, paths: list[str]) -> DataFrame:
    """(id, part, mask): bit i of the mask is set where the row fails the i-th filter.

    A condition that is null isn't failed. The filter named ``duplicates`` fails rows whose
    text (null: empty) a smaller id also has; a row without an id is no duplicate, and none is one of it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, (name, c) in enumerate(fails.items()) if name != duplicates), F.lit(0))
    known = [F.col(f"`{id_col}`").alias("id"), part.alias("part"), bits.alias("mask")]
    if duplicates is None:
        return df.select(*known)
    texts = df.select(known[0], text.alias("text"))
    for seed in range(SEEDS):
        sketched = df.select(*known, F.length(text).cast("long").alias("chars"), block_hashes(text, seed).alias("blocks"))
        sketches = _saved(sketched.withColumn("whole", _whole(F.col("chars"), F.col("blocks"))), "audit-sketches", paths)
        if (first := firsts(sketches, texts, seed, paths)) is not None:
            break
    else:
        raise ValueError(f"texts that differ share all block hashes under {SEEDS} seeds")
    bit = 1 << list(fails).index(duplicates)
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return sketches.join(first, "whole", "left").select("id", "part", (F.col("mask") + F.when(later, bit).otherwise(0)).alias("mask"))


def _total(cells: Column, what: str, chosen) -> Column:
    return F.aggregate(F.filter(cells, chosen), F.lit(0).cast("long"), lambda s, x: s + x[what])


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """Every order and step of the filters from counts of masks: (part, mask, n, good, toxic), at most 2 ** len(names) rows a part.

    ``names`` has one letter a filter. A part has a row an order and step, zeros included. The
    number of orders is the factorial of the number of filters, so up to seven are taken.
    """
    if not 1 <= len(names) <= 7 or len(set(names)) < len(names):
        raise ValueError("between one and seven filters, a letter each")
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(names)))
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(x), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))

    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
    rows = rows.withColumn("bit", bits(F.col("letter"))).withColumn("prior", bits(F.col("before")))
    c, bit, prior = F.col("cells"), F.col("bit"), F.col("prior")
    has = lambda m, b: m["mask"].bitwiseAND(b) != 0
    here = lambda m: has(m, bit) & ~has(m, prior)
    # Of all orders, a row that fails k filters is removed by each of them in every k-th.
    n_orders = 1
    for k in range(2, len(names) + 1):
        n_orders *= k
    shapley = F.aggregate(F.filter(c, lambda m: has(m, bit)), F.lit(0).cast("long"), lambda s, m: s + m["n"] * (F.lit(n_orders) / F.bit_count(m["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        _total(c, "n", lambda m: ~has(m, bit) & ~has(m, prior)).alias("kept"),
        _total(c, "n", here).alias("removed"),
        _total(c, "n", lambda m: has(m, bit) & has(m, prior)).alias("redundant"),
        _total(c, "n", lambda m: m["mask"] == bit).alias("unique_fails"),
        _total(c, "good", here).alias("good_lost"),
        _total(c, "toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def measured(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """The five standard filters: df with what they measure, and each one's condition of failing; E, duplicates, is found by ``masks``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts, n, distinct = (f"__audit_{x}" for x in ("parts", "words", "distinct"))
    # White space at either end leaves an empty part there, and at no other place.
    first, last = F.get(parts, F.lit(0)) == "", F.get(parts, F.size(parts) - 1) == ""
    out = df.withColumn(parts, F.split(text, "[\\x20\\x09-\\x0D]+"))
    out = out.withColumn(n, F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int"))
    out = out.withColumn(distinct, F.size(F.array_distinct(parts)) - (first | last).cast("int")).drop(parts)
    return out, {
        "A": F.col(n) < 200,
        "B": 100 * F.col(distinct).cast("long") < 50 * F.col(n).cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
        "E": F.lit(None).cast("boolean"),
    }


def audit(df: DataFrame, labels: DataFrame, fails: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", duplicates: str | None = "E") -> DataFrame:
    """A row for each part, order of the filters and step of the order.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley). ``fails`` maps a letter to the condition of failing that filter;
    the letter ``duplicates`` stands for the table-wide test of equal texts. Null texts are
    empty, a null part is the empty string. A row is good or toxic if any label of its id
    says so; rows without an id or label are neither. Rows that repeat id and text are no
    duplicates of each other, since neither id is smaller. No rows give no parts.
    """
    if fails is None:
        df, fails = measured(df, text_col)
    names, paths = "".join(fails), []
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    try:
        rows = masks(df, fails, id_col, text_col, part, duplicates, paths)
        known = labels.select(F.col(f"`{id_col}`").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")).where("good OR bad")
        known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
        tally = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
        counted = rows.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), tally("good").alias("good"), tally("bad").alias("toxic"))
        counts = _saved(counted, "audit-masks", [])  # a few rows a part, which the result reads
    finally:
        for path in paths:
            discard(df.sparkSession, path)
    return interactions(counts, names)
