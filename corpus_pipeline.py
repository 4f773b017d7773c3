"""A training corpus from raw documents: five stages, each written and read again.

toxicity drops documents; line_dedup shortens texts, and drops documents that it leaves
nothing of; near_duplicates keeps one document of each group; decontamination drops
contaminated documents; bpe turns texts into token ids. All but the last return the columns
of documents, and each works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import bpe, decontam, jaccard, lines, toxicity
from lodeframe.llm.queries import vocabulary
from lodeframe.llm.shared import table, written

#: Row numbers up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


#: Columns that stages add for themselves alone; a column of the documents that is called so gives way.
ROW, SCORE, MARKS = "__row", "__score", ("__lines", "__dropped", "__kept")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row; written, so that every read gives the same numbers."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered docs without these rows, and without the numbers: ids may be null or repeat."""
    rows = written(rows.select(ROW), "dropped")
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ROW, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, by a model fitted on the labelled ones that aren't held out.

    Null and empty texts have no toxic word and stay, rows that repeat an id are each judged, and no rows give none.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns, name=SCORE).where(F.col(SCORE) < 0.5).drop(SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that recur across documents; a document goes if only blanks are left of it.

    Only near duplicates of one document keep such lines: the next stage drops them as a whole.
    Null and empty texts stay as they are, rows that repeat an id are documents of their own, and no rows give none.
    """
    marked = lines.mark(docs, tested=True, names=MARKS)
    dropped, kept = F.col(MARKS[1]), F.col(MARKS[2])
    left = marked.where((dropped == 0) | (F.trim(kept, F.lit(" \t\r\n")) != ""))
    return left.withColumns({"text": kept, "n_chars": F.when(dropped > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, null after all others.

    Texts without words are near nothing and stay; of rows that repeat id and text one stays; no rows give none.
    """
    docs = numbered(docs)
    found = jaccard.groups(docs, ROW)
    several = found.where(F.col(ROW) != F.col("component_id")).select("component_id").distinct()
    members = docs.select(ROW, "doc_id").join(found.join(several, "component_id").select(ROW, "component_id"), ROW)
    members = written(members, "near-duplicates")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return without(docs, members.join(first, "component_id").where(F.col(ROW) != F.col(f"first.{ROW}")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of test items.

    Null and empty texts stay, each row is judged for itself, and without items all stay.
    """
    docs = numbered(docs)
    found = decontam.judged(decontam.contamination(docs, table(spark, sf_dir, "benchmark"), ROW))
    return without(docs, found.where("contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row; null and empty texts have no tokens."""
    return bpe.encode_checked(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Neither a fitted model nor merges by rank can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
