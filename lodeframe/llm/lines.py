"""Line deduplication by a log-template tree, in DataFrame functions alone.

A line goes down a tree of fixed depth: first by its number of tokens, then by its
leading tokens, where a token with a digit is a variable field. At the leaf stand
templates: the line with its variable fields, and, for lines that are long enough, the
line with one of three parts of its rest left open. Lines of several documents at one
template are the same line with other values; all but those of the first document go.
A template is kept as hashes of its parts, so that each token is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import written

#: Leading tokens on the way down the tree; parts of the rest that may vary.
DEPTH, PARTS = 3, 3
#: Lines with fewer tokens, or fewer fixed ones, are a template as they stand; open parts need LONG fixed tokens.
LEAST, FIXED, LONG = 4, 3, 12
#: A document that would lose more than this share of its words may be a copy as a whole.
SHARE = 0.5
#: What near-duplicate detection takes for near: words of a gram, and percent of the grams of both.
GRAM, SIMILAR = 5, 80
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(line: Column) -> Column:
    """Tokens of a line that has single spaces between them."""
    return F.split(line, " ")


def masked(line: Column) -> Column:
    """The line with <*> for each token with a digit. No place is looked at twice, however long a token is."""
    return F.regexp_replace(line, r"(?<![^ ])[^0-9 ]*+[0-9][^ ]*+", "<*>")


def line_rows(rows: DataFrame, doc: Column, text: Column) -> DataFrame:
    """(doc, line, text) of every line with tokens; space, tab and return between tokens are one space."""
    single = F.regexp_replace(text, r"[ \t\r]{2,}|[\t\r]", " ")
    lines = rows.select(doc.alias("doc"), F.posexplode(F.split(single, "\n")).alias("line", "raw"))
    return lines.select("doc", "line", F.trim("raw").alias("raw")).where("raw <> ''")


def templates(lines: DataFrame) -> DataFrame:
    """(doc, line, words, a, b): a row for each template that a line stands for, under two hashes."""
    cut = lines.select("doc", "line", "raw", tokens(masked(F.col("raw"))).alias("t"))
    cut = cut.select("doc", "line", "raw", "t", F.size("t").alias("n"), F.size(F.array_remove("t", "<*>")).alias("fixed"))
    n = F.col("n")
    cuts = [F.lit(0), *(F.least(n, F.lit(DEPTH)) + F.floor(F.greatest(n - DEPTH, F.lit(0)) * i / PARTS).cast("int") for i in range(PARTS + 1))]
    pieces = [F.slice("t", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = cut.select("doc", "line", "raw", "n", "fixed", *(f(p).alias(f"{name}{i}") for i, p in enumerate(pieces) for name, f in (("x", F.xxhash64), ("y", F.hash))))
    key = lambda kind, of: F.struct(F.xxhash64(F.lit(kind), n, *(f"x{i}" for i in of)).alias("a"), F.hash(F.lit(kind), n, *(f"y{i}" for i in of)).alias("b"))
    every = range(PARTS + 1)
    whole, opened = key(0, every), [key(k, [i for i in every if i != k]) for k in range(1, PARTS + 1)]
    exact = F.struct(F.xxhash64("raw", "n").alias("a"), F.hash("raw", "n").alias("b"))
    found = F.when((n < LEAST) | (F.col("fixed") < FIXED), F.array(exact)).when(F.col("fixed") < LONG, F.array(whole)).otherwise(F.array(whole, *opened))
    return parts.select("doc", "line", F.col("n").alias("words"), F.inline(found))


def shingles(text: Column) -> Column:
    """Hashes of the text's distinct five-word grams, as near-duplicate detection takes its words; of all words if they are fewer."""
    words = F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), r"[ \t-\r]+"), lambda w: w != "")
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - GRAM, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, GRAM))))
    return F.transform(F.array(words), grams)[0]


def near_copies(rows: DataFrame, gone: DataFrame, text: Column) -> DataFrame:
    """(__rid, __copy) of the documents that are near duplicates of what stays of their __owner.

    Looked at are those that would lose more than SHARE of their words, though not all lines. The
    test is that of near-duplicate detection: five-word grams and a Jaccard similarity of 0.8. An
    owner that is looked at itself doesn't count, as it may lose lines too, and a null
    id doesn't, as near-duplicate detection drops none.
    """
    sizes = rows.select("__doc", "__all", "__size")
    likely = (F.col("__words") > SHARE * F.col("__all")) & (F.size("__gone") < F.col("__size"))
    found = written(gone.join(sizes, "__doc").where(likely).select(F.col("__doc.rid").alias("a"), F.col("__owner").alias("b"), (~F.col("__doc.none")).alias("named")), "line-copies")
    pairs = found.where("named").select("a", "b").join(found.select(F.col("a").alias("b")), "b", "left_anti")
    kept = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(left_over(F.split(text, "\n"), F.col("__gone")), "\n"))
    owners = rows.join(pairs.select(F.col("b").alias("__rid")).distinct(), "__rid").join(gone.select("__doc", "__gone"), "__doc", "left").select(F.col("__rid").alias("b"), shingles(kept).alias("of_owner"))
    own = rows.join(pairs, F.col("__rid") == F.col("a")).select("a", "b", shingles(text).alias("own"))
    shared = F.size(F.array_intersect("own", "of_owner"))
    near = own.join(owners, "b").withColumn("shared", shared).where(100 * F.col("shared") >= SIMILAR * (F.size("own") + F.size("of_owner") - F.col("shared")))
    return written(near.select(F.col("a").alias("__rid"), F.lit(True).alias("__copy")), "line-copies")


def left_over(split: Column, gone: Column) -> Column:
    """The lines whose numbers, sorted in gone, aren't listed: whole slices between the listed ones."""

    def slices(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
        ends = F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))

    # Within a lambda a column is made anew for each element, a variable isn't.
    return F.transform(F.array(split), slices)[0]


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tested: bool = False, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """Adds to each row: n_lines, n_dropped, and kept, the text without its recurring lines.

    A line goes if an earlier document, by id (null after all others), then by a hash of
    the text, has a line of one of its templates. Lines that recur within one document alone
    stay, and so do lines without tokens. Null texts have no lines and stay null; an empty
    text is one empty line. Rows that repeat an id with other texts are documents of their own,
    rows that repeat both are one. No rows give no rows. Columns that are called like the
    new ones (``names``) give way to them.

    With ``tested`` a document that would lose more than half of its words keeps all its
    lines if it is a near duplicate of what stays of the document that most of its
    recurring words are from. Rows are then numbered in a written copy, and each is a document.
    """
    rid = "__rid"
    text = F.col(f"`{text_col}`")
    # A number must be the same whenever it is read, so it is written; else the text itself is the key.
    if tested:
        sizes = {"__all": F.size(F.split(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), " ")), "__size": F.size(F.split(text, "\n"))}
        rows = written(df.withColumns({rid: F.monotonically_increasing_id(), **sizes}), "line-rows")
    else:
        rows = df.withColumn(rid, F.xxhash64(text))
    rows = rows.withColumn("__doc", F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(rid).alias("rid")))
    keyed = written(templates(line_rows(rows, F.col("__doc"), text)), "line-templates")
    # First and last document are combined before the shuffle, however often a template recurs.
    seen = keyed.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first <> final").drop("final")
    gone = keyed.join(seen, ["a", "b"]).where("doc <> first")
    if tested:
        gone = gone.groupBy("doc", "line").agg(F.first("words").alias("words"), F.min("first").alias("owner"))
        gone = gone.groupBy("doc", F.col("owner.rid").alias("owner")).agg(F.sum("words").alias("words"), F.collect_list("line").alias("lines"))
        gone = gone.groupBy("doc").agg(F.sum("words").alias("__words"), F.sort_array(F.flatten(F.collect_list("lines"))).alias("__gone"), F.max_by("owner", F.struct("words", "owner")).alias("__owner"))
        gone = written(gone.withColumnRenamed("doc", "__doc"), "line-gone")
    else:
        gone = gone.groupBy(F.col("doc").alias("__doc")).agg(F.sort_array(F.collect_set("line")).alias("__gone"))
    joined = rows.join(gone, "__doc", "left")
    split = F.split(text, "\n")
    left = F.array_join(left_over(split, F.col("__gone")), "\n")
    if tested:
        joined = joined.join(near_copies(rows, gone, text), rid, "left")
        joined = joined.withColumn("__gone", F.when(F.col("__copy").isNull(), F.col("__gone")))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    added = dict(zip(names, (n_lines.cast("long"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"), F.when(F.col("__gone").isNull(), text).otherwise(left)), strict=True))
    return joined.select(*(f"`{c}`" for c in df.columns if c not in names), *(c.alias(name) for name, c in added.items()))
