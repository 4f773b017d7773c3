"""Secret scans in DataFrame functions alone.

Three known forms are found by pattern. Besides, every long token goes through a
battery of randomness tests for the encoding it seems to be in: a chi-squared test of
its alphabet's uniformity, a runs test about the alphabet's middle, and the serial
correlation of neighbours. A secret is one that the battery can't tell from random
symbols while it would have told words of that length: the rejections are decided
over all tokens of the table at a false-discovery rate, after the rate that a token's
length leaves to miss a word has been bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import written

# The known forms, in the order in which they are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of these two are as long as can be, so a bound within the pattern finds the same ones.
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))

#: A token for the battery: symbols of any of the encodings, and no shorter than this.
LEAST = 20
TOKEN = r"([A-Za-z0-9+/_-]{20,})"
#: Encodings by the first pattern that fits: name, pattern, symbols in order.
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hexu", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper", "^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: The share of truly random tokens that may be dismissed, among all that are.
RATE = 0.05
#: Chance that two symbols of a word are equal: about 0.065 in the languages at hand.
WORD_COLLISIONS = 0.06
#: Lengths whose tokens are decided together.
CLASSES = (32, 48, 64)
#: Elements that are added up or passed over together.
BLOCK = 64
_SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,word:string>>"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _blocks(xs: Column, of) -> Column:
    """of(block, number) for each block of BLOCK elements of an array that isn't empty."""
    numbers = F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1)
    return F.transform(numbers, lambda k: of(F.slice(xs, k * BLOCK + 1, BLOCK), k))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda total, x: total + x)


def sums_before(xs: Column) -> Column:
    """For each of some integers the sum of those before it, by sums of blocks: no array grows step by step."""

    def placed(given: Column) -> Column:
        ahead = lambda part, k: F.transform(part, lambda _, i: given["ahead"][k] + _total(F.slice(part, 1, i)))
        return F.flatten(_blocks(given["xs"], lambda block, k: _let(block, lambda part: ahead(part, k))))

    def summed(values: Column) -> Column:
        sums = _blocks(values, lambda block, _: _total(block))
        ahead = _let(sums, lambda totals: F.transform(totals, lambda _, k: _total(F.slice(totals, 1, k))))
        return _let(F.struct(values.alias("xs"), ahead.alias("ahead")), placed)

    return F.when(F.size(xs) > 0, _let(xs, summed)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, no: int, kind: str, pattern: str, least: int) -> Column:
    """Leftmost matches whose group has ``least`` characters, as structs by start.

    The pieces that a split leaves between the matches give their places, in code points.
    """
    whole, word = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pairs = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(whole.alias("all"), word.alias("word")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m["all"]), F.lit(0)).alias("all"), m["word"].alias("word")))

    def spans(found: Column) -> Column:
        before = sums_before(F.transform(found, lambda m: m["gap"] + m["all"]))
        start = lambda m, at: at + m["gap"]
        return F.zip_with(found, before, lambda m, at: F.struct(start(m, at).alias("start"), F.lit(no).alias("kind_no"), (start(m, at) + m["all"]).alias("end"), F.lit(kind).alias("kind"), m["word"].alias("word")))

    found = F.filter(_let(pairs, spans), lambda s: F.length(s["word"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that touch no span of base; blocks of spans that end before a token or start after it are passed over."""
    meets = lambda t, lo, hi: (lo < t["end"]) & (t["start"] < hi)

    def free(blocks: Column) -> Column:
        touched = lambda t: F.exists(blocks, lambda b: meets(t, b["lo"], b["hi"]) & F.exists(b["spans"], lambda s: meets(t, s["start"], s["end"])))
        return F.filter(tokens, lambda t: ~touched(t))

    ranges = _blocks(base, lambda block, _: _let(block, lambda part: F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(part, lambda s: s["end"])).alias("hi"), part.alias("spans"))))
    return F.when(F.size(base) > 0, _let(ranges, free)).otherwise(tokens)


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by a rational approximation that is good to 1e-7."""

    def tail(v: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        p = F.exp(-v * v / 2) / math.sqrt(2 * math.pi) * poly
        return F.when(v >= 0, p).otherwise(1 - p)

    return _let(z, lambda v: _let(1 / (1 + 0.2316419 * F.abs(v)), lambda t: tail(v, t)))


def _sum(xs: Column, of) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda total, x: total + of(x))


def battery(word: Column) -> Column:
    """struct<n, size, p>: length, size of the inferred alphabet, and p-value of the battery for random symbols.

    p is three times the least p-value of the three tests, and 1 at the most. Sums go over the
    distinct symbols and their counts where they can.
    """
    word = F.translate(word, "-_", "+/")
    coded = None
    for _, fits, symbols in reversed(ENCODINGS):
        low = -(-len(symbols) // 2)
        found = F.struct(F.lit(symbols).alias("abc"), F.translate(word, symbols, "0" * low + "1" * (len(symbols) - low)).alias("halves"), word.alias("word"))
        coded = found if coded is None else F.when(word.rlike(fits), found).otherwise(coded)

    def placed(g: Column) -> Column:
        x = F.transform(F.split(g["word"], ""), lambda c: F.position(c, g["abc"]) - 1)
        return F.struct(F.length(g["abc"]).cast("double").alias("size"), F.length(g["word"]).cast("double").alias("n"), g["halves"].alias("halves"), x.alias("x"))

    def counted(g: Column) -> Column:
        counts = F.transform(F.array_distinct(g["x"]), lambda s: F.struct(s.cast("double").alias("s"), (g["n"] - F.size(F.array_remove(g["x"], s))).alias("c")))
        return F.struct(*(g[k].alias(k) for k in ("size", "n", "halves", "x")), counts.alias("counts"))

    def summed(g: Column) -> Column:
        x, counts = g["x"], g["counts"]
        both = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b)
        runs = F.length(F.regexp_replace(F.regexp_replace(g["halves"], "0+", "0"), "1+", "1"))
        sums = {
            "squares": _sum(counts, lambda k: k["c"] * k["c"]),
            "total": _sum(counts, lambda k: k["c"] * k["s"]),
            "own": _sum(counts, lambda k: k["c"] * k["s"] * k["s"]),
            "both": _sum(both, lambda v: v),
            "ends": x[0] + F.element_at(x, -1),
            "high": F.length(F.replace(g["halves"], F.lit("0"), F.lit(""))).cast("double"),
            "runs": runs.cast("double"),
        }
        return F.struct(g["n"].alias("n"), g["size"].alias("size"), *(v.alias(k) for k, v in sums.items()))

    def tested(g: Column) -> Column:
        n, size, high, m = g["n"], g["size"], g["high"], g["total"] / g["n"]
        uniform = upper_tail((size / n * g["squares"] - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
        mean = 2 * high * (n - high) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        halves = F.when((high == 0) | (high == n), F.pow(F.lit(2.0), 1 - n)).when(spread <= 0, 1.0).otherwise(2 * upper_tail(F.abs(g["runs"] - mean) / F.sqrt(spread)))
        own = g["own"] - n * m * m
        r = (g["both"] - m * (2 * g["total"] - g["ends"]) + (n - 1) * m * m) / F.when(own > 1e-9, own)
        neighbours = F.coalesce(2 * upper_tail(F.abs((r + 1 / n) * F.sqrt(n))), F.lit(0.0))
        return F.struct(n.cast("int").alias("n"), size.alias("size"), F.least(F.lit(1.0), 3 * F.least(uniform, halves, neighbours)).alias("p"))

    return _let(_let(_let(_let(coded, placed), counted), summed), tested)


def tells_words(n: Column, size: Column) -> Column:
    """Whether a word of n symbols would stand out from random ones: its expected chi-squared is 3 deviations off."""
    same = F.greatest(F.lit(WORD_COLLISIONS), 2 / size)
    return (size * (same * (n - 1) + 1) - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n) >= 3


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, most in enumerate(CLASSES):
        out = F.when(n >= most, i + 1).otherwise(out)
    return out


def dismissals(tokens: DataFrame, rate: float) -> dict[int, int]:
    """Per class of lengths, the least bin of p-values that is dismissed as not random.

    Benjamini and Hochberg's step-up rule on a histogram of 2,001 bins of -20 ln p a
    class, so that neither ranks nor rows of all tokens meet in one place.
    """
    from pyspark.sql import Window

    counts = tokens.groupBy("class", "bin").agg(F.count("*").alias("c"))
    of = Window.partitionBy("class")
    ranked = counts.withColumn("k", F.sum("c").over(of.orderBy(F.desc("bin")))).withColumn("m", F.sum("c").over(of))
    low = ranked.where(F.exp(-F.col("bin") / 20) <= rate * F.col("k") / F.col("m")).groupBy("class").agg(F.min("bin").alias("bin"))
    return {r["class"]: r["bin"] for r in low.collect()}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Finds secrets in whole texts: (id, spans array<struct<start,kind_no,end,kind>>) for each row.

    Spans are in code points, end exclusive, sorted by start, then kind as listed. Kinds
    0 to 2 are the known forms; kind 3, random, is a token that touches none of these
    and that the battery holds to be random. Null and empty texts have no spans; repeated
    rows are each scanned; no rows give no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = F.concat(*(matches(text, i, *k) for i, k in enumerate(KINDS)))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), base.alias("base"), matches(text, 3, "random", TOKEN, LEAST).alias("tokens"))
    free = apart(F.col("tokens"), F.col("base"))

    def judged(t: Column) -> Column:
        return _let(
            battery(t["word"]),
            lambda b: F.struct(t["start"].alias("start"), t["end"].alias("end"), length_class(b["n"]).alias("class"), F.floor(F.least(F.lit(2000.0), -20 * F.log(F.greatest(b["p"], F.lit(1e-300))))).cast("int").alias("bin"), tells_words(b["n"], b["size"]).alias("told")),
        )

    rows = rows.withColumn("tokens", free).withColumn("tokens", F.transform("tokens", judged))
    rows = written(rows.withColumn("base", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"), b["end"].alias("end"), b["kind"].alias("kind")))), "secret-spans")
    cuts = dismissals(rows.select(F.explode("tokens").alias("t")).select("t.class", "t.bin"), rate)

    def kept(t: Column) -> Column:
        cut = F.lit(2001)
        for no, least in cuts.items():
            cut = F.when(t["class"] == no, least).otherwise(cut)
        return t["told"] & (t["bin"] < cut)

    random = F.transform(F.filter("tokens", kept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind_no"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", random)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
