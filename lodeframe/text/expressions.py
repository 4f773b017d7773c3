"""Text rules as column expressions; none of them runs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark English, and the scripts by their Unicode block names.
ENGLISH = "a an and are as at be by for from has have in is it of on or that the this to was were with".split()
SCRIPTS = ("Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Arabic", "Latin")
# Common words of Hindi in Latin letters.
ROMAN_HINDI = "kya hai mein ka ki ke se ko ne par hain kaun chahiye aur nahi nahin kahan kaise".split()
# Words that don't count as search terms.
STOP = "what which are is the a an of for in and to does please explain tell me about क्या कौन है हैं के की का में और बताएं नियम".split()
# Cues of sentences that state a fact, a unit or an assumption.
FACTS = r"(?iU)\b(defin(?:e|es|ed|ition)|assum(?:e|es|ed|ption)|unit|means|refers to|denotes|treated as|calculated as|measured in|is in|reported in|inr|usd|eur|rupees?|percent(?:age)?|kilograms?|kg|kilometers?|km|miles?|hours?|days?|months?|years?)\b|है का अर्थ|मान लिया|इकाई"
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def sentences(text: Column) -> Column:
    """Sentences by end marks before white space, or by lines; trimmed, none empty."""
    parts = F.split(F.trim(text), r"(?<=[.!?।॥])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, longer than two and not numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{Nd}+$")))


def script_counts(text: Column) -> Column:
    """map<script, letters> of the scripts at hand that occur."""
    pairs = F.array(*(F.struct(F.lit(s).alias("k"), F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("v")) for s in SCRIPTS))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def dominant_script(text: Column) -> Column:
    """The script with most letters, any other before Latin; null without letters."""
    entries = F.map_entries(script_counts(text))
    others = F.filter(entries, lambda e: e["key"] != "Latin")
    best = lambda xs: F.array_sort(F.transform(xs, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("s"))))
    return F.when(F.size(others) > 0, F.get(best(others), F.lit(0))["s"]).otherwise(F.get(best(entries), F.lit(0))["s"])


def script_language(text: Column) -> Column:
    """hi-IN for Devanagari alone, en-IN for Latin alone with two English words in the first 500, else und."""
    foreign = F.regexp_count(text, F.lit(r"[\p{L}&&[^\p{IsLatin}\p{IsDevanagari}]]"))
    latin, hindi = (F.regexp_count(text, F.lit(rf"[\p{{L}}&&\p{{Is{s}}}]")) for s in ("Latin", "Devanagari"))
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), 1, 500)
    marks = F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))
    return F.when((foreign == 0) & (hindi > 0) & (latin == 0), "hi-IN").when((foreign == 0) & (latin > 0) & (hindi == 0) & (marks >= 2), "en-IN").otherwise("und")


def romanised_hindi(text: Column) -> Column:
    """Whether two words and a quarter of all are Hindi in Latin letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    n = F.size(F.filter(words, lambda w: w.isin(*ROMAN_HINDI)))
    return (n >= 2) & (n / F.greatest(F.size(words), F.lit(1)) >= 0.25)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def clean_spaces(text: Column) -> Column:
    """Runs of spaces as one, no NUL; tabs and line ends stay."""
    return F.regexp_replace(F.translate(text, "\0", ""), " {2,}", " ")


def redact(text: Column, secrets: list[str] = ()) -> Column:  # type: ignore[assignment]
    """Masks given secrets, bearer tokens and the credentials in urls."""
    for s in sorted(set(secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    text = F.regexp_replace(text, r"(?i)Bearer\s+\S+", "Bearer [redacted]")
    return F.regexp_replace(text, r"(?i)([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", "$1[redacted]@")


def contains_secret(text: Column, secrets: list[str]) -> Column:
    out = F.lit(False)
    for s in secrets:
        out = out | F.contains(text, F.lit(s))
    return out


def unit_present(text: Column, unit: str) -> Column:
    """The unit's code as a word, or its symbol."""
    symbol = {"GBP": "£", "INR": "₹", "EUR": "€"}.get(unit.upper())
    found = text.rlike(rf"(?iU)(?<!\w)\Q{unit}\E(?!\w)")
    return found | F.contains(text, F.lit(symbol)) if symbol else found


def numeric_claims(text: Column) -> Column:
    """Number literals as text without their grouping."""
    plain = F.regexp_replace(text, r"\[(?:evidence|artifact):[^\]]+\]", "")
    plain = F.regexp_replace(plain, "(?<=[0-9])[\\u00a0\\u202f\\u2009](?=[0-9]{2,3}(?![0-9]))", "")
    found = F.regexp_extract_all(plain, F.lit(r"(?<![\w/-])-?\d[\d,]*(?:\.\d+)?(?![\w/-])"), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def normal(text: Column) -> Column:
    """Lower case, white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compress(text: Column, query: str) -> Column:
    """The sentences that hold one of the query's terms, verbatim; the whole text if none does."""
    wanted = sorted({w.casefold().strip("?,।.") for w in query.split()} - set(STOP) - {""})
    parts = F.split(text, r"(?<=[.!?।])\s+|\n+")
    kept = F.filter(parts, lambda s: F.exists(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"), lambda w: F.contains(F.lower(s), w)))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(text)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, a path of at least /, no fragment; null for other schemes, credentials or ports.

    Hosts beyond ASCII are null here, as international names need a library.
    """
    g = lambda i: F.regexp_extract(url, r"^([A-Za-z]+)://([A-Za-z0-9.-]+)(:80|:443)?((?:/[^?#]*)?)(\?[^#]*)?(#.*)?$", i)
    return F.when(F.lower(g(1)).isin("http", "https") & (g(2) != ""), F.concat(F.lower(g(1)), F.lit("://"), F.lower(g(2)), g(3), F.when(g(4) == "", "/").otherwise(g(4)), F.when(g(5) == "?", "").otherwise(g(5))))


def links(html: Column, most: int = 1000) -> Column:
    """Targets of anchors, in order, so many at the most."""
    return F.slice(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)), 1, most)


# --- table cells
_CURRENCY = r"(?i)^\s*(?:INR|USD|EUR|GBP|₹|\$|€|£)\s*|\s*(?:INR|USD|EUR|GBP|₹|\$|€|£)\s*$"
_GROUPED = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})*,\d{3})(?:\.\d+)?$"


def table_value(raw: Column, identifier: bool = False) -> Column:
    """struct<kind, value>: null, boolean, date, text, integer or number, with grouped digits and currencies read."""
    v = F.regexp_replace(raw, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(v, _CURRENCY, ""), _CURRENCY, "")
    digits = F.when(bare.rlike(_GROUPED), F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)
    number = digits.rlike(r"^[+-]?\d+(\.\d+)?$") & ~F.lit(identifier) & ~v.rlike(r"^0\d+$")
    whole = number & digits.rlike(r"^[+-]?\d+(\.0+)?$")
    as_whole = F.regexp_replace(F.regexp_replace(digits, r"\.0+$", ""), r"^\+", "")
    kind = F.when(v.isNull() | (v == ""), "null").when(F.lower(v).isin("true", "yes", "false", "no"), "boolean").when(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull(), "date").when(whole, "integer").when(number, "number").otherwise("text")
    value = F.when(kind == "null", None).when(kind == "boolean", F.when(F.lower(v).isin("true", "yes"), "true").otherwise("false")).when(kind == "integer", as_whole).when(kind == "number", F.regexp_replace(digits, r"^\+", "")).otherwise(v)
    return F.struct(kind.alias("kind"), value.alias("value"))


def invalid_grouping(v: Column) -> Column:
    """A number by its characters whose commas don't group it."""
    bare = F.regexp_replace(F.regexp_replace(v, _CURRENCY, ""), _CURRENCY, "")
    return F.contains(v, F.lit(",")) & v.rlike(r"^[+\-\d.,\s₹$€£]+$") & ~bare.rlike(_GROUPED)


def currency(v: Column) -> Column:
    code = F.upper(F.regexp_extract(v, r"(?i)^\s*(INR|USD|EUR|GBP)\b", 1))
    return F.when(code != "", code).when(F.contains(v, F.lit("₹")), "INR").when(F.contains(v, F.lit("$")), "USD").when(F.contains(v, F.lit("€")), "EUR").when(F.contains(v, F.lit("£")), "GBP")


# What a translation must leave as it is, its placeholders, and fonts with encodings of their own.
_PROTECTED = r"```[\s\S]*?```|`[^`\n]+`|https?://[^\s)>]+|\b[A-Z][A-Z0-9_]{1,}\b|\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b|\b\d[\d,._:/%-]*(?:\s?(?:INR|USD|Rs\.?|₹|%|kg|km|years?))?\b|\[\^?[\w.-]+\]|\b(?:[A-Z]{2,}[0-9]+|[A-Za-z]+_[A-Za-z0-9_]+)\b"
PLACEHOLDER = "⟦kept%04d⟧"
LEGACY_FONTS = r"(?i)(?:chanakya|kruti\s*dev|devlys|shusha|aps\s*dv|krutidev)"


def protect(text: Column) -> Column:
    """struct<text, originals>: literals, links, names and numbers as placeholders, numbered from 0, and what they stand for."""
    originals = F.regexp_extract_all(text, F.lit(_PROTECTED), F.lit(0))
    between = F.split(text, _PROTECTED, -1)
    pieces = F.transform(between, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.format_string(PLACEHOLDER, i - 1), part)))
    return F.struct(F.array_join(pieces, "").alias("text"), originals.alias("originals"))


def restore(text: Column, originals: Column) -> Column:
    """The text with its originals; null where a placeholder is missing or there twice."""
    token = lambda i: F.format_string(PLACEHOLDER, i)
    places = F.transform(originals, lambda o, i: F.struct(i.alias("i"), o.alias("o")))
    whole = F.forall(places, lambda p: F.length(text) - F.length(F.replace(text, token(p["i"]), F.lit(""))) == F.length(token(p["i"])))
    return F.when(whole, F.aggregate(places, text, lambda t, p: F.replace(t, token(p["i"]), p["o"])))


def legacy_font(name: Column) -> Column:
    """The font's name without slash and subset prefix if its family has an encoding of its own, else null."""
    bare = F.regexp_replace(F.regexp_replace(name, "^/+", ""), r"^[A-Z]{6}\+", "")
    return F.when(bare.rlike(LEGACY_FONTS), bare)
