"""Toxicity from misspelling-tolerant lexicon hits and the context that they stand in.

The lexicon is learnt: terms that labelled toxic texts hold far more often than others.
A word is looked up by walking the lexicon's trie together with the word's Levenshtein
automaton, so that every term within its tolerance is found. Hits are then read in
their window of words: quotation marks and words of reporting around a hit speak for a
quotation, other hits and words of address near it for abuse. A logistic regression
on those window scores gives the probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.shared import released, rows_of, slices, written
from lodeframe.llm.words import alnum_words

#: Labelled rows that the model is fitted on, at the most: those with the least hash of their id.
FIT_ROWS = 20_000
#: The log-likelihood ratio (G-squared) that a term of the lexicon needs. FIT_ROWS bounds how many words can have it.
EVIDENCE = 20.0
#: How much more often toxic texts hold a term.
TIMES = 2.0
#: Letters of a stem, which stands for all words that begin so.
STEMS = (5, 4)
#: Words to each side of a hit that make its context.
WINDOW = 12
# Words of reporting and of address, in the languages at hand.
REPORTING = frozenset("said says wrote writes called quoted quote cited reported according dit écrit appelé selon cité sagte schrieb nannte laut zitiert dijo escribió llamó según citó".split())
ADDRESS = frozenset("you your youre tu vous toi ton votre du dich dein ihr euer tú usted vosotros vuestro".split())
_QUOTES = re.compile("[\"“”„«»‹›]")
_FEATURES = 7
#: Characters of the texts whose words are held at a time.
_SLICE = 1 << 20


def stems(word: str) -> list[str]:
    """The beginnings of a longer word that may be terms of their own: letters and a *."""
    return [word[:k] + "*" for k in STEMS if len(word) > k]


def tolerance(term: str) -> int:
    """Edits that a term forgives: none below five letters or for a stem, two from twelve."""
    return 0 if len(term) < 5 or term[-1] == "*" else 1 if len(term) < 12 else 2


class Trie:
    """Terms as nested dictionaries, one trie for each tolerance and piece; a node's "" holds its term's number.

    Of a term that forgives e edits, cut into e + 1 pieces, one piece stays whole in
    every word that it matches. A word is walked with the tries of its pieces alone.
    """

    def __init__(self, terms: list[str]):
        self.exact: dict[str, int] = {}
        self.roots: dict[tuple[int, int, str], dict] = {}
        self.pieces: dict[int, dict[tuple[int, int, int], dict[str, list[dict]]]] = {}
        for t in terms:
            self.add(t)

    def add(self, t: str) -> None:
        """Puts a new term into the tries of its pieces; its number is that of the terms before it."""
        i = self.exact[t] = len(self.exact)
        if not (e := tolerance(t)):
            return
        cuts = [len(t) * k // (e + 1) for k in range(e + 2)]
        # Terms of one length and piece share a trie, so all of it may match where the piece does.
        own = [self.roots.setdefault((len(t), a, t[a:b]), {}) for a, b in zip(cuts, cuts[1:], strict=False)]
        for node in own:
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
        for size in range(len(t) - e, len(t) + e + 1):
            kept = self.pieces.setdefault(size, {})
            for a, b, root in zip(cuts, cuts[1:], own, strict=False):
                # The first piece stays in its place, the last at the end, others move by e.
                for shift in (0,) if a == 0 else (size - len(t),) if b == len(t) else range(-e, e + 1):
                    found = kept.setdefault((e, a + shift, b + shift), {}).setdefault(t[a:b], [])
                    if not any(root is x for x in found):
                        found.append(root)

    def near(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term within its tolerance, the first of equals.

        A term itself comes first, then the longest stem.
        """
        if (i := self.exact.get(word)) is not None:
            return 0, i
        for stem in stems(word):
            if (i := self.exact.get(stem)) is not None:
                return 0, i
        if not (kept := self.pieces.get(len(word))):
            return None
        possible = {id(root): (root, e) for (e, a, b), found in kept.items() for root in found.get(word[a:b], ())}
        return min(filter(None, (intersect(root, word, e) for root, e in possible.values())), default=None)


def intersect(root: dict, word: str, edits: int) -> tuple[int, int] | None:
    """Walks trie and Levenshtein automaton together: the nearest term within so many edits.

    The automaton's state is a bit vector for each number of edits: bit j says that the
    path so far matches the word's first j letters. A branch whose vectors are all
    empty is left.
    """
    masks: dict[str, int] = {}
    for j, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << j
    full = 1 << len(word)
    all_bits = 2 * full - 1
    start = [1]
    for _ in range(edits):
        start.append((start[-1] << 1 | start[-1]) & all_bits)
    best: tuple[int, int] | None = None
    stack = [(root, tuple(start))]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if not c:
                for e, bits in enumerate(state):
                    if bits & full:
                        best = min(best or (e, child), (e, child))
                        break
                continue
            m, after, last = masks.get(c, 0), [], 0
            for e, bits in enumerate(state):
                new = (bits & m) << 1
                if e:
                    # A letter more in the term, one replaced, or one more in the word.
                    new |= state[e - 1] | state[e - 1] << 1 | last << 1
                last = new & all_bits
                after.append(last)
            if last:
                stack.append((child, tuple(after)))
    return best


def lexicon(found: list[tuple[str, float]]) -> list[str]:
    """The terms to look for, of candidates with their evidence: strongest first, each for what the ones before it miss.

    A stem is a term only if the words it stands for have EVIDENCE beyond that of the strongest of
    them, or of a longer stem. A word that a stronger term catches within its tolerance needs no
    entry of its own.
    """
    strongest: dict[str, float] = {}
    for word, g in found:
        for stem in stems(word.rstrip("*")):
            strongest[stem] = max(strongest.get(stem, 0.0), g)
    trie = Trie([])
    for word, g in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        if word[-1] == "*":
            known = any(stem in trie.exact for stem in stems(word[:-1]))
            if not known and g >= strongest.get(word, 0.0) + EVIDENCE:
                trie.add(word)
        elif trie.near(word) is None:
            trie.add(word)
    return list(trie.exact)


class Lookup(dict):
    """word -> (edits, term number) or None; remembers ``most`` words at the most."""

    def __init__(self, trie: Trie, most: int = 200_000):
        super().__init__()
        self.trie, self.most = trie, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.trie.near(word.decode("utf-8", "replace"))
        return found


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, with a word \\x01 for each quotation mark."""
    if not text:
        return []
    if not text.isascii():
        text = text.lower()
    words: list[bytes] = []
    for i, part in enumerate(_QUOTES.split(text)):
        words += ([b"\x01"] if i else []) + alnum_words(part)
    return words


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    strengths: tuple[float, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


_REPORT = frozenset(w.encode() for w in REPORTING)
_ADDRESS = frozenset(w.encode() for w in ADDRESS)


def context_scores(text: str | None, lookup: Lookup, strengths: tuple[float, ...]) -> list[float]:
    """The features of a text, each a sum or the most over its hits' windows."""
    words = words_of(text)
    found = [(i, *hit) for i, hit in enumerate(map(lookup.__getitem__, words)) if hit]
    if not found:
        return [0.0] * _FEATURES
    marks = [i for i, w in enumerate(words) if w == b"\x01"]
    exact = fuzzy = quoted = most = address = 0.0
    at = np.array([i for i, *_ in found])
    near = np.searchsorted(at, at + WINDOW, "right") - np.searchsorted(at, at - WINDOW)
    inside = np.searchsorted(np.array(marks), at) if marks else np.zeros(len(at), int)
    for (i, edits, term), around, before in zip(found, near.tolist(), inside.tolist(), strict=True):
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        report = any(w in _REPORT for w in window)
        quote = before % 2 == 1 and before < len(marks)
        strength = strengths[term] / (1 + edits)
        if quote or report:
            quoted += strength / (1 + (quote and report))
        elif edits:
            fuzzy += strength
        else:
            exact += strength
        address += any(w in _ADDRESS for w in window)
        most = max(most, strength * math.sqrt(around) * (0.5 if quote or report else 1.0))
    share = 100 * len(found) / len(words)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), most, min(share, 20.0), math.log1p(address), math.log1p(len({t for *_, t in found}))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) by Newton's method."""
    means, scales = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.hstack([(x - means) / scales, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), ridge * len(x) * np.append(np.ones(z.shape[1] - 1), 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-6), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, means, scales


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    return slices((row for batch in batches for row in rows_of(batch, "text", "y")), lambda row: len(row[0] or ""), _SLICE)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns the lexicon and the regression from labelled rows that aren't held out.

    At most ``fit_rows`` labels are used, those with the least hash of their id; a
    document that has several counts as toxic if one of them says so. With labels of
    one kind alone, or none, the model has an intercept and no terms. Equal texts are learnt
    from once, and a word counts once for each pair of neighbours that it first stands between
    in a text: copies of one document are no evidence about all of its words.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # The sample is bounded, so it is broadcast and the documents stay where they are.
    train = texts.join(F.broadcast(sample), "id").groupBy("text").agg(F.max("y").alias("y"))
    train = written(train, "toxicity-train")
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), sum(n for y, n in totals.items() if y != 0)
    if not clean or not toxic:
        p = (toxic + 1) / (toxic + clean + 2)
        return Model((), (), (0.0,) * _FEATURES + (math.log(p / (1 - p)),), (0.0,) * _FEATURES, (1.0,) * _FEATURES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            seen: dict[bytes, list[int]] = {}
            for text, y in part:
                for w in set(words_of(text)) - {b"\x01"}:
                    seen.setdefault(w, [0, 0])[y != 0] += 1
            words = pa.array([w.decode("utf-8", "replace") for w in seen], pa.string())
            yield pa.RecordBatch.from_arrays([words, *(pa.array([n[i] for n in seen.values()], pa.int64()) for i in (1, 0))], ["word", "t", "c"])

    counts = train.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    begun = F.filter(F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS)), lambda s: s.isNotNull())
    counts = counts.select(F.explode(F.concat(F.array("word"), begun)).alias("word"), "t", "c").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # Terms that toxic texts hold more often, and often enough for the evidence, are looked at in their contexts.
    enough = F.col("t") >= EVIDENCE / (4 * math.log((toxic + clean) / toxic))
    likely = counts.where(enough & (F.col("t") * clean > F.col("c") * toxic)).select("word")
    given = docs.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in likely.collect()))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = given.value
        for part in _parts(batches):
            seen: set[tuple[str, int, bool]] = set()
            for text, y in part:
                words = [b"", *words_of(text), b""]
                places: dict[bytes, int] = {}
                for i, w in enumerate(words):
                    places.setdefault(w, i)
                for w, i in places.items():
                    word = w.decode("utf-8", "replace")
                    terms = [t for t in (word, *stems(word)) if t in wanted]
                    if terms:
                        between = xxhash.xxh3_64_intdigest(words[i - 1] + b" " + words[i + 1]) >> 1
                        seen.update((t, between, y != 0) for t in terms)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], ["word", "between", "toxic"])

    counts = train.mapInArrow(spots, "word string, between long, toxic boolean").distinct().groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    share, n = toxic / (toxic + clean), F.col("t") + F.col("c")
    part = lambda seen, expected: F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    evidence = part(F.col("t"), n * share) + part(F.col("c"), n * (1 - share)) + part(toxic - F.col("t"), (toxic + clean - n) * share) + part(clean - F.col("c"), (toxic + clean - n) * (1 - share))
    telling = counts.select("word", odds.alias("odds"), evidence.alias("g")).where((F.col("odds") >= math.log(TIMES)) & (F.col("g") >= EVIDENCE))
    best = {r["word"]: r for r in telling.collect()}
    terms = tuple(lexicon([(w, r["g"]) for w, r in best.items()]))
    strengths = tuple(min(6.0, best[w]["odds"]) * min(1.0, math.sqrt(best[w]["g"]) / 10) for w in terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(Trie(list(terms)))
        for part in _parts(batches):
            made = [context_scores(t, lookup, strengths) for t, _ in part]
            yield pa.RecordBatch.from_arrays([pa.array([y for _, y in part], pa.int32()), pa.array(made, pa.list_(pa.float64()))], ["y", "x"])

    fitted = train.mapInArrow(features, "y int, x array<double>").collect()
    x, y = np.array([r["x"] for r in fitted]), np.array([float(r["y"] != 0) for r in fitted])
    order = np.lexsort((*x.T, y))  # the sums must not hang on the order of tasks
    w, means, scales = logistic(x[order], y[order])
    return Model(terms, strengths, tuple(w.tolist()), tuple(means.tolist()), tuple(scales.tolist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(kept columns, score) for each row; by default the id alone is kept. ``name`` is the score's column.

    Scores are probabilities of label 1. Null and empty texts have no hits and the
    score of such texts; repeated rows are each scored.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])))
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        lookup = Lookup(Trie(list(m.terms)))
        w, means, scales = np.array(m.weights), np.array(m.means), np.array(m.scales)
        for batch in batches:
            x = np.array([context_scores(t, lookup, m.strengths) for (t,) in rows_of(batch, text_col)]).reshape(-1, _FEATURES)
            p = 1 / (1 + np.exp(-np.clip(((x - means) / scales) @ w[:-1] + w[-1], -60, 60)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], [*keep, name])

    return rows.mapInArrow(released(run), kind)
