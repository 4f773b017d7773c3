import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeframe.llm import phrases

KIND = "doc_id long, text string, lang string, n long, rank string, shard int"


def brute(rows, least, longest, most):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        few = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        over = defaultdict(int)
        for g, a in few.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    over[g[i : i + m]] = max(over[g[i : i + m]], a)
        found = []
        for g, a in few.items():
            if 100 * over[g] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, left, right, score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, total[lang], score))
    return out


def corpus(n=300):
    rng = random.Random(9)
    words = [*"abcdefgh", "é", "É", "Ab", " ", "x\x00y", "a-b", "new york city", "new york", "to be or not", "\x85"]
    joins = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", "?!"]
    rows = [("".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(n)]
    return [*rows, (None, "en"), ("", None), (". , ;", "de"), *[("same copy of it all", "fr")] * 50]


def given(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "r", 2) for i, r in enumerate(rows)], KIND)


@pytest.mark.parametrize("shard", [1 << 23, 600, 40])
def test_phrases_against_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrases, "OPEN_BYTES", 4 * shard)
    monkeypatch.setattr(phrases, "ROWS", 7)
    rows = corpus() + [("one two three four " * 2000 + "five", "long")]
    got = phrases.mine(given(spark, rows).repartition(3), least=5, most=40)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 4, 40)
    assert {tuple(r) for r in phrases.mine(given(spark, rows), least=3, longest=5, most=10).collect()} == brute(rows, 3, 5, 10)


def test_no_phrases(spark):
    assert phrases.mine(given(spark, [])).collect() == []
    assert phrases.mine(given(spark, [(None, None), ("a b", "en"), (" ", "en")])).collect() == []
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    phrases.mine(given(spark, [("a b", "en")]), least=1).collect()
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError):
        phrases.mine(given(spark, []), longest=1)


def test_suffixes_by_their_first_names():
    rng = np.random.default_rng(3)
    for depth in (2, 3, 4, 5):
        names = rng.integers(-1, 4, 400).astype(np.int32)
        links = np.append((names[:-1] >= 0) & (names[1:] >= 0), False) & (rng.random(400) < 0.9)
        order, lcp, reach = phrases.suffixes(names, links, depth, 350)

        def run(i, depth=depth, names=names, links=links):
            out = []
            while i < 400 and names[i] >= 0 and len(out) < depth:
                out.append(int(names[i]))
                if not links[i]:
                    break
                i += 1
            return out

        assert [run(i) for i in order] == sorted(run(i) for i in range(350) if names[i] >= 0)
        assert all(reach[i] == len(run(i)) for i in range(400))
        for n in range(1, depth + 1):
            begins, counts = phrases.intervals(order, lcp, reach, n)
            got = {tuple(run(order[b])[:n]): int(c) for b, c in zip(begins, counts, strict=True)}
            assert got == Counter(tuple(run(i)[:n]) for i in range(350) if len(run(i)) >= n)


def test_scores_beyond_64_bits(spark):
    big = 10**15
    grams = spark.createDataFrame([("en", "a b", big, 2), ("en", "a", 3 * big, 1), ("en", "b", big, 1)], "lang string, gram string, f long, size int")
    assert [tuple(r) for r in phrases.scored(grams).collect()] == [("en", "a b", big, 3 * big, big, 500000)]


def test_a_worker_is_handed_a_shard_at_a_time(spark, monkeypatch):
    def alone(run):
        def checked(batches):
            def one(b):
                assert b.num_rows == 1, f"{b.num_rows} shards in a batch"
                return b

            return run(map(one, batches))

        return checked

    pairs, longer = phrases._ask_pairs, phrases._count_longer
    monkeypatch.setattr(phrases, "_ask_pairs", alone(pairs))
    monkeypatch.setattr(phrases, "_count_longer", lambda longest: alone(longer(longest)))
    monkeypatch.setattr(phrases, "SHARD_BYTES", 600)
    rows, key = corpus(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = phrases.mine(given(spark, rows).coalesce(1), least=5, most=40)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 4, 40)
    assert spark.conf.get(key) == before


def test_sorting_suffixes_takes_few_bytes_a_word():
    """What a worker holds beside a shard's own arrays; with 64-bit places, and keys beside ranks, it was 73."""
    names = np.random.default_rng(5).integers(-1, 5000, 200_000).astype(np.int32)
    links = np.append((names[:-1] >= 0) & (names[1:] >= 0), False)
    tracemalloc.start()
    order, lcp, reach = phrases.suffixes(names, links, 4, len(names))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(names)
    assert reach.max() == 4 and lcp.max() >= 1 and sorted(order) == list(np.flatnonzero(reach))
