import random

import pytest

from lodeframe.llm import decontam
from lodeframe.llm.words import alnum_words

ITEMS = "item_id long, text string, lang string"
DOCS = "doc_id long, text string, item_id string"


def brute(docs, items):
    """Every window of every item, at every place."""
    out = []
    for doc_id, text, *_ in docs:
        words, hit, ids = alnum_words(text), set(), set()
        for item_id, item, *_ in items:
            want = alnum_words(item)
            k = min(len(want), 13)
            for q in range(len(want) - k + 1 if k else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == want[q : q + k]:
                        hit.update(range(p, p + k))
                        ids.add(item_id)
        out.append((doc_id, len(words), len(hit), sorted(str(x) for x in ids if x is not None)))
    return out


def data(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(9)] + ["Été", "x"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 8, 12, 13, 14, 20, 40])), "en") for i in range(25)] + [(3, "x x", None), (None, text(15), None), (90, None, None), (91, "", None), (92, "...", None)]
    docs = [(i, text(rng.randrange(60)), "a") for i in range(40)] + [(50, None, None), (51, "", None), (None, items[3][1], None), (52, "x " * 60, None), (53, "!!", None), (53, "!!", None)]
    docs += [(100 + i, f"{text(5)} {it[1]} {text(7)}", None) for i, it in enumerate(items)]
    docs += [(200 + i, f"{text(9)} {' '.join((it[1] or '').split()[2:17])} {text(3)}", None) for i, it in enumerate(items)]
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_matches_brute_force(spark, most):
    docs, items = data()
    found = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_bytes=most).collect()
    key = lambda r: repr(r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found], key=key) == sorted(brute(docs, items), key=key)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_empty_tables(spark, most):
    docs, items = data()
    none = decontam.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS), broadcast_bytes=most)
    assert none.collect() == []
    free = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS), broadcast_bytes=most)
    assert {r.n_hit for r in free.collect()} == {0}


def test_a_twentieth_is_contaminated(spark):
    df = spark.createDataFrame([(20, 1), (21, 1), (0, 0), (5, 0)], "n_words long, n_hit long")
    assert [r.contaminated for r in decontam.judged(df).collect()] == [True, False, False, False]


def test_winnowing_keeps_a_least_hash_of_every_window():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 6, 7, 8, 50, 200):
        g = rng.integers(0, 6, n).astype(np.uint64)
        kept = set(decontam.winnow(g, 7).tolist())
        for i in range(max(0, n - 6)):
            assert any(j in kept and g[j] == g[i : i + 7].min() for j in range(i, i + 7))
