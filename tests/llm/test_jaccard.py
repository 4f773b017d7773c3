import random
from collections import Counter, defaultdict

import pytest

from lodeframe.llm import jaccard
from lodeframe.llm.words import space_words

DOCS = "doc_id long, text string, class string, comp long"


def brute(rows, percent=80):
    sets, at = [], defaultdict(list)
    for i, (_, text, *_rest) in enumerate(rows):
        w = space_words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
        for g in sets[-1]:
            at[g].append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g] if j < i).items():
            if 100 * n >= percent * len(s | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, (doc_id, *_rest) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least[root(i)], doc_id)
    return sorted(((r[0], len(s), None if r[0] is None else least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def data(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows, doc = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((doc := doc + 1, rng.choice([" ", "\n", "  "]).join(text), "x", 1))
    rows += [(900, None, None, None), (901, "", None, None), (902, " \t", None, None), (903, rows[3][1], None, None), (903, rows[3][1], None, None), (904, "A " * 300, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds,spread,block", [(2, 200_000, 1000), (0, 4, 3)])
def test_groups_are_those_of_all_pairs(spark, rounds, spread, block):
    rows = data(rounds)
    found = jaccard.groups(spark.createDataFrame(rows, DOCS), rounds=rounds, spread=spread, block=block)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute(rows)


def test_no_rows(spark):
    assert jaccard.groups(spark.createDataFrame([], DOCS)).collect() == []


def test_trees_leave_no_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [base[rng.random(len(base)) < rng.choice([0.3, 0.9, 0.97])] for _ in range(60)]
    sets.sort(key=len)
    bits = [jaccard.bitmap(s) for s in sets]
    width = min(map(len, bits))
    tree = jaccard.Tree(np.array(list(map(len, sets))), np.stack([jaccard.folded(b, width) for b in bits]))
    found = set(jaccard.traverse(tree, tree, 80))
    true = {(i, j) for j in range(60) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= found < {(i, j) for j in range(60) for i in range(j)}


def test_components_by_joins_and_in_one_task(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)] + [(400, 400), (None, 3), (500, 900), (500, 901)]
    df = spark.createDataFrame(edges, "a long, b long")
    from lodeframe.llm.components import components

    a = sorted(map(tuple, components(df).collect()))
    assert a == sorted(map(tuple, components(df, one_task=1000).collect()))
    assert dict(a)[330] == 300 and dict(a)[901] == 500 and dict(a)[400] == 400


def test_sets_of_one_name_get_another(spark):
    rows = [(0, 1, 3, 7, 70), (0, 2, 4, 7, 71), (0, 3, 4, 7, 71), (0, 4, 5, 8, 80), (0, None, 5, 9, 90), (0, 5, 0, None, None), (1, 6, 2, 0, 0)]
    sketches = spark.createDataFrame(rows, "kind int, id long, size long, class long, other long")
    join = jaccard.Join(spark.createDataFrame([], DOCS), "doc_id", "text", 5, 80, 200_000, 1000)
    docs, classes = join.classes(sketches)
    assert join.taken == {7}
    assert sorted(map(tuple, classes.collect())) == [(8, 4), (70, 1), (71, 2)]
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted([(1, 3, 70), (2, 4, 71), (3, 4, 71), (4, 5, 8), (None, 5, 9), (5, 0, None)], key=repr)
    grams = jaccard.shingles("a b c d e f", 5)
    assert jaccard.class_of(grams, frozenset({jaccard.class_of(grams)})) == jaccard.named(grams, 1) != jaccard.class_of(grams)
