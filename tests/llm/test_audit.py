import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeframe.llm import audit

KIND = "doc_id long, text string, lang string, quality int, part string, key long"


def brute(rows, labels):
    """Each order and step by applying the filters one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    fails = {}
    for at, (i, text, lang) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        upper = sum("A" <= c <= "Z" for c in text)
        same = any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails[at] = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": same}
    out, removed_of = {}, {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [at for at, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [at for at in left if fails[at][x]]
                redundant = sum(fails[at][x] for at in mine if at not in left)
                left = [at for at in left if not fails[at][x]]
                unique = sum(fails[at][x] and sum(fails[at].values()) == 1 for at in mine)
                ids = [rows[at][0] for at in gone]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(i in good for i in ids), sum(i in bad for i in ids)]
                removed_of[part, x] = removed_of.get((part, x), 0) + len(gone)
    return {(p, o, s, *v, removed_of[p, o[s - 1]]) for (p, o, s), v in out.items()}


def corpus(n=160):
    rng = random.Random(4)
    pool = ["", " ", "A b\tc", "x# y", " ".join(f"w{i}" for i in range(210)), "SHOUT " * 220, "é" * 5000, "é" * 4999 + "e", "ÄÖ  x", " lead", "trail ", "\x0b\x0c"]
    pool += [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(260))) + rng.choice(["", "$", "%"]) for _ in range(20)]
    rows = [(i, rng.choice(pool), rng.choice(["en", "fr", None, ""])) for i in range(n)]
    return [*rows, (3, rows[3][1], "en"), (None, "A b\tc", "en"), (None, None, None), (500, None, "fr"), (501, "long " * 60_000, "en"), (502, "long " * 60_000, "fr")]


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], KIND)


def test_audit_against_applying_the_filters(spark):
    rows = corpus()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 200, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1)]
    got = audit.audit(given(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in got} == brute(rows, labels)
    assert len(got) == 600 * 3


def test_texts_with_the_same_hashes_are_told_apart(spark, monkeypatch):
    whole = audit._whole
    seeds = []

    def weak(text, seed):
        seeds.append(seed)
        return hashes(text, seed) if seed else F.transform(hashes(text, seed), lambda h: F.lit(7).cast("long"))

    hashes = audit.block_hashes
    monkeypatch.setattr(audit, "block_hashes", weak)
    rows = [(i, t, "en") for i, t in enumerate(["ab", "cd", "ab", "ef", "cd"])]
    got = audit.audit(given(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [r["removed"] for r in got] == [2] and 1 in seeds and whole is audit._whole


def test_blocks_cover_a_text_once(spark):
    texts = [("x" * n,) for n in (0, 1, 63, 64, 65, 319, 320, 321, 5000, 22000)]
    monkey = spark.createDataFrame(texts, "text string").select(F.size(audit.block_hashes(F.col("text"), 0)).alias("n"), F.length("text").alias("chars")).collect()
    ends = [audit.FIRST_BLOCK * (audit.GROWTH**r - 1) // (audit.GROWTH - 1) for r in range(20)]
    assert all(r["chars"] == 0 and r["n"] == 0 or ends[r["n"]] >= r["chars"] for r in monkey)


def test_audit_of_no_rows_and_own_filters(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(given(spark, []), none).collect() == []
    got = audit.audit(given(spark, corpus()), none, {"x": F.col("doc_id") > 10, "y": F.col("text").contains("w")}, duplicates=None)
    assert got.count() == 2 * 2 * 3
    with pytest.raises(ValueError):
        audit.interactions(none, "AA")
