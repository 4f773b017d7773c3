import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodeframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.Encoder(bpe.load(f.read()))


def texts():
    rng = random.Random(1)
    letters = [chr(c) for c in (0x1680, 0x2003, 0x2028, 0x3000, 0x85, 0x1C, 0xA0, 0x200B)] + list("aAbB'sS reΣσς İıß éé\t\n12٣Ⅷ❤️👍🏽ﬁǅ한국어中文") + ["<|endoftext|>"]
    return ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(400)] + ["", " ", "a" * 5000, "ab" * 3000 + "é" * 900, "x<|endoftext|>y<|startoftext|>", "zs" * 40]


def test_equals_the_library(encoder):
    theirs = Tokenizer.from_file(PATH)
    for text in texts():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert encoder.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike(encoder):
    rng = random.Random(2)
    for n in (1, 2, 63, 64, 65, 300):
        data = bytes(rng.choice(b"theinganstr") for _ in range(n))
        ids = [encoder.v.first[b] for b in data[:-1]] + [encoder.v.last[data[-1]]]
        assert bpe.merge_short(list(ids), encoder.v.pairs) == bpe.merge_long(list(ids), encoder.v.pairs)


def test_rows(spark, encoder):
    rows = [(1, "Hello world", "a", 5), (2, None, "b", 6), (2, "", None, None), (None, "x", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(df, PATH).collect()}
    assert got[2, 0].ids_sha256 == got[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and (None, 1) in got
    back = bpe.decode(bpe.encode(df, PATH), PATH).where("doc_id = 1").first().decoded
    assert back == "hello</w> world</w>"
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises((ValueError, TypeError)):
        bpe.load(f.read())


def test_results_leave_a_worker_in_small_batches():
    rows = [(i, None if i % 7 == 0 else "x" * (i % 50)) for i in range(3 * bpe.ROWS + 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])
    empty = batch.slice(0, 0)
    out = list(bpe._results(iter([batch, empty]), None, "doc_id", "text", ["n"], [pa.int64()], lambda _, text: [len(text or "")]))
    assert [len(b) for b in out] == [bpe.ROWS] * 3 + [1]
    assert [(r["doc_id"], r["n"]) for b in out for r in b.to_pylist()] == [(i, len(t or "")) for i, t in rows]
