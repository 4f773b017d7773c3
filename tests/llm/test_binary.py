import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import binary

tokenizers = pytest.importorskip("tokenizers")
KIND = "doc_id long, text string, start long, part int, ids string"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def texts(n=120):
    rng = random.Random(7)
    alphabet = ["word", " ", "  ", "\n", "\t ", "é", " É", "  ", "　 x", " 12", "'s", "!", "!!", "<|endoftext|>", " <|endoftext|> ", "👍 ", "ß", "-", "\x00", " a", "  b", "\u0085 c", "İ "]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*out, None, "", " ", "x" * 5000, "naïve café " * 3000, " ".join(str(i) for i in range(20_000))]


def wanted(rows, path):
    t = tokenizers.Tokenizer.from_file(path)
    at, out = 0, []
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def given(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, "i") for r in rows], KIND)


@pytest.mark.parametrize("window", [1 << 22, 100])
def test_ids_are_those_of_the_library(vocabulary, monkeypatch, window):
    monkeypatch.setattr(binary, "WINDOW", window)
    monkeypatch.setattr(binary, "PIECES", 50)
    with open(vocabulary, "rb") as f:
        encoder = binary.Encoder(f.read())
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    column = pa.array(["skipped", *texts(), "last"])[1:-1]
    got = {}
    for i, ids, _ in encoder.texts(column):
        got.setdefault(i, []).extend(ids.tolist())
    for i, text in enumerate(column.to_pylist()):
        assert got[i] == plain.encode(text or "", add_special_tokens=False).ids, text


def test_files_give_every_document_back(spark, vocabulary, monkeypatch, tmp_path):
    for name, value in (("WINDOW", 3000), ("FILE_TOKENS", 5000), ("BATCH_TOKENS", 700)):
        monkeypatch.setattr(binary, name, value)
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    df = given(spark, rows)
    got = sorted(map(tuple, binary.round_trip(spark, df, vocabulary, length=64).collect()))
    assert got == wanted(rows, vocabulary)

    folder = f"file://{tmp_path}/t"
    manifest = binary.write(df, vocabulary, folder, end=7, length=64)
    listed = binary.placed(manifest).orderBy("part", "no").collect()
    assert len(listed) > 4 and [r["base"] for r in listed] == [sum(x["tokens"] for x in listed[:i]) for i in range(len(listed))]
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    stream = [x for _, t in sorted(rows) for x in [*plain.encode(t or "", add_special_tokens=False).ids, 7]]
    seen, ends = [], 0
    for r in listed:
        s = binary.Sequences(folder, r["name"])
        assert len(s) == r["sequences"] == -(-r["tokens"] // 64)
        for i in (len(s) - 1, *range(len(s))):
            ids, mask, closed = s[i]
            assert len(ids) == len(mask) == 64 and not ids.flags["OWNDATA"]
            if i < len(s) - 1:
                assert mask.all()
        for i in range(len(s)):
            ids, mask, closed = s[i]
            seen += ids[mask].tolist()
            ends += int(closed.sum())
        with pytest.raises(IndexError):
            s[len(s)]
    assert seen == stream and ends == len(rows)
    ids = {r["doc_id"]: r["ids"] for r in binary.read(manifest, folder, "bigint", tokens=True).collect()}
    assert all(ids[i] == [*plain.encode(t or "", add_special_tokens=False).ids, 7] for i, t in rows)


def test_no_rows_nulls_and_repeated_ids(spark, vocabulary):
    assert binary.round_trip(spark, given(spark, []), vocabulary).collect() == []
    rows = [(None, "a b"), (1, None), (1, ""), (1, "same text"), (1, "same text"), (2, "x")]
    got = binary.round_trip(spark, given(spark, rows), vocabulary).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1, 1, 2]
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3, 3]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(6)]
    named = spark.createDataFrame([("b", "x"), ("a", "y")], "doc_id string, text string")
    assert [r["doc_id"] for r in binary.round_trip(spark, named, vocabulary).orderBy("start").collect()] == ["a", "b"]


def test_a_damaged_file_is_told(spark, vocabulary, tmp_path):
    folder = f"file://{tmp_path}/t"
    name = binary.write(given(spark, [(1, "a b"), (2, "c")]).coalesce(1), vocabulary, folder, length=4).collect()[0]["name"]
    path = tmp_path / "t" / f"{name}.documents.arrow"
    with pa.ipc.open_file(path) as f:
        docs = f.read_all()
    with pa.ipc.new_file(path, docs.schema) as out:
        out.write_table(docs.slice(0, docs.num_rows - 1) if docs.num_rows > 1 else docs.slice(0, 0))
    with pytest.raises(ValueError, match="no document"):
        list(binary._tokens_of(folder, name))
