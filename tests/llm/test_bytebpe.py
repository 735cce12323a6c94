"""Byte-level BPE by arrays gives the library's ids, and its ids give the text."""

import base64
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kinetable.llm import bytebpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: What the pattern tells apart: contractions, all kinds of white space, letters, numbers, marks.
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "'S", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "　", "1", "Ⅷ", "٣", "é", "ß", "中", "!", "-", "_", "😀", "́", "\U0001e4d0", "\x00", "<|endoftext|>", "a", "B"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(PATH, bytebpe.class_runs())


def same(codec, library, texts):
    ids, offsets, n = codec.encode(texts)
    back, k = codec.decode(ids, offsets, n), 0
    for t, m, b in zip(texts, n.tolist(), back, strict=True):
        own = ids[k : k + m].tolist()
        assert own == library.encode_ordinary(t), t
        assert b == t.encode()
        sizes = [len(library.decode_single_token_bytes(i)) for i in own]
        assert offsets[k : k + m].tolist() == [0, *itertools.accumulate(sizes)][:m]
        k += m


def test_mixed_texts(codec, library):
    r = random.Random(3)
    for _ in range(1500):
        same(codec, library, ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(r.randint(0, 5))])


def test_every_code_point_beside_letters_and_blanks(codec, library):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    step = 40_000
    for i in range(0, len(every), step):
        same(codec, library, [" a".join(every[i : i + step])])


def test_scan_goes_on_over_its_steps(codec, library, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(bytebpe, "SCANNED", 7)
    for _ in range(400):
        same(codec, library, ["".join(r.choices(PARTS, k=r.randint(0, 40))) for _ in range(3)])


def test_long_slices(codec, library):
    r = random.Random(7)
    same(codec, library, ["a" * 5000, "ab" * 3000 + "x" * 1000, "", " " * 3000 + "a", "é" * 2000, "".join(r.choices("abcdefgh", k=30_000)), "'s" * 4000])


def test_products_are_those_of_functions():
    own, product, values = bytebpe.OWN, bytebpe.PRODUCT, bytebpe.VALUES
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000):
        s = r.integers(0, 9, n)
        state, want = 0, []
        for x in s.tolist():
            state = int(bytebpe.GO[state, x])
            want.append(state)
        assert values[bytebpe.scan(own[s]), 0].tolist() == want
    a, b, c = (r.integers(0, len(values), 300) for _ in range(3))
    assert (product[product[a, b], c] == product[a, product[b, c]]).all()


def test_rows(spark, tmp_path):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (3, "it's  so", "z", 3), (3, "it's  so", "z", 3), (None, "no id", None, None), (5, "word " * 30_000, "w", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded long")
    out = bytebpe.tokenize(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in out) == sorted((i or 0, (t or "").encode()) for i, t, *_ in rows)
    assert bytebpe.tokenize(df.where("false"), PATH).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_byte_slices(spark, str(tmp_path)).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] in (1, 2)} == {(0, none, none)}


def test_query(spark, library):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    t = pq.read_table(f"{folder}/documents.parquet")
    want = set()
    for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        ids = library.encode_ordinary(x or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert set(map(tuple, queries.op12_byte_slices(spark, folder).collect())) == want
