"""Every registered query on small tables: its digest columns against the libraries or brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from kinetable.llm import queries

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOURCE), reason="no test tables")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, with a null text and two empty ones."""
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(f"{SOURCE}/documents.parquet")
    extra = pa.table({"doc_id": [100001, 100002, 100003], "text": [None, "", " \n"], "lang": ["en", None, "de"], "source": ["s", "s", "s"], "n_chars": [0, 0, 2]}).cast(docs.schema)
    pq.write_table(pa.concat_tables([docs, extra]), folder / "documents.parquet")
    for name in ("embeddings", "pages", "benchmark", "conversations"):
        pq.write_table(pq.read_table(f"{SOURCE}/{name}.parquet"), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts(tables):
    t = pq.read_table(f"{tables}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()], strict=True))


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def run(spark, tables, name):
    return {n: f for n, f in queries.QUERIES.items() if n.startswith(name)}.popitem()[1](spark, tables).toPandas()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark, tables, texts):
    out = run(spark, tables, "op1_")
    assert (out["other_id"] < out["doc_id"]).all() and (out["n_words"] >= 50).all() and (out["similarity"] >= 0.8).all()
    for r in out.itertuples():  # what is said to be alike is
        a, b = texts[r.doc_id].lower().split()[r.start_word : r.start_word + r.n_words], texts[r.other_id].lower().split()[r.other_start : r.other_start + r.other_words]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) / len(x | y) >= 0.8 - 1e-9


def test_op2(spark, tables):
    out = run(spark, tables, "op2_").set_index("vec_id")
    t = pq.read_table(f"{tables}/embeddings.parquet")
    x = np.array(t["embedding"].to_pylist(), float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.95).sum(1) - 1
    assert dict(zip(t["vec_id"].to_pylist(), near.tolist(), strict=True)) == out["n_links"].to_dict()


def test_op3(spark, tables, texts, tokenizer):
    out = run(spark, tables, "op3_")
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    for r in out.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert out["length"].sum() == sum(map(len, ids.values()))
    for _, q in out.sort_values("offset").groupby("sequence_id"):
        assert (q["offset"] == q["length"].cumsum() - q["length"]).all() and q["length"].sum() <= 4096 and len(q) <= 64
    size = out.groupby("sequence_id")["length"].sum()
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in size)
    assert padded < 0.01 * size.sum()


def test_op4(spark, tables):
    import base64

    out = run(spark, tables, "op4_").set_index("page_id")
    t = pq.read_table(f"{tables}/pages.parquet")
    first: dict = {}
    for i, h in sorted(zip(t["page_id"].to_pylist(), t["html"].to_pylist(), strict=True)):
        b = (h or "").encode()
        r, lead = out.loc[i], first.setdefault(b, i)
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r["record_type"] == ("response" if lead == i else "revisit") and (lead == i or r["refers_to"] == lead)


def test_op5(spark, tables, texts):
    out = run(spark, tables, "op5_").set_index("doc_id")
    assert set(out.index) == set(texts) and (out["kept"] == (out.index == out["class_id"])).all()
    first: dict = {}
    for i in sorted(texts):
        if texts[i].strip():
            assert out.loc[i, "class_id"] == out.loc[first.setdefault(texts[i], i), "class_id"]


def test_op6(spark, tables, texts, tokenizer):
    out = run(spark, tables, "op6_").set_index("doc_id")
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        r = out.loc[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and r["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{tables}/{table}.parquet'")
    want, out = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, tables)
    cols = sorted(out.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(tuple, out.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_op8(spark, tables, texts):
    out = run(spark, tables, "op8_").set_index("doc_id")
    assert set(out.index) == set(texts) and (out["score"] < 0).all() and out["train_tokens"].nunique() == 1
    for i, t in texts.items():
        assert out.loc[i, "n_tokens"] == len(t.encode().split()) + 1 and out.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_op9(spark, tables, texts):
    out = run(spark, tables, "op9_").set_index("doc_id")
    t = pq.read_table(f"{tables}/documents.parquet")
    lang = dict(zip(t["doc_id"].to_pylist(), t["lang"].to_pylist(), strict=True))
    for i, x in texts.items():
        assert out.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out.loc[i, "score"] <= 1
        assert (out.loc[i, "lang_pred"] == "und") == (not any(c.isalpha() for c in x))
    held = [i for i in texts if out.loc[i, "held_out"] and lang[i] and out.loc[i, "lang_pred"] != "und"]
    assert np.mean([out.loc[i, "lang_pred"] == lang[i] for i in held]) > 0.9


def test_op10(spark, tables, texts):
    out = run(spark, tables, "op10_").set_index("doc_id")
    least: dict = {}
    raw = {i: t.encode() for i, t in texts.items()}
    for i, b in raw.items():
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            if least.get(s, i) >= i:
                least[s] = i
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k] += 1
                gone[k + 50] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        r = out.loc[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()))
        assert r["kept_sha256"] == sha(np.frombuffer(b, np.uint8)[~gone].tobytes())


def test_names_and_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
