"""Queries over whole tables, compared with brute force."""

import os

import pandas as pd
import pytest

from kinetable.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def table(name):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet")


def test_tracks_have_all_events(spark):
    e = table("events").sort_values(["user_id", "ts", "event_id"])
    tracks = {u: [round(v * 10) for v in g["value"]] for u, g in e.groupby("user_id")}
    assert max(map(len, tracks.values())) > 6
    text = {u: ";".join(f"{f}.0 1 {x} 0 0" for f, x in enumerate(v)) for u, v in tracks.items()}
    assert {r["user_id"]: r["tracks"] for r in rows(spark, "encode_tracks")} == {u: f'<tracks coords="{s}">object points</tracks>' for u, s in text.items()}
    assert sorted(map(tuple, rows(spark, "decode_tracks"))) == sorted((u, float(f), 1, x, 0, 0) for u, v in tracks.items() for f, x in enumerate(v))
    end = max(map(len, tracks.values()))
    assert sorted(map(tuple, rows(spark, "grid_fill"))) == sorted((u, f, v[f] / 10 if f < len(v) else 0.0) for u, v in tracks.items() for f in range(end + 1))


def test_lists_of_all_sources(spark):
    want = {d: [p for s in t.split("|") if (p := s.strip(" "))] for d, t in table("documents")[["doc_id", "text"]].itertuples(index=False)}
    assert {r["doc_id"]: r["objects"] for r in rows(spark, "object_list")} == want


def test_whole_vectors_are_padded_and_cut(spark):
    x = {i: [float(v) for v in e] for i, e in table("embeddings")[["vec_id", "embedding"]].itertuples(index=False)}
    assert min(map(len, x.values())) > 16
    out = {r["vec_id"]: (r["padded"], r["cut"]) for r in rows(spark, "pad_collate")}
    assert out == {i: (v + [-1.0] * (80 - len(v)), v[:16]) for i, v in x.items()}
