"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from kinetable.llm import queries, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def brute(docs, target, least=20):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for _, x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for k, (i, n, f) in enumerate(own):
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n, k])
    may = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: 5 * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, **settings):
    a, b = (spark.createDataFrame(x, k) for x, k in ((docs, KIND), (target, "item_id long, text string")))
    return sorted(map(tuple, resample.importance(a, b, **settings).collect()), key=repr)


WORDS = ["Ab", "c0", "é", "É", "ÀB", "x'y", "中文", "İ", "ß", "a\x00b", "-", "Ω", "k", "1", "_q_"]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    own = [(i, " ".join(r.choices(WORDS, k=r.choice([0, 1, 2, 3, 30])))) for i in range(300)]
    return [*own, (3, own[3][1]), (400, None), (401, ""), (402, " \n--"), (None, "a b c " * 20), (403, "Long " * 40_000), (404, "x" * 100_000 + " y" * 30)]


def test_against_plain_python(spark, docs):
    target = [(i, t) for i, t in docs[:40]] + [(None, None), (1, "x y z " * 50)]
    got = run(spark, docs, target)
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 1


def test_rows(spark, docs):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, docs[:60], []) == brute(docs[:60], [])
    same = [(7, "one two three " * 10)] * 200  # rows of one id are documents of their own
    got = run(spark, same, [(1, "one")])
    assert got == brute(same, [(1, "one")]) and sorted(r[4] for r in got if r[4]) == list(range(1, 11))


def test_clashing_columns_and_drawn_rows(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "q", 2) for i, t in docs], KIND + ", row int, word string, b1 int")
    aim = spark.createDataFrame([(1, "ab c0 k")], "item_id long, text string")
    ranks = {r["doc_id"] for r in resample.importance(df, aim).collect() if r["rank"] is not None}
    out = resample.resample(df, aim)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == ranks


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda n: [tuple(r.values()) for r in pq.read_table(f"{folder}/{n}.parquet").to_pylist()]
    want = brute([(r[0], r[1]) for r in read("documents")], read("benchmark"))
    assert sorted(map(tuple, queries.op11_position_ngrams(spark, folder).collect()), key=repr) == want
