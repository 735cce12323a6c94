"""Operators that search for what is near: nothing that should be found is missed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import graph, icws, langid, passages, shingles

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(r, n):
    return ["".join(r.choices(LETTERS, k=r.randint(2, 8))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, class_id int, rep string").repartition(3)


# -- weighted sampling -------------------------------------------------------------


@pytest.fixture(scope="module")
def families():
    r, rows = random.Random(0), []
    for f in range(12):
        base = words(r, 200)
        for k in range(6):
            own = list(base)
            for _ in range(k):
                own[r.randrange(len(own))] = "edit"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, ""), (504, " \n"), (505, "two words"), (506, "two words"), (507, " ".join(words(r, 30_000))), (None, rows[1][1]), (3, rows[3][1])]
    return rows


def test_near_duplicates_like_brute_force(spark, families):
    df = frame(spark, families)
    out = icws.near_duplicates(df).toPandas()
    assert len(out) == len(families)
    cls = {i: c for i, c in zip(out["doc_id"], out["class_id"], strict=True) if i == i}
    bags = {i: set(shingles.bags([t])[1].tolist()) for i, t in families if t and t.strip() and i is not None}
    for a in bags:
        for b in bags:
            j = len(bags[a] & bags[b]) / len(bags[a] | bags[b])
            if j >= 0.86:
                assert cls[a] == cls[b], (a, b, j)
            if j == 0:
                assert cls[a] != cls[b]
    assert cls[500] == cls[501] == 0 and cls[505] == cls[506] == 505 and cls[502] == 502 and cls[503] == 503 and cls[504] == 504
    known = out[out["doc_id"].notna()]
    assert (known["kept"] == (known["doc_id"] == known["class_id"])).all() and out[out["doc_id"].isna()]["kept"].all()
    assert icws.near_duplicates(df.where("false")).count() == 0


def test_samples_agree_as_often_as_the_sets():
    r = np.random.default_rng(1)
    h = np.sort(r.choice(1 << 47, 600, replace=False)).astype(np.uint64)
    w = r.random(600) * 3 + 0.2
    a, b = slice(0, 450), slice(150, 600)
    want = icws.similarity((h[a], w[a]), (h[b], w[b] * 1.3))
    x, y = (icws.samples(np.zeros(450, np.int64), h[s], v, 3000)[0] for s, v in ((a, w[a]), (b, w[b] * 1.3)))
    assert abs((x == y).mean() - want) < 0.04


def test_document_frequency_is_never_too_low(spark, families):
    df = frame(spark, families).select(F.coalesce("text", F.lit("")).alias("text"))
    sketch = icws.document_frequencies(df)
    true: dict = {}
    for _, t in families:
        for x in set(shingles.bags([t or ""])[1].tolist()):
            true[x] = true.get(x, 0) + 1
    h = np.array(list(true), np.uint64)
    got = np.minimum.reduce([sketch[s] for s in icws._slots(h)])
    assert (got >= np.array(list(true.values()))).all() and (got == np.array(list(true.values()))).mean() > 0.9


def test_originals_of_any_id_keep_their_copies(spark):
    r, rows, want = random.Random(8), [], {}
    for f, centre in enumerate((0, 10, 20)):  # the original's place among its copies
        base = words(r, 200)
        for k in range(21):
            own = list(base)
            if k != centre:  # J 0.85 to the original, 0.72 to each other
                at = 9 * (k if k < centre else k - 1)
                own[at : at + 12] = words(r, 12)
            rows.append((100 * f + k, " ".join(own)))
            want[100 * f + k] = 100 * f
    base = words(r, 200)
    for k in range(12):  # a chain: each is near to the next only
        rows.append((1000 + k, " ".join(base)))
        want[1000 + k] = 1000
        at = 14 * k
        base[at : at + 12] = words(r, 12)
    out = icws.near_duplicates(frame(spark, rows)).toPandas()
    assert dict(zip(out["doc_id"], out["class_id"], strict=True)) == want


def test_chains_lose_no_links(spark):
    """A-B-C with B near A and C near B: what is at least 0.8 alike by the operator's own
    similarity is of one class (samples miss a pair at 0.8 with a probability of 0.2 %)."""
    r, rows = random.Random(21), []
    for k in range(150):
        a = words(r, 150)
        b, c = list(a), None
        b[40:46] = words(r, 6)
        c = list(b)
        c[100:106] = words(r, 6)
        rows += [(3 * k + i, " ".join(x)) for i, x in enumerate(r.sample([a, b, c], 3))]
    df = frame(spark, rows)
    out = icws.near_duplicates(df).toPandas().set_index("doc_id")["class_id"]
    weights = icws.Weights(icws.document_frequencies(df.select("text")), len(rows))
    sets = []
    for _, t in rows:
        _, h, n = shingles.bags([t])
        sets.append((h, weights(h, n)))
    links = [(i, j) for k in range(150) for i, j in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 2)) if icws.similarity(sets[i], sets[j]) >= 0.8]
    assert len(links) >= 300 and sum(out[i] != out[j] for i, j in links) <= 2


def test_blocks_find_the_links_of_all_pairs():
    r = np.random.default_rng(11)
    sets, base = [], r.choice(1 << 40, 80, replace=False).astype(np.uint64)
    for k in range(60):
        h = np.sort(np.unique(np.r_[r.choice(base, 60 + k % 15, replace=False), r.integers(1 << 41, 1 << 42, k % 9).astype(np.uint64)]))
        n = 1 + (h % np.uint64(3)).astype(np.int64) + (r.random(len(h)) < 0.15)
        sets.append((h, n, n * (1 + (h % np.uint64(7)).astype(float) / 30)))
    cls, side = np.arange(60), np.where(np.arange(60) % 3 == 0, 1, 2)
    got = icws.links_within(sets, cls, side, 0.7)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if side[i] != side[j] and icws.similarity(sets[i][::2], sets[j][::2]) >= 0.7]

    def classes(links):
        c = list(range(60))
        for _ in range(60):
            for i, j in links:
                c[i] = c[j] = min(c[i], c[j])
        return c

    assert set(got) <= set(want) and len(got) < 60 and classes(got) == classes(want) and len(want) > 40


# -- passages ------------------------------------------------------------------------


def test_windows_are_those_of_the_tree():
    r = np.random.default_rng(2)
    sizes = np.array([60, 100, 46])
    h = r.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
    h[10] = h[30]
    at, left, right = passages.compact_windows(h, sizes, 46, 3)
    v = shingles.mix(h + np.uint64(3 * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)
    want, start = [], 0
    for n in sizes:
        for c in range(n):
            i = j = c
            while i > 0 and v[start + i - 1] > v[start + c]:
                i -= 1
            while j < n - 1 and v[start + j + 1] >= v[start + c]:
                j += 1
            if j - i + 1 >= 46:
                want.append((start + c, c - i, j - c))
        start += n
    assert sorted(zip(at.tolist(), left.tolist(), right.tolist(), strict=True)) == sorted(want)


def test_shared_passages_are_found(spark):
    r, rows = random.Random(3), []
    shared = [words(r, 60) for _ in range(5)]
    for i in range(60):
        own = words(r, 150)
        if i % 2 == 0:
            p = list(shared[i % 5])
            if i % 4 == 0:
                p[30] = "edit"
            own[70:70] = p
        rows.append((i, " ".join(own)))
    rows += [(100, rows[2][1]), (101, None), (102, ""), (103, " ".join(words(r, 49))), (104, " ".join(words(r, 49))), (None, rows[0][1]), (2, rows[2][1])]
    out = passages.near_passages(frame(spark, rows)).toPandas()
    assert set(out["doc_id"]) == {i for i in range(0, 60, 2) if i >= 10} | {100}
    assert (out["other_id"] < out["doc_id"]).all() and (out["similarity"] >= 0.8).all() and (out["n_words"] >= 50).all()
    one = out[out["doc_id"] == 12].iloc[0]
    assert 68 <= one["start_word"] <= 72 and one["other_id"] % 10 == 2
    for group in range(5):  # documents of one passage are of one class
        own = [i for i in range(0, 60, 2) if i % 5 == group]
        assert set(out[out["doc_id"].isin(own)]["class_id"]) == {min(own)}
    assert passages.near_passages(frame(spark, rows).where("false")).count() == 0


def test_passages_around_a_frequent_line(spark):
    """Pairs share passages that all hold one line, which also stands alone in smaller documents."""
    r, line, rows, want = random.Random(13), None, [], {}
    line = words(r, 14)
    for i in range(60):
        rows.append((i, " ".join(words(r, 60) + line + words(r, 60))))
    for k in range(40):
        p = words(r, 18) + line + words(r, 18)
        for i in (100 + 2 * k, 101 + 2 * k):
            rows.append((i, " ".join(words(r, 70) + p + words(r, 70))))
        want[101 + 2 * k] = 100 + 2 * k
    out = passages.near_passages(frame(spark, rows)).toPandas()
    got = set(zip(out["doc_id"], out["other_id"], strict=True))
    assert {(a, b) for a, b in want.items()} <= got
    assert set(out["doc_id"]) == set(want) and (out["class_id"] == out["doc_id"] - 1).all()


def test_pair_recall_of_edited_passages(spark):
    """Two documents of each pair share 100 words with two edits (similarity about 0.8): nearly all
    are found; and a document of 40,000 words is searched whole."""
    r, rows, want = random.Random(14), [], set()
    for k in range(100):
        p = words(r, 100)
        q = list(p)
        q[33], q[66] = "edit", "more"
        rows += [(2 * k, " ".join(words(r, 80) + p + words(r, 80))), (2 * k + 1, " ".join(words(r, 80) + q + words(r, 80)))]
        want.add((2 * k + 1, 2 * k))
    long = words(r, 40_000)
    rows += [(500, " ".join(long)), (501, " ".join(words(r, 50) + long[39_900:39_980]))]
    out = passages.near_passages(frame(spark, rows)).toPandas()
    got = set(zip(out["doc_id"], out["other_id"], strict=True))
    assert len(got & want) >= 98 and got <= want | {(501, 500)} and (501, 500) in got


def test_places_need_enough_functions():
    at = lambda *x: passages.places(*[np.array(v) for v in x], 46)
    assert at([0, 1, 2], [0, 5, 2], [60, 70, 64], [3, 3, 3]) == [(0, 70, 3, 73)]
    assert at([0, 1, 1], [0, 5, 2], [60, 70, 64], [3, 3, 3]) == []
    assert at([0, 1, 2], [0, 50, 2], [60, 110, 64], [0, 0, 0]) == []
    assert at([0, 1, 2] * 2, [0, 1, 2, 200, 200, 200], [50, 51, 52, 246, 246, 246], [0] * 3 + [7] * 3) == [(0, 52, 0, 52), (200, 246, 207, 253)]


# -- vectors ---------------------------------------------------------------------------


def test_links_like_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.08 * r.normal(size=(60, 16)), np.repeat(base[:3], 20, 0), base[5:8] * 7.5, base[9:10] + 0.02 * r.normal(size=(40, 16))])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0] * 15 + [None]), (n + 4, []), (n + 5, x[0].tolist()[:8]), (n + 6, [float("inf")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    out = {row["vec_id"]: row for row in graph.near_vectors(df).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    assert [out[i]["n_links"] for i in range(n)] == near.sum(1).tolist()
    least = list(range(n))
    for _ in range(n):
        new = [min([least[i], *[least[j] for j in np.flatnonzero(near[i])]]) for i in range(n)]
        if new == least:
            break
        least = new
    assert [out[i]["component_id"] for i in range(n)] == least
    assert all(out[i]["kept"] == (least[i] == i) for i in range(n))
    assert all(out[n + k]["n_links"] == 0 and out[n + k]["kept"] for k in range(7)) and out[None]["n_links"] == 0
    there, met = graph.AUDITED[spark.sparkContext.applicationId]
    assert there and met >= 0.98 * there
    assert graph.near_vectors(df.where("false")).count() == 0


def test_many_shards_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 60)  # a dense cluster and its border are in many shards
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(500, 16)), 3 * np.ones((150, 16)) + 0.35 * r.normal(size=(150, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    out = {row["vec_id"]: row["n_links"] for row in graph.near_vectors(df).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.95).sum(1) - 1
    assert sum(out.values()) >= 0.995 * near.sum() and all(out[i] <= near[i] for i in range(len(x)))


def test_search_ends_only_when_the_cluster_is_expanded():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 24)), np.ones((200, 24)) + 0.05 * r.normal(size=(200, 24))])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    links = [np.array(a) for a in graph.build(x.astype(np.float32))]
    found = set(graph.search(x, links, 450, int(np.argmax(x @ x.mean(0))), 0.95))
    want = set(np.flatnonzero(x @ x[450] >= 0.95).tolist()) - {450}
    assert len(found & want) >= 0.98 * len(want)


# -- languages -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows = random.Random(6), []
    alphabet = {"aa": "aeioubcd", "bb": "aeiouxyz", "cc": "éèàçlmno", "dd": "ñóábcdst", "ee": "äöüßghij", "ff": "åøæklmno"}
    for i in range(900):
        lang = r.choice(list(alphabet))
        rows.append((i, " ".join("".join(r.choices(alphabet[lang], k=r.randint(2, 7))) for _ in range(r.randint(5, 60))), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ... !!", "bb"), (1003, rows[0][1], None), (None, rows[1][1], "aa"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, lang string, source string, score double").repartition(3)


def test_held_out_accuracy_and_undetermined(labelled):
    out = langid.identify(labelled, ["doc_id", "lang"], langid.train(labelled)).withColumn("held_out", langid.held_out()).toPandas()
    assert len(out) == labelled.count() and out["score"].between(0, 1).all()
    held = out[out["held_out"] & out["doc_id"].lt(900)]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert (out[out["doc_id"].isin([1000, 1001, 1002])]["lang_pred"] == "und").all()
    none = langid.identify(labelled.where("false"), ["doc_id"], langid.train(labelled.where("false")))
    assert none.count() == 0
    assert langid.identify(labelled, ["doc_id"], None).where("lang_pred <> 'und'").count() == 0


def test_very_long_and_repeated_texts(labelled, spark):
    model = langid.train(labelled)
    one = labelled.where("doc_id = 7").first()["text"]
    df = spark.createDataFrame([(1, one * 30_000, None), (2, one, None), (2, one, None), (3, "ж", None)], "doc_id long, text string, lang string")
    out = langid.identify(df, ["doc_id"], model).toPandas()
    assert out[out["doc_id"].lt(3)]["lang_pred"].nunique() == 1 and len(out[out["doc_id"] == 2].drop_duplicates()) == 1
    assert out[out["doc_id"] == 3]["lang_pred"].isin(model.languages).all()


def test_every_language_is_learnt(spark):
    r, rows = random.Random(9), []
    for k in range(140):  # languages of their own letters; the last ones have the fewest rows
        letters = [chr(0x4E00 + 40 * k + i) for i in range(6)]
        rows += [(len(rows) + i, " ".join("".join(r.choices(letters, k=4)) for _ in range(20)), f"l{k:03}") for i in range(24 if k < 130 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df)
    assert model.languages == [f"l{k:03}" for k in range(140)]
    out = langid.identify(df, ["doc_id", "lang"], model).withColumn("held_out", langid.held_out()).toPandas()
    assert set(out["lang_pred"]) == set(model.languages)
    assert (out["lang"] == out["lang_pred"])[out["held_out"]].mean() > 0.9


def test_blocks_of_rows_learn_the_same(monkeypatch):
    r = np.random.default_rng(10)
    x, y = r.random((90, 12)), r.integers(0, 7, 90)
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16)
    one = langid.fit(x, y, list("abcdefg"), 5)
    monkeypatch.setattr(langid, "HELD", 16)
    many = langid.fit(x, y, list("abcdefg"), 5)
    assert np.allclose(one.weights, many.weights, atol=1e-2) and np.allclose(one.bias, many.bias, atol=1e-2)


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 6, 20):
        m = langid.codewords(k)
        assert len(m) == k and min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= (1 if k < 3 else 2)
