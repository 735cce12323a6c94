"""Operators whose results are fixed: compared with brute force or the library itself."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinetable.llm import bpe, components, exact, lbl, packing, queries, suffix, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Words that make up texts; some documents share long runs of them.
WORDS = [a + b for a in ("ba", "ké", "lo", "Mi", "nu") for b in ("", "ra", "st", "ß", "'s", ".")]


def texts(n=60, seed=0):
    r = random.Random(seed)
    shared = [" ".join(r.choices(WORDS, k=70)) for _ in range(4)]
    out = []
    for i in range(n):
        own = " ".join(r.choices(WORDS, k=r.randint(0, 120)))
        out.append(own + (" " + r.choice(shared) if i % 3 == 0 else "") + " " + " ".join(r.choices(WORDS, k=20)))
    return [*out, out[3], out[3] + " ", None, "", " \t\n", "a", "x" * 5000, out[5][:200]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(3, rows[3][1]), (None, "no id at all " * 20)]
    df = spark.createDataFrame([(i, t, "en", 1, "q", True) for i, t in rows], "doc_id long, text string, lang string, n long, keep_id string, kept boolean")
    return df.repartition(3).cache()


def empty(docs):
    return docs.where("false")


# -- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, leaf=16)


def same(codec, s):
    want = codec.whole.encode(s, add_special_tokens=False).ids
    got = codec.encode([s])[0]
    assert np.frombuffer(got, "<u4").tolist() == want, s
    assert codec.decode(got).decode() == codec.whole.decode(want, skip_special_tokens=False), s


def test_every_character_splits_as_in_the_library(codec):
    for i in [*range(1, 0x250), 0x300, 0x345, 0x3A3, 0x600, 0x2028, 0x3000, 0x4E2D, 0xAC00, 0xFEFF, 0x1F600]:
        c = chr(i)
        same(codec, f"a{c}b {c}{c} A{c}́x 1{c}2'{c}")


def test_random_texts_with_added_tokens(codec):
    r = random.Random(2)
    letters = "".join(map(chr, range(1, 0x500))) + " \n'" * 40 + "abc" * 60
    for _ in range(300):
        same(codec, "".join(r.choices(letters, k=40)) + r.choice(["", "<|endoftext|>", "x<|startoftext|>Y", "<|endoftext"]))


def test_long_unsplit_text_is_joined_exactly(codec):
    r = random.Random(3)
    for _ in range(150):
        same(codec, "".join(r.choice(["a", "ab", "the", "ing", "aaaa", "é", "x", "qu"]) for _ in range(r.randint(5, 300))))
    same(codec, "a" * 20_000)
    same(codec, "")


def test_tokenize_rows(spark, docs):
    got = {(r["doc_id"], bytes(r["ids"])): r["decoded"] for r in bpe.tokenize(docs, PATH).collect()}
    c = bpe.codec(PATH)
    for r in docs.collect():
        ids = c.encode([r["text"] or ""])[0]
        assert got[r["doc_id"], ids] == c.decode(ids).decode()
    assert bpe.tokenize(docs, PATH).count() == docs.count() and bpe.tokenize(empty(docs), PATH).count() == 0


# -- packing --------------------------------------------------------------------


@pytest.mark.parametrize(("segments", "loss"), [(64, None), (8, None), (64, 3000), (3, 100)])
def test_limits_hold_and_every_id_is_in_one_piece(segments, loss):
    r = random.Random(4)
    p, sizes, prompts = packing.Packer(4096, segments, loss, window=8), [r.choice([1, 3, 700, 4096, 9000, r.randint(1, 3000)]) for _ in range(200)], {}
    for k, n in enumerate(sizes):
        prompts[k] = r.randint(0, n) if loss else 0
        p.add(k, n, prompts[k])
    p.finish()
    seen, bins = {}, {}
    for k, s, n, q, o, x in p.pieces():
        assert n > 0 and x == n - max(0, min(s + n, prompts[k]) - s)
        seen.setdefault(k, []).append((s, n))
        bins.setdefault(q, []).append((o, n, x))
    for k, n in enumerate(sizes):
        at = 0
        for s, m in sorted(seen[k]):
            assert s == at
            at += m
        assert at == n
    for v in bins.values():
        at = 0
        for o, n, _ in sorted(v):
            assert o == at
            at += n
        assert at <= 4096 and len(v) <= segments and (loss is None or sum(x[2] for x in v) <= loss)
    if loss is None:
        assert all(sum(n for _, n, _ in v).bit_count() == 1 for v in bins.values())  # nothing is padded


def test_many_short_documents_take_time_in_proportion():
    for size in (3, 20):
        p, begin = packing.Packer(4096, 64), time.perf_counter()
        for i in range(40_000):
            p.add(i, size)
        p.finish()
        out, filled = p.pieces(), Counter()
        for x in out:
            filled[x[3]] += x[2]
        assert sum(x[2] for x in out) == 40_000 * size and all(n & (n - 1) == 0 for n in filled.values())
        assert time.perf_counter() - begin < 12  # all waiting pieces looked at each time: 65 s


@pytest.mark.parametrize("n", [1, 3, 5, 10, 20, 40])
def test_short_documents_leave_no_padding(n):
    p, sizes = packing.Packer(4096, 64), {}
    for k in range(20_000):
        p.add(k, n)
    p.finish()
    for _, _, m, q, _, _ in p.pieces():
        sizes[q] = sizes.get(q, 0) + m
    padded = sum(0 if m.bit_count() == 1 else 4096 - m for m in sizes.values())
    assert sum(sizes.values()) == 20_000 * n and padded == 0


def test_pack_rows(spark, docs):
    out = packing.pack(docs, PATH).toPandas()
    c = bpe.codec(PATH)
    total = sum(len(c.encode([r["text"] or ""])[0]) // 4 + 1 for r in docs.collect())
    assert out["length"].sum() == total and (out["ids"].map(len) == 4 * out["length"]).all()
    one = out[out["doc_id"] == 0].sort_values("start")
    assert b"".join(map(bytes, one["ids"])) == c.encode([texts()[0]])[0] + np.array([2], "<u4").tobytes()
    assert packing.pack(empty(docs), PATH).count() == 0


# -- exact duplicates ------------------------------------------------------------


def test_few_slots_change_nothing(spark, docs, monkeypatch):
    key = lambda: sorted(map(str, exact.exact_groups(docs).collect()))
    want = key()
    monkeypatch.setattr(exact, "SLOTS", 8)  # every key shares its slot: all is hashed in full
    monkeypatch.setattr(exact, "CHUNK", 4)
    assert key() == want


def test_no_python_on_the_way(docs):
    plan = exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_groups_like_brute_force(docs):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["d"]) for r in exact.exact_groups(docs, carry={"d": F.sha2(F.col("norm").cast("binary"), 256)}).collect())
    groups: dict = {}
    for r in docs.collect():
        t = r["text"] or ""
        groups.setdefault(t.translate(dict.fromkeys(map(ord, " \t\n\v\f\r"))), []).append((-len(t), r["doc_id"] is None, r["doc_id"]))
    want = Counter()
    for norm, rows in groups.items():
        keep = min(rows, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        for _, _, i in rows:
            want[i, keep, len(rows), i == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == want
    assert exact.exact_groups(empty(docs)).count() == 0


# -- repeats of bytes --------------------------------------------------------------


def brute_repeats(rows, length):
    least: dict = {}
    for i, b in rows:
        for k in range(len(b) - length + 1 if i is not None else 0):
            least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1 if i is not None else 0):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize("length", [50, 37])
def test_repeats_like_brute_force(docs, length):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    out = suffix.remove_repeats(docs, length)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in out.collect())
    assert got == brute_repeats(rows, length) and sum(r[2] for r in got) > 0
    assert suffix.remove_repeats(empty(docs)).count() == 0


def test_periodic_text_and_one_id_with_two_texts(spark):
    rows = [(1, "ab" * 100), (2, "ab" * 60 + "c"), (2, "zz" + "ab" * 40), (3, "x" * 49), (4, "x" * 49), (5, "ba" * 30)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in out.collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], 50)


def test_buckets_are_refined_by_later_offsets():
    r = random.Random(8)
    texts = [bytes(r.choices(b"ab", k=400)) for _ in range(6)]
    texts[3] = texts[1][100:300] + texts[3]
    texts[5] = b"ab" * 100 + texts[0][:90]
    block = suffix.Block(texts, 50)
    doc = np.repeat(np.arange(6), block.sizes)
    room = np.repeat(block.starts[1:], block.sizes) - np.arange(len(doc))
    at, least, steps = suffix.refine(block.eight[: len(doc)], room, doc, 50)
    of: dict = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            of.setdefault(t[k : k + 50], []).append((i, int(block.starts[i]) + k))
    want = {p: min(i for i, _ in v) for v in of.values() if len({i for i, _ in v}) > 1 for _, p in v}
    assert dict(zip(at.tolist(), least.tolist(), strict=True)) == want and want
    assert len(steps) == 4 and steps[0] > steps[1] > steps[2] >= steps[3] >= len(want)  # 8, 16, 32, 50 bytes


def test_very_long_texts_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)
    r = random.Random(12)
    long = "".join(r.choices("abcdef ", k=5000))
    rows = [(1, long), (2, "x" * 80 + long[270:420] + "y" * 70), (3, long[1000:1049]), (4, long[3000:3050] + "é" * 30), (5, long[:4999] + "!")]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in out.collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], 50)


def test_whole_characters_stay():
    import pyarrow as pa

    text = "aé" * 40
    b = text.encode()
    docs = pa.table({"doc_id": [1], "text_hash": [7], "text": [text]})
    blob = suffix._dump(np.array([1, 1]), np.array([7, 7]), np.array([2, 20], "<u4"), np.array([9, 30], "<u4"))
    (_, _, n, spans, kept), = suffix._cut(docs, pa.table({"blob": [blob]}), True)
    assert kept.decode() and (n, spans) == (4 + 9, 2) or kept.decode() and n == len(b) - len(kept)
    (_, _, n, _, kept), = suffix._cut(docs, pa.table({"blob": [blob]}), False)
    assert n == 17 and kept == b[:2] + b[9:20] + b[30:]


def test_anchors_cover_every_string_once():
    r = random.Random(5)
    texts = [bytes(r.choices(b"ab c", k=n)) for n in (3000, 50, 51, 120, 70_000)]
    block = suffix.Block(texts, 50)
    begin, count, at, gram, text = block.anchors()
    starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin.tolist(), count.tolist(), strict=True)])
    want = [p for i, t in enumerate(texts) for p in range(int(block.starts[i]), int(block.starts[i]) + len(t) - 49)]
    assert starts.tolist() == want and ((at >= begin + count - 1) & (at + 16 <= begin + 50)).all()
    all_bytes, of = b"".join(texts), {}
    for p, a in zip(starts.tolist(), np.repeat(at, count).tolist(), strict=True):  # equal strings, equal anchors
        assert of.setdefault(all_bytes[p : p + 50], a - p) == a - p
    h = block.hashes(starts)
    assert len(set(h.tolist())) == len(of)


# -- WARC ---------------------------------------------------------------------------


def test_archives_round_trip(spark):
    html = ["<p>\r\n\r\nWARC/1.1\r\n</p>", "same", "same", None, "", "é" * 1000, "same"]
    urls = ["http://www.b.example/x?q=1", "https://a.example:8443/", None, "http://a.example/a b", "", "http://[bad", "http://b.example/X"]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(6, urls[6], "same"), (None, "http://c.example/", "same")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload_bytes int, record_type string").repartition(3)
    out = warc.capture_history(pages).toPandas()
    assert len(out) == len(rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        own = out[out["page_id"].isna() if i is None else out["page_id"] == i].iloc[0]
        b = (h or "").encode()
        assert own["payload_bytes"] == len(b) and own["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        lead = first[h or ""]
        assert (own["record_type"], own["refers_to"] if own["refers_to"] == own["refers_to"] else None) == (("response", None) if i == lead else ("revisit", lead))
    order = out.sort_values("position")[["url_key", "captured_at"]].apply(tuple, axis=1).tolist()
    assert order == sorted(order)
    assert warc.capture_history(pages.where("false")).count() == 0
    assert (warc.capture_history(pages, min_bytes=5).toPandas().query("payload_bytes < 5")["record_type"] == "response").all()


def test_huge_ids_and_long_pages(spark):
    html = "<p>" + "WARC/1.1\r\n\r\n" * 300_000  # over 4 MB, full of what begins a record
    rows = [(1 << 62, "http://a.example/", "x"), (10**12, "http://a.example/", html), (-5, "http://a.example/", html), (0, "http://a.example/", "")]
    out = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id")
    assert out.loc[10**12, "payload_bytes"] == len(html) == out.loc[-5, "payload_bytes"]
    assert out.loc[10**12, "record_type"] == "revisit" and out.loc[10**12, "refers_to"] == -5
    assert out["captured_at"].map(len).eq(20).all() and out.sort_values("position")["captured_at"].is_monotonic_increasing


def test_capture_times_are_those_of_any_session(spark):
    pages = spark.createDataFrame([(0, "http://a.example/", "x"), (5_972_400, "http://a.example/", "y")], "page_id long, url string, html string")
    seen = set()
    for zone in ("America/New_York", "Asia/Kolkata", "UTC"):  # page 5972400 is dated within an hour that New York skips
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            seen.add(tuple(warc.capture_history(pages).toPandas().sort_values("page_id")["captured_at"]))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen == {("2024-01-01T00:00:00Z", "2024-03-10T03:00:00Z")}


def test_merge_is_external(monkeypatch, tmp_path):
    r, schema = random.Random(9), warc.arrow_schema("url_key string, captured_at string, page_id long")
    monkeypatch.setattr(warc, "BATCH", 7)
    monkeypatch.setattr(warc, "FAN", 4)
    with open(tmp_path / "spool", "w+b") as f:
        spool, want = warc.Spool(f, schema), []
        for _ in range(23):  # more runs than are merged at once
            run = sorted((r.choice("abc"), str(r.randint(0, 50)), r.randint(0, 9)) for _ in range(r.randint(0, 40)))
            spool.runs.append(spool.add_sorted(iter(run)))
            want += run
        assert list(spool.merged()) == sorted(want)


def test_loser_tree_merges():
    r = random.Random(6)
    for k in range(9):
        runs = [sorted((r.choice("abc"), str(r.randint(0, 5)), r.randint(0, 9)) for _ in range(r.randint(0, 12))) for _ in range(k)]
        assert [x[:3] for x in warc.LoserTree(runs)] == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("https://www.Sub.Example.com:443/A?b=C") == "com,example,sub)/a?b=c"
    assert warc.url_key("http://example.com:81") == "com,example:81)/"


# -- language model ------------------------------------------------------------------


def test_base_scores_and_counts(docs):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], round(r["base_score"], 6)) for r in lbl.score(docs).collect())
    toks = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), b"\n"]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in toks if i is not None and not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t), n, held(i), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks)
    assert got == want
    assert lbl.score(empty(docs)).count() == 0


def test_probabilities_add_up(docs):
    m, counts = lbl.train(docs)
    n = {r["word"].encode(): r["n"] for r in counts.collect()}
    every = np.arange(len(m.words) + m.tails)
    for one, two in ((0, 0), (0, 3), (m.own, 1), (m.own + m.tails - 1, m.own)):
        p = 10.0 ** m.log_probability(np.full(len(every), one), np.full(len(every), two), every)
        assert abs(p.sum() - 1) < 1e-4
    for k in range(m.tails):
        own = [c for w, c in n.items() if w not in m.words and lbl.tail_of(w, m.tails) == k]
        assert m.tail_total[k] == sum(own) + len(own)


def test_score_like_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lbl, "sizes", lambda distinct: (12, 8, 3))  # most words are in tails
    monkeypatch.setattr(lbl, "HEAD", 20)  # and some of those meet their texts in the join
    model, counts = lbl.train(docs)
    monkeypatch.setattr(lbl, "train", lambda _: (model, counts))
    n = {r["word"].encode(): r["n"] for r in counts.collect()}
    p = model.params

    def brute(text):
        toks, total = [*(text or "").encode().lower().split(), b"\n"], 0.0
        entry = [model.words.index(w) if w in model.words else len(model.words) + lbl.tail_of(w, model.tails) for w in toks]
        cls = [0, 0, *[e if e < model.own else model.own + (lbl.tail_of(w, model.tails)) for e, w in zip(entry, toks, strict=True)]]
        for k, (e, w) in enumerate(zip(entry, toks, strict=True)):
            h = p["context"][cls[k]].astype(float) @ p["positions"][: lbl.DIM] + p["context"][cls[k + 1]].astype(float) @ p["positions"][lbl.DIM :]
            s = p["target"] @ h + p["bias"][:, 0]
            total += (s[e] - np.log(np.exp(s).sum())) / math.log(10)
            if e >= len(model.words):
                total += math.log10((n.get(w, 0) + 1) / (model.tail_total[e - len(model.words)] + 1))
        return total

    got = sorted((str(r["doc_id"]), round(r["score"], 2)) for r in lbl.score(docs).collect())
    want = sorted((str(r["doc_id"]), brute(r["text"])) for r in docs.collect())
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 0.02 + 1e-4 * abs(b) for (_, a), (_, b) in zip(sorted(got), sorted(want), strict=True))


def test_vocabulary_grows_with_the_words():
    small, large = lbl.sizes(10_000), lbl.sizes(1_000_000)
    assert large[0] == 10 * small[0] == 8000 and large[1] > 2 * small[1] and large[2] > small[2]
    assert lbl.sizes(3) == (3, 3, 4)


def test_model_beats_its_base_on_order(spark):
    r = random.Random(7)
    words = [chr(97 + i) * 3 for i in range(20)]
    rows = [(i, " ".join(words[(s + k) % 20] for k in range(60))) for i, s in enumerate(r.choices(range(20), k=200))]
    out = lbl.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert len(out) and (out["score"] > 0.5 * out["base_score"]).all()


# -- components and the registry --------------------------------------------------------


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[90], got[95], got[100]} == {90} and got[229] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
