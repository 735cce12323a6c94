"""The language model step by step in plain Python: features, losses, gradient steps."""

import math
import tracemalloc
import zlib

import numpy as np

from kinetable.llm import langid, lbl

TEXTS = ["Das ist ein Haus, 1 von 20!", "a", "", "ÀÉî  ß\n", "the THE the", "x" * 3000]


def plain_features(text):
    b = bytes(ord("0") if chr(c).isdigit() and c < 128 else (c + 32 if 65 <= c <= 90 else c) for c in text.encode())
    x = [0] * langid.FEATURES
    for i, c in enumerate(b):
        x[c] += 1
        if i + 1 < len(b):
            two = (c * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B) % 2**32
            x[two >> 20] += 1
            if i + 2 < len(b):
                x[((two * 0xC2B2AE35 + b[i + 2] * 0x27D4EB2F) % 2**32) >> 20] += 1
    x = [math.sqrt(v) for v in x]
    n = math.sqrt(sum(v * v for v in x))
    return [v / max(n, 1e-9) for v in x]


def test_features():
    for t in TEXTS:
        assert np.allclose(langid.features(t), plain_features(t), atol=1e-6)


def test_codewords_tell_all_languages_apart():
    for k in (1, 2, 3, 5, 6, 12, 40):
        code = langid.codewords(k)
        assert code.shape[0] == k and set(np.unique(code)) <= {-1.0, 1.0} and len({tuple(r) for r in code.tolist()}) == k
        if k > 5:  # several bits may be wrong
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= math.log2(k)


def test_decoding_is_the_least_loss():
    r = np.random.default_rng(0)
    for k in (2, 3, 7):
        code = langid.codewords(k)
        m = langid.Model([f"l{i}" for i in range(k)], code, r.normal(size=(6, code.shape[1])), r.normal(size=code.shape[1]), r.random(code.shape[1]) + 0.1)
        x = r.normal(size=(50, 6))
        best, score, lead = m.decode(x)
        for row, got, p, gap in zip(x, best, score, lead, strict=True):
            loss = []
            for word in code:
                loss.append(sum(t * math.log(1 + math.exp(-c * (sum(a * w for a, w in zip(row, m.weights[:, j], strict=True)) + m.bias[j]))) for j, (c, t) in enumerate(zip(word, m.trust, strict=True))))
            each = [math.exp(min(loss) - v) for v in loss]
            each = sorted((v / sum(each) for v in each), reverse=True)
            assert got == min(range(k), key=loss.__getitem__) and abs(p - each[0]) < 1e-9 and abs(gap - (each[0] - each[1])) < 1e-9


def test_fit_takes_the_same_steps(monkeypatch):
    r = np.random.default_rng(1)
    y = np.array([i % 3 for i in range(40)] + [0] * 20)
    x = np.round(np.eye(3)[y] @ r.normal(size=(3, 5)) + 0.3 * r.normal(size=(60, 5)), 3)
    code, n = langid.codewords(3), [int((y == k).sum()) for k in range(3)]
    share = np.array([1 / n[k] for k in y])
    share /= share.sum()
    w, b = np.zeros((5, code.shape[1])), np.zeros(code.shape[1])
    vw, vb = w.copy(), b.copy()
    for _ in range(30):
        gw, gb = np.zeros_like(w), np.zeros_like(b)
        for row, k, s in zip(x, y, share, strict=True):
            for j in range(code.shape[1]):
                t = code[k, j]
                g = -t * s / (1 + math.exp(t * (row @ w[:, j] + b[j])))
                gw[:, j] += g * row
                gb[j] += g
        vw, vb = 0.9 * vw - 40 * (gw + 1e-6 * w), 0.9 * vb - 40 * gb
        w, b = w + vw, b + vb
    m = langid.fit(x, y, ["a", "b", "c"], steps=30)
    assert np.allclose(m.weights, w, rtol=1e-3, atol=1e-2) and np.allclose(m.bias, b, rtol=1e-3, atol=1e-2)
    monkeypatch.setattr(langid, "HELD", 7)  # blocks give the same
    again = langid.fit(x, y, ["a", "b", "c"], steps=30)
    assert np.allclose(m.weights, again.weights, rtol=1e-3, atol=1e-2)
    assert (m.decode(x)[0] == y).mean() > 0.9


def test_held_out_rows_are_never_learnt_from(spark):
    rows = [(i, f"wort{i} und der die das", "de") for i in range(60)] + [(i, f"word{i} and the of it", "en") for i in range(60, 120)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows], plain.schema)
    a, b = langid.train(plain), langid.train(wrong)
    assert a.languages == b.languages == ["de", "en"] and np.allclose(a.weights, b.weights)


def test_a_step_does_linear_work_once_a_class_and_is_the_plain_step():
    r = np.random.default_rng(4)
    words = [b"\n", *[b"w%d" % i for i in range(60)]]
    m = lbl.Model(words, 20, 4, np.r_[1000 / np.arange(1, 62), [5.0, 3, 2, 1]], 5000, 90, np.ones(4), {})
    m.start()
    one, two, entry = (r.integers(0, n, 500).astype(np.int32) for n in (24, 24, 65))
    learner = lbl.Learner(m, 0.1, 7)
    seen = []

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *args, **kw):
            if ufunc is np.matmul:
                seen.append(len(args[0]))
            return getattr(ufunc, method)(*[np.asarray(a) for a in args], **{k: v for k, v in kw.items() if k != "out"})

    learner.p["positions"] = learner.p["positions"].view(Seen)
    fake = np.minimum(np.searchsorted(np.cumsum(m.noise), np.random.default_rng(7).random(lbl.NOISE)), 64)
    p, at = m.params, m.params["positions"]
    h = p["context"][one] @ at[:32] + p["context"][two] @ at[32:]
    score = lambda e, x: 1 / (1 + np.exp(-x - p["bias"][e, 0] + np.log(lbl.ODDS * m.noise[e])))
    up = (1 - score(entry, np.einsum("ij,ij->i", h, p["target"][entry]))) / 500
    down = -lbl.ODDS / lbl.NOISE / 500 * score(fake, h @ p["target"][fake].T)
    back = up[:, None] * p["target"][entry] + down @ p["target"][fake]
    grad = {k: np.zeros(v.shape) for k, v in p.items()}
    np.add.at(grad["target"], entry, up[:, None] * h)
    np.add.at(grad["target"], fake, down.T @ h)
    np.add.at(grad["bias"][:, 0], entry, up)
    np.add.at(grad["bias"][:, 0], fake, down.sum(0))
    np.add.at(grad["context"], one, back @ at[:32].T)
    np.add.at(grad["context"], two, back @ at[32:].T)
    grad["positions"] = np.concatenate([p["context"][one].T @ back, p["context"][two].T @ back])
    learner.step(one, two, entry)
    for k, g in grad.items():
        want = p[k] + 0.1 * g / np.sqrt(1e-8 + (g * g).mean(1))[:, None]
        assert np.allclose(np.asarray(learner.p[k]), want, atol=2e-4), k
    assert (learner.met["context"] == np.bincount(one, minlength=24) + np.bincount(two, minlength=24)).all()
    assert seen and max(seen) <= 24  # products with the positions have a row a class, not a token


def test_a_step_uses_its_large_arrays_again():
    r = np.random.default_rng(5)
    m = lbl.Model([b"\n", *[b"w%d" % i for i in range(60)]], 20, 4, np.r_[1000 / np.arange(1, 62), [5.0, 3, 2, 1]], 5000, 90, np.ones(4), {})
    m.start()
    learner, batch = lbl.Learner(m, 0.1, 7), [r.integers(0, n, lbl.BATCH).astype(np.int32) for n in (24, 24, 65)]
    learner.step(*batch)
    tracemalloc.start()
    try:
        learner.step(*batch)
        assert tracemalloc.get_traced_memory()[1] < lbl.BATCH * lbl.NOISE * 4  # less than the one large matrix
    finally:
        tracemalloc.stop()
