"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit a logistic classifier on hashed byte n-grams
(one to three bytes) learns whether the bit is set. A text's language is the codeword with
the least logistic loss over the bits, each weighted by how well it was learnt. The share of
the best codeword is the score; a text whose two best codewords are close is ambiguous.

Every language with a labelled row gets a codeword, however many there are. The classifiers
are fitted on at most SAMPLE rows for a language (the bound is a parameter), drawn by a hash
of the id; their features lie in a file of the driver and are read in blocks. Everything else
reads every row and whole texts.

Rows: a null or empty text, or one without a letter, is ``und`` with score 0; so is
every row if no labelled row is left to learn from. Rows whose id is null are held out.
Repeated rows get the same answer. Other columns may be kept as they are.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import frugal, materialize, prepare, small, text_groups, texts_of

#: Features, rows to learn from for each language, rows that the driver holds as 32-bit numbers.
FEATURES, SAMPLE, HELD = 4096, 600, 8192
LETTER = regex.compile(r"\p{L}")
#: Upper to lower case, and digits to one digit, in ASCII.
FOLD = bytes(ord("0") if chr(b).isdigit() else (b + 32 if 65 <= b <= 90 else b) for b in range(128)) + bytes(range(128, 256))


def features(text: str) -> np.ndarray:
    """Hashed counts of the text's byte n-grams, damped and of unit length."""
    b = np.frombuffer(text.encode().translate(FOLD), np.uint8).astype(np.uint32)
    x = np.bincount(b, minlength=FEATURES)
    if len(b) > 1:
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
        x += np.bincount(two >> np.uint32(20), minlength=FEATURES)
        if len(b) > 2:
            x += np.bincount((two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=FEATURES)
    x = np.sqrt(x).astype(np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits for up to five languages, else the best of a number
    of random codes by least distance."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        return np.array([[1, *x] for x in itertools.product((1, -1), repeat=k - 1)][1:]).T.astype(float)
    rng, best = np.random.default_rng(5), None
    n = int(10 * np.ceil(np.log2(k)))
    for _ in range(50):
        m = rng.choice((-1.0, 1.0), (k, n))
        m = m[:, np.abs(m.sum(0)) < k]
        least = ((m.shape[1] - m @ m.T) / 2 + 1e9 * np.eye(k)).min()
        if best is None or least > best[0]:
            best = least, m
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of features: language's index, score, and the lead over the next."""
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, margin) * self.trust) @ (self.code < 0).T
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = -np.sort(-p, 1)
        return loss.argmin(1), top[:, 0], top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 300) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient steps."""
    code = codewords(len(languages))
    share = 1 / np.bincount(y, minlength=len(languages))[y][:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, rate, share = w.copy(), b.copy(), 40.0, share / share.sum()
    held = np.asarray(x, np.float32) if len(x) <= HELD else None

    def blocks():
        for k in range(0, len(y), HELD):
            own = slice(k, k + HELD)
            yield held if held is not None else np.asarray(x[own], np.float32), code[y[own]], share[own]

    for _ in range(steps):
        gw, gb = np.zeros_like(w), np.zeros_like(b)
        for part, target, own in blocks():
            g = (-target * own / (1 + np.exp(target * (part @ w + b)))).astype(np.float32)
            gw, gb = gw + part.T @ g, gb + g.sum(0)
        vw, vb = 0.9 * vw - rate * (gw + 1e-6 * w), 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    right = sum(((target * (part @ w + b) > 0) * own).sum(0) for part, target, own in blocks())
    trust = np.log(np.clip(right, 0.51, 0.9999) / (1 - np.clip(right, 0.51, 0.9999)))
    return Model(languages, code, w, b, trust / trust.sum() * len(trust) if len(trust) else trust)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from text and lang of the rows that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(0.9 * sample) / F.col("count")).alias("part"))
    counts = materialize(counts, "counts", few=True)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20))
    drawn = known.select("lang", "text", "doc_id").join(small(counts), "lang").where(draw < F.col("part") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
    drawn = drawn.withColumn("nth", place).where(F.col("nth") <= sample).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_groups(batches):
            pick = [(lang, features(t)) for lang, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True) if LETTER.search(t)]
            if pick:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([p[0] for p in pick]), "x": pa.array([p[1].astype(np.float16).tobytes() for p in pick], pa.binary())})

    labels = []
    with tempfile.TemporaryFile() as f:
        for r in materialize(drawn.mapInArrow(frugal(run), "lang string, x binary"), "drawn").toLocalIterator():
            labels.append(r["lang"])
            f.write(r["x"])
        if not labels:
            return None
        f.flush()
        languages = sorted(set(labels))
        index = {lang: i for i, lang in enumerate(languages)}
        x = np.memmap(f, np.float16, "r", shape=(len(labels), FEATURES))
        return fit(x, np.array([index[lang] for lang in labels]), languages)


def identify(docs: DataFrame, keep: list[str], model: Model | None, lead: float = 0.2) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred, score and ambiguous."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    first = docs.select(F.col("text").alias("_t"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_groups(batches, "_t"):
            texts = texts_of(b, "_t")
            letters = [m is not None and LETTER.search(t) is not None for t in texts]
            pred, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            own = [i for i, ok in enumerate(letters) if ok]
            if own:
                best, p, gap = m.decode(np.stack([features(texts[i]) for i in own]))
                for i, k, s, g in zip(own, best.tolist(), p.tolist(), gap.tolist(), strict=True):
                    pred[i], score[i], unsure[i] = m.languages[k], s, g < lead
            cols = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pred), pa.array(score, pa.float64()), pa.array(unsure)], [*keep, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return first.mapInArrow(frugal(run), f"{schema}, lang_pred string, score double, ambiguous boolean")
