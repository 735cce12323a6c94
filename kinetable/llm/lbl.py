"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts each word from the two words before it: the contexts' vectors, each through
a matrix of its position, are added and multiplied with the word's vector, plus a bias. The
vocabulary grows with the corpus, as the root of the number of its distinct words; so does the
number of words with a context vector of their own. All other words share tails by their last
two bytes: a tail is an entry of the vocabulary, and a word's part of it its smoothed count.

Training is spread over the tasks that hold the text: each runs over its training documents (all
are learnt from once, by a hash of the text in one of ROUNDS rounds, whatever the size) with
mini-batches, in which each true word is told from noise words drawn by frequency. After a
round the tasks' vectors are averaged, each row by how often a task met it. So what is learnt
from grows in proportion to the corpus, and what is gathered are the rows that tasks have met.

Scores are exact log10 probabilities: for every pair of context classes the sum over the whole
vocabulary is made by batched matrix products, dealt over tasks, and a token's score is its
product less that sum. Word counts are unbounded: those of the most frequent words go to all
tasks, the others meet their texts in a join.

Rows: null text is empty and scores as its end mark alone; rows whose id is null are scored
but not learnt from; repeated rows count as often as they occur; without training text all
tokens are unknown and the model is the base. A text of any length is read whole, and further
columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, prepare, text_groups, texts_of
from .suffix import _dump, _load

HEAD, DIM = 100_000, 32
#: Rounds (each learns from as large a part of the training text, together from all of it), mini-batches
#: that a task runs at least (over its text again if it has less), tokens of a mini-batch, its noise
#: words, and for how many noise words a token these stand.
ROUNDS, LEAST_STEPS, BATCH, NOISE, ODDS = 2, 60, 1024, 192, 20
#: The end of a text as a token; no word holds white space.
END = "\n"


def words_of(text: str) -> list[bytes]:
    """Words between white space [\\x20\\x09-\\x0D], with A to Z in lower case."""
    return text.encode().lower().split()


def sizes(distinct: int) -> tuple[int, int, int]:
    """Words of the vocabulary, words with a context vector of their own, and tails."""
    words = min(distinct, max(256, math.ceil(8 * math.sqrt(distinct))))
    classes = math.ceil(4 * math.sqrt(words))
    tails = max(4, classes // 8)
    return words, min(words, classes - tails), tails


def tail_of(word: bytes, tails: int) -> int:
    return zlib.crc32(word[-2:]) % tails


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """``words``: the vocabulary, the end mark first, then by frequency; entries from len(words)
    on are tails. The first ``own`` words are context classes; the others' class is own + tail."""

    words: list[bytes]
    own: int
    tails: int
    counts: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray
    head: dict[bytes, int]
    params: dict[str, np.ndarray] = field(default_factory=dict)
    log_sum: np.ndarray | None = None

    def start(self) -> None:
        r, n, c = np.random.default_rng(3), len(self.counts), self.own + self.tails
        eye = np.eye(DIM, dtype=np.float32)
        self.params = {
            "context": r.normal(0, 0.1, (c, DIM)).astype(np.float32), "positions": np.concatenate([0.5 * eye, eye]), "target": r.normal(0, 0.1, (n, DIM)).astype(np.float32),
            "bias": np.log(self.noise).astype(np.float32)[:, None],
        }

    @functools.cached_property
    def noise(self) -> np.ndarray:
        """Frequency of each entry, none of them nothing."""
        return (self.counts + 0.5) / (self.counts + 0.5).sum()

    @functools.cached_property
    def class_of(self) -> np.ndarray:
        """Context class of each entry."""
        tail = [self.own + tail_of(w, self.tails) for w in self.words[self.own :]]
        return np.array([*range(self.own), *tail, *range(self.own, self.own + self.tails)], np.int32)

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors through the matrices of the first and the second position."""
        p = self.params
        return p["context"] @ p["positions"][:DIM], p["context"] @ p["positions"][DIM:]

    def log_sums(self, first_class: int) -> np.ndarray:
        """For contexts that begin with a class, by their second class: the logarithm of the sum
        of all entries' exponentials."""
        first, second = self.projected()
        h, out = first[first_class] + second, None
        for k in range(0, len(self.counts), 2048):
            s = h @ self.params["target"][k : k + 2048].T + self.params["bias"][k : k + 2048, 0]
            part = np.logaddexp.reduce(s, 1) if s.shape[1] < 8 else _log_sum(s)
            out = part if out is None else np.logaddexp(out, part)
        return out

    def log_probability(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """log10 P(entry | classes of the two words before)."""
        (first, second), out = self.projected(), np.empty(len(entry))
        for k in range(0, len(entry), 8192):  # what is gathered stays in a core's cache
            s = slice(k, k + 8192)
            out[s] = np.einsum("ij,ij->i", first[one[s]] + second[two[s]], self.params["target"][entry[s]])
        return (out + self.params["bias"][entry, 0] - self.log_sum[one, two]) / np.log(10)


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return top + np.log(np.exp(s - top[:, None]).sum(1))


class _Entries(dict):
    """Entry of a word; kept for the words met before, within a bound."""

    def __init__(self, m: Model):
        self.own = {w: i for i, w in enumerate(m.words)}
        super().__init__(self.own)
        self.first_tail, self.tails = len(m.words), m.tails

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.own) + 200_000:
            self.clear()
            self.update(self.own)
        self[word] = k = self.first_tail + tail_of(word, self.tails)
        return k


class _Places(dict):
    """Place of a word in the arrays ``entry`` (of the vocabulary), ``log`` (of its count and one) and
    ``inside`` (its part of a tail): first the ``heads``, then the end mark if it is none of them,
    and from ``known`` on a place a tail for all other words."""

    def __init__(self, m: Model):
        super().__init__((w, i) for i, w in enumerate(m.head))
        self.heads = len(self)
        self.setdefault(END.encode(), self.heads)
        self.known, self.tails, self.bound = len(self), m.tails, len(self) + 200_000
        own, tails = {w: i for i, w in enumerate(m.words)}, len(m.words)
        entry = [own[w] if w in own else tails + tail_of(w, m.tails) for w in self]
        self.entry = np.array([*entry, *range(tails, tails + m.tails)], np.int32)
        self.log = np.zeros(len(self.entry))
        self.log[: self.heads] = np.log10(np.fromiter(m.head.values(), float, self.heads) + 1)
        self.inside = np.where(self.entry < tails, 0.0, self.log - np.r_[np.zeros(tails), np.log10(m.tail_total + 1)][self.entry])

    def __missing__(self, word: bytes) -> int:
        k = self.known + tail_of(word, self.tails)
        if len(self) < self.bound:  # words met later are looked up each time
            self[word] = k
        return k


def _numbers(get, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What ``get`` says of each word and of the end mark of each text, and how many these are."""
    n = np.array([len(w) + 1 for w in texts], np.int64)
    ends = itertools.repeat((END.encode(),))
    return np.fromiter(map(get, itertools.chain.from_iterable(itertools.chain.from_iterable(zip(texts, ends)))), np.int32, int(n.sum())), n


def _contexts(m: Model, entry: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Classes of the two words before, and entry, of each token, with the number of tokens of each
    text; the end mark is a token, and a text starts with two of them as context."""
    start = np.cumsum(n) - n
    cls = m.class_of[entry]
    two = np.r_[np.int32(0), cls[:-1]]
    two[start] = 0
    one = np.r_[np.int32(0), two[:-1]]
    one[start] = 0
    return one, two, entry


class Learner:
    """Mini-batch steps of noise-contrastive estimation on a copy of the model's vectors. What a
    step fills is allocated once: fresh arrays of this size cost more in page faults than the sums
    in them."""

    def __init__(self, m: Model, rate: float, seed: int):
        self.m, self.rate, self.rng = m, rate, np.random.default_rng(seed)
        # an entry's vector and bias lie in one row, so that they are gathered and moved at once
        self.joint = np.concatenate([m.params["target"], m.params["bias"]], 1)
        self.p = {k: m.params[k].copy() for k in ("context", "positions")} | {"target": self.joint[:, :DIM], "bias": self.joint[:, DIM:]}
        self.speed = {k: np.full(len(v), 1e-8, np.float32) for k, v in self.p.items()}
        self.met = {k: np.zeros(len(v), np.float32) for k, v in self.p.items()}
        self.log_noise = np.log(ODDS * m.noise).astype(np.float32)
        self.cum, self.steps = np.cumsum(m.noise), 0
        c, new = len(self.p["context"]), lambda *shape: np.empty(shape, np.float32)
        self.first, self.second = np.zeros((c, DIM + 1), np.float32), np.ones((c, DIM + 1), np.float32)  # last columns add up to one
        self.h, self.other, self.t, self.f = (new(k, DIM + 1) for k in (BATCH, BATCH, BATCH, NOISE))
        self.down, self.back, self.part = new(BATCH, NOISE), new(BATCH, DIM), new(BATCH, DIM)
        self.values, self.sorted = new(BATCH + NOISE, DIM + 1), new(BATCH + NOISE, DIM + 1)
        self.sorted_back = new(BATCH, DIM)

    @staticmethod
    def _sums(rows: np.ndarray, values: np.ndarray, n: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that occur (of ``n``), how often, and the sums of their values, sorted into ``held``."""
        order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")  # of 16 bits by radix
        r = rows[order]
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        held = np.take(values, order, 0, out=held[: len(r)], mode="clip")  # with another mode a copy is made
        return r[edge], np.diff(np.r_[edge, len(r)]), np.add.reduceat(held, edge, axis=0)

    def _pace(self, name: str, own: np.ndarray, times: np.ndarray, g: np.ndarray) -> np.ndarray:
        """How far rows move for each unit of their gradients."""
        speed = self.speed[name][own] + np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.speed[name][own] = speed
        self.met[name][own] += times
        return np.sqrt(speed)[:, None]

    def step(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        p, n = self.p, len(entry)
        fake = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        context, at = p["context"], p["positions"]
        # few classes stand for many tokens: what is linear is done once a class
        self.first[:, :DIM], self.second[:, :DIM] = context @ at[:DIM], context @ at[DIM:]
        h, t, f, down, back, values = self.h[:n], self.t[:n], self.f, self.down[:n], self.back[:n], self.values[: n + NOISE]
        np.take(self.first, one, 0, out=h, mode="clip")
        h += np.take(self.second, two, 0, out=self.other[:n], mode="clip")
        for i, out in ((entry, t), (fake, f)):
            np.take(self.joint, i, 0, out=out, mode="clip")
            out[:, DIM] -= self.log_noise[i]
        true = np.einsum("ij,ij->i", h, t)
        up = (1 / (n + n * np.exp(np.clip(true, -30, 30)))).astype(np.float32)[:, None]
        against, scale = -f.T, np.float32(-ODDS / NOISE / n)
        with np.errstate(over="ignore"):  # where the exponential overflows, the inverse is zero
            for k in range(0, n, 256):  # the one large matrix, in parts that stay in a core's cache
                x = np.matmul(h[k : k + 256], against, out=down[k : k + 256])
                np.exp(x, out=x)
                x += 1
                np.divide(scale, x, out=x)
                np.matmul(x, f[:, :DIM], out=back[k : k + 256])
        back += np.multiply(up, t[:, :DIM], out=self.part[:n])
        # the last column of h is one, so that of the gradients is the bias's
        np.multiply(up, h, out=values[:n])
        np.matmul(down.T, h, out=values[n:])
        own, times, g = self._sums(np.concatenate([entry, fake]), values, len(self.log_noise), self.sorted)
        pace = [self._pace("target", own, times, g[:, :DIM]), self._pace("bias", own, times, g[:, DIM:])]
        g *= self.rate
        g[:, :DIM] /= pace[0]
        g[:, DIM:] /= pace[1]
        self.joint[own] += g
        first, second = (np.zeros_like(context) for _ in range(2))
        seen = np.zeros(len(context), bool)
        for rows, out in ((one, first), (two, second)):
            own, times, g = self._sums(rows, back, len(context), self.sorted_back)
            out[own], seen[own] = g, True
            self.met["context"][own] += times
        grad = np.concatenate([context.T @ first, context.T @ second])
        own = np.flatnonzero(seen)
        for name, rows, times, g in (("context", own, 0, first[own] @ at[:DIM].T + second[own] @ at[DIM:].T), ("positions", np.arange(2 * DIM), 1, grad)):
            p[name][rows] += self.rate * g / self._pace(name, rows, times, g)
        self.steps += 1

    def run(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        order = self.rng.permutation(len(entry))
        for k in range(0, len(order), BATCH):
            i = order[k : k + BATCH]
            self.step(one[i], two[i], entry[i])


def _learn(shared, round_: int, rate: float):
    """Training text to what a task has learnt: rows that it met, how often, and how far they moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of, task = _Entries(m), TaskContext.get().partitionId()
        learner, first = Learner(m, rate, 1000 * round_ + task % 997), None
        for b in text_groups(batches):
            held = _contexts(m, *_numbers(of.__getitem__, [words_of(t) for t in texts_of(b)]))
            first = held if first is None else first
            learner.run(*held)
        while first is not None and learner.steps < LEAST_STEPS:
            learner.run(*first)
        out = []
        for name, v in learner.p.items():
            rows = np.flatnonzero(learner.met[name])
            for k in range(0, len(rows), 512) if first is not None else ():
                r, n = rows[k : k + 512], learner.met[name][rows[k : k + 512]]
                moved = (v[r] - m.params[name][r]) * n[:, None]
                out.append((name, int(r[0]) // 4096, task % 32, _dump(r.astype("<i4"), n.astype("<f4"), moved.astype("<f4").ravel())))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["name", "chunk", "salt", "blob"])

    return frugal(run)


def _merge(key, group):
    """Rows of several tasks added up."""
    name = key[0].as_py()
    each = [_load(x.as_py(), "<i4", "<f4", "<f4") for x in group["blob"]]
    rows, n = (np.concatenate([e[k] for e in each]) for k in (0, 1))
    moved = np.concatenate([e[2] for e in each]).reshape(len(rows), -1)
    order = np.argsort(rows, kind="stable")
    edge = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
    r, n, moved = rows[order][edge], np.add.reduceat(n[order], edge), np.add.reduceat(moved[order], edge, axis=0)
    blob = _dump(r.astype("<i4"), n.astype("<f4"), moved.astype("<f4").ravel())
    return pa.table({"name": pa.array([name]), "chunk": pa.array([key[1].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()).cast(pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for b in text_groups(batches):
        for text in texts_of(b):
            seen.update(words_of(text))
        seen[END.encode()] += b.num_rows
        if len(seen) > 300_000:
            yield flush()
    yield flush()


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts as a few binary rows: far less memory on the driver than rows."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_pydict({"words": pa.array([" ".join(b.column(0).to_pylist()).encode()], pa.binary()), "n": pa.array([b.column(1).to_numpy().astype("<i8").tobytes()], pa.binary())})


def train(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and the counts of all words (word, n) in training text."""
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(known.mapInArrow(frugal(_count_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    if not distinct:
        return None, counts
    n_words, own, tails = sizes(distinct)
    top = counts.orderBy(F.desc("n"), "word").limit(max(HEAD, n_words)).mapInArrow(_pack_words, "words binary, n binary").collect()
    pairs = [p for r in top for p in zip(bytes(r["words"]).split(b" "), np.frombuffer(r["n"], "<i8").tolist(), strict=True)]
    head = dict(sorted(pairs, key=lambda p: (-p[1], p[0])))
    end = END.encode()
    words = [end, *[w for w in head if w != end][: n_words - 1]]
    tail = F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % tails
    tail_count, tail_total = np.zeros(tails), np.zeros(tails)
    for r in counts.groupBy(tail.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_count[r["k"]], tail_total[r["k"]] = r["n"], r["n"] + r["v"]
    for w in words:
        if w in head:
            tail_count[tail_of(w, tails)] -= head[w]
            tail_total[tail_of(w, tails)] -= head[w] + 1
    m = Model(words, min(own, len(words)), tails, np.r_[[head.get(w, 0) for w in words], tail_count], total, distinct, tail_total, head)
    m.start()
    for k in range(ROUNDS):
        learn_round(known, m, k, 0.1 / (1 + k))
    # sums over the vocabulary, a row of contexts at a time
    shared, classes = spark.sparkContext.broadcast(m), m.own + m.tails

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "s": pa.array([shared.value.log_sums(i).astype("<f4").tobytes()], pa.binary())})

    m.log_sum = np.empty((classes, classes), np.float32)
    for r in spark.range(0, classes, 1, min(classes, 64)).mapInArrow(frugal(sums), "i long, s binary").collect():
        m.log_sum[r["i"]] = np.frombuffer(r["s"], "<f4")
    return m, counts


def learn_round(known: DataFrame, m: Model, k: int, rate: float) -> None:
    """One round over another part of the training texts; the model takes the averages."""
    shared = known.sparkSession.sparkContext.broadcast(m)
    mine = known.where(F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(ROUNDS)) == k)
    learnt = mine.mapInArrow(_learn(shared, k, rate), "name string, chunk int, salt int, blob binary")
    kind = "name string, chunk int, blob binary"
    first = learnt.groupBy("name", "chunk", "salt").applyInArrow(lambda key, g: _merge(key, g), kind)
    new = {n: v.copy() for n, v in m.params.items()}
    for r in first.groupBy("name", "chunk").applyInArrow(_merge, kind).collect():
        rows, n, moved = _load(r["blob"], "<i4", "<f4", "<f4")
        new[r["name"]][rows] += moved.reshape(len(rows), -1) / n[:, None]
    m.params = new


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = prepare(docs.sparkSession)
    model, counts = train(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        of = _Places(m) if m else None
        for b in text_groups(batches):
            texts = [words_of(t) for t in texts_of(b)]
            if not m:
                rows = [(len(w) + 1, 0, 0.0, 0.0, list(c), list(c.values())) for w in texts for c in (Counter(x.decode() for x in w),)]
            else:
                place, n = _numbers(of.__getitem__, texts)
                start = np.cumsum(n) - n
                entry, rare = of.entry[place], np.flatnonzero(place >= of.known)
                gained = m.log_probability(*_contexts(m, entry, n)) + of.inside[place]
                total, log, found = (np.add.reduceat(v, start) for v in (of.log[place], gained, (place < of.heads).astype(np.int64)))
                cut, rows = np.searchsorted(rare, np.r_[start, len(place)]).tolist(), []
                rare = (rare - np.repeat(start, np.diff(cut))).tolist()
                for i, words in enumerate(texts):
                    c = Counter([words[k] for k in rare[cut[i] : cut[i + 1]]])
                    rows.append((n[i], found[i], total[i], log[i], [w.decode() for w in c], list(c.values())))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_head", "all_log", "model_log", "words", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, all_log double, model_log double, words array<string>, times array<long>"
    base = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(frugal(run), schema)
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = base.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"))
    out = base.drop("words", "times").join(found, "row", "left")
    rare_log, n = F.coalesce("rare_log", F.lit(0.0)), F.lit(model.total if model else 0)
    base_score = F.col("all_log") + rare_log - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)) if model else 0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), n.cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("model_log") + rare_log if model else base_score).alias("score"),
    )
