"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is its set of five-word shingles, each weighted by its count times a damped
inverse document frequency. ICWS draws ``bands * rows`` samples from each weighted set; two
documents draw the same sample with a probability equal to their weighted Jaccard
similarity. Documents that share all samples of a band are compared, on whole texts, by
exact weighted Jaccard similarity, and linked from the threshold up.

Document frequencies cover the whole corpus in a count-min sketch of fixed size (1 MB a
row; an estimate is at most a few parts in a million of all shingles too high), so what is
gathered and broadcast doesn't grow with the data. The frequency only scales weights from
1 to 1 + IDF, so the similarity stays close to the unweighted one.

Equal texts are one document here; copies join its class at the end. Documents that share a
bucket meet at its smallest id, their representative, so a pair that shares several buckets
meets once. First all are compared with their representative. Then, wherever documents of one
representative are still in different classes, all their pairs of different classes are
compared: the members are cut into blocks by class and bytes, and two blocks at a time are
compared in one task, by a product of their matrices of shingles. Only links that join two
classes come out, so what is written stays in proportion to the documents however many pairs
are compared. So every pair that shares a bucket is compared, or of one class by other links.
Where the samples of a document and its representative already tell that they are far below
the threshold (over four standard deviations), their texts are not read.

Rows: a null, empty or blank text, and a null id, is alone in its class; rows with the same
id are one document; further columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, prepare, release, small, text_groups, texts_of, with_groups
from .components import components
from .shingles import bags, mix

WIDTH, DEPTH, CHUNK, IDF = 1 << 18, 2, 1 << 13, 0.25
_CHUNKS = WIDTH * DEPTH // CHUNK
#: Members and bytes of text in a block; bytes of text that one group of blocks stands for;
#: columns of a matrix of shingles that are multiplied at once.
MEMBERS, BLOCK_BYTES, GROUP_BYTES, COLUMNS = 256, 1 << 20, 4 << 20, 8192
#: Text whose samples are drawn at once (so little that it stays in a core's cache).
SIGN_BYTES = 1 << 19


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The sketch's slot for each shingle in each row."""
    return [(((h >> np.uint64(20 * d)) & np.uint64(WIDTH - 1)) + np.uint64(d * WIDTH)).astype(np.int64) for d in range(DEPTH)]


def document_frequencies(texts: DataFrame, words: int = 5) -> np.ndarray:
    """The count-min sketch of how many texts have each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH * DEPTH, np.int64)
        for b in text_groups(batches):
            for s in _slots(bags(texts_of(b), words)[1]):
                total += np.bincount(s, minlength=len(total))
        salt = TaskContext.get().partitionId() % 64
        rows = [(k, zlib.compress(c.astype("<i8").tobytes(), 1)) for k, c in enumerate(total.reshape(_CHUNKS, CHUNK)) if c.any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([r[0] for r in rows], pa.int32()), "salt": pa.array([salt] * len(rows), pa.int32()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    def add(key, group):
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in group["counts"])
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = "chunk int, counts binary"
    parts = texts.select("text").mapInArrow(frugal(run, "words"), "chunk int, salt int, counts binary")
    sums = parts.groupBy("chunk", "salt").applyInArrow(lambda key, g: add(key, g), out).groupBy("chunk").applyInArrow(add, out)
    total = np.zeros((_CHUNKS, CHUNK), np.int64)
    for r in sums.collect():
        total[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return total.reshape(-1)


class Weights:
    """Weights of shingles from the sketch."""

    def __init__(self, sketch: np.ndarray, texts: int, idf: float = IDF):
        self.table = sketch
        self.scale, self.idf = np.log1p(max(texts, 1)), idf

    def __call__(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        df = np.minimum.reduce([self.table[s] for s in _slots(h)])
        return count * (1 + self.idf * np.clip(1 - np.log1p(df) / self.scale, 0, 1))


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) twice (the second as logarithm) and uniform draws, by 16 bits of a hash."""
    rng = np.random.default_rng(7)
    return rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16).astype(np.float32)


def samples(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each run of one text (texts with no shingle are left out) n samples as hashes."""
    r_of, c_of, u_of = _tables()
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    index, low = np.arange(len(h), dtype=np.uint64), np.uint64(0xFFFF)
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(begin), n), np.uint64)
    for k in range(n):
        z = mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r, u = r_of[z >> np.uint64(48)], u_of[(z >> np.uint64(16)) & low]
        t = np.floor(log_w / r + u)
        a = c_of[(z >> np.uint64(32)) & low] - r * (t - u + 1)
        bits = a.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        best = (np.minimum.reduceat((order << np.uint64(32)) | index, begin) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = mix(z[best] ^ (t[best].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted hashes."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(float(a[1].sum() + b[1].sum()) - both, 1e-12)


def links_within(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cls: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) that join the classes of the sets as all pairs of different classes with a
    weighted Jaccard similarity from the threshold up do; sets on one side > 0 aren't compared
    with each other. A set is (hashes, counts, weights), its weight of a hash the count times
    a factor that is the same in all sets."""
    n, total = len(sets), np.array([float(w.sum()) for _, _, w in sets])
    differ = np.triu(cls[:, None] != cls[None, :], 1) & ~((side[:, None] == side[None, :]) & (side[:, None] > 0))
    i, j = np.nonzero(differ)
    if len(i) <= 8:
        good = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if similarity(sets[x][::2], sets[y][::2]) >= threshold]
        return _forest(list(zip(i[good].tolist(), j[good].tolist(), strict=True)), cls)
    # a column for each occurrence of a shingle that two sets have: products are then minima
    h = np.concatenate([np.repeat(x, c) for x, c, _ in sets])
    nth = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c, _ in sets])
    factor = np.concatenate([np.repeat(w / c, c) for _, c, w in sets])
    row = np.repeat(np.arange(n), [int(c.sum()) for _, c, _ in sets])
    key = mix(h ^ (nth.astype(np.uint64) << np.uint64(48)))
    order = np.argsort(key)
    key, row, factor = key[order], row[order], np.sqrt(factor[order])
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = (np.bincount(column) > 1)[column] if len(column) else new
    row, factor, column = row[shared], factor[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        m = np.zeros((n, COLUMNS if b < len(column) else int(column[-1]) + 1 - k * COLUMNS), np.float32)
        m[row[a:b], column[a:b] - k * COLUMNS] = factor[a:b]
        both += m @ m.T
    s = (both / np.maximum(total[:, None] + total[None, :] - both, 1e-12))[i, j]
    near = np.flatnonzero(s >= threshold - 1e-3)
    near = near[np.argsort(-s[near], kind="stable")]
    sure = s[near] >= threshold + 1e-3
    found = ((x, y) for x, y, ok in zip(i[near].tolist(), j[near].tolist(), sure.tolist(), strict=True) if ok or similarity(sets[x][::2], sets[y][::2]) >= threshold)
    return _forest(found, cls)


def _forest(links, cls: np.ndarray) -> list[tuple[int, int]]:
    """Of links between items those that join two classes that earlier ones haven't joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in links:
        a, b = root(int(cls[i])), root(int(cls[j]))
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 12, rows: int = 4, words: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (smallest id of its class), kept."""
    spark = prepare(docs.sparkSession)
    n = bands * rows
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = base.where("doc_id is not null and text rlike '\\\\S'")
    facts = materialize(own.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "facts")
    groups = facts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    groups, total = materialize(groups.select("sha", "first", "n"), "groups", few=True), facts.count()
    copies = materialize(with_groups(facts, groups, ["sha"], "n", total).where("doc_id > first").select("doc_id", "first").distinct(), "copies", few=True)
    discard(facts, groups)
    # a row with the id of a copy, whatever its text, is that document's; so its text counts too
    distinct = own.join(small(copies.select("doc_id")), "doc_id", "left_anti")

    weights = spark.sparkContext.broadcast(Weights(document_frequencies(distinct, words), total))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_groups(batches, limit=SIGN_BYTES):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            text, h, count = bags(texts_of(b), words)
            if not len(h):
                continue
            s = samples(text, h, weights.value(h, count), n)
            one = np.unique(text)
            keys = mix(np.arange(bands, dtype=np.uint64))[None, :] + np.zeros((len(one), 1), np.uint64)
            for k in range(rows):
                keys = mix(keys ^ s[:, k::rows])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[one], pa.int64()),
                "n_bytes": b.column(2).take(pa.array(one)),
                "keys": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                "sketch": pa.array(list((s & np.uint64(0x7FFF)).astype(np.int16)), pa.list_(pa.int16())),
            })

    signed = distinct.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    signed = materialize(signed.mapInArrow(frugal(sign, "words"), "doc_id long, n_bytes long, keys array<long>, sketch array<short>"), "signed")
    member = signed.select("doc_id", F.explode("keys").alias("key")).distinct()
    sizes = member.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1").select("key", "rep")
    member = materialize(member.join(sizes, "key").where("doc_id > rep").select("doc_id", "rep").distinct(), "member", few=True)
    ids = materialize(member.select("doc_id").union(member.select("rep")).distinct(), "ids", few=True)
    texts = materialize(distinct.join(small(ids), "doc_id", "left_semi"), "texts")
    sketch = materialize(signed.join(small(ids), "doc_id", "left_semi").select("doc_id", "n_bytes", "sketch"), "sketch")

    # Far below the threshold: over four standard deviations of the share of equal samples.
    least = int(n * (threshold - 4.2 * (threshold * (1 - threshold) / n) ** 0.5))
    schema = "a long, b long"

    def compare(key, group):
        """Links of each task-sized lot of (part, doc_id, class, side, text)."""
        part, doc, cls, side = (group[c].to_numpy() for c in ("part", "doc_id", "class", "side"))
        order = np.lexsort((doc, side, part))
        edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
        text, out = group["text"].combine_chunks(), []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            o = order[x:y]
            at, h, count = bags(text.take(pa.array(o)).to_pylist(), words)
            w, cut = weights.value(h, count), np.searchsorted(at, np.arange(len(o) + 1))
            sets = [(h[p:q], count[p:q], w[p:q]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            out += [(int(doc[o[i]]), int(doc[o[j]])) for i, j in links_within(sets, cls[o], side[o], threshold)]
        release("words")
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def compared(lots: DataFrame, name: str) -> DataFrame:
        """``lots``: part (what is compared together), doc_id, class, side, n_bytes."""
        lots = materialize(lots, "lots", few=True)
        tasks = max(1, math.ceil((lots.agg(F.sum("n_bytes")).first()[0] or 0) / GROUP_BYTES))
        dealt = lots.withColumn("task", F.pmod("part", F.lit(tasks))).drop("n_bytes")
        return materialize(texts.join(small(dealt), "doc_id").groupBy("task").applyInArrow(compare, schema), name)

    # 1. each with its representative; one of many is compared in parts of MEMBERS
    one, two = sketch.select("doc_id", "n_bytes", F.col("sketch").alias("x")), sketch.select(F.col("doc_id").alias("rep"), F.col("n_bytes").alias("rep_bytes"), F.col("sketch").alias("y"))
    equal = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    pairs = member.join(one, "doc_id").join(two, "rep").where(equal >= least).select("rep", "doc_id", "n_bytes", "rep_bytes")
    pairs = materialize(pairs.groupBy("rep", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.max("rep_bytes").alias("rep_bytes")), "pairs", few=True)
    fans = pairs.groupBy("rep").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n_bytes") / BLOCK_BYTES)).alias("parts"), F.max("rep_bytes").alias("n_bytes"))
    fans = materialize(fans, "fans", few=True)
    share = F.pmod(F.xxhash64(F.lit(3), "doc_id"), "parts")
    zero, lot = F.lit(0), F.xxhash64("rep", "share").alias("part")
    leads = fans.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    leads = leads.select(lot, F.col("rep").alias("doc_id"), F.col("rep").alias("class"), zero.alias("side"), "n_bytes")
    rest = pairs.select("rep", "doc_id", "n_bytes").join(small(fans.select("rep", "parts")), "rep").withColumn("share", share)
    rest = rest.select(lot, "doc_id", F.col("doc_id").alias("class"), F.lit(1).alias("side"), "n_bytes")
    found = compared(leads.unionByName(rest), "near")

    # 2. pairs of different classes that have one representative, which itself is done
    named = materialize(found.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c")), "named", few=True)
    up = small(named.select(F.col("doc_id").alias("c"), F.col("c").alias("up")))
    named = materialize(named.join(up, "c", "left").select("doc_id", F.coalesce("up", "c").alias("c")), "named", few=True)
    many = materialize(member.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep"), "many", few=True)
    left = member.join(small(many), "rep", "left_semi").join(small(named), "doc_id", "left")
    left = left.select("rep", "doc_id", F.coalesce("c", "doc_id").alias("class"))
    left = materialize(left.join(sketch.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes")), "doc_id"), "left", few=True)
    still = materialize(left.groupBy("rep").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("rep"), "still", few=True)
    left = left.join(small(still), "rep", "left_semi")
    sizes = left.groupBy("rep", "class").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    sizes = sizes.withColumn("parts", F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("bytes") / BLOCK_BYTES)))
    large = materialize(sizes.where("parts > 1").select("rep", "class", "parts"), "large", few=True)  # classes with blocks of their own
    others = sizes.where("parts = 1").groupBy("rep").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    others = materialize(others.select("rep", F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("bytes") / BLOCK_BYTES)).alias("mixed")), "others", few=True)
    nth = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(F.pmod(F.xxhash64("class"), "mixed"))
    blocks = left.join(small(large), ["rep", "class"], "left").join(small(others), "rep", "left")
    blocks = blocks.select("rep", "doc_id", "class", "n_bytes", F.when(F.col("parts").isNotNull(), F.col("class")).alias("of"), nth.alias("nth"))
    # two blocks meet unless both are of one class
    every = large.select("rep", F.col("class").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("nth"))
    every = every.unionByName(others.select("rep", F.lit(None).cast("long").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("mixed") - 1)).alias("nth")))
    other = every.select("rep", F.col("of").alias("of2"), F.col("nth").alias("nth2"))
    name, name2 = F.struct(F.coalesce("of", F.lit(-1)), F.col("of").isNull(), "nth"), F.struct(F.coalesce("of2", F.lit(-1)), F.col("of2").isNull(), F.col("nth2").alias("nth"))
    meet = every.join(other, "rep").where(F.col("of").isNull() | F.col("of2").isNull() | (F.col("of") != F.col("of2")))
    meet = meet.select("rep", "of", "nth", F.xxhash64("rep", F.least(name, name2), F.greatest(name, name2)).alias("part"), F.when(name == name2, 0).when(name < name2, 1).otherwise(2).alias("side"))
    meet = materialize(meet, "meet", few=True)
    same = blocks["rep"].eqNullSafe(meet["rep"]) & blocks["of"].eqNullSafe(meet["of"]) & (blocks["nth"] == meet["nth"])
    lots = blocks.join(small(meet), same).select("part", "doc_id", "class", "side", "n_bytes")
    more = compared(lots, "more")

    out = base.select("doc_id")
    classes = components(copies.toDF("a", "b").unionByName(found).unionByName(more))
    out = out.join(classes, out["doc_id"] == classes["node"], "left")
    class_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
