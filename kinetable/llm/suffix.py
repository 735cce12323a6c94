"""Removal of byte strings that repeat across documents, by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id. Sorting every suffix would shuffle many times the input, so suffixes are
bucketed by anchors first: the least of the hashed 16-grams inside a string of ``length``
bytes. Equal strings have the same anchor at the same offset, so each string need only be
compared with those in the bucket of its anchor's 16-gram.

1. Whole texts that equal one with a smaller id need no search: they go as a whole.
2. Anchors (one in about 18 positions) are dealt by 16-gram, 8 bytes each and packed many
   to a row; those whose 16-gram is in one document only are dropped.
3. Around the others the text that their strings cover is dealt by 16-gram. There suffixes
   are put in buckets by their first 8 bytes, and each position points to its bucket. Then
   the members of each bucket are sorted by the pointers at the offset up to which they are
   known to be equal, which splits the bucket and gives its members new pointers; the next
   step reads these, so each step doubles the depth. A bucket of one member, or of one
   document, is settled and not sorted again. Buckets are exact: no hash decides.
4. Intervals go back to their documents.

Before each shuffle a task keeps, of equal entries, the one of its smallest document and
decides the others at once, so a passage that a third of all documents share arrives once
for each batch of text, not for each document. A text longer than a block is searched in
pieces that overlap by ``length`` - 1 bytes, so each string lies in one piece.

Rows: null text is empty; texts shorter than ``length`` stay as they are; a row with a null
id neither removes nor loses anything; rows with the same id don't remove from each other,
and each gets its own answer; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, prepare, release, small, text_groups, with_groups

#: Bytes in an anchor's gram, and in the first buckets' grams; text that a part or bucket stands for.
GRAM, FIRST, PART_BYTES = 16, 8, 3 << 20
#: Bytes of text that are searched at once, and whose anchors are dealt at once; positions whose
#: hashes are made at once (so few that they stay in a core's cache).
BLOCK, DEAL, STEP = 1 << 20, 16 << 20, 1 << 15
#: Bytes of contexts that are refined at once (more only if one 16-gram's are more).
SEARCH = 2 << 20
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _B
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two neighbouring buckets."""
    return _mix(a * _A + _mix(b + _A))


def _first(sorted_values: np.ndarray) -> np.ndarray:
    """For each element the index of the first of its run of equals."""
    new = np.r_[True, sorted_values[1:] != sorted_values[:-1]] if len(sorted_values) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _dump(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.array([len(a)], "<u4").tobytes() + a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _load(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)
    at, out = 0, []
    for k in kinds:
        n = int(np.frombuffer(raw, "<u4", 1, at)[0])
        out.append(np.frombuffer(raw, k, n, at + 4))
        at += 4 + out[-1].nbytes
    return out


def part_of(doc_id: np.ndarray, parts: int) -> np.ndarray:
    return (doc_id ^ (doc_id >> 7) ^ (doc_id >> 19)) % parts


def part_column(doc_id: Column, parts: int) -> Column:
    folded = doc_id.bitwiseXOR(F.shiftright(doc_id, 7)).bitwiseXOR(F.shiftright(doc_id, 19))
    return F.pmod(folded, F.lit(parts)).cast("int")


class Block:
    """Some texts laid end to end, with the anchor of every string of ``length`` bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.sizes = sizes
        self.bytes = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
        #: The eight bytes at every position as one number, read in place.
        self.eight = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Runs of strings with one anchor: where the first begins, how many there are, the
        anchor's place, its 16-gram's identifier, and the text they lie in."""
        n, width, low_bits = int(self.starts[-1]), self.length - GRAM + 1, np.uint64(2 * STEP - 1)
        inside = np.zeros(n + 1, bool)  # a string starts here
        edge = np.clip(self.starts[1:] - self.length + 1, self.starts[:-1], None)
        inside[:-1] = np.repeat(np.tile([True, False], len(self.sizes)), np.stack([edge - self.starts[:-1], self.starts[1:] - edge], 1).ravel())
        found = []
        for begin in range(0, n, STEP):
            end = min(n, begin + STEP)
            gram = _pair(self.eight[begin : end + width - 1], self.eight[begin + 8 : end + width + 7])
            low, have = (gram & ~low_bits) | np.arange(len(gram), dtype=np.uint64), 1
            while have * 2 <= width:
                low = np.minimum(low[:-have], low[have:])
                have *= 2
            if have < width:
                low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
            at, ok = (low & low_bits).astype(np.int32), inside[begin:end]
            first = ok.copy()
            first[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
            stop = ok.copy()
            stop[:-1] &= first[1:] | ~ok[1:]
            first, stop = np.flatnonzero(first), np.flatnonzero(stop)
            found.append((first + begin, stop - first + 1, at[first] + np.int64(begin), gram[at[first]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        first, count, at, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, count, at, gram, np.searchsorted(self.starts, first, "right") - 1

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``length`` bytes at some positions."""
        out = _mix(self.eight[at])
        for k in [*range(8, self.length - 7, 8), self.length - 8]:
            out = _pair(out, self.eight[at + k])
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ``length`` bytes at positions a and b are equal, byte for byte."""
        ok = np.ones(len(a), bool)
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            ok &= self.eight[a + k] == self.eight[b + k]
        return ok


def refine(eight: np.ndarray, room: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Positions whose ``length`` bytes also start in another document, the least document that
    has them, and how many positions were sorted in each step.

    ``eight`` holds the eight bytes at each position (of less than 2 GB), ``room`` the bytes up to
    the end of its text, ``doc`` the number of its document. A pointer is the number of a position's bucket;
    a step sorts the members of open buckets by (own pointer, pointer at the offset ``depth``).
    """
    place = np.flatnonzero(room >= FIRST).astype(np.int32)
    key = eight[place]
    pointer, depth, used, steps = np.zeros(len(eight), np.int32), FIRST, 0, []
    while True:
        steps.append(len(place))
        if not len(place):
            return place, place, steps
        order = np.argsort(key)
        place, key = place[order], key[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size, own = np.diff(np.r_[begin, len(place)]), doc[place]
        least, most = np.minimum.reduceat(own, begin), np.maximum.reduceat(own, begin)
        shared = least < most
        there = np.repeat(shared, size)
        if depth == length:
            return place[there], np.repeat(least[shared], size[shared]), steps
        pointer[place] = np.repeat(np.arange(used, used + len(begin), dtype=np.int32), size)
        used += len(begin)
        step = min(depth, length - depth)
        bucket, place = np.repeat(np.arange(int(shared.sum())), size[shared]), place[there]
        room_left = room[place] >= depth + step
        bucket, place = bucket[room_left], place[room_left]
        key = (bucket << 32) | pointer[place + step]
        depth += step


def pieces(rows: Iterator[tuple], length: int, limit: int) -> Iterator[list[tuple]]:
    """Lists of (..., where the piece begins in its text, bytes) with about ``limit`` bytes each,
    from rows of (..., bytes). Each string of ``length`` bytes lies in one piece."""
    held, size = [], 0
    for *own, text in rows:
        for base in range(0, len(text) - length + 1, limit):
            part = text[base : base + limit + length - 1]
            held.append((*own, base, part))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, then the text as bytes."""
    for b in text_groups(batches):
        at = [b.schema.get_field_index(n) for n in names]
        yield from zip(*[b.column(i).to_pylist() for i in at], b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist(), strict=True)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _dealt(target: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' rows by target."""
    order = np.argsort(target, kind="stable")
    t = target[order]
    edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True]) if len(t) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True) if len(t) else []:
        yield int(t[a]), [c[order[a:b]] for c in columns]


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"target": pa.array([p[0] for p in pairs], pa.int32()), "blob": pa.array([p[1] for p in pairs], pa.binary())})


def _anchor_rows(length: int, parts: int):
    """Texts to packed anchors: a target from 0 is a bucket of 16-grams; a negative one a part
    of documents, to which anchors go that are known to be shared."""

    def deal(own: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((own, gram))
        own, pos, gram = own[order], pos[order], gram[order]
        head = _first(gram)
        least, ends = own[head], np.flatnonzero(np.r_[gram[1:] != gram[:-1], True])
        shared = np.repeat(own[ends] != least[ends], np.diff(np.r_[-1, ends]))
        out = [(-1 - p, _dump(d, x)) for p, (d, x) in _dealt(part_of(own[shared], parts), [own[shared], pos[shared]])]
        send = ~shared | (head == np.arange(len(head)))
        route = _mix(gram[send] + _A)
        rest = (route & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out += [(p, _dump(*c)) for p, c in _dealt(((route >> _S) % np.uint64(parts)).astype(np.int64), [rest, own[send], pos[send]])]
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block_rows in pieces(_rows_of(batches, "doc_id"), length, 2 * BLOCK):
            doc, base = (np.array([r[k] for r in block_rows], np.int64) for k in (0, 1))
            block = Block([r[2] for r in block_rows], length)
            _, _, at, gram, text = block.anchors()
            held.append((doc[text], (base[text] + at - block.starts[text]).astype(np.uint32), gram))
            size += int(block.starts[-1])
            if size >= DEAL:
                yield deal(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield deal(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return frugal(run)


def _shared_rows(parts: int):
    """A bucket's anchors to those that more than one document has, by part of documents."""

    def run(key, group):
        target = key[0].as_py()
        if target < 0:
            out = [(-1 - target, x.as_py()) for x in group["blob"]]
        else:
            each = [_load(x.as_py(), "<u4", "<i8", "<u4") for x in group["blob"]]
            rest, own, pos = (np.concatenate(c) for c in zip(*each, strict=True))
            order = np.lexsort((own, rest))
            rest, own, pos = rest[order], own[order], pos[order]
            ends = np.flatnonzero(np.r_[rest[1:] != rest[:-1], True])
            shared = np.repeat(own[ends] != own[_first(rest)][ends], np.diff(np.r_[-1, ends]))
            out = [(p, _dump(d, x)) for p, (d, x) in _dealt(part_of(own[shared], parts), [own[shared], pos[shared]])]
        return pa.Table.from_batches([_rows(out)])

    return run


def _context_rows(length: int, parts: int):
    """A part's texts and shared anchors to the text around them, by 16-gram; what a smaller
    document of the same block has goes to the part itself (negative target) as intervals."""

    def run(key, docs, anchors):
        if not docs.num_rows or not anchors.num_rows:
            return pa.Table.from_batches([_rows([])])
        each = [_load(x.as_py(), "<i8", "<u4") for x in anchors["blob"]]
        owner, place = (np.concatenate(c) for c in zip(*each, strict=True))
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order].astype(np.int64)
        out = []
        for block_rows in pieces(_rows_of(docs.to_batches(), "doc_id", "text_hash"), length, BLOCK):
            doc, own_hash, base = (np.array([r[k] for r in block_rows], np.int64) for k in range(3))
            block = Block([r[3] for r in block_rows], length)
            begin, count, at, gram, text = block.anchors()
            marked = np.zeros(int(block.starts[-1]) + 1, bool)
            for i, d in enumerate(doc.tolist()):
                lo, hi = np.searchsorted(owner, [d, d + 1])
                p = place[lo:hi] - base[i]
                marked[p[(p >= 0) & (p < block.sizes[i])] + block.starts[i]] = True
            keep = marked[at]
            begin, count, gram, text = (x[keep] for x in (begin, count, gram, text))
            whole = _pair(block.hashes(begin), block.hashes(begin + count - 1) + count.astype(np.uint64))
            order = np.lexsort((doc[text], whole))
            begin, count, text, gram, whole = (x[order] for x in (begin, count, text, gram, whole))
            lead = _first(whole)
            equal = (count == count[lead]) & block.same(begin, begin[lead]) & block.same(begin + count - 1, (begin + count - 1)[lead])
            done = equal & (doc[text] > doc[text[lead]])
            pos = (begin - block.starts[text] + base[text]).astype(np.uint32)
            if done.any():
                t = text[done]
                out.append((-1 - key[0].as_py(), _dump(doc[t], own_hash[t], pos[done], pos[done] + (count[done] + length - 1).astype(np.uint32))))
            send = ~done
            begin, count, text, gram, pos = begin[send], count[send], text[send], gram[send], pos[send]
            spread = _mix(gram + _B)
            route, sub = ((spread >> _S) % np.uint64(parts)).astype(np.int64), (spread & np.uint64(255)).astype(np.uint8)
            for p, (s, c, t, x, u) in _dealt(route, [begin, count, text, pos, sub]):
                out.append((p, _dump(doc[t], own_hash[t], x, c.astype(np.uint8), u, block.bytes[_ranges(s, c + length - 1)])))
        return pa.Table.from_batches([_rows(out)])

    return run


def _interval_rows(length: int, parts: int):
    """A bucket's suffixes to the intervals of those that a smaller document has."""

    def run(key, group):
        target = key[0].as_py()
        if target < 0:
            return pa.Table.from_batches([_rows([(-1 - target, x.as_py()) for x in group["blob"]])])
        each = [_load(x.as_py(), "<i8", "<i8", "<u4", "u1", "u1", "u1") for x in group["blob"]]
        doc, own_hash, pos, count, sub, text = (np.concatenate(c) for c in zip(*each, strict=True))
        del each
        size = count.astype(np.int64) + length - 1
        starts = np.cumsum(size) - size
        rank = np.unique(doc, return_inverse=True)[1].astype(np.int32)
        # one 16-gram's contexts are in one share
        shares = max(1, math.ceil(len(text) / SEARCH))
        share, found = sub.astype(np.int32) * shares >> 8, []
        for k in range(shares):
            mine = np.flatnonzero(share == k)
            begin = np.cumsum(size[mine]) - size[mine]
            block = Block([text[_ranges(starts[mine], size[mine])].tobytes()], length)
            n = int(block.starts[-1])
            entry = np.repeat(np.arange(len(mine), dtype=np.int32), size[mine])
            room = (np.repeat(begin + size[mine], size[mine]) - np.arange(n)).astype(np.int32)
            at, least, _ = refine(block.eight[:n], room, rank[mine][entry], length)
            hit = np.sort(at[rank[mine][entry[at]] > least])
            edge = np.r_[True, (hit[1:] != hit[:-1] + 1) | (entry[hit[1:]] != entry[hit[:-1]])] if len(hit) else np.zeros(0, bool)
            e = entry[hit[edge]]
            last = hit[np.r_[edge[1:], True]] if len(hit) else hit
            found.append((mine[e], hit[edge] - begin[e], last + length - begin[e]))
        e, begin, end = (np.concatenate(c) for c in zip(*found, strict=True))
        cols = [doc[e], own_hash[e], (pos[e] + begin).astype(np.uint32), (pos[e] + end).astype(np.uint32)]
        out = pa.Table.from_batches([_rows([(p, _dump(*c)) for p, c in _dealt(part_of(doc[e], parts), cols)])])
        release()
        return out

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch as one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.zeros(0, bool)
    return begin[new], end[np.r_[new[1:], True]] if len(begin) else end


def _cut(docs: pa.Table, intervals: pa.Table, whole_characters: bool) -> Iterator[tuple]:
    each = [_load(x.as_py(), "<i8", "<i8", "<u4", "<u4") for x in intervals["blob"]]
    owner, own_hash, begin, end = (np.concatenate(c) for c in zip(*each, strict=True)) if each else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((own_hash, owner))
    owner, own_hash, begin, end = (x[order] for x in (owner, own_hash, begin, end))
    for doc, h, text in _rows_of(docs.to_batches(), "doc_id", "text_hash"):
        lo, hi = np.searchsorted(owner, [doc, doc + 1])
        mine = np.arange(lo, hi)[own_hash[lo:hi] == h]
        spans = []
        for x, y in zip(*(c.tolist() for c in merged(begin[mine], end[mine])), strict=True):
            if whole_characters:  # keep a character of which a byte stays
                while x < y and text[x] & 0xC0 == 0x80:
                    x += 1
                while x < y < len(text) and text[y] & 0xC0 == 0x80:
                    y -= 1
            if x < y:
                spans.append((x, y))
        kept, last = [], 0
        for x, y in spans:
            kept.append(text[last:x])
            last = y
        yield doc, h, sum(y - x for x, y in spans), len(spans), b"".join([*kept, text[last:]])


def _cut_rows(whole_characters: bool):
    def run(key, docs, intervals):
        rows = list(_cut(docs, intervals, whole_characters))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "text_hash", "n_removed", "n_spans", "kept_bytes"])

    return run


def _docs_of(key, group):
    """The documents of one part that its blobs name."""
    own = [np.unique(_load(x.as_py(), "<i8")[0]) for x in group["blob"]]
    return pa.table({"doc_id": pa.array(np.unique(np.concatenate(own)), pa.int64())})


def remove_repeats(docs: DataFrame, length: int = 50, whole_characters: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_bytes, n_removed, n_spans, kept_bytes (binary).

    ``whole_characters`` keeps a character unless all its bytes are covered, so that what is
    left is text.
    """
    if length < 2 * GRAM or length > 255:
        raise ValueError(f"length must be from {2 * GRAM} to 255")
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    facts = materialize(rows.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)).select("doc_id", "text_hash", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    groups = facts.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("sha", "least", "n")
    groups = materialize(groups, "groups", few=True)
    copies = materialize(with_groups(facts, groups, ["sha"], "n", facts.count()).where("doc_id > least").select("doc_id", "text_hash").distinct(), "copies", few=True)
    discard(facts, groups)

    key = ["doc_id", "text_hash"]
    long = rows.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)).join(small(copies), key, "left_anti")
    blobs = "target int, blob binary"
    anchors = long.select("doc_id", "text").mapInArrow(_anchor_rows(length, parts), blobs)
    shared = materialize(anchors.groupBy("target").applyInArrow(_shared_rows(parts), blobs), "anchors")
    ids = materialize(shared.groupBy("target").applyInArrow(_docs_of, "doc_id long"), "ids", few=True)
    near = long.join(small(ids), "doc_id", "left_semi").select(part_column(F.col("doc_id"), parts).alias("target"), *key, "text")
    contexts = near.groupBy("target").cogroup(shared.groupBy("target")).applyInArrow(_context_rows(length, parts), blobs)
    found = materialize(contexts.groupBy("target").applyInArrow(_interval_rows(length, parts), blobs), "intervals")
    hit = materialize(found.groupBy("target").applyInArrow(_docs_of, "doc_id long"), "hit", few=True)

    cut = (
        long.join(small(hit), "doc_id", "left_semi")
        .select(part_column(F.col("doc_id"), parts).alias("target"), *key, "text")
        .groupBy("target")
        .cogroup(found.groupBy("target"))
        .applyInArrow(_cut_rows(whole_characters), "doc_id long, text_hash long, n_removed long, n_spans long, kept_bytes binary")
    )
    cut = cut.withColumn("n_bytes", F.col("n_removed") + F.length("kept_bytes"))
    rest = rows.join(small(copies.withColumn("copy", F.lit(True))), key, "left").join(small(hit.withColumn("hit", F.lit(True))), "doc_id", "left")
    rest = rest.where(F.col("copy").isNotNull() | F.col("hit").isNull() | (F.col("n_bytes") < length))
    whole = F.col("copy").isNotNull()
    rest = rest.select(
        *key,
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, "").otherwise(F.col("text")).cast("binary").alias("kept_bytes"),
    )
    return cut.unionByName(rest)
