"""Byte-level BPE encoding and decoding, with pre-tokenisation by arrays instead of a pattern.

Texts are read as arrays of code points. A table gives each its class (letter, number, blank,
other white space, other), and what follows it tells a contraction and the last of a run of
white space apart; so each position has one of nine symbols. A symbol is a function from the
state before it to the state after it. There are few functions and few products of them, so a
product is one look-up in a table and, being associative, is scanned: within blocks side by side,
then over the blocks. The state before a position and its symbol say whether a slice of text
begins there. The same scan goes on from state to state in a text of any length.

The slices' bytes are looked up in a bounded cache of merged pieces; a slice that isn't there is
merged pair by pair, the least rank first. Each id keeps the byte of the text where it begins
(``offsets``), by which the decoder puts its bytes in place, all ids at once.

Rows: null text counts as empty and gives no ids; repeated rows and null ids are kept as they
are; further columns are not read. Slices of very many bytes (one unbroken run) are merged with a
heap, in about 200 bytes of memory for each of theirs.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import cached, frugal, text_groups, texts_of

#: Code points scanned at once, positions of a block of the scan, bytes of a slice from which a heap is used; bounds of the cache.
SCANNED, BLOCK, LONG, CACHE_ENTRIES = 1 << 20, 64, 400, 400_000

#: Classes of code points; EDGE parts one text from the next.
LETTER, NUMBER, OTHER, WHITE, BLANK, EDGE = range(6)
#: What parts texts in one string: a code point that no text holds.
PARTING = "\ud800"
#: Symbols: letter, number, other, apostrophe of a contraction with one or two letters, white space
#: before more of it (or the end), its last of a run, the same if it is a blank, edge.
L, N, O, ONE_LETTER, TWO_LETTERS, INNER, LAST, LAST_BLANK, END = range(9)
#: States: nothing open; in letters, numbers, others, white space; a blank that joins what follows; one or two letters of a contraction due.
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINS, DUE_1, DUE_2 = range(8)
#: Letters after the apostrophe of a contraction (fixed values).
CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """(state, symbol) -> next state, and -> whether a slice begins there."""
    go, begins = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    go[:, L], go[:, N], go[:, O] = IN_LETTERS, IN_NUMBERS, IN_OTHERS
    go[DUE_2, L], go[DUE_1, L] = DUE_1, OPEN
    go[:, ONE_LETTER], go[:, TWO_LETTERS] = DUE_1, DUE_2
    for s in (ONE_LETTER, TWO_LETTERS):  # inside a run of others an apostrophe is one of them
        go[[IN_OTHERS, JOINS], s] = IN_OTHERS
        begins[[IN_OTHERS, JOINS], s] = False
    go[:, INNER], go[:, LAST], go[:, LAST_BLANK], go[:, END] = IN_WHITE, OPEN, JOINS, OPEN
    begins[[IN_LETTERS, JOINS, DUE_1, DUE_2], L] = False
    begins[[IN_NUMBERS, JOINS], N] = False
    begins[[IN_OTHERS, JOINS], O] = False
    begins[IN_WHITE, INNER] = False
    return go, begins


GO, BEGINS = _moves()


def _products() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols make: each symbol's, products (first, then second), values (function, state)."""
    known: dict[tuple, int] = {tuple(range(8)): 0}
    own = [known.setdefault(tuple(GO[:, s].tolist()), len(known)) for s in range(9)]
    todo = list(known)
    for f in todo:
        for s in range(9):
            g = tuple(int(GO[x, s]) for x in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    values = np.array(list(known), np.uint8)
    product = np.array([[known[tuple(values[b][values[a]].tolist())] for b in range(len(values))] for a in range(len(values))], np.intp)
    return np.array(own, np.intp), product, values


OWN, PRODUCT, VALUES = _products()


def scan(f: np.ndarray) -> np.ndarray:
    """Products of all functions up to each position, in order."""
    n, size = len(f), len(VALUES)
    rows = -(-n // BLOCK)
    x = np.zeros((rows, BLOCK), np.intp)  # the rest of the last block does nothing
    x.reshape(-1)[:n] = f
    x = np.ascontiguousarray(x.T)
    flat = PRODUCT.reshape(-1)
    for k in range(1, BLOCK):
        x[k] = flat[x[k - 1] * size + x[k]]
    if rows > 1:
        before = np.r_[0, scan(x[-1])[:-1]]
        x = flat[before * size + x]
    return x.T.reshape(-1)[:n]


def class_runs() -> tuple[list[int], list[int]]:
    """Where runs of one class begin among the code points, and the classes. They are those of
    the library's own pattern engine, whose version of Unicode may be newer than Python's."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    of = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for i in range(0, len(every), 1 << 15):
            found = bytes(engine.encode_ordinary("".join(every[i : i + (1 << 15)]))).decode()
            of[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    of[ord(" ")], of[ord(PARTING)] = BLANK, EDGE
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return begin.tolist(), of[begin].tolist()


def class_table(runs: tuple[list[int], list[int]]) -> np.ndarray:
    return np.repeat(np.array(runs[1], np.uint8), np.diff([*runs[0], 0x110000]))


def symbols(points: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Symbols of the first n code points; two more that follow are looked at."""
    kind = table[points]
    out = np.array([L, N, O, LAST, LAST_BLANK, END], np.intp)[kind[:n]]
    after = np.r_[kind[1:], EDGE, EDGE][:n]
    white = (kind == WHITE) | (kind == BLANK)
    out[white[:n] & ((after == WHITE) | (after == BLANK) | (after == EDGE))] = INNER
    for at in np.flatnonzero(points[:n] == ord("'")).tolist():
        two = "".join(map(chr, points[at + 1 : at + 3].tolist()))
        out[at] = ONE_LETTER if two[:1] in CONTRACTIONS[0] else TWO_LETTERS if two in CONTRACTIONS[1] else O
    return out


def slices(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte of the text where each slice begins, and whether the slice is a parting."""
    state, done, places, edges = OPEN, 0, [], []
    for a in range(0, len(text), SCANNED):
        points = np.frombuffer(text[a : a + SCANNED + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        n = min(SCANNED, len(text) - a)
        s = symbols(points, n, table)
        after = VALUES[scan(OWN[s]), state]
        at = np.flatnonzero(BEGINS[np.r_[np.uint8(state), after[:-1]], s])
        p = points[:n]
        size = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        ends = done + np.cumsum(size)
        places.append((ends - size)[at])
        edges.append(s[at] == END)
        state, done = int(after[-1]), int(ends[-1])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(places), np.concatenate(edges)


class Pieces(dict):
    """Slices and their ids (little-endian unsigned 32 bit), merged when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else self.merged_long(piece) if len(piece) > LONG else self.merged(piece)
        packed = array("I", ids).tobytes()
        if len(piece) <= LONG:
            self[piece] = packed
        return packed

    def merged(self, piece: bytes) -> list[int]:
        """The pair of least rank, the leftmost of equals, is merged until none is left."""
        get, none = self.ranks.get, len(self.ranks)
        cut = list(range(len(piece) + 1))
        pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair and (least := min(pair)) < none:
            i = pair.index(least)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = get(piece[cut[i] : cut[i + 2]], none)
            if i:
                pair[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]

    def merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs and links between neighbours."""
        get, n = self.ranks.get, len(piece)
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))  # of each part by its first byte
        heap = [(r << 32) | i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if j <= i or j >= n or get(piece[i : after[j]]) != rank:  # the pair has changed since
                continue
            k = after[j]
            after[i], after[j] = k, -1
            if k < n:
                before[k] = i
                if (r := get(piece[i : after[k]])) is not None:
                    heapq.heappush(heap, (r << 32) | i)
            if i and (r := get(piece[(h := before[i]) : k])) is not None:
                heapq.heappush(heap, (r << 32) | h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out


class Codec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str, runs: tuple[list[int], list[int]]):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table, self.pieces = class_table(runs), Pieces(ranks)
        names = [b""] * (max(ranks.values()) + 1)
        for name, i in ranks.items():
            names[i] = name
        self.size = np.array([len(x) for x in names], np.int64)
        self.blob, self.at = np.frombuffer(b"".join(names), np.uint8), np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte of its text where each begins, and how many each text has."""
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        text = PARTING.join(texts)
        begin, edge = slices(text, self.table)
        raw, b = text.encode("utf-8", "surrogatepass"), begin.tolist()
        cut = [-1, *np.flatnonzero(edge).tolist(), len(b)] if len(texts) else [-1]
        b.append(len(raw))
        get, packed = self.pieces.__getitem__, []
        for i, j in zip(cut, cut[1:], strict=False):
            packed.append(b"".join([get(raw[x:y]) for x, y in zip(b[i + 1 : j], b[i + 2 : j + 1], strict=True)]))
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        n = np.array([len(x) // 4 for x in packed], np.int64)
        return ids, self.offsets(ids, n), n

    def offsets(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bytes of its text before each id."""
        before = np.cumsum(self.size[ids]) - self.size[ids]
        first = np.cumsum(n) - n
        has = n > 0
        return before - np.repeat(before[first[has]], n[has])

    def decode(self, ids: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of each text: every id's are put at its offset, all ids of one length at once."""
        has = n > 0
        last = (np.cumsum(n) - 1)[has]
        length = np.zeros(len(n), np.int64)
        length[has] = offsets[last] + self.size[ids[last]]
        start = np.cumsum(length) - length
        at, size = offsets + np.repeat(start, n), self.size[ids]
        out = np.zeros(int(length.sum()), np.uint8)
        order = np.argsort(size, kind="stable")
        for k, rows in zip(*_groups(size[order], order), strict=True):
            for d in range(k):
                out[at[rows] + d] = self.blob[self.at[ids[rows]] + d]
        raw = out.tobytes()
        return [raw[a : a + m] for a, m in zip(start.tolist(), length.tolist(), strict=True)]


def _groups(key: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct keys of a sorted array and the rows of each."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[begin].tolist(), np.split(rows, begin[1:]) if len(key) else []


@functools.lru_cache(maxsize=1)
def codec(path: str, begin: tuple, kinds: tuple) -> Codec:
    """One codec for a worker process, whose cache serves all tasks of the operator."""
    return Codec(path, (list(begin), list(kinds)))


@functools.lru_cache(maxsize=1)
def _runs() -> tuple[tuple, tuple]:
    begin, kinds = class_runs()
    return tuple(begin), tuple(kinds)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decode: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, ``ids`` (array of int) and, if asked for, ``offsets`` (the
    byte of the text where each id begins) and ``decoded`` (binary, made from ids and offsets).
    No shuffle: texts are encoded where they are read."""
    begin, kinds = _runs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, begin, kinds)
        cached("bytebpe", codec.cache_clear)
        for b in text_groups(batches, text_col):
            ids, places, n = c.encode(texts_of(b, text_col))
            ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            cols = {id_col: b.column(0), "ids": pa.ListArray.from_arrays(ends, pa.array(ids))}
            if offsets:
                cols["offsets"] = pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32)))
            if decode:
                cols["decoded"] = pa.array(c.decode(ids, places, n), pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else "") + (", decoded binary" if decode else "")
    return docs.select(id_col, text_col).mapInArrow(frugal(run, "bytebpe"), schema)
