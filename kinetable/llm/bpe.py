"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is cut at ASCII white space, which the tokenizer drops and which never lies
inside one of its words, and the ids of each piece are looked up in a bounded cache.
A piece that isn't in the cache goes through the tokenizer's own steps: added tokens,
normaliser, word pattern, merges. Words of up to LEAF bytes are merged directly. A
longer word ("long unsplit text") is cut into halves again and again; the leaves are
encoded in parallel, and neighbours are joined bottom-up: a window of tokens on both
sides of the join is encoded again and grows until its first token is the left side's
token at that place and its last token is the right side's. Then every two neighbours
in the joined list are neighbours in some encoding, which for merges applied by rank
means that the list is the encoding of the whole.

Rows: null text counts as empty and gives no ids; repeated rows and null ids are kept
as they are; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import cached, frugal, text_groups, texts_of

#: Bytes of a word that is merged without cutting, and bounds of the cache.
LEAF, CACHE_ENTRIES, CACHE_BYTES = 2048, 300_000, 32 << 20

#: The tokenizer's word pattern (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Marks that are words of their own behind a word, whatever the word is.
MARKS = frozenset(".,;:!?)")
#: Byte values that stand for themselves as letters in byte-level vocabularies (fixed values).
PRINTED = (range(33, 127), range(161, 173), range(174, 256))
#: Characters whose class, lower case and composition are the same in Python and in the
#: tokenizer's libraries (tests compare each): ASCII without 1C-1F, Latin letters to 024F.
UNSURE = regex.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")


def _byte_letters() -> list[str]:
    """The printable letter for each byte that byte-level BPE vocabularies use."""
    own = [b for r in PRINTED for b in r]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks(dict):
    """Pieces of text and their ids, which are made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, piece: bytes) -> bytes:
        self[piece] = ids = self.make(piece.decode())
        self.held += len(piece) + len(ids)
        return ids


class Codec:
    """Encoder and decoder for one tokenizer file of the kind "word ends, lower case"."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.leaf = leaf
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        suffix = spec["model"]["end_of_word_suffix"]
        self.ending = Tokenizer(BPE(vocab, merges, end_of_word_suffix=suffix))
        self.inner = Tokenizer(BPE(vocab, merges))
        self.model = self.ending.model
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.name_bytes = [x.encode() for x in self.names]
        self.inside = [x.removesuffix(suffix) for x in self.names]
        self.letters = _byte_letters()
        self.chunks = Chunks(self._chunk)
        self.words: dict[str, bytes] = {}

    # -- encoding ---------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > CACHE_ENTRIES or self.chunks.held > CACHE_BYTES:
            self.chunks = Chunks(self._chunk)
        if len(self.words) > CACHE_ENTRIES:
            self.words = {}
        get = self.chunks.__getitem__
        return [b"".join(map(get, t.encode().split())) for t in texts]

    def _chunk(self, s: str) -> bytes:
        """Ids of a text without ASCII white space."""
        if s.isascii():  # most are a word, or one with a mark behind it, which need no pattern
            if s.isalpha():
                return self._word(s.lower())
            if s[-1] in MARKS and s[:-1].isalpha():
                return self._word(s[:-1].lower()) + self._word(s[-1])
        if UNSURE.search(s) or "<|" in s:
            return b"".join([_pack([w]) if isinstance(w, int) else self._merge(w) for w in self._exact(s)])
        return b"".join(map(self._word, WORDS.findall(s.lower())))

    def _word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = self._merge(self._spell(w))
            if len(w) <= self.leaf:
                self.words[w] = ids
        return ids

    def _merge(self, spelled: str) -> bytes:
        """Ids of one spelled word."""
        if len(spelled) > self.leaf:
            return _pack(self.encode_long(spelled))
        return _pack([t.id for t in self.model.tokenize(spelled)])

    def _spell(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word  # each byte stands for itself
        return "".join([self.letters[b] for b in word.encode()])

    def _exact(self, s: str) -> list:
        """Words of a piece by the tokenizer's own normaliser and pattern; ints are added tokens."""
        out: list = []
        for part in self.splits.split(s):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                n = self.whole.normalizer.normalize_str(part)
                out += [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(n)]
        return out

    def encode_long(self, word: str) -> list[int]:
        """Tree concatenation of one spelled word."""
        cuts = [0, len(word)]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        leaves = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        level = [e.ids for e in self.inner.encode_batch_fast(leaves[:-1])] + [self.ending.encode(leaves[-1]).ids]
        while len(level) > 1:
            last = len(level) - 2
            level = [self._join(level[i], level[i + 1], i == last) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            text = "".join([self.inside[t] for t in left[i:] + right[:j]])
            mid = (self.ending if ends and j == len(right) else self.inner).encode(text).ids
            if (i == 0 or mid[0] == left[i]) and (j == len(right) or mid[-1] == right[j - 1]):
                return left[:i] + mid + right[j:]
            k *= 2

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8: token names with a space between, as without a decoder."""
        return b" ".join(map(self.name_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for a worker process, whose caches serve all tasks of the operators that use it."""
    return Codec(path)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, ``ids`` (binary, little-endian unsigned 32 bit) and, if
    asked for, ``decoded`` (string). No shuffle: texts are encoded where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        cached("bpe", codec.cache_clear)
        for b in text_groups(batches, text_col):
            ids = c.encode(texts_of(b, text_col))
            cols = {id_col: b.column(0), "ids": pa.array(ids, pa.binary())}
            if decode:
                cols["decoded"] = pa.array(list(map(c.decode, ids)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(frugal(run, "bpe"), f"`{id_col}` {kind}, ids binary" + (", decoded string" if decode else ""))
