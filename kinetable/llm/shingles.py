"""Word shingles of many texts at once, as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import cached

_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Bits of a shingle's hash; the rest of a 64-bit key holds the text's number in its batch.
BITS = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _B
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


class _WordHash(dict):
    """Hash of a word; kept for the words met before, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case, parted by white space) and each text's first word."""
    cached("words", _WORDS.clear)
    split = [t.lower().encode().split() for t in texts]
    ends = np.cumsum([len(s) for s in split])
    get = _WORDS.__getitem__
    flat = np.fromiter((h for s in split for h in map(get, s)), np.uint64, int(ends[-1]) if len(ends) else 0)
    return flat, np.r_[0, ends].astype(np.int64)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a text, and its text. A text with fewer words
    has one shingle of all of them; one without words has none."""
    n = np.diff(starts)
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = h * _A + mix(words[k : k + len(h)])
    count = np.clip(n - size + 1, 0, None)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) + np.repeat(starts[:-1] - np.r_[0, np.cumsum(count)[:-1]], count)
    out = mix(h[at])
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        own = np.array([int(mix(np.array([(hash(tuple(words[starts[i] : starts[i + 1]].tolist()))) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) for i in few], np.uint64)
        text, out = np.r_[text, few], np.r_[out, own]
    return out, text


def bags(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order (text, hash), as text, hash and count."""
    words, starts = word_hashes(texts)
    h, text = shingle_hashes(words, starts, size)
    key = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1), count
