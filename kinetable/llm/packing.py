"""Vector bin packing of token sequences by the dot-product heuristic.

Limits hold at once on tokens, segments and loss-bearing tokens of a sequence. A bin is
filled by taking, among the pieces that fit, the one with the largest dot product of its
size vector and the bin's free space (both in units of the limits). When none fits, or
one segment is left, the piece that fills most of the gap is cut to fill it. Full
sequences are cut from long documents first. A bin that another limit closes before it is
full (many short documents, or the end of a partition) is cut into sequences whose lengths
are powers of two, so that nothing is padded.

Each partition of the scan packs its own documents in windows of bounded size: no shuffle,
no driver, and a lost task gives the same pieces again, since its input is the same.

Rows: null text counts as empty (one id, the end mark), so every row has a piece; rows that
repeat a document, or have no id, are packed as documents of their own; a document of any
length is cut as often as it needs. Further columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import codec
from .common import cached, frugal, text_groups, texts_of

#: Sequences' worth of tokens that a partition holds while it packs.
WINDOW = 192


class Packer:
    """Packs documents that are added one by one; pieces() gives what is finished.

    A document's first ``prompt`` ids bear no loss. A piece is (document, start, length,
    sequence, offset, loss).
    """

    def __init__(self, tokens: int = 4096, segments: int = 64, loss: int | None = None, window: int = WINDOW):
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], np.int64)
        if self.limits.min() < 1:
            raise ValueError("limits must be positive")
        self.window = window
        self.waiting: dict[tuple[int, int], deque] = {}  # (ids, ids with loss) to document, start, end, prompt
        self.total = 0
        self.sequence = 0
        self.out: list[tuple] = []

    def add(self, doc, n: int, prompt: int = 0) -> None:
        most, start = int(self.limits[0]), 0
        while n - start >= most and most - self._bare(start, start + most, prompt) <= self.limits[2]:
            self._emit([(doc, start, start + most, prompt)])
            start += most
        if n > start:
            self._wait(doc, start, n, prompt)
            self.total += n - start
        if self.total >= self.window * most:
            self._fill(self.window * most // 4)

    def finish(self) -> None:
        self._fill(0)

    def pieces(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    @staticmethod
    def _bare(start: int, end: int, prompt: int) -> int:
        """Ids without loss in the piece."""
        return max(0, min(end, prompt) - start)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, end, prompt in pieces:
            self.out.append((doc, start, end - start, self.sequence, offset, end - start - self._bare(start, end, prompt)))
            offset += end - start
        self.sequence += 1

    def _wait(self, doc, start: int, end: int, prompt: int, first: bool = False) -> tuple[int, int]:
        key = end - start, end - start - self._bare(start, end, prompt)
        queue = self.waiting.setdefault(key, deque())
        queue.appendleft((doc, start, end, prompt)) if first else queue.append((doc, start, end, prompt))
        return key

    def documents(self) -> set:
        """Those with pieces that wait."""
        return {x[0] for queue in self.waiting.values() for x in queue}

    def _fill(self, keep: int) -> None:
        """Close sequences while more than ``keep`` ids wait."""
        keys = list(self.waiting)
        at = {k: i for i, k in enumerate(keys)}
        sizes = np.array([(n, 1, loss) for n, loss in keys], np.int64).reshape(-1, 3)
        alive, unit = np.ones(len(keys), bool), sizes / self.limits
        while self.total > keep:
            free, chosen = self.limits.copy(), []
            while free[0] and free[1] and alive.any():
                fit = alive & (sizes <= free).all(1) if free[1] > 1 else alive & (sizes[:, 0] == free[0]) & (sizes[:, 2] <= free[2])
                if fit.any():
                    i = int(np.argmax(np.where(fit, unit @ (free / self.limits), -1.0)))
                    take = keys[i][0]
                else:
                    i, take = self._cut(free, sizes, alive)
                    if i < 0:
                        break
                doc, start, whole, prompt = self.waiting[keys[i]].popleft()
                end = start + take
                chosen.append((doc, start, end, prompt))
                free -= (take, 1, take - self._bare(start, end, prompt))
                self.total -= take
                alive[i] = bool(self.waiting[keys[i]])
                if end < whole:
                    key = self._wait(doc, end, whole, prompt, True)
                    if key not in at:
                        at[key] = len(keys)
                        keys.append(key)
                        sizes = np.vstack([sizes, (key[0], 1, key[1])])
                        unit, alive = np.vstack([unit, sizes[-1] / self.limits]), np.r_[alive, True]
                    alive[at[key]] = True
            if free[0]:  # segments or loss are used up, or nothing is left
                self._tail(chosen)
            else:
                self._emit(chosen)
        self.waiting = {k: q for k, q in self.waiting.items() if q}

    @staticmethod
    def _cut(free: np.ndarray, sizes: np.ndarray, alive: np.ndarray) -> tuple[int, int]:
        """The pieces that fill most of the gap when cut, and how many ids to take. Ids without loss
        come first in a piece."""
        bare = sizes[:, 0] - sizes[:, 2]
        take = np.where(alive, np.minimum(np.minimum(sizes[:, 0], free[0]), bare + free[2]), 0)
        i = int(np.argmax(take))
        return (i, int(take[i])) if take[i] > 0 else (-1, 0)

    def _tail(self, chosen: list[tuple]) -> None:
        """A partly filled sequence as sequences of powers of two; each obeys all limits, as the
        pieces did together."""
        left = sum(e - s for _, s, e, _ in chosen)
        queue = chosen[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                doc, start, end, prompt = queue.pop()
                cut = min(end, start + size)
                part.append((doc, start, cut, prompt))
                size -= cut - start
                if cut < end:
                    queue.append((doc, cut, end, prompt))
            self._emit(part)


def pack(docs: DataFrame, path: str, end_id: int = 2, tokens: int = 4096, segments: int = 64, loss: int | None = None, prompt_col: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary), doc_tokens, sequence_id,
    offset, loss_tokens. ``prompt_col``: a column with a count of leading ids without loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, p = codec(path), Packer(tokens, segments, loss)
        cached("bpe", codec.cache_clear)
        base, mark = TaskContext.get().partitionId() << 32, np.array([end_id], "<u4").tobytes()
        held: dict[int, tuple] = {}

        def done() -> Iterator[pa.RecordBatch]:
            rows = p.pieces()
            if not rows:
                return
            ids = [held[k][1][4 * s : 4 * (s + n)] for k, s, n, *_ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k, *_ in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(ids, pa.binary()), pa.array([len(held[k][1]) // 4 for k, *_ in rows], pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"],
            )
            waiting = p.documents()
            for k in [k for k in held if k not in waiting]:
                del held[k]

        k = 0
        for b in text_groups(batches, "text"):
            prompts = b.column(2).to_pylist() if prompt_col else [0] * b.num_rows
            for doc, ids, prompt in zip(b.column(0).to_pylist(), c.encode(texts_of(b)), prompts, strict=True):
                held[k] = doc, ids + mark
                p.add(k, len(ids) // 4 + 1, max(0, prompt or 0))
                k += 1
            yield from done()
        p.finish()
        yield from done()

    cols = ["doc_id", "text", *([prompt_col] if prompt_col else [])]
    return docs.select(*cols).mapInArrow(frugal(run, "bpe"), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long")
