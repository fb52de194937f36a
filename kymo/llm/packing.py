"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the examples that it reads, a window of them at a time; a window's size bounds memory, and no row moves
to another task. Examples of ``TOKENS`` and more give full sequences of their own first. What is left is placed by the
dot product heuristic: bins are filled one after another; next comes the example whose demand vector (tokens, one
segment, loss-bearing tokens, each over its limit) has the largest dot product with what the bin has free. When no whole
example fits, one is cut so that the bin is full; its rest stays in the window. The last bin of a task is cut into
sequences of powers of two, which need no padding.

Cases: limits under 1 are refused (ValueError); a null or empty text is an example of the end token alone; repeated rows are packed once each; an empty table
gives no rows. Sequence ids hold the task's number, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, byte_values, table, utf8
from .tokens import VOCABULARY, encoded

TOKENS, SEGMENTS, LOSS = 2048, 256, 2048
END = (1).to_bytes(4, "little")
WINDOW = 1024


class Packer:
    """Packs (key, ids, loss-bearing tokens at the end) into sequences; gives (key, start, length, ids, sequence, offset)."""

    def __init__(self, first: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        if min(tokens, segments, loss) < 1:
            raise ValueError("a sequence takes at least one token, segment and loss-bearing token")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.sequence = first
        self.waiting: list[list] = []  # [key, start, end, loss begins at, ids]

    def _demand(self, e: list) -> tuple[int, int, int]:
        return e[2] - e[1], 1, max(0, e[2] - max(e[1], e[3]))

    def add(self, key, ids: bytes, loss_from: int = 0) -> Iterator[tuple]:
        e = [key, 0, len(ids) // 4, loss_from, ids]
        while e[2] - e[1] >= self.tokens and min(self.tokens, e[2] - max(e[1], e[3])) <= self.loss:
            yield self._piece(e, self.tokens, 0)
            self.sequence += 1
        if e[2] > e[1]:
            self.waiting.append(e)
        if len(self.waiting) >= WINDOW:
            yield from self.pack(WINDOW // 4)

    def _piece(self, e: list, n: int, offset: int) -> tuple:
        start = e[1]
        e[1] += n
        return e[0], start, n, e[4][start * 4 : (start + n) * 4], e[2], self.sequence, offset

    def pack(self, least: int = 0) -> Iterator[tuple]:
        """Fill bins until no more than ``least`` examples wait; the last bin of all is split into powers of two."""
        held = self.waiting
        need = np.array([self._demand(e) for e in held], float).reshape(-1, 3)
        share = need / self.limits
        out = np.zeros(len(held), bool)  # used up
        while len(held) - out.sum() > least:
            if not least and need[~out, 0].sum() < self.tokens:
                break
            free, placed, used = self.limits.copy(), [], out.copy()
            while free[0] >= 1 and free[1] >= 1:
                fits = ~used & (need[:, 0] <= free[0]) & (need[:, 2] <= free[2])
                score = np.where(fits, share @ (free / self.limits), -1.0)
                k = int(score.argmax())
                if score[k] >= 0:
                    n = int(need[k, 0])
                else:
                    k, n = self._cut(need, free, used)
                    if k < 0:
                        break
                e = held[k]
                free -= (n, 1, max(0, e[1] + n - max(e[1], e[3])))
                placed.append((k, n))
                used[k] = True
            offset = 0
            for k, n in placed:
                yield self._piece(held[k], n, offset)
                offset += n
                need[k] = self._demand(held[k])
                share[k] = need[k] / self.limits
                out[k] = held[k][2] == held[k][1]
            self.sequence += 1
        self.waiting = [e for e in held if e[2] > e[1]]
        if not least and self.waiting:
            yield from self._rest()

    def _cut(self, need: np.ndarray, free: np.ndarray, used: np.ndarray) -> tuple[int, int]:
        """The waiting example to cut, and after how many tokens: the longest one whose part obeys the limits."""
        fit = np.minimum(need[:, 0], free[0])
        fit = np.minimum(fit, need[:, 0] - need[:, 2] + free[2])  # what bears no loss comes first
        fit[used] = 0
        best = np.where(fit >= 1, need[:, 0], -1.0)
        k = int(best.argmax())
        return (k, int(fit[k])) if best[k] > 0 else (-1, 0)

    def _rest(self) -> Iterator[tuple]:
        """Fewer tokens than one sequence takes: sequences of falling powers of two, under the other limits too."""
        left = sum(e[2] - e[1] for e in self.waiting)
        while left:
            size = 1 << (left.bit_length() - 1)
            offset = segments = loss = 0
            for e in self.waiting:
                if offset == size or segments == self.segments:
                    break
                n = min(size - offset, e[2] - e[1])
                n = min(n, max(0, e[3] - e[1]) + self.loss - loss)
                if n > 0:
                    loss += max(0, e[1] + n - max(e[1], e[3]))
                    yield self._piece(e, n, offset)
                    offset, segments = offset + n, segments + 1
            self.sequence += 1
            self.waiting = [e for e in self.waiting if e[2] > e[1]]
            left -= offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, loss_from_col: str | None = None) -> DataFrame:
    """A row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and ``ids``.

    ``loss_from_col`` gives the token from which an example bears loss (its answer's begin); without it all tokens do.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss)

        def out(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            key, start, n, ids, doc_tokens, sequence, offset = zip(*pieces, strict=True) if pieces else [()] * 7
            columns = batch("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary", [start, n, [zlib.crc32(x) for x in ids], doc_tokens, sequence, offset, ids]).columns
            return pa.RecordBatch.from_arrays([pa.array(key, id_type), *columns], names=[id_col, *names])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            texts, loss_from = list(byte_values(b.column(1))), b.column(2).to_pylist()
            pieces: list[tuple] = []
            for key, ids, at in zip(b.column(0).to_pylist(), encoded(texts, path), loss_from, strict=True):
                pieces += packer.add(key, ids + END, max(0, at or 0))
                if len(pieces) > 4096:
                    yield out(pieces, id_type)
                    pieces = []
            yield out(pieces, id_type)
        if id_type is not None:
            yield out(list(packer.pack()), id_type)

    loss_from = F.col(loss_from_col) if loss_from_col else F.lit(0)
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col), utf8(text_col).alias("bytes"), loss_from.cast("long").alias("loss_from")).mapInArrow(run, schema)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text")).drop("ids")
