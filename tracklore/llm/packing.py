"""Sum-of-squares packing of token ids into windows, online within each partition."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textblocks import blocks
from .tokencount import encoder

COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
#: Sequence ids of a partition begin at its number times this.
STRIDE = 1 << 40


@dataclass
class Piece:
    """ids[start : start + length] of a document."""

    doc_id: object
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


class Packer:
    """Windows of ``size`` ids, open ones held by their fill level.

    A piece goes to the level (or a new window) after which the sum of squares of the numbers
    of open windows at each level is least; of equal choices, to the fullest.
    """

    def __init__(self, size: int, first_id: int):
        self.size, self._next = size, first_id
        self.level = np.zeros(size + 1, np.int64)
        self._open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) > self.size:
            whole, piece = piece.cut(self.size)
            self._close([whole])
        self._place(piece)

    def _place(self, piece: Piece) -> None:
        n, level = len(piece.ids), self.level
        if n == self.size:
            self._close([piece])
            return
        fill, best = 0, 2 * level[n] + 1
        at = np.flatnonzero(level[1 : self.size - n + 1]) + 1
        if at.size:
            after = np.where(at + n < self.size, 2 * level[at + n] + 1, 0)
            cost = after - 2 * level[at] + 1
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                fill = int(at[k])
        window = self._open[fill].pop() if fill else []
        if fill:
            level[fill] -= 1
        window.append(piece)
        if fill + n == self.size:
            self._close(window)
        else:
            level[fill + n] += 1
            self._open[fill + n].append(window)

    def _close(self, window: list[Piece]) -> None:
        at = 0
        for p in window:
            self.rows.append((p.doc_id, p.start, len(p.ids), p.doc_tokens, self._next, at, p.ids.astype("<u4").tobytes()))
            at += len(p.ids)
        self._next += 1

    def finish(self) -> None:
        """Close all: the emptiest windows' pieces, cut where needed, fill up the fullest.

        What remains, less than one window, is cut into sequences of powers of two, which need no padding.
        """
        windows = [w for fill in sorted(self._open, reverse=True) for w in self._open[fill]]
        first, last = 0, len(windows) - 1
        while first < last:
            room = self.size - sum(len(p.ids) for p in windows[first])
            while room and first < last:
                piece = windows[last].pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    windows[last].append(rest)
                windows[first].append(piece)
                room -= len(piece.ids)
                last -= not windows[last]
            if not room:
                self._close(windows[first])
                first += 1
        rest = windows[first] if windows and first == last else []
        left = sum(len(p.ids) for p in rest)
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = rest.pop(0)
                if len(piece.ids) > room:
                    piece, more = piece.cut(room)
                    rest.insert(0, more)
                part.append(piece)
                room -= len(piece.ids)
            self._close(part)
        self._open.clear()
        self.level[:] = 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document: where it lies in it and in its sequence, and its ``ids``.

    A document is its ids under the tokenizers file at ``tokenizer_path`` (the same on every
    executor) and then ``end_id``. Each partition packs its documents in the order in which they
    come, so a lost task is packed again alone; sequences never span partitions. ``ids`` are
    little-endian unsigned 32-bit integers. Every sequence is full but for a partition's last
    few, whose lengths are powers of two.

    Defined cases: a null or empty text is ``end_id`` alone; a null id stays null; repeated rows
    are packed each; an empty table gives an empty result; longer documents are cut; other
    columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, types = encoder(tokenizer_path).ids, Packer(size, TaskContext.get().partitionId() * STRIDE), None

        def ready() -> Iterator[pa.RecordBatch]:
            rows = packer.take()
            for at in range(0, len(rows), 1000):
                columns = zip(*rows[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], COLUMNS)

        for batch in batches:
            types = [batch.column(0).type, *[pa.int64()] * 5, pa.binary()]
            keys = batch.column(0).to_pylist()
            for start, stop, block in blocks(batch.column(1)):
                ids, counts = ids_of(block)
                at = 0
                for key, n in zip(keys[start:stop], counts.tolist(), strict=True):
                    packer.add(Piece(key, 0, n + 1, np.append(ids[at : at + n], np.int32(end_id))))
                    at += n
                yield from ready()
        packer.finish()
        yield from ready()

    return rows.mapInArrow(run, schema)
