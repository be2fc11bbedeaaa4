"""Sum-of-squares packing (operator 6) of token ids into windows.

Documents come one by one. A document longer than the window first fills windows of its own; what is left of it goes to
the fill level that makes the sum of the squared counts of partly filled windows least, counts being held in an array
with one place per level. At the end of a partition the windows still open are emptied into full ones, documents being
cut, and the last ids go to windows of falling powers of two, which need no padding. So nothing is padded.

Each partition packs on its own: no shuffle, and memory for its open windows only. A lost task gives the same pieces again.

Nulls: a null text is empty and has the end id only; a null ``doc_id`` stays null. Repeated rows are packed each. An
empty table gives no pieces. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.tokens import Encoder

END = (2).to_bytes(4, "little")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NONE = -(1 << 30)


class Packer:
    """Gives each piece to ``emit(doc, start, ids, doc_tokens, sequence, offset)`` when its window is closed."""

    def __init__(self, window: int, emit: Callable[..., None], first_sequence: int = 0):
        self.window, self.emit, self.next = window, emit, first_sequence
        # Twice the count at each level; at the full level what makes the change of the sum come out right.
        self.after = np.zeros(window + 1, np.int64)
        self.after[window] = -1
        self.at = np.full(window + 1, NONE, np.int64)
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def add(self, doc: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self._close([(doc, start, ids[start * 4 : (start + self.window) * 4], total)])
            start += self.window
        if size := total - start:
            self._place((doc, start, ids[start * 4 :], total), size)

    def _place(self, piece: tuple, size: int) -> None:
        window = self.window
        level = 0
        if window - size > 0:
            change = self.after[window:size:-1] - self.at[window - size : 0 : -1] + 2  # fullest first
            best = int(change.argmin())
            if change[best] <= self.after[size] + 1:
                level = window - size - best
        pieces = self._take(level) if level else []
        pieces.append(piece)
        if level + size == window:
            self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self._count(level + size)

    def _take(self, level: int) -> list[tuple]:
        pieces = self.open[level].pop()
        self._count(level)
        return pieces

    def _count(self, level: int) -> None:
        n = 2 * len(self.open[level])
        self.after[level] = n
        self.at[level] = n or NONE

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.emit(doc, start, ids, total, self.next, offset)
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> None:
        """Empty the open windows into full ones and the rest into powers of two."""
        rest = [piece for level in sorted(self.open) for pieces in self.open[level] for piece in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        room, out = 0, []
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= size
                part = ids[: room * 4]
                out.append((doc, start, part, total))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if not room:
                    self._close(out)
                    out = []
        self.open.clear()
        self.after[: self.window], self.at[:] = 0, NONE


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 4096, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to pieces, one row each; ``with_ids`` adds the ids as bytes. ``window``: a power of two."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows = Encoder.of(tokenizer), []

        def emit(doc, start, ids, total, sequence, offset):
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, *([ids] if with_ids else [])))

        def flush():
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        packer = Packer(window, emit, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + END)
                yield flush()
        packer.finish()
        yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, SCHEMA + ", ids binary" * with_ids)


def op6_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
