"""Adaptive context-mixing range coder for token ids, over many lanes at once.

A block of ids is cut into lanes of consecutive ids. All lanes share one model and take their steps together, so a step
codes one id a lane with the model made from all earlier steps. Coder and decoder make the same model.

An id's probability mixes three predictions: the id that last followed the two ids before it (order 2), the id that last
followed the one before it (order 1), and the counts of all ids so far (order 0). The weights of the mixture are counts
too, kept for each pair of confidences of the two predictions. One interval is coded an id: the predicted ids come first,
then all ids by their counts. Every lane has a range coder of its own with 64-bit state, 32-bit output and carries.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, BLOCK = 8192, 1 << 20
HEAD = struct.Struct("<IIIIIII")  # ids, lanes, steps, ids' range, crc32 of the ids, words, bytes of the word counts
U = np.uint64
LOW, BITS = U(1 << 32), U(32)
#: Sum of the mixture's weights; its product with the sum of the counts stays under 2**31.
WEIGHTS = 256
T2 = 18
GAIN = 6
#: Places of the order-0 interval for which the decoder keeps an entry into the ids.
CELL = 64
HASH_1, HASH_2, SHIFT = np.uint32(0x2F0B4C47), np.uint32(0x9E3779B1), np.uint32(32 - T2)
#: Change of an entry by its confidence (0 to 3), without and with a hit.
STEP = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class Model:
    def __init__(self, lanes: int, ids: int):
        self.ids = ids
        self.counts = np.ones(ids, np.int64)
        self.seen: list[np.ndarray] = []
        self.one = np.zeros(ids, np.int32)
        self.two = np.zeros(1 << T2, np.int32)
        self.mixture = np.ones((32, 3), np.int64)
        self.kinds: list[np.ndarray] = []
        self.last = self.key = np.zeros(lanes, np.int64)
        self.step = 0
        self._count()
        self._weigh()

    def _count(self) -> None:
        if self.seen:
            self.counts += GAIN * np.bincount(np.concatenate(self.seen), minlength=self.ids)
            self.seen = []
        self.below = np.full(self.ids + 1 + CELL, (1 << 31) - 1, np.int32)
        self.below[0] = 0
        np.cumsum(self.counts, out=self.below[1 : self.ids + 1])
        self.total = int(self.below[self.ids])
        self.cells = None

    def find(self, place: np.ndarray) -> np.ndarray:
        """The id whose interval holds each place: from the first id of its cell, which has ``CELL`` ids at most, by halving."""
        if self.cells is None:
            starts = -(-self.below[: self.ids + 1] // CELL)  # the first cell that begins in or after an id's interval
            self.cells = np.repeat(np.arange(self.ids), np.diff(starts))
        at, step = self.cells.take(place // CELL), CELL
        while step:
            at += (self.below.take(at + step) <= place) * step
            step >>= 1
        return at

    def _weigh(self) -> None:
        if self.kinds:
            self.mixture += np.bincount(np.concatenate(self.kinds), minlength=96).reshape(32, 3)
            self.kinds = []
        sums = self.mixture.sum(1)
        self.weight_2 = np.maximum(1, self.mixture[:, 2] * (WEIGHTS - 2) // sums)
        self.weight_1 = np.maximum(1, self.mixture[:, 1] * (WEIGHTS - 2) // sums)
        self.weight_1[16:] = 0  # both predict the same id
        self.weight_12 = self.weight_2 + self.weight_1

    def predict(self) -> None:
        """The entries of both predictions and the weights of this step, a lane each."""
        self.e2, self.e1 = self.two.take(self.key), self.one.take(self.last)
        self.p2, self.p1 = self.e2 >> 2, self.e1 >> 2
        same = self.p2 == self.p1
        self.context = (self.e2 & 3) << 2 | (self.e1 & 3) | same.view(np.int8).astype(np.int32) << 4
        self.w2, self.w12 = self.weight_2.take(self.context), self.weight_12.take(self.context)

    def learn(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        """``ids`` of this step; which of them order 2 said, and which order 1 but not order 2."""
        self.kinds.append(self.context * 3 + (two.view(np.int8) * 2 + one.view(np.int8)))
        fresh = ids << 2
        for table, at, entry, hit in ((self.two, self.key, self.e2, two), (self.one, self.last, self.e1, ids == self.p1)):
            # Confidence goes up with a hit and down without; at the lowest the entry becomes the new id.
            state = (entry & 3) | hit.view(np.int8).astype(np.int32) << 2
            table[at] = np.where(state == 0, fresh, entry + STEP.take(state))
        self.key = ((self.last.astype(np.uint32) * HASH_1 + ids.view(np.uint32) * HASH_2) >> SHIFT).astype(np.int64)
        self.last = ids.astype(np.int64)
        self.seen.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 16 == 0:
            self._count()
        if self.step < 4 or self.step % 4 == 0:
            self._weigh()
        if self.step % 16 == 0:
            self.mixture = self.mixture >> 1 | 1


def encode_block(ids: np.ndarray) -> bytes:
    """One block, which no other is needed to decode. ``ids``: unsigned 32-bit integers under 2**20."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 128))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes, int(ids.max(initial=0)) + 1)
    low, span = np.zeros(lanes, U), np.full(lanes, ~U(0))
    out, at, every = np.zeros((lanes, 2 * steps + 4), np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)

    def carry(rows):
        cells = at[rows] - 1
        while len(rows):
            out[rows, cells] += np.uint32(1)
            over = out[rows, cells] == 0
            rows, cells = rows[over], cells[over] - 1

    for row in grid:
        model.predict()
        total = model.total
        two = row == model.p2
        one = (row == model.p1) & ~two
        rest = WEIGHTS - model.w12
        wide = row.astype(np.int64)
        start, size = model.w12 * total + rest * model.below.take(wide), rest * model.counts.take(wide)
        np.copyto(start, model.w2 * total, where=one)
        np.copyto(size, (model.w12 - model.w2) * total, where=one)
        np.copyto(start, 0, where=two)
        np.copyto(size, model.w2 * total, where=two)
        span //= U(WEIGHTS * total)
        more = low + start.view(U) * span
        if (over := more < low).any():
            carry(np.flatnonzero(over))
        low = more
        span *= size.view(U)
        if len(short := np.flatnonzero(span < LOW)):
            out[short, at[short]] = (low[short] >> BITS).astype(np.uint32)
            at[short] += 1
            low[short] <<= BITS
            span[short] <<= BITS
        model.learn(row, two, one)
    more = low + (LOW - U(1))
    if (over := more < low).any():
        carry(np.flatnonzero(over))
    out[every, at] = (more >> BITS).astype(np.uint32)
    at += 1
    words = out[np.arange(out.shape[1]) < at[:, None]]
    sizes = zlib.compress(at.astype("<u2").tobytes(), 1)
    return HEAD.pack(n, lanes, steps, model.ids, zlib.crc32(ids.astype("<u4").tobytes()), len(words), len(sizes)) + sizes + words.astype("<u4").tobytes()


def decode_block(data: bytes | memoryview, start: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``start`` and where it ends. A damaged block raises ValueError."""
    n, lanes, steps, limit, crc, words, packed = HEAD.unpack_from(data, start)
    start += HEAD.size
    try:
        at = np.frombuffer(zlib.decompress(data[start : start + packed]), "<u2").astype(np.int64)
    except zlib.error as e:
        raise ValueError("damaged block") from e
    start += packed
    end = start + 4 * words
    stream = np.zeros(words + 2, U)
    stream[:words] = np.frombuffer(data[start:end], "<u4")
    if len(at) != lanes or at.sum() != words:
        raise ValueError("damaged block")
    stop = np.cumsum(at)
    place = stop - at
    code = stream[place] << BITS
    place += 1
    code |= np.where(place < stop, stream[place], U(0))
    place += 1
    model, span = Model(lanes, limit), np.full(lanes, ~U(0))
    grid = np.zeros((steps, lanes), np.int32)
    for row in grid:
        model.predict()
        total = model.total
        span //= U(WEIGHTS * total)
        found = np.minimum(code // span, U(WEIGHTS * total - 1)).view(np.int64)
        top = model.w2 * total
        two = found < top
        rest = found - model.w12 * total
        one = (rest < 0) & ~two
        row[:] = np.where(two, model.p2, model.p1)
        start_, size = np.where(two, 0, top), np.where(two, top, model.w12 * total - top)
        if len(new := np.flatnonzero(rest >= 0)):
            w12 = model.w12.take(new)
            w0 = WEIGHTS - w12
            # Below 2**31, so the floating quotient has the right whole part.
            ids = model.find((rest.take(new) / w0).astype(np.int32))
            row[new] = ids
            start_[new] = w12 * total + w0 * model.below.take(ids)
            size[new] = w0 * model.counts.take(ids)
        code -= start_.view(U) * span
        span *= size.view(U)
        if len(short := np.flatnonzero(span < LOW)):
            p = place[short]
            code[short] = code[short] << BITS | np.where(p < stop[short], stream[np.minimum(p, words)], U(0))
            place[short] += 1
            span[short] <<= BITS
        model.learn(row, two, one)
    ids = grid.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return ids, end
