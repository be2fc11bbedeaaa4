"""Periodic runs of words (operator 13) by block convolution.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 * q) that no neighbouring word extends.
For every power of two B the words are cut into blocks of B. A run of a period q in [B, 2 * B) holds a block whose next
occurrence at distance q lies in it too, so it is enough to know where blocks occur again at distances B to 2 * B - 1: where the
sum of squared differences is zero. That sum is two running sums less twice a correlation, which a number-theoretic transform
over whole numbers gives exactly modulo a prime (blocks under ``DIRECT`` words sum the squares as they are; a block with a
word that does not come again within 2 * B cannot occur again itself and needs no transform). Each (block, distance) of sum zero is a seed. A seed inside a known run of a smaller period is one of its multiples; any other is extended both
ways by binary search over prefix hashes, and what comes out long enough is compared word by word. Neither a sum that is zero
only modulo the prime nor equal hashes of different words can make a run, and none is missed: equal words always agree.

Many short texts are worked on at once as one sequence in which nothing is extended across a text's end. A text is in one task,
as whole numbers (its distinct words are held once); there is no shuffle, and a lost task is simply done again.

Nulls: a null text has no words; a null ``doc_id`` counts as the text '' for the planted periods and stays null. Empty texts
have no run: four nulls, and the digests of nothing. Ties for the longest run: smallest start, then period. Repeated rows
give equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.workers import lean

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: A prime with roots of unity of order 2**23, and one of its primitive roots. Fixed values.
PRIME, ROOT = 998244353, 3
#: The prime of the prefix hashes.
HASH_PRIME = np.uint64((1 << 31) - 1)
#: Blocks below this length sum their squares directly.
DIRECT = 16
#: Numbers transformed at once.
AREA = 1 << 16
#: Words and characters worked on at once, unless one text is longer.
WORDS, CHARS = 1 << 18, 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo a prime below 2**31, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), modulus)) % np.uint64(modulus)])
    return out[:n]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row, of a length that is a power of two."""
    p, n = np.uint64(PRIME), rows.shape[1]
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    unity = powers(pow(root, PRIME - 2, PRIME) if inverse else root, max(n // 2, 1), PRIME)
    scaled = (unity << np.uint64(32)) // p  # a product's quotient by p, one too small at most
    # Each step halves the transforms' stride and doubles their number; results come out in natural order.
    out, count, size = rows.reshape(len(rows), n, 1), n, 1
    while count > 1:
        even, odd, step = out[:, : count // 2], out[:, count // 2 :], n // (2 * size)
        turned = odd * unity[::step] - ((odd * scaled[::step]) >> np.uint64(32)) * p
        turned = np.minimum(turned, turned - p)  # below zero is very large
        both = np.empty((len(rows), count // 2, 2 * size), np.uint64)
        np.add(even, turned, out=both[:, :, :size])
        np.subtract(even + p, turned, out=both[:, :, size:])
        out = np.minimum(both, both - p)
        count, size = count // 2, size * 2
    out = out.reshape(len(rows), n)
    return out * np.uint64(pow(n, PRIME - 2, PRIME)) % p if inverse else out


def gaps(x: np.ndarray) -> np.ndarray:
    """How far on each word comes again; beyond the end if never."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), 2 * len(x))
    like = x[order[1:]] == x[order[:-1]]
    out[order[:-1][like]] = (order[1:] - order[:-1])[like]
    return out


def again(x: np.ndarray, block: int, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of blocks at multiples of ``block`` that occur again at a distance in [block, 2 * block); a few may be false. ``gap``: ``gaps(x)``."""
    blocks = len(x) // block
    if blocks < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if block < DIRECT:
        starts, distances = [], []
        for d in range(block, 2 * block):
            apart = x[: len(x) - d] - x[d:]
            whole = len(apart) // block * block
            found = np.flatnonzero((apart[:whole] * apart[:whole]).reshape(-1, block).sum(1) == 0)
            starts.append(found * block)
            distances.append(np.full(len(found), d))
        return np.concatenate(starts), np.concatenate(distances)
    p = np.uint64(PRIME)
    padded = np.concatenate([x, np.zeros(3 * block, x.dtype)]).astype(np.uint64)
    squares = np.concatenate([[0], np.cumsum(padded * padded % p)]).astype(np.uint64)
    rows, out = max(1, AREA // (2 * block)), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    every = np.flatnonzero(gap[: blocks * block].reshape(-1, block).max(1) < 2 * block) * block
    for first in range(0, len(every), rows):
        at = every[first : first + rows]
        own = np.zeros((len(at), 2 * block), np.uint64)
        own[:, 0] = padded[at]
        own[:, : block : -1] = padded[at[:, None] + np.arange(1, block)]  # backwards, so that the product is a correlation
        after = padded[at[:, None] + block + np.arange(2 * block)]
        product = transform(transform(own) * transform(after) % p, inverse=True)[:, :block]
        here = (squares[at + block] - squares[at])[:, None]
        there = at[:, None] + block + np.arange(block)
        sums = (here + squares[there + block] - squares[there] + (p - product) * np.uint64(2)) % p
        k, d = np.nonzero(sums == 0)
        out[0].append(at[k])
        out[1].append(d + block)
    return np.concatenate(out[0]), np.concatenate(out[1])


class Prefixes:
    """Hashes of all stretches of ``x``: equal stretches are always found equal."""

    def __init__(self, x: np.ndarray):
        p = HASH_PRIME
        self.power = powers(1103515245, len(x) + 1, int(p))
        value = (x.astype(np.uint64) * np.uint64(2654435761) + np.uint64(12345)) % p
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.power[:-1] % p)]) % p

    def same(self, i: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        p, s = HASH_PRIME, self.sums
        return (s[i + n] + p - s[i]) % p * self.power[d] % p == (s[i + d + n] + p - s[i + d]) % p

    def reach(self, i: np.ndarray, d: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How far words from ``i`` on (or before ``i``) equal those ``d`` later, up to ``most``."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            good = self.same(i if forward else i - middle, d, middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low


def stretch(x: np.ndarray, begin: int, end: int, i: int, d: int) -> tuple[int, int]:
    """Where the words around ``i`` equal those ``d`` later within [begin, end), compared as they are: (first, past the last later word)."""
    unlike = np.flatnonzero(x[begin : end - d] != x[begin + d : end])
    k = int(np.searchsorted(unlike, i - begin))
    first = begin + int(unlike[k - 1]) + 1 if k else begin
    return first, (begin + int(unlike[k]) if k < len(unlike) else end - d) + d


def runs_of(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of the texts ``x[bounds[i]:bounds[i + 1]]`` as rows (start in x, length, period), by start, then period."""
    longest = int(np.diff(bounds).max(initial=0))
    if longest < 6:
        return np.zeros((0, 3), np.int64)
    prefixes, gap, found = Prefixes(x), gaps(x), [np.zeros((0, 3), np.int64)]
    ends = np.zeros(len(x), np.int64)  # at the start of a known run, its end
    block = 1
    while 4 * block <= longest:
        i, d = again(x, block, gap)
        text = np.searchsorted(bounds, i, "right") - 1
        begin, end = bounds[text], bounds[text + 1]
        new = (i + block + d <= end) & (np.maximum.accumulate(ends)[i] < i + block + d)
        i, d, begin, end = i[new], d[new], begin[new], end[new]
        new = prefixes.same(i, d, np.full(len(i), block, np.int64))
        i, d, begin, end = i[new], d[new], begin[new], end[new]
        first = i - prefixes.reach(i, d, i - begin, False)
        last = i + prefixes.reach(i, d, end - d - i, True) + d
        runs = np.unique(np.stack([first, last - first, d, begin, end, i], 1)[last - first >= np.maximum(6, 4 * d)], axis=0)
        sure, seen = set(), set()
        for s, n, q, b, e, at in runs.tolist():
            if (s, n, q) in seen:
                continue
            if not (x[s : s + n - q] == x[s + q : s + n]).all():  # equal hashes of different words
                s, n = (f := stretch(x, b, e, at, q))[0], f[1] - f[0]
            else:
                seen.add((s, n, q))
            if n >= max(6, 4 * q) and x[at] == x[at + q]:
                sure.add((s, n, q))
        if sure:
            rows = np.array(sorted(sure), np.int64)
            found.append(rows)
            np.maximum.at(ends, rows[:, 0], rows[:, 0] + rows[:, 1])
        block *= 2
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def pieces_of(text: str) -> Iterator[str]:
    """The text in parts that end at white space."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, min(at + CHARS, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the contract's period put in, for one document in ten."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


class Texts:
    """Texts as numbers of their words, until ``rows`` gives a result for each."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.docs, self.n = [], [], 0

    def add(self, doc_id: int | None, text: str | None, plant: bool) -> None:
        parts = [np.fromiter(map(self.number.__getitem__, WORD.findall(part)), np.int64) for part in pieces_of(text or "")]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids = planted(ids, doc_id) if plant else ids
        self.ids.append(ids)
        self.docs.append(doc_id)
        self.n += len(ids)

    def rows(self) -> Iterator[tuple]:
        bounds = np.concatenate([[0], np.cumsum([len(i) for i in self.ids])]).astype(np.int64)
        x = np.concatenate([*self.ids, np.zeros(0, np.int64)])
        runs = runs_of(x, bounds)
        words = list(self.number)
        cover = np.zeros(len(x) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(cover)[:-1] == 0
        cuts = np.searchsorted(runs[:, 0], bounds)
        for k, doc_id in enumerate(self.docs):
            own = runs[cuts[k] : cuts[k + 1]] - [bounds[k], 0, 0]
            best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist() if len(own) else None
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
            left, digest = self.ids[k][kept[bounds[k] : bounds[k + 1]]], hashlib.sha256()
            for i in range(0, len(left), WORDS):
                digest.update((" " * (i > 0) + " ".join(map(words.__getitem__, left[i : i + WORDS].tolist()))).encode())
            found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            yield doc_id, len(own), *found, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()
        self.clear()


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``SCHEMA``, one row per row. ``plant`` puts the contract's periods into one document in ten."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*texts.rows(), strict=True)) or [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                texts.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), plant)
                if texts.n >= WORDS:
                    yield flush()
        yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, SCHEMA)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
