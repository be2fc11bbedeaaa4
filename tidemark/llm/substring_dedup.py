"""Substring dedup (operator 2) by collinear chaining of shared word k-mers.

Seeds are 5-word shingles, the least hash of every ``WINDOW`` in a row (minimizers), so that two texts that share
``WINDOW`` + 4 = 16 words share a seed. Each seed of a document is joined with its first occurrence in the corpus, the one in
the document with the smallest id; this makes one match a seed, whatever number of documents holds the passage. The short
seeds of a passage may occur first in other documents, each of which holds less than a passage. So runs of ``min_words``
words are seeds too, the least hash of every ``LONG_WINDOW`` in a row: what holds such a seed first holds a passage. A
run of a period of up to ``PERIOD`` words is one seed, and it is covered by the first such run, as often as it takes. The
matches of a pair of documents are chained: increasing in both, with a gap cost for skipped words, through a Fenwick
tree that holds the best chain end for every prefix of source positions. Chains are cut at wide gaps, and each piece is
aligned on the words of both texts, gaps and ends included; a piece of a single seed too, if enough words around it are
alike. A passage is an alignment of at least ``min_words`` words of
which at least ``identity`` are equal.

Nulls: a null text has no words and a null ``doc_id`` takes no part; ``cut_repeats`` keeps both as they are. Texts shorter
than a shingle have no seed. Of tied first occurrences the earlier position counts; repeated rows of one id are one
document and never each other's source. An empty table gives an empty result. Further columns are ignored by ``repeats`` and kept
by ``cut_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import spill
from tidemark.llm.workers import lean
from tidemark.llm.words import BASE, bytes_of, mix, shingle_hashes, slices, word_hashes

K, WINDOW = 5, 12
#: Words that a chain may skip, in either text; words looked at beyond the ends of a chain at first.
GAP, BEYOND = 16, 128
#: A run of ``min_words`` words is a long seed if its hash is the least of so many in a row.
LONG_WINDOW = 11
#: Longest period of a run that is a seed as a whole.
PERIOD = 12
#: The bits of a seed that give its kind: 0 for a short one, the period for a run.
KIND, LONG = np.uint64(15), np.uint64(15)
#: Pieces that span fewer words are looked at in ``NEAR`` words on either side, on diagonals up to ``DRIFT`` away, before they are aligned.
SHORT, NEAR, DRIFT = 15, 64, 3
#: Cost of a skipped word, in seeds.
SKIP = 1 / 64


def minimizers(s: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``window`` hashes in a row, and where they are."""
    if len(s) > window:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(s, window).argmin(1) + np.arange(len(s) - window + 1))
    else:
        at = np.array([s.argmin()]) if len(s) else np.zeros(0, np.int64)
    return s[at], at


def periodic(words: np.ndarray, firsts: np.ndarray, long: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a period of ``PERIOD`` words at most, so long that from any word of the first
    period on ``long`` words are left. ``firsts`` are the places where texts begin and the last ends."""
    found: list[tuple[int, int, int]] = []
    for d in range(1, PERIOD + 1):
        least = long + d - 1
        step = max((least - d) // 5, 1)  # any run that is long enough holds four words in a row of every ``step``th
        seen = words[d::step] == words[:-d:step]
        if not (seen[3:] & seen[2:-1] & seen[1:-2] & seen[:-3]).any():
            continue
        runs, spans = [], np.flatnonzero(np.diff(np.r_[False, seen, False])).reshape(-1, 2)
        for u, v in spans[spans[:, 1] - spans[:, 0] >= 4].tolist():
            known = any(d % e == 0 and s <= step * u and step * (v - 1) + d < t for s, t, e in found)  # of a shorter period
            if not known:  # a run that holds these is between the words looked at before and after them, which are not in it
                low, high = max(step * (u - 1), 0), min(step * v + 1, len(words) - d)
                other = np.r_[low - 1, low + np.flatnonzero(words[low + d : high + d] != words[low:high]), high]
                runs += [(int(other[x]) + 1, int(other[x + 1]) + d) for x in np.flatnonzero(np.diff(other) - 1 >= least - d)]
        for start, end in runs:
            for i in range(int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts, end, "left"))):
                a, b = max(start, int(firsts[i])), min(end, int(firsts[i + 1]))
                if b - a >= least and not any(s <= a and b <= e for s, e, _ in found):
                    found.append((a, b, d))
    return found


def run_seed(words: np.ndarray, start: int, end: int, d: int) -> tuple[int, int]:
    """Hash of a periodic run, whatever word it starts with, and its place: start, words before the first whole period, length."""
    block = words[start : start + d].tolist()
    turn = min(range(d), key=lambda x: block[x:] + block[:x])
    key = shingle_hashes(np.array(block[turn:] + block[:turn], np.uint64), d)
    return int(key[0] & ~KIND | np.uint64(d)), start << 32 | turn << 28 | min(end - start, (1 << 28) - 1)


def tiles(at: int, src_at: int, d: int, long: int) -> Iterator[tuple[int, int, int]]:
    """(place, source place, words) that cover a periodic run by one of the same period, each of ``long`` words at least."""
    n, turn, m, src_turn = at & 0xFFFFFFF, at >> 28 & 15, src_at & 0xFFFFFFF, src_at >> 28 & 15
    i = 0
    while i < n:
        i = min(i, n - long)
        j = (i - turn + src_turn) % d
        size = min(n - i, m - j)
        yield (at >> 32) + i, (src_at >> 32) + j, size
        i += size


def swept(values: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """``best``, minimum or maximum, of every ``window`` values in a row."""
    n, width, out = max(len(values) - window + 1, 0), 1, values
    while 2 * width <= window:
        out = best(out[: len(out) - width], out[width:])
        width *= 2
    return best(out[:n], out[window - width : window - width + n])


def inside(at: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of the places ``at``, all below ``n``, are in any of the spans."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges)[at] > 0


def minimizers_of(s: np.ndarray, firsts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Where in ``s`` the ``minimizers`` are of many texts at once; a text has ``counts`` hashes from ``firsts`` on.

    A hash is the least of some window if it is the largest of the least ones of its windows. Ties within a window are told by
    the texts alone.
    """
    n = len(s)
    if n <= window:
        full = np.zeros(0, np.int64)
    else:
        a, b = firsts[counts >= window], (firsts + counts)[counts >= window]
        least = np.zeros(n + window - 1, np.uint64)  # by the end of the window, 0 where it is not in one text
        least[window - 1 : n] = np.where(inside(np.arange(n - window + 1), a, b - window + 1, n), swept(s, window, np.minimum), 0)
        full = np.flatnonzero(swept(least, window, np.maximum) == s)
        full = full[inside(full, a, b, n)]
    tied = np.flatnonzero((s[full[1:]] == s[full[:-1]]) & (np.diff(full) < window))
    again = np.unique(np.searchsorted(firsts, full[tied], "right") - 1) if len(tied) else tied
    alone = np.concatenate([again, np.flatnonzero((counts > 0) & ((counts < window) | (n <= window)))])
    if len(again):
        full = full[~np.isin(np.searchsorted(firsts, full, "right") - 1, again)]
    return np.concatenate([full, *(minimizers(s[firsts[x] : firsts[x] + counts[x]], window)[1] + firsts[x] for x in alone)])


def seeds(words: np.ndarray, firsts: np.ndarray, long: int, runs_at: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds of texts, which text they are of and their places there; the lowest bits of a hash tell the kind. The
    periodic runs ``runs_at`` are seeds of their own, and there are no others inside them. A place is a word position times
    2**32, for runs with turn and length."""
    sizes = np.diff(firsts)
    s = shingle_hashes(words, K) if len(words) >= K else words[:0]
    n = max(len(words) - long + 1, 0)
    runs = np.zeros(n, np.uint64)
    for i in [*range(0, long - K, K), long - K]:
        runs = runs * BASE + s[i : i + n]
    runs = mix(runs)
    p = minimizers_of(s, firsts[:-1], np.maximum(sizes - K + 1, 0), WINDOW)
    q = minimizers_of(runs, firsts[:-1], np.maximum(sizes - long + 1, 0), LONG_WINDOW)
    if runs_at:
        a, b, _ = np.array(runs_at, np.int64).T
        p, q = p[~inside(p, a, b - K + 1, len(words))], q[~inside(q, a, b - long + 1, len(words))]
    at = np.concatenate([p, q, np.array([a for a, _, _ in runs_at], np.int64)]).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    places = at - firsts[text] << 32
    own = [run_seed(words, *r) for r in runs_at]
    places[len(p) + len(q) :] += np.array([x & 0xFFFFFFFF for _, x in own], np.int64)
    return np.concatenate([s[p] & ~KIND, runs[q] & ~KIND | LONG, np.array([x for x, _ in own], np.uint64)]), text, places


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def seeds_of(docs: DataFrame, long: int) -> DataFrame:
    """``(seed, doc_id, pos)``, all seeds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, ids, places in found_in(batches, long):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids), pa.array(places)], names=["seed", "doc_id", "pos"])

    return texts_of(docs).mapInArrow(lean(each), "seed long, doc_id long, pos long")


def ends_of(docs: DataFrame, long: int) -> DataFrame:
    """``(seed, doc_id, pos, last)``: of the texts of a slice, each seed's first occurrence and the largest id that has it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, ids, places in found_in(batches, long):
            order = np.argsort(hashes)
            hashes, ids, places = hashes[order], ids[order], places[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            starts, more = np.flatnonzero(new), np.flatnonzero(~(new & np.r_[new[1:], True]))
            inner = more[np.lexsort((places[more], ids[more], hashes[more]))]
            ids[more], places[more] = ids[inner], places[inner]
            last = np.maximum.reduceat(ids, starts)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes[starts], ids[starts], places[starts], last)], names=["seed", "doc_id", "pos", "last"])

    return texts_of(docs).mapInArrow(lean(each), "seed long, doc_id long, pos long, last long")


def found_in(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seeds, ids and places of ``batches(doc_id, text)``, slice by slice."""
    for batch in batches:
        data, at = bytes_of(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(at):
            words, firsts, _, _ = word_hashes(data, at[i : j + 1])
            hashes, text, places = seeds(words, firsts, long, periodic(words, firsts, long))
            if len(hashes):
                yield hashes.view(np.int64), ids[i:j][text], places


def words_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, words)``, 32 bits a word, of the documents in ``ids(doc_id)``."""
    return packed_words(texts_of(docs).join(ids, "doc_id", "left_semi"), "words", np.uint32)


def packed_words(texts: DataFrame, name: str, kind: type) -> DataFrame:
    """``(doc_id, <name>)``, the low bits of the words of ``texts(doc_id, text)``, as many as ``kind`` has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for i, j in slices(at):
                hashes, firsts, _, _ = word_hashes(data, at[i : j + 1])
                low = pa.py_buffer(hashes.astype(kind))
                ends = pa.py_buffer((firsts * np.dtype(kind).itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, ends, low])], names=["doc_id", name])

    return texts.mapInArrow(lean(each), f"doc_id long, {name} binary")


def promising(a: list[bytes], b: list[bytes], at_a: np.ndarray, at_b: np.ndarray, min_words: int, identity: float) -> np.ndarray:
    """Whether words around a match, at ``at_a`` and ``at_b``, may be a passage: in some window of ``min_words`` around it, or up to the
    end of what is seen, three quarters of the equal words it takes are equal on one of the diagonals nearby."""
    side = NEAR + DRIFT
    size = 2 * side + K

    def spread(texts: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), lengths)
        column = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(side - at, lengths)
        out, seen = np.zeros((len(texts), size), np.uint8), np.zeros((len(texts), size), bool)
        ok = (column >= 0) & (column < size)
        out[row[ok], column[ok]] = np.frombuffer(b"".join(texts), np.uint8)[ok]
        seen[row[ok], column[ok]] = True
        return out, seen

    (x, x_seen), (y, y_seen) = spread(a, at_a), spread(b, at_b)
    width = 2 * NEAR + K
    equal = np.zeros((len(a), width), bool)
    for d in range(-DRIFT, DRIFT + 1):
        own, other = np.s_[DRIFT : DRIFT + width], np.s_[DRIFT + d : DRIFT + d + width]
        equal |= (x[:, own] == y[:, other]) & x_seen[:, own] & y_seen[:, other]
    window = min(min_words, width)
    total = np.zeros((len(a), width + 1), np.int16)
    np.cumsum(equal, 1, out=total[:, 1:])
    return (total[:, window:] - total[:, :-window]).max(1) >= 0.75 * identity * window


def looked_at(weak: DataFrame, docs: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Of pieces of chains ``weak(doc_id, src_id, p, q)`` those that may be in a passage, by the low bits of the words around their first match."""
    low = spill(packed_words(texts_of(docs), "low", np.uint8), "low")  # of all documents: a byte a word is less than the texts that a join would move
    side = NEAR + DRIFT

    def around(at: str, name: str):
        return F.expr(f"substring(low, greatest({at}[0] - {side}, 0) + 1, least({at}[0], {side}) + {side + K})").alias(name)

    one = weak.join(low, "doc_id").select("doc_id", "src_id", "p", "q", around("p", "a"))
    both = one.join(low.withColumnRenamed("doc_id", "src_id"), "src_id").select("doc_id", "src_id", "p", "q", "a", around("q", "b"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                firsts = [np.minimum(pc.list_element(part.column(x), 0).to_numpy(zero_copy_only=False), side) for x in (2, 3)]
                keep = promising(part.column(4).to_pylist(), part.column(5).to_pylist(), *firsts, min_words, identity)
                yield part.select([0, 1, 2, 3]).filter(pa.array(keep))

    return both.mapInArrow(lean(each), "doc_id long, src_id long, p array<int>, q array<int>")


class Fenwick:
    """Maximum of the values put at places below a given one."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def below(self, place: int) -> tuple[float, int]:
        out = self.best[0]
        while place > 0:
            out = max(out, self.best[place])
            place -= place & -place
        return out


def chains(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Chains of matches (p, q), sorted by p then q, best first; each match is in one chain at most."""
    if (np.diff(p) > 0).all() and (np.diff(q) > 0).all():
        return [np.arange(len(p))]  # gap costs add up along a chain, so the best one takes every match
    places = np.unique(q, return_inverse=True)[1].tolist()
    tree, ps, qs, n = Fenwick(max(places) + 1), p.tolist(), q.tolist(), len(p)
    score, back = [1.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and ps[j] == ps[i]:
            value, at = tree.below(places[j])
            value -= SKIP * (ps[j] + qs[j])
            if value > 0:
                score[j], back[j] = 1 + value, at
            j += 1
        for x in range(i, j):
            tree.put(places[x], (score[x] + SKIP * (ps[x] + qs[x]), x))
        i = j
    out, used = [], [False] * n
    for end in sorted(range(n), key=lambda x: -score[x]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = back[end]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def pieces(p: np.ndarray, q: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains cut at gaps of more than ``GAP`` words, if their seeds alone span ``least`` words."""
    for chain in chains(p, q):
        cp, cq = p[chain], q[chain]
        cuts = np.flatnonzero((np.diff(cp) > GAP + K) | (np.diff(cq) > GAP + K)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cp)], strict=True):
            if cp[b - 1] + K - cp[a] >= least:
                yield cp[a:b], cq[a:b]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b, m = a[n:], b[n:], 0
    while m < min(len(a), len(b)) and a[len(a) - 1 - m] == b[len(b) - 1 - m]:
        m += 1
    a, b = a[: len(a) - m].tolist(), b[: len(b) - m].tolist()
    if not a or not b:
        return n + m
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return n + m + row[-1]


def reach(equal: np.ndarray) -> tuple[int, int]:
    """How far an alignment goes on along ``equal`` words, a different one costing two; and how many of these are equal."""
    if not len(equal):
        return 0, 0
    gain = (equal.view(np.int8) * np.int8(3) - np.int8(2)).cumsum()
    best = int(gain.argmax())
    return (best + 1, int(equal[: best + 1].sum())) if gain[best] > 0 else (0, 0)


#: Words skipped in either text to find another diagonal beyond the end of an alignment.
SHIFTS = [(x, y) for x in range(4) for y in range(4) if x or y]


def shifts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of ``SHIFTS`` on whose diagonals three words in a row are equal: no other has a gain above the cost of its shift."""
    n = min(len(a), len(b))
    if n < 3:
        return []
    both = np.full((2, n + 6), -1, np.int64)
    both[1] = -2
    both[0, : min(len(a), n + 3)], both[1, : min(len(b), n + 3)] = a[: n + 3], b[: n + 3]
    x, y = np.ndarray((2, 4, n + 3), np.int64, both, strides=(both.strides[0], 8, 8))
    same = x[:, None] == y
    same = same[..., 2:] & same[..., 1:-1] & same[..., :-2]
    if not same.any():
        return []
    return [xy for xy in SHIFTS if same[xy].any()]


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """How far an alignment goes on into ``a`` and ``b``, over differences and short gaps; its equal words and columns."""
    x = y = equal = columns = 0
    while True:
        n = min(len(a) - x, len(b) - y)
        far, same = reach(a[x : x + n] == b[y : y + n])
        x, y, equal, columns = x + far, y + far, equal + same, columns + far
        best = (0, 0, 0)
        for da, db in shifts(a[x:], b[y:]):
            n = min(len(a) - x - da, len(b) - y - db)
            if n > 0:
                far, same = reach(a[x + da : x + da + n] == b[y + db : y + db + n])
                best = max(best, (3 * same - 2 * far - 2 * max(da, db), da, db))
        if not best[0]:
            return x, y, equal, columns
        x, y, columns = x + best[1], y + best[2], columns + max(best[1:])


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """(start, end) in a, (start, end) in b, equal words and columns of the alignment through the matches (p, q)."""
    equal = columns = 0
    turns = np.flatnonzero(np.diff(p - q)) + 1  # where the diagonal changes
    starts, ends = [0, *turns.tolist()], [*(turns - 1).tolist(), len(p) - 1]
    at_a, at_b = int(p[0]), int(q[0])
    for x, y in zip(starts, ends, strict=True):
        pa_, qa = int(p[x]), int(q[x])
        shift = max(at_a - pa_, at_b - qa, 0)  # a match that overlaps the one before
        pa_, qa = pa_ + shift, qa + shift
        same = common_words(a[at_a:pa_], b[at_b:qa])
        equal += same
        columns += max(pa_ - at_a, qa - at_b)
        n = int(p[y]) + K - pa_
        if n > 0:
            equal += int((a[pa_ : pa_ + n] == b[qa : qa + n]).sum())
            columns += n
            at_a, at_b = pa_ + n, qa + n
        else:
            at_a, at_b = pa_, qa
    start_a, start_b = int(p[0]), int(q[0])
    far_a, far_b, same, more = extend(a[:start_a][::-1], b[:start_b][::-1])
    start_a, start_b, equal, columns = start_a - far_a, start_b - far_b, equal + same, columns + more
    far_a, far_b, same, more = extend(a[at_a:], b[at_b:])
    return start_a, at_a + far_a, start_b, at_b + far_b, equal + same, columns + more


def points(p: np.ndarray, q: np.ndarray, kind: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches of seeds as matches of ``K`` words, those of a long seed near enough for a chain; sorted by p then q."""
    whole = kind == LONG
    if whole.any():
        steps = np.r_[np.arange(0, long - K, GAP + K), long - K]
        p = np.concatenate([p[~whole], (p[whole, None] + steps).ravel()]).astype(np.int64)
        q = np.concatenate([q[~whole], (q[whole, None] + steps).ravel()]).astype(np.int64)
        both = np.unique(p << 32 | q)
        p, q = both >> 32, both & 0xFFFFFFFF
    return p, q


def in_line(columns: list[np.ndarray], long: int) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Pieces of the groups of matches (sorted: doc_id, src_id, pos, src_pos, kind) that increase in both texts and have no periodic
    run, all at once: the best chain of such a group takes every match, and no long seed is torn. And the rows of the other groups."""
    doc, src, p, q, kind = columns
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])
    group = np.cumsum(new) - 1
    good = np.ones(group[-1] + 1, bool)
    good[group[(kind > 0) & (kind < LONG)]] = False
    g, x, y = group, p >> 32, q >> 32
    if len(whole := np.flatnonzero(kind == LONG)):
        steps = np.r_[np.arange(0, long - K, GAP + K), long - K]
        has = np.zeros(len(good), bool)
        has[g[whole]] = True
        short = kind != LONG
        g, x, y = (np.concatenate([c[short], (c[whole, None] + s).ravel()]) for c, s in ((g, 0 * steps), (x, steps), (y, steps)))
        order = np.lexsort((y, x, g))
        g, x, y = g[order], x[order], y[order]
        once = np.ones(len(g), bool)
        once[1:] = ~has[g[1:]] | (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        g, x, y = g[once], x[once], y[once]
    same, dx, dy = g[1:] == g[:-1], np.diff(x), np.diff(y)
    good[g[1:][same & ((dx <= 0) | (dy <= 0))]] = False
    cut = np.ones(len(g), bool)
    cut[1:] = ~same | (dx > GAP + K) | (dy > GAP + K)
    keep = good[g]
    g, x, y, cut = g[keep], x[keep], y[keep], cut[keep]
    starts = np.flatnonzero(cut)
    at = pa.array(np.r_[starts, len(g)].astype(np.int32))
    first = np.flatnonzero(new)[g[starts]]
    lists = [pa.ListArray.from_arrays(at, pa.array(c, pa.int32())) for c in (x, y)]
    return [pa.array(doc[first]), pa.array(src[first]), *lists], [c[~good[group]] for c in columns]


def chained(matches: DataFrame, least: int, long: int) -> DataFrame:
    """``matches(doc_id, src_id, pos, src_pos, kind)`` to pieces of chains and to tiles of periodic runs; a group has one row a seed of its document at most."""
    names = ["doc_id", "src_id", "p", "q"]

    def flush(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        plain, rest = in_line(columns, long)
        yield pa.RecordBatch.from_arrays(plain, names=names)
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays(one_by_one(rest), names=names)

    def one_by_one(columns: list[np.ndarray]) -> list[pa.Array]:
        doc, src, p, q, kind = columns
        edge = np.flatnonzero((doc[1:] != doc[:-1]) | (src[1:] != src[:-1])) + 1
        rows = []
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(doc)], strict=True):
            ids = int(doc[a]), int(src[a])
            whole = (kind[a:b] > 0) & (kind[a:b] < LONG)
            for x in np.flatnonzero(whole) + a:
                rows += [(*ids, np.array([i, i + n - K]), np.array([j, j + n - K])) for i, j, n in tiles(int(p[x]), int(q[x]), int(kind[x]), long)]
            if whole.all():
                continue
            gp, gq = points(p[a:b][~whole] >> 32, q[a:b][~whole] >> 32, kind[a:b][~whole], long)
            if gp[-1] + K - gp[0] >= least:
                found = list(pieces(gp, gq, least))
                rows += [(*ids, cp, cq) for cp, cq in found]
                if len(found) != 1 or len(found[0][0]) != len(gp):  # chains may have torn a long seed that occurs again nearby
                    of = {xy: x for x, piece in enumerate(found) for xy in zip(piece[0].tolist(), piece[1].tolist(), strict=True)}
                    for x in np.flatnonzero(kind[a:b] == LONG) + a:
                        i, j = int(p[x]) >> 32, int(q[x]) >> 32
                        if (piece := of.get((i, j))) is None or piece != of.get((i + long - K, j + long - K)):
                            rows.append((*ids, np.array([i, i + long - K]), np.array([j, j + long - K])))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from flush([c[:cut] for c in new])
            held = [c[cut:] for c in new]
        if held:
            yield from flush(held)

    dealt = matches.repartition("doc_id").sortWithinPartitions("doc_id", "src_id", "pos", "src_pos")
    return dealt.select("doc_id", "src_id", "pos", "src_pos", "kind").mapInArrow(lean(each), "doc_id long, src_id long, p array<int>, q array<int>")


def aligned(found: DataFrame, docs: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Pieces of chains to passages; of each text only the words around the chain meet. Alignments that come to the end of what is
    seen, where the texts go on, are made again with eight times as much around, until none does."""
    ids = found.select("doc_id").union(found.select("src_id")).distinct()
    words, beyond, ended = spill(words_of(docs, ids), "words"), BEYOND, []
    while True:
        rows = spill(aligned_within(found, words, beyond, min_words, identity), "aligned")
        ended.append(rows.where("p is null").drop("p", "q"))
        found, beyond = rows.where("p is not null").select("doc_id", F.col("src_doc_id").alias("src_id"), "p", "q"), 8 * beyond
        if found.isEmpty():
            return reduce(DataFrame.union, ended)


def aligned_within(found: DataFrame, words: DataFrame, beyond: int, min_words: int, identity: float) -> DataFrame:
    """Passages of the pieces ``found``, from ``beyond`` words on either side; a row with ``p`` and ``q`` is a piece that may go on further."""

    def around(at: str, name: str):
        low = F.greatest(F.col(at)[0] - beyond, F.lit(0))
        return low.alias(f"{name}_low"), F.substring("words", 4 * low + 1, 4 * (F.element_at(at, -1) + K + beyond - low)).alias(name)

    one = found.join(words, "doc_id").select("doc_id", "src_id", "p", "q", *around("p", "a"))
    both = one.join(words.withColumnRenamed("doc_id", "src_id"), "src_id").select("doc_id", "src_id", "p", "q", "a", "a_low", *around("q", "b"))
    names = ["doc_id", "start_word", "end_word", "src_doc_id", "src_start_word", "src_end_word", "n_words", "identity", "weak", "p", "q"]

    def cut(at: np.ndarray, low: int, seen: np.ndarray, start: int, end: int) -> bool:
        """Does an alignment come near an end of the words seen where the text goes on?"""
        return low > 0 and start < GAP or len(seen) == at[-1] + K + beyond - low and len(seen) - end < GAP

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ends, values = zip(*((x.offsets.to_numpy().tolist(), x.values.to_numpy()) for x in batch.columns[2:4]), strict=True)
            plain = (batch.column(x).to_pylist() for x in (0, 1, 4, 5, 6, 7))
            for i, (doc, src, a, a_low, b, b_low) in enumerate(zip(*plain, strict=True)):
                p, q = (v[n[i] : n[i + 1]] for n, v in zip(ends, values, strict=True))
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                s, e, t, u, equal, columns = align(a, b, p - a_low, q - b_low)
                if cut(p, a_low, a, s, e) or cut(q, b_low, b, t, u):
                    rows.append((doc, None, None, src, *[None] * 5, p, q))
                elif e - s >= min_words and equal >= identity * columns:
                    rows.append((doc, s + a_low, e + a_low, src, t + b_low, u + b_low, e - s, equal / columns, bool(p[-1] + K - p[0] < min(min_words, SHORT)), None, None))
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.bool_()] + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 11, kinds, strict=True)], names=names)

    return both.select("doc_id", "src_id", "p", "q", "a", "a_low", "b", "b_low").mapInArrow(lean(each), "doc_id long, start_word long, end_word long, src_doc_id long, src_start_word long, src_end_word long, n_words long, identity double, weak boolean, p array<int>, q array<int>")


def repeats(docs: DataFrame, min_words: int = 40, identity: float = 0.8) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row for each passage of a document that an earlier document holds too:
    ``(doc_id, start_word, end_word, src_doc_id, src_start_word, src_end_word, n_words, identity)``, ends exclusive.
    """
    long = max(min_words, K)
    seeds = seeds_of(docs, long)
    first = F.min(F.struct("doc_id", "pos"))
    # Slices of texts have reduced their seeds already and nearly all are left: they are sorted once, after the shuffle, not before it too.
    shared = ends_of(docs, long).repartition("seed").groupBy("seed").agg(first.alias("first"), F.max("last").alias("last")).where("first.doc_id <> last")
    shared = spill(shared.select("seed", F.col("first.doc_id").alias("src_id"), F.col("first.pos").alias("src_pos")), "shared")
    # Both sides are plain: a seed that a third of all documents hold is split by AQE.
    matches = seeds.join(shared, "seed").where("doc_id <> src_id").select("doc_id", "src_id", "pos", "src_pos", F.expr("cast(seed & 15 as int)").alias("kind"))
    found = spill(chained(matches, K, long), "chains")
    span = F.element_at("p", -1) + K - F.element_at("p", 1)
    likely = looked_at(found.where(span < min(min_words, SHORT)), docs, min_words, identity)
    passages = aligned(spill(found.where(span >= min(min_words, SHORT)).union(likely), "pieces"), docs, min_words, identity)
    # What a short piece gives is left out only where a longer one gives it too: the same source, and all of its words in both texts.
    of_pair = Window.partitionBy("doc_id", "src_doc_id").orderBy("start_word")
    so_far = F.max(F.expr("if(weak, null, struct(end_word, src_start_word, src_end_word))")).over(of_pair)
    again = "so_far.end_word >= end_word and so_far.src_start_word <= src_start_word and so_far.src_end_word >= src_end_word"
    return passages.withColumn("so_far", so_far).where(f"not weak or so_far is null or not ({again})").drop("weak", "so_far")


def cut_repeats(docs: DataFrame, min_words: int = 40, identity: float = 0.8) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; rows of which nothing is left go. ``n_chars``, if there, follows."""
    found = spill(repeats(docs, min_words, identity), "repeats")
    # No more spans than the document has words. The names below are no column's of ``docs``.
    cut_id, mine, was = (f"__{n}_{'_'.join(docs.columns)}" for n in ("id", "spans", "cut"))
    spans = found.groupBy(F.col("doc_id").alias(cut_id)).agg(F.sort_array(F.collect_list(F.array("start_word", "end_word"))).alias(mine))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if s is None else without(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    cut = cut.asNondeterministic()  # else the filter below would have it run twice

    joined = docs.join(spans, docs["doc_id"] == spans[cut_id], "left").withColumn(was, F.col(mine).isNotNull())
    out = joined.withColumn("text", F.when(F.col(was), cut("text", mine)).otherwise(F.col("text")))
    out = out.where(~F.col(was) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(was), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def without(text: str, spans) -> str:
    """``text`` without the words in ``spans`` and the white space after each span."""
    data, at = bytes_of(pa.array([text]))
    _, _, starts, _ = word_hashes(data, at)
    starts, raw, out, last = np.r_[starts, len(data)], data.tobytes(), [], 0
    for a, b in spans:
        out.append(raw[last : max(last, starts[min(a, len(starts) - 1)])])
        last = max(last, int(starts[min(b, len(starts) - 1)]))
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace").rstrip()


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
