"""Phrase collocations (operator 11): frequent phrases per language, found by mergeable Misra-Gries summaries, counted exactly.

A text's A-Z become a-z; sentence marks and line ends cut it into pieces, spaces and tabs a piece into words. Tasks take
blocks of a few million bytes of one language; a very long text is cut between words, and phrases belong to the block they begin in.

First pass: every phrase of one to ``longest`` words has a 64-bit hash. Its first bits name a bucket, the next 32 are its key there,
and a block sends each bucket its keys and counts, packed. Every bucket has its own summary: blocks are merged into it, and
whenever it holds more keys than its capacity, the count of the first key beyond it is taken off all and those at zero go. The
capacity is ``ROOM`` times the bucket's mass over the threshold, so less than threshold / ``ROOM`` is taken off in all;
a key whose count and what was taken off reach the threshold survives. So every phrase with ``threshold`` occurrences survives: keys
that coincide only add counts. The number of buckets grows with the mass, so a summary stays small.
Second pass: survivors mark a bitmap of ``FILTER`` bits, a fixed size, that all tasks hold. Blocks count the phrases that it marks and
whose parts it marks (a phrase is no more frequent than its parts), and send each bucket its phrases in order with their counts, compressed.
A bucket sums them by the phrase itself, which is exact: what the bitmap lets through wrongly is counted and found to be under the
threshold. The more survivors there are for the bitmap, the more goes through; results are the same.

A candidate of two words or more is cut after each of its words; l and r are the counts of the parts, the score is
floor(1000000 * a * a / (l * r)), and the lowest-scoring cut counts (ties: the first). All of it is in decimals of 38 digits,
enough for counts below 10**15. A candidate inside a longer one with at least ``share`` percent of its count goes. The first
``top`` of each language are found in salted parts first, so no task ever holds a whole language.

Nulls: a null text is empty, a null language is ``und`` (as is the text 'und'). Empty texts and empty tables give nothing. Repeated
rows count each. Ties in the order are settled by count, then phrase in byte order, so ranks are unique. Very long texts are
counted whole. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import spill
from tidemark.llm.workers import lean

#: The contract's marks between pieces, and spaces between words. Fixed values.
MARKS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: Bytes whose phrases are counted together, such blocks that wait for more of their language, the mass that makes another bucket, spare capacity of summaries, bits of the filter.
BYTES, WAITING, MASS, ROOM, FILTER = 3_000_000, 4, 8_000_000, 4, 2**27
SALTS = 64

_class = np.zeros(256, np.uint8)
_class[list(SPACES)], _class[list(MARKS)] = 1, 2
_gap = re.compile(b"[" + re.escape(SPACES + MARKS) + b"]+")


def blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, bytes, int]]:
    """Batches of (lang, text) to (lang, lower-cased bytes, limit): phrases that begin before the limit are the block's own."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0

    def flush(lang: str) -> Iterator[tuple[str, bytes, int]]:
        whole, at = b"\n".join(waiting.pop(lang)).lower(), 0
        del sizes[lang]
        while at < len(whole):
            gap = _gap.search(whole, at + BYTES)
            end = far = gap.end() if gap else len(whole)
            for _ in range(longest - 1):
                gap = _gap.search(whole, far)
                far = gap.end() if gap else len(whole)
            yield lang, whole[at:far], end - at
            at = end

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            full = lang if sizes.get(lang, 0) + len(text) > BYTES else max(sizes, key=sizes.get) if total > WAITING * BYTES else None
            if full in sizes:
                total -= sizes[full]
                yield from flush(full)
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            total += len(text) + 1
    for lang in list(waiting):
        yield from flush(lang)


class Block:
    """The words of a block as codes of a vocabulary, and the hashes of all its phrases."""

    def __init__(self, lang: str, data: bytes, limit: int, longest: int) -> None:
        raw = np.frombuffer(data, np.uint8)
        kinds = _class[raw]
        inside = kinds == 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.codes, self.vocabulary = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.own = int(np.searchsorted(starts, limit))
        piece = np.cumsum(kinds == 2)[starts]
        seed = xxhash.xxh64_intdigest(lang.encode())
        word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))[self.codes]
        #: By length: whether a phrase begins at a word, and its hash.
        self.there, self.hashes = [], []
        running = word
        for k in range(1, longest + 1):
            n = max(0, len(starts) - k + 1)
            if k > 1:
                running = (running[:n] ^ (running[:n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k - 1 :]
            mixed = (running ^ (running >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            self.there.append(piece[:n] == piece[k - 1 :])
            self.hashes.append(mixed ^ (mixed >> np.uint64(31)))


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their bytes by place, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def dealt(longest: int, bits: int):
    """A task's function: batches of (lang, text) to (bucket, mass, entries, keys, counts), a row for a block and bucket of 2**bits."""

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, longest):
            b = Block(*block, longest)
            found = np.concatenate([h[: b.own][t[: b.own]] for h, t in zip(b.hashes, b.there, strict=True)])
            found, counts = np.unique(found, return_counts=True)
            edges = np.searchsorted(found >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
            keys = ((found >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = np.flatnonzero(np.diff(edges))
            for some in np.array_split(full, len(full) // 1000 + 1):
                cuts = [slice(edges[i], edges[i + 1]) for i in some]
                mass = [int(counts[c].sum()) for c in cuts]
                deltas = [packed(np.diff(keys[c], prepend=np.uint32(0))) for c in cuts]
                columns = [pa.array(some, pa.int32()), pa.array(mass, pa.int64()), pa.array([c.stop - c.start for c in cuts], pa.int32()), pa.array(deltas, pa.binary()), pa.array([packed(counts[c]) for c in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "mass", "entries", "keys", "counts"])

    return each


class Summary:
    """A Misra-Gries summary of keys with counts; ``off`` is what was taken off every count."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.off = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(500_000, self.capacity // 2):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            less = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.off += less
            keys, counts = keys[counts > less], counts[counts > less] - less
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= threshold]


def summarised(threshold: int, bits: int):
    """A task's function: the rows of whole buckets, one bucket after the other, to (bucket, marks): the bucket's part of the bitmap."""
    width = FILTER >> bits

    def marks(bucket: int, rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        summary = Summary(ROOM * sum(mass for mass, *_ in rows) // threshold + 1)
        for _, n, keys, counts in rows:
            summary.add(np.cumsum(unpacked(keys, n), dtype=np.uint32), unpacked(counts, n).astype(np.int64))
        held = np.zeros(width, np.uint8)
        held[summary.survivors(threshold) // np.uint32(2**32 // width)] = 1
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "marks": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []  # a bucket's rows as they came, packed
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, *row = (batch.column(c)[i].as_py() for c in ("bucket", "mass", "entries", "keys", "counts"))
                if bucket != at and rows:
                    yield marks(at, rows)
                    rows = []
                at = bucket
                rows.append(tuple(row))
        if rows:
            yield marks(at, rows)

    return each


def counted(longest: int, bitmap, bits: int):
    """A task's function: batches of (lang, text) to (bucket, lang, entries, size, phrases, counts), a row for a block and bucket of 2**bits.

    ``phrases`` are the block's marked ones in order, a line each, compressed from ``size`` bytes; the empty one (bucket 0) counts all words.
    """

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bitmap.value, np.uint8)
        shift = np.uint64(64 - (FILTER.bit_length() - 1))
        for block in blocks(batches, longest):
            b = Block(*block, longest)
            ids = parts = None
            phrases, hashes, counts = [pa.array([b""], pa.large_binary())], [np.zeros(1, np.uint64)], [np.array([b.own])]
            for k in range(1, longest + 1):
                slot = b.hashes[k - 1] >> shift
                hit = b.there[k - 1] & ((marked[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                if k == 1:
                    ids = b.codes
                else:
                    hit &= parts[: len(hit)] & parts[1 : len(hit) + 1]
                    ids = ids[: len(hit)] * len(b.vocabulary) + b.codes[k - 1 :]
                at = np.flatnonzero(hit)
                _, first, again = np.unique(ids[at], return_index=True, return_inverse=True)
                numbered = np.zeros(len(hit), np.int64)
                numbered[at] = again
                ids, parts = numbered, hit
                n = np.bincount(again[at < b.own], minlength=len(first))
                seen = np.flatnonzero(n)
                starts = at[first[seen]]
                words = [b.vocabulary.take(pa.array(b.codes[starts + j])) for j in range(k)]
                phrases.append(pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())))
                hashes.append(b.hashes[k - 1][starts])
                counts.append(n[seen])
            buckets, n = (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(counts)
            order = pc.sort_indices(pa.table({"bucket": buckets, "phrase": (whole := pa.concat_arrays(phrases))}), [("bucket", "ascending"), ("phrase", "ascending")])
            whole, n = whole.take(order), n[order.to_numpy()]
            edges = np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=2**bits))])
            full = np.flatnonzero(np.diff(edges))
            for some in np.array_split(full, len(full) // 1000 + 1):
                cuts = [slice(edges[i], edges[i + 1]) for i in some]
                lines = [b"\n".join(whole[c].to_numpy(zero_copy_only=False)) + b"\n" for c in cuts]
                columns = [pa.array(some, pa.int32()), pa.repeat(pa.scalar(block[0], pa.string()), len(some)), pa.array([c.stop - c.start for c in cuts], pa.int32()), pa.array([len(x) for x in lines], pa.int64())]
                columns += [pa.array([pa.compress(x, "zstd", asbytes=True) for x in lines], pa.binary()), pa.array([packed(n[c]) for c in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "entries", "size", "phrases", "counts"])

    return each


class Sums:
    """Counts by phrase."""

    def __init__(self) -> None:
        self.waiting: list[pa.Table] = []
        self.size = self.merged = 0

    def add(self, lines: bytes, counts: np.ndarray) -> None:
        raw = np.frombuffer(lines, np.uint8)
        ends = np.flatnonzero(raw == 10)
        offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
        phrases = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10])])
        self.waiting.append(pa.table({"phrase": phrases, "n": counts.astype(np.int64)}))
        self.size += len(ends)
        if self.size > max(500_000, self.merged):
            self.merge()

    def merge(self) -> pa.Table:
        whole = pa.concat_tables(self.waiting).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        whole = pa.table({"phrase": whole["phrase"], "n": whole["n_sum"]})
        self.waiting, self.size, self.merged = [whole], 0, len(whole)
        return whole


def summed(threshold: int):
    """A task's function: the rows of whole buckets, one bucket after the other, to (lang, phrase, words, a) with a >= threshold or words = 0."""

    def known(sums: dict[str, Sums]) -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            whole = own.merge()
            words = np.where(pc.binary_length(whole["phrase"]).to_numpy() == 0, 0, pc.count_substring(whole["phrase"], " ").to_numpy() + 1)
            kept = pa.array((words == 0) | (whole["n"].to_numpy() >= threshold))
            found = pa.table({"phrase": whole["phrase"], "words": words.astype(np.int32), "a": whole["n"]}).filter(kept)
            found = found.add_column(0, "lang", pa.repeat(pa.scalar(lang, pa.string()), len(found)))
            yield from found.cast(pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("a", pa.int64())])).to_batches(50_000)

    @lean
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, lang, n, size, phrases, counts = (batch.column(c)[i].as_py() for c in ("bucket", "lang", "entries", "size", "phrases", "counts"))
                if bucket != at:
                    yield from known(sums)
                    at, sums = bucket, {}
                sums.setdefault(lang, Sums()).add(pa.decompress(phrases, size, "zstd", asbytes=True), unpacked(counts, n))
        yield from known(sums)

    return each


def frequent(texts: DataFrame, longest: int, threshold: int) -> DataFrame:
    """``texts(lang, text binary)`` to the exact (lang, phrase, words, a) with a >= threshold, and words = 0 with all words of a language."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word has seven bytes or so, and a phrase of each length begins at it.
    bits = min(24, max(6, (longest * size // 7 // MASS).bit_length()))
    blocked = texts.mapInArrow(dealt(longest, bits), "bucket int, mass long, entries int, keys binary, counts binary")
    whole = blocked.repartition(2**bits, "bucket").sortWithinPartitions("bucket")
    bitmap = bytearray(FILTER // 8)
    part = (FILTER >> bits) // 8 or 1
    # FILTER bits in all, whatever the input.
    for bucket, marks in whole.mapInArrow(summarised(threshold, bits), "bucket int, marks binary").toLocalIterator():
        at = bucket * (FILTER >> bits)
        if FILTER >> bits >= 8:
            bitmap[at // 8 : at // 8 + part] = marks
        else:
            bitmap[at // 8] |= marks[0] << at % 8
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    counts = texts.mapInArrow(counted(longest, shared, bits), "bucket int, lang string, entries int, size long, phrases binary, counts binary")
    whole = counts.repartition(2**bits, "bucket").sortWithinPartitions("bucket")
    return whole.mapInArrow(summed(threshold), "lang string, phrase binary, words int, a long").withColumn("phrase", F.col("phrase").cast("string"))


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """``docs(lang, text, ...)`` to (lang, rank, phrase, a, l, r, n, score)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    known = spill(frequent(texts, longest, threshold), "phrases")
    totals = known.where("words = 0").select("lang", F.col("a").alias("n"))
    known = known.where("words > 0")
    candidates = known.where("words > 1")

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    lefts, rights = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * aa) div ll")
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumns({"aa": wide("a") * wide("a"), "ll": wide("l") * wide("r")})
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")

    # What each longer candidate holds: its stretches of two words or more.
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(0, words - m), j -> array_join(slice(split(phrase, ' '), j + 1, m), ' '))))")
    held = candidates.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), flat AS (
    SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded
), following AS MATERIALIZED (
    SELECT lang, word AS w1, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM flat WINDOW p AS (PARTITION BY piece ORDER BY i)
), known AS MATERIALIZED (
    -- Parts of a candidate are as frequent as the candidate.
    SELECT lang, w1 AS phrase, 1 AS words, count(*) AS a FROM following GROUP BY ALL HAVING count(*) >= 10
    UNION ALL
    SELECT lang, w1 || ' ' || w2 AS phrase, 2 AS words, count(*) AS a FROM following WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
    UNION ALL
    SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, 3 AS words, count(*) AS a FROM following WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS w FROM known WHERE words > 1
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
    JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
    JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most
    FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE words = 3) GROUP BY ALL
), ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
    WHERE o.most IS NULL OR 100 * o.most < 50 * b.a
), totals AS (
    SELECT lang, count(*) AS n FROM following GROUP BY lang
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
