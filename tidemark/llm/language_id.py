"""Language identification (operator 3): sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-case text fall into ``FEATURES`` hashed places. Document frequencies are counted over
all rows one may learn from, by Spark. The weights are learned by follow-the-regularised-leader with an elastic net
(FTRL-proximal) from at most ``sample`` rows, dealt evenly to the languages by a hash of the id; a fifth of these is held
back to set the temperature that calibrates the probabilities. The driver gets hashed counts, never texts.

Nulls: a null or letterless text is ``und`` with score 0; rows with a null ``lang`` are not learned from; a null ``doc_id``
is only predicted. Ties go to the language first in order. Without rows to learn from all are ``und``. Repeated rows get
equal predictions; an empty table gives an empty result; further columns are ignored (or kept by ``keep_languages``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder
from tidemark.llm.workers import lean

FEATURES = 1 << 15
#: Rows to learn weights from, at most, over all languages.
SAMPLE = 4000


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the n-grams of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    for i in range(0, len(codes), 1 << 18):  # whole text, in parts that overlap by two characters
        part = codes[i : i + (1 << 18) + 2]
        gram, new = np.zeros(len(part), np.uint32), 1 << 18
        for n in (1, 2, 3):
            gram = (gram[: len(part) - n + 1] * np.uint32(0x01000193)) ^ part[n - 1 :] if n <= len(part) else gram[:0]
            total += np.bincount(((gram * np.uint32(0x9E3779B1)) >> np.uint32(17))[:new], minlength=FEATURES)
    places = np.flatnonzero(total)
    return places, total[places]


def has_letter(text: str) -> bool:
    return text[:64].isalpha() or any(map(str.isalpha, text))


class Model:
    """Scores whole texts. ``weights[place, language]``, ``bias``, ``idf`` and ``temperature``."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        self.weights, self.bias = np.zeros((FEATURES, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[places]
        return (x / (np.sqrt(x @ x) or 1)).astype(np.float32)

    def logits(self, places: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[places] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0
        places, counts = counts_of(text)
        p = softmax(self.logits(places, self.vector(places, counts)) / self.temperature)
        return self.languages[int(p.argmax())], float(min(1.0, p.max()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp((z - z.max(-1, keepdims=True)).astype(np.float64))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
    """FTRL-proximal; the last place of z and n is the bias."""
    k = len(model.languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zz) <= l1] = 0
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            places, x, y = rows[i]
            at, x = np.r_[places, FEATURES], np.r_[x, 1.0]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(FEATURES + 1))
    model.weights, model.bias = every[:-1].astype(np.float32), every[-1].astype(np.float32)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least cross entropy on rows that were not learned from, by a search over its logarithm."""
    if not rows:
        return
    logits, y = np.array([model.logits(p, x) for p, x, _ in rows], np.float64), np.array([r[2] for r in rows])

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    a, b = -4.0, 3.0
    for _ in range(40):
        c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` where crc32(doc_id as text) mod 3 is not 1 and text and lang are there."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id") != 1))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(FEATURES))
    share = {c: min(1.0, sample / len(languages) / sizes[c]) for c in languages}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (place, documents with it) for each place of this task, and a row for each sampled document."""
        found = np.zeros(FEATURES, np.int64)
        kinds = {"place": pa.int64(), "n": pa.int64(), "id": pa.int64(), "lang": pa.string(), "places": pa.binary(), "counts": pa.binary()}
        for batch in batches:
            rows = []
            for doc, text, lang, taken in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places, counts = counts_of(text)
                found[places] += 1
                if taken:
                    rows.append((doc, lang, places.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            if rows:
                ids, langs, places, counts = zip(*rows, strict=True)
                nones = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((nones, nones, ids, langs, places, counts), kinds.values(), strict=True)], names=list(kinds))
        places = np.flatnonzero(found)
        nones = [None] * len(places)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((places, found[places], nones, nones, nones, nones), kinds.values(), strict=True)], names=list(kinds))

    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = F.coalesce(F.element_at(F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(share[c]))]), F.col("lang")), F.lit(0.0)) > draw
    parts = known.select(F.col("doc_id").cast("long"), "text", "lang", taken.alias("taken")).mapInArrow(lean(each), "place long, n long, id long, lang string, places binary, counts binary")
    # A row for each place, and the sampled documents, whose number has a bound: one pass over the texts for both.
    key = F.when(F.col("place").isNull(), F.struct("id", "lang", "places", "counts"))
    got = parts.groupBy("place", key.alias("doc")).agg(F.sum("n").alias("n")).toArrow().to_pylist()
    frequency, docs_ = np.zeros(FEATURES), []
    for r in got:
        if r["place"] is not None:
            frequency[r["place"]] = r["n"]
        else:
            docs_.append(r["doc"])
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1
    model = Model(languages, idf)
    docs_.sort(key=lambda r: (r["id"], r["lang"]))
    rows = []
    for r in docs_:
        places, counts = np.frombuffer(r["places"], "<u4"), np.frombuffer(r["counts"], "<u4")
        if len(places):
            rows.append((places.astype(np.int64), model.vector(places, counts), languages.index(r["lang"])))
    held = rows[::5] if len(rows) >= 25 else []
    follow_the_leader(model, [r for i, r in enumerate(rows) if i % 5] if held else rows)
    calibrate(model, held)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, held_out, lang_pred, score)``; the weights are broadcast, with a size that FEATURES bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = (remainder("doc_id") == 1) & F.col("doc_id").isNotNull()
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(lean(each), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less probable than ``least``; one pass, no shuffle."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        return pa.array([(f := shared.value.predict(t))[0] != "und" and f[1] >= least for t in text.to_pylist()], pa.bool_())

    return docs.where(known("text")) if model.languages else docs.limit(0)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
