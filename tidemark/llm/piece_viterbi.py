"""SentencePiece encoding and decoding (operator 8) by a Viterbi search that words with equal beginnings share.

A text gets a space in front, and its spaces are the marks of the vocabulary's pieces. It falls apart before every run of
spaces and around line ends; no piece crosses such a place, so the best segmentation of a text is that of its marked words.
The distinct new words of a batch are sorted, which is a depth-first walk through their trie, and the forward scores of a
prefix are kept on a stack: a word computes only what lies beyond the prefix it shares with the one before.

A piece scores by its rank in the public vocabulary (minus the logarithm of the rank, in 64ths, so sums are exact);
a character without a piece scores less than any piece and becomes its UTF-8 bytes. Of equal scores the one with the longer last
piece wins. Decoding joins the pieces' bytes, so that any text comes back as it was.

Nulls: a null text counts as empty, which has no pieces; a null ``doc_id`` stays null. Repeated rows get equal ids; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tokens import MOST_UNITS, vocabulary
from tidemark.llm.workers import held

_word = re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        #: Pieces and their suffixes: (score or None, id).
        self.ends: dict[str, tuple[float | None, int]] = {}
        pieces, rank = [], 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                piece = piece.replace("▁", " ")
                pieces.append((piece, self.score(rank), i))
                rank += 1
                self.bytes_of.append(piece.encode())
        for piece, _, _ in pieces:
            for k in range(1, len(piece)):
                self.ends[piece[k:]] = (None, -1)
        for piece, score, i in pieces:
            self.ends[piece] = (score, i)
        self.unknown = self.score(rank) - 10.0
        self.known: dict[str, bytes] = {}

    @staticmethod
    def score(rank: int) -> float:
        return -round(64 * math.log(rank + 10)) / 64

    @classmethod
    def of(cls, name: str) -> Pieces:
        return held(f"pieces {name}", lambda: cls(name))

    def learn(self, words: list[str]) -> None:
        """Segment words; sorted, each goes on from the prefix it shares with the one before."""
        ends, unknown, before = self.ends.get, self.unknown, ""
        best, back = [0.0], [(0, -1)]  # by prefix length: score; where its last piece begins and the piece's id
        for word in sorted(words):
            keep, most = 0, min(len(word), len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], back[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                top, step = best[i - 1] + unknown, (i - 1, -1)
                for j in range(i - 1, -1, -1):
                    found = ends(word[j:i])
                    if found is None:
                        break
                    if found[0] is not None and (score := best[j] + found[0]) >= top:
                        top, step = score, (j, found[1])
                best.append(top)
                back.append(step)
            ids, i = [], len(word)
            while i:
                j, piece = back[i]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.byte_ids[b] for b in reversed(word[j:i].encode("utf-8", "surrogatepass"))]
                i = j
            self.known[word] = array("I", reversed(ids)).tobytes()
            before = word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        words = [_word.findall(" " + t) if t else [] for t in texts]
        wanted = set().union(*words)
        if len(self.known) + len(wanted) > MOST_UNITS:
            self.known = {w: self.known[w] for w in wanted if w in self.known}
        self.learn([w for w in wanted if w not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, ids)``: binary, 32 bits an id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pieces.encode(part.column(1).to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, text)``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [pieces.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Encode, decode and describe both: ``(doc_id, n_pieces, ids_crc32, text_sha256, exact)``; ``text_sha256`` is of the decoded text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        names = ["doc_id", "n_pieces", "ids_crc32", "text_sha256", "exact"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(1).to_pylist()
                encoded = pieces.encode(texts)
                decoded = [pieces.decode(x) for x in encoded]
                columns = [
                    pa.array([len(x) // 4 for x in encoded], pa.int64()),
                    pa.array(map(zlib.crc32, encoded), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a == (b or "") for a, b in zip(decoded, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, exact boolean")


def op8_piece_viterbi(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
