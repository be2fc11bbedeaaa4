"""Token-ID files (operator 1): ids in ascending ``doc_id`` order, coded by ``range_coder`` in independent blocks.

``write_ids`` sorts documents into ranges of ``doc_id``, and each task encodes its range and writes one file. The file:
magic, blocks (each with its own model, sizes and crc32), then a directory of the blocks' places and of every document's
id and number of ids, then the directory's place. A task names its file by attempt and the driver lists the files of
the attempts that counted, one short row a file; files of lost attempts are never read.

``read_ids`` deals the listed files to tasks, decodes block by block with one block in memory, checks every crc32 and
gives each document's numbers, or its ids.

Nulls: a null text has the end id only; a null ``doc_id`` sorts first and stays null. Repeated rows are written each, in
any order among themselves. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import new_path
from tidemark.llm.files import reading, writing
from tidemark.llm.range_coder import BLOCK, decode_block, encode_block
from tidemark.llm.tokens import Encoder

MAGIC = b"TIDEIDS1"
TAIL = struct.Struct("<QQQ")  # where the directory is, its length, its crc32
END = (2).to_bytes(4, "little")
NULL_ID = -(1 << 63)
#: Pieces of texts a worker holds the ids of: 350 MB at most, as a worker has little else to hold here.
UNITS = 1_000_000


class Writer:
    """Ids come document by document; each full block is coded and written at once."""

    def __init__(self, out):
        self.out, self.at = out, out.write(MAGIC)
        self.waiting, self.size = [], 0
        self.blocks: list[int] = []
        self.docs: list[int] = []
        self.counts: list[int] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc is None else doc)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 4 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, stop, BLOCK):
            self.blocks.append(self.at)
            self.at += self.out.write(encode_block(ids[i : min(i + BLOCK, stop)]))
        self.waiting = [ids[stop:].tobytes()]
        self.size = len(self.waiting[0])

    def close(self) -> None:
        if self.size:
            self._flush(True)
        parts = [np.array(x, "<i8").tobytes() for x in (self.blocks, self.docs, self.counts)]
        body = struct.pack("<QQ", len(self.blocks), len(self.docs)) + zlib.compress(b"".join(parts), 1)
        self.out.write(body)
        self.out.write(TAIL.pack(self.at, len(body), zlib.crc32(body)))


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of an open file, block by block."""
    source.seek(source.size() - TAIL.size)
    at, size, crc = TAIL.unpack(source.read(TAIL.size))
    source.seek(at)
    body = source.read(size)
    if zlib.crc32(body) != crc:
        raise ValueError("damaged directory")
    blocks, docs = struct.unpack_from("<QQ", body)
    numbers = np.frombuffer(zlib.decompress(body[16:]), "<i8")
    starts, ids_of, counts = np.split(numbers, [blocks, blocks + docs])
    stops, k, have = [*starts[1:].tolist(), at], 0, np.zeros(0, np.uint32)
    for doc, n in zip(ids_of.tolist(), counts.tolist(), strict=True):
        parts, need = [], n
        while need > len(have):
            parts.append(have)
            need -= len(have)
            source.seek(int(starts[k]))
            have, _ = decode_block(source.read(stops[k] - int(starts[k])))
            k += 1
        parts.append(have[:need])
        have = have[need:]
        yield (None if doc == NULL_ID else doc), np.concatenate(parts)


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json") -> list[tuple[int, str, int]]:
    """Write ``docs(doc_id, text, ...)``; ``(first ids before it, file, documents)`` of each file, in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        encoder, task = Encoder.of(tokenizer, UNITS), TaskContext.get()
        uri = f"{folder}/{task.partitionId():06d}-{uuid.uuid4().hex}.ids"
        with writing(uri) as out:
            writer, batch = Writer(out), first
            while batch is not None:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                        writer.add(doc, ids + END)
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [uri], "ids": [sum(writer.counts)], "docs": [len(writer.docs)]})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(each, "part long, file string, ids long, docs long").collect()  # one short row a file
    files, before = [], 0
    for row in sorted(made):
        files.append((before, row["file"], row["docs"]))
        before += row["ids"]
    return files


def read_ids(spark: SparkSession, files: list[tuple[int, str, int]], with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files, read back from them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for start, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with reading(uri) as source:
                    for doc, ids in read_file(source):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc, start, len(ids), zlib.crc32(raw), *([raw] if with_ids else [])))
                        start += len(ids)
                        if len(rows) >= 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files, "start long, file string, docs long")
    # One file a task: the sort by number spreads them evenly.
    dealt = listed.repartitionByRange(len(files), "start") if len(files) > 1 else listed
    return dealt.mapInArrow(each, schema)


def op1_token_id_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(spark, write_ids(docs, new_path(spark, "ids")))
