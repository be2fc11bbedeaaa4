"""Media columns (operator 5): a Spark data source over archives of media members.

``df.write.format("tide_media")`` stores each row's payload as a grey PNG image of 8-bit samples, 64 to a row, in archives,
one a task. An archive is a run of segments, members' bytes followed by a directory of their offsets, lengths and crc32,
and a footer with one short entry a segment. A commit lists the archives that count; what lost attempts left is never read.

``spark.read.format("tide_media")`` plans on the listing and the footers alone, never on members: a partition is a byte
range of whole segments of about ``SPLIT`` bytes. A task reads the directories in its range and then each member by its
offset; a member that fails to read, or fails its crc32, is tried again by itself, with a fresh handle, and an archive is
never read anew for it. Members stream to Spark in Arrow batches of bounded size.

Nulls: a null text is the empty text, whose payload is 64 zero bytes; a null ``doc_id`` stays null. Equal texts get equal
media, whatever else the row holds, repeated rows are stored each, an empty table gives an empty result, and further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.llm.common import new_path
from tidemark.llm.files import place, reading, writing

SCHEMA = "doc_id long, n_bytes long, media binary"
MAGIC, TAIL = b"TIDEMED1", struct.Struct("<QQI")
#: Members' bytes of a segment and of a partition, about; rows and bytes of an Arrow batch, at most but for one member.
SEGMENT, SPLIT, ROWS, BATCH = 1 << 21, 8 << 20, 1000, 4 << 20
TRIES = 3
NULL_ID = -(1 << 63)
WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the bytes before these."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    grid = np.zeros((rows, WIDTH + 1), np.uint8)  # the first byte of each row: no filter
    grid[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of a grey 8-bit PNG whose rows have no filter."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG")
    at, rows, packed = 8, 0, []
    while at < len(png):
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            _, rows = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, WIDTH + 1)[:, 1:].tobytes()


class ArchiveWriter:
    def __init__(self, out):
        self.out, self.at = out, out.write(MAGIC)
        self.members: list[tuple[int, int, int, int, int]] = []
        self.segments: list[tuple[int, int, int, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, n_bytes: int, media: bytes) -> None:
        self.members.append((NULL_ID if doc_id is None else doc_id, n_bytes, self.at, len(media), zlib.crc32(media)))
        self.at += self.out.write(media)
        self.held += len(media)
        if self.held >= SEGMENT:
            self._end()

    def _end(self) -> None:
        if self.members:
            directory = np.array(self.members, "<i8").tobytes()
            self.segments.append((self.at, len(directory), self.held, zlib.crc32(directory)))
            self.at += self.out.write(directory)
            self.members, self.held = [], 0

    def close(self) -> None:
        self._end()
        footer = np.array(self.segments, "<i8").tobytes()
        self.out.write(footer + TAIL.pack(self.at, len(footer), zlib.crc32(footer)))


def segments_of(source) -> np.ndarray:
    """Rows (place of the directory, its length, bytes of the members, crc32 of the directory) of an open archive's footer."""
    source.seek(source.size() - TAIL.size)
    at, size, crc = TAIL.unpack(source.read(TAIL.size))
    source.seek(at)
    footer = source.read(size)
    if zlib.crc32(footer) != crc:
        raise OSError("damaged footer")
    return np.frombuffer(footer, "<i8").reshape(-1, 4)


def read_at(uri: str, offset: int, size: int, crc: int, handle: list) -> bytes:
    """``size`` bytes at ``offset``; a failure opens the archive again and reads this one range again."""
    for attempt in range(TRIES):
        try:
            if not handle:
                system, path = place(uri)
                handle.append(system.open_input_file(path))
            handle[0].seek(offset)
            data = handle[0].read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError(f"{uri}: bytes {offset} to {offset + size} are damaged")
            return data
        except OSError:
            handle.clear()
            if attempt == TRIES - 1:
                raise
    raise AssertionError


@dataclass
class Range(InputPartition):
    uri: str
    segments: list[tuple[int, int, int]]


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        with reading(f"{self.folder}/_committed.json") as source:
            files = json.loads(source.read())
        out = []
        for file in files:
            uri = f"{self.folder}/{file}"
            with reading(uri) as source:
                found = segments_of(source)
            some, size = [], 0
            for at, length, held, crc in found.tolist():
                some.append((at, length, crc))
                size += held
                if size >= SPLIT:
                    out.append(Range(uri, some))
                    some, size = [], 0
            if some:
                out.append(Range(uri, some))
        return out or [Range("", [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        handle: list = []
        for at, length, crc in partition.segments:
            members = np.frombuffer(read_at(partition.uri, at, length, crc, handle), "<i8").reshape(-1, 5).tolist()
            rows, size = [], 0
            for doc_id, n_bytes, offset, length_, crc_ in members:
                rows.append((None if doc_id == NULL_ID else doc_id, n_bytes, read_at(partition.uri, offset, length_, crc_, handle)))
                size += length_
                if len(rows) >= ROWS or size >= BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


class Writer(DataSourceArrowWriter):
    """Rows (doc_id, text)."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file = f"{uuid.uuid4().hex}.media"
        with writing(f"{self.folder}/{file}") as out:
            archive = ArchiveWriter(out)
            for batch in iterator:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    payload, n_bytes = payload_of(text.as_py())
                    archive.add(doc_id.as_py(), n_bytes, to_png(payload))
            archive.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        with writing(f"{self.folder}/_committed.json") as out:
            out.write(json.dumps(sorted(m.file for m in messages if m and m.file)).encode())

    def abort(self, messages) -> None:
        """Nothing reads what is not listed."""


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tide_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Store the texts of ``docs(doc_id, text, ...)`` and give the column of media read from the archives."""
    spark = docs.sparkSession
    register(spark)
    docs.selectExpr("cast(doc_id as long) doc_id", "text").write.format("tide_media").mode("append").save(folder)
    return spark.read.format("tide_media").load(folder)


def feature_of(payload: bytes) -> str:
    """An average hash: which of 64 runs of samples are brighter than all samples on average; then mean and deviation."""
    samples = np.frombuffer(payload, np.uint8)
    runs = samples.reshape(64, -1).sum(1, dtype=np.int64) if len(samples) % 64 == 0 else samples[:64]
    bits = np.packbits(runs * 64 > runs.sum()).tobytes().hex()
    return f"{bits}:{samples.mean():.3f}:{samples.std():.3f}"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                png = png.as_py()
                payload = from_png(png)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.mapInArrow(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(store(docs, new_path(spark, "media")))
