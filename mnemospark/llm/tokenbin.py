"""Token ids in containers of separately compressed documents with a shared dictionary.

A zstandard dictionary is trained once on serialized id arrays of a bounded sample. Each
document is one frame, so a short document is read by its index entry alone. Container:

    magic "MNTOKZ01" | SHA-256 of the dictionary | n, ids before (u64 each)
    n x document id (i64) | n x id is null (u8) | n x number of ids (u32)
    n + 1 x frame offset (u64) | frames

Containers hold documents in ascending id order (null ids first). Spark's writer commits
them, one in a row, so a lost executor leaves no half-written file; `export` writes
them as plain files where a shared file system is mounted.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mnemospark.llm.common import fresh_path, slices
from mnemospark.llm.tokens import encoder

MAGIC = b"MNTOKZ01"
LEVEL = 3
DICTIONARY_BYTES = 65_536
#: Bounds of the sample that the dictionary is trained on; ids do not depend on it.
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 8_192
CONTAINER_BYTES = 4 << 20
DOCS_PER_PART = 4_096
MOST_PARTS = 20_000
#: Chunks of text that a Python worker remembers while it encodes.
CHUNKS = 600_000


@dataclass(frozen=True)
class Dictionary:
    """A trained dictionary; without enough samples to train one its data is empty and frames use none."""

    data: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.data).digest()

    def compressor(self) -> zstandard.ZstdCompressor:
        if not self.data:
            return zstandard.ZstdCompressor(level=LEVEL)
        shared = zstandard.ZstdCompressionDict(self.data)
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.data)) if self.data else zstandard.ZstdDecompressor()


def train(samples: list[bytes]) -> Dictionary:
    """A dictionary of DICTIONARY_BYTES at most; empty if the samples are too few or too small."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return Dictionary(b"")
    try:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10))
        return Dictionary(zstandard.train_dictionary(size, samples).as_bytes())
    except zstandard.ZstdError:
        return Dictionary(b"")


def container(digest: bytes, before: int, doc_ids: list[int | None], sizes: list[int], frames: list[bytes]) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    return b"".join([
        MAGIC, digest, struct.pack("<QQ", len(frames), before),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array(sizes, dtype="<u4").tobytes(), offsets.tobytes(), *frames,
    ])


class Reader:
    """Random access to the documents of one container."""

    def __init__(self, data: bytes, dictionary: Dictionary) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token container")
        if data[8:40] != dictionary.digest:
            raise ValueError("the container was written with another dictionary")
        n, self.before = struct.unpack_from("<QQ", data, 40)
        at = 56
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.sizes = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self._body, self._data, self._zstd = at + 13 * n + 8 * (n + 1), memoryview(data), dictionary.decompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def raw(self, i: int) -> bytes:
        """The i-th document's ids as little-endian unsigned 32-bit numbers."""
        lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
        return self._zstd.decompress(self._data[self._body + lo : self._body + hi], max_output_size=4 * int(self.sizes[i]))

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with an id."""
        return np.flatnonzero((self.doc_ids == doc_id) & ~self.null).tolist()


def train_on(docs: DataFrame, tokenizer: str, text_col: str, rows: int, end_id: int) -> Dictionary:
    """A dictionary from at most SAMPLE_DOCS documents chosen by a hash of their text over all rows, SAMPLE_BYTES of ids each."""
    share = min(1.0, 1.5 * SAMPLE_DOCS / max(rows, 1))
    tail = int(end_id).to_bytes(4, "little")
    drawn = F.xxhash64("text", F.lit(17))
    picked = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.pmod(drawn, F.lit(1 << 40)) < int(share * (1 << 40)))
    picked = picked.orderBy(drawn, "text").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([(raw + tail)[:SAMPLE_BYTES] for raw in encoder(tokenizer, CHUNKS).encode(texts)], pa.binary())], names=["ids"])

    return train([bytes(r[0]) for r in picked.mapInArrow(run, "ids binary").collect()])


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> Dictionary:
    """Writes all documents under path and returns the dictionary, which is stored there too.

    Rows of path/containers: part, number, first_id, tokens, data. Parts are ascending ranges of ids; a single id
    with more rows than a part is spread over several. The format holds ids as 64-bit integers; other ids are refused.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column: the containers hold 64-bit ids")
    spark = docs.sparkSession
    rows = docs.count()
    dictionary = train_on(docs, tokenizer, text_col, rows, end_id)
    spark.createDataFrame([(dictionary.digest.hex(), bytearray(dictionary.data))], "digest string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(min(MOST_PARTS, max(1, rows // DOCS_PER_PART)))
    cuts = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), cuts, 100_000)).first()[0] if cuts else None
    bounds = np.array(found or [], dtype=np.int64)
    tail = int(end_id).to_bytes(4, "little")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, zstd = encoder(tokenizer, CHUNKS).encode, dictionary.compressor()
        rng = np.random.default_rng(5)
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                raw = [x + tail for x in encode(texts)]
                known = ids.fill_null(0).to_numpy(zero_copy_only=False)
                left, right = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
                part = np.where(right - left > 1, left + rng.integers(0, np.maximum(right - left, 1)) + 1, left)
                part = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, part).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), ids, pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zstd.compress(x) for x in raw], pa.binary())], names=["part", "doc", "n", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now, held, size, number, before = dictionary.digest, None, [], 0, 0, 0

        def emit() -> pa.RecordBatch:
            ids, sizes, frames = zip(*held, strict=True)
            data = container(digest, before, list(ids), list(sizes), list(frames))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([number], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([data], pa.binary())], names=["part", "number", "first_id", "tokens", "data"])

        for batch in batches:
            for part, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (part != now or size >= CONTAINER_BYTES):
                    yield emit()
                    before, number = before + sum(x[1] for x in held), number + 1
                    held, size = [], 0
                if part != now:
                    now, number, before = part, 0, 0
                held.append(row)
                size += len(row[2])
        if held:
            yield emit()

    frames = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(compress, "part int, doc bigint, n bigint, frame binary")
    dealt = frames.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc").asc_nulls_first())
    dealt.mapInArrow(gather, "part int, number int, first_id bigint, tokens bigint, data binary").write.option("compression", "none").parquet(f"{path}/containers")
    return dictionary


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary(bytes(spark.read.parquet(f"{path}/dictionary").first()["data"]))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document under path, from its containers.

    start counts the ids of all documents before it in the order of the files.
    """
    import zlib

    dictionary = load_dictionary(spark, path)
    files = spark.read.schema("part int, number int, first_id bigint, tokens bigint, data binary").parquet(f"{path}/containers")
    totals = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # at most MOST_PARTS rows
    base, total = {}, 0
    for row in totals:
        base[row.part] = total
        total += row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = Reader(data, dictionary)
                raw = [one.raw(i) for i in range(len(one))]
                n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                start = base[part] + one.before + np.cumsum(n) - n
                columns = [pa.array(one.doc_ids, mask=one.null), pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return files.select("part", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each container as folder/part-number.tok on a file system that all executors mount; returns the names."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for part, number, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names.append(f"{part:06d}-{number:06d}.tok")
                with open(f"{folder}/.{names[-1]}.{os.getpid()}", "wb") as out:
                    out.write(data)
                os.replace(out.name, f"{folder}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["file"])

    return spark.read.parquet(f"{path}/containers").select("part", "number", "data").mapInArrow(run, "file string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes docs to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty and is end_id alone. Null ids come first; rows with equal ids follow each other
    in any order. An empty table gives an empty one. Other columns are not read. Ids that are not integers raise
    ValueError.
    """
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, id_col, text_col, end_id)
    return read(docs.sparkSession, path)
