"""Shared folder, written tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
#: Text handled at once inside a Python worker, in bytes of UTF-8.
SLICE_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without one; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='mnemospark-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so its lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run inside hand at most `rows` rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spare(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores until no column of df clashes with it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """df with its columns that are named like one of names (Spark ignores case) renamed by leading underscores."""
    for name in names:
        for c in df.columns:
            if c.lower() == name.lower():
                df = df.withColumnRenamed(c, spare(df, c))
    return df


def trim() -> None:
    """Gives memory that this Python process has freed back to the system; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Consecutive runs of texts with about `most` bytes each: their bounds, and the texts as Python strings."""
    start = size = 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += length
        if size >= most:
            yield start, i + 1, texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts), texts.slice(start).to_pylist()


def map_text(df: DataFrame, text: str, work: Callable[[list[str | None]], list[pa.Array]], fields: list[tuple[str, pa.DataType]], schema: str, keep: list[str]) -> DataFrame:
    """keep plus what work computes for each text (one array per field), batch by batch."""
    kept = [c for c in keep if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(len(kept))):
                part = batch.slice(lo, hi - lo)
                columns = [part.column(i) for i in range(len(kept) + (text in keep))]
                names = [*kept, *([text] if text in keep else [])]
                made = work(texts)
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *(n for n, _ in fields)])

    out = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*kept, *([text] if text in keep else [])]), schema])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, out)


def unsigned_crc32(column: Column) -> Column:
    """CRC-32 of a string's UTF-8 or of a binary, as an unsigned number in a long."""
    return F.crc32(column)
