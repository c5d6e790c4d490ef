"""Learning and logging as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.config import MemoryConfig
from mnemospark.operators.writes import Codebook, Gate

STATE = "next_id bigint, eta double, ids array<bigint>, address array<array<double>>, counter array<array<double>>, counts array<double>, mass array<double>, neighbors array<array<bigint>>"
OUT = "collection string, seq bigint, posted array<bigint>, n_locations bigint, eta double"


def _loaded(state: GroupState, config: MemoryConfig, name: str) -> Codebook:
    book = Codebook(config, name)
    if not state.exists:
        book.seed()
        return book
    next_id, book_eta, ids, address, counter, counts, mass, neighbors = state.get
    for i, a, c, n, m, near in zip(ids, address, counter, counts, mass, neighbors, strict=True):
        book._append(np.array(a), np.array(c), float(n), [int(x) for x in near], float(m), int(i))
    book.next_id, book.eta = int(next_id), float(book_eta)
    return book


def learn_stream(writes: DataFrame, config: MemoryConfig, gate: Gate | None = None) -> DataFrame:
    """Learns a stream (collection, seq, vector); keyed state holds each collection's codebook.

    One row per write: the locations that it is posted under, and the state's size and rate after it. Within a
    micro-batch writes are learned in seq order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = _loaded(state, config, str(key[0]))
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            posted = book.write(np.array(r.vector, dtype=np.float64), None, gate)
            out.append((key[0], int(r.seq), posted, book.size, book.eta))
        n = book.size
        state.update((book.next_id, book.eta, book.ids[:n].tolist(), book.address[:n].tolist(), book.counter[:n].tolist(), book.count[:n].tolist(), book.mass[:n].tolist(), [list(map(int, x)) for x in book.neighbors]))
        yield pd.DataFrame(out, columns=["collection", "seq", "posted", "n_locations", "eta"])

    return writes.select("collection", F.col("seq").cast("long").alias("seq"), "vector").groupBy("collection").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def audit_sink(log: DataFrame, path: str, checkpoint: str, every: str = "2 seconds"):  # noqa: ANN201
    """Appends a stream of log records to files; flushed at fixed times."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def activity_stream(log: DataFrame, ts: str = "ts", late: str = "10 minutes", gap: str = "60 seconds") -> DataFrame:
    """Sessions of activity over event time; records later than `late` are left out."""
    return log.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def running_mean(vectors: DataFrame, value: str = "vector") -> DataFrame:
    """(at, mean): the mean of a vector stream by position, in complete mode."""
    return vectors.select(F.posexplode(value).alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"))
