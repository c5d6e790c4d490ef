"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row p of the matrix says how many rows of input partition p go to each shard. Rows and
columns have fixed sums, so the whole matrix is multivariate hypergeometric; a binary
tree over the partitions lets any task draw its own row from seeded draws along one
path. Each partition permutes its rows, deals them out by its row of the matrix, and
each shard permutes what it received.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, lgamma, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import fresh_path, make_room, spare

#: Rows whose order inside a shard is settled by one task, about.
CELL_ROWS = 4096
#: numpy's hypergeometric sampler ends here; the same law is then drawn by large_draw.
NUMPY_TOTAL = 1_000_000_000
#: Rows of one partition of the last permutation, about.
PART_ROWS = 8_192
MOST_PARTS = 100_000


def _rest(n: int) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability by the saddle point, accurate for any size."""
    if x in (0, n):
        return n * (log1p(-p) if x == 0 else log(p)) if n else 0.0
    main = _rest(n) - _rest(x) - _rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return main + 0.5 * (log(n) - log(2 * pi) - log(x) - log(n - x))


def log_pmf(k: int, good: int, bad: int, take: int) -> float:
    """log of the hypergeometric probability of k good ones among `take`."""
    p = take / (good + bad)
    if p >= 1:
        return 0.0
    return _log_binomial(k, good, p) + _log_binomial(take - k, bad, p) - _log_binomial(take, good + bad, p)


def large_draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """A hypergeometric draw for totals of any size, by the ratio of uniforms."""
    low, high, total = max(0, take - bad), min(good, take), good + bad
    if low == high:
        return low
    mean = take * (good / total)
    width = 2 * sqrt(2 / np.e) * sqrt(mean * (bad / total) * ((total - take) / (total - 1)) + 0.5) + 3 - 2 * sqrt(3 / np.e)
    mode = min(max(floor((take + 1) * (good + 1) / (total + 2)), low), high)
    top = log_pmf(mode, good, bad, take)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= log_pmf(k, good, bad, take) - top:
            return k


def draw(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """A multivariate hypergeometric draw of `take` from `left`, by one draw for each shard."""
    out, rest = np.zeros(len(left), dtype=np.int64), int(left.sum())
    for j, good in enumerate(left.tolist()):
        rest -= good
        if good + rest < NUMPY_TOTAL:
            out[j] = rng.hypergeometric(good, rest, take) if good + rest else 0
        else:
            out[j] = large_draw(rng, good, rest, take)
        take -= int(out[j])
    return out


def even_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards get the rows left over."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix for partitions of `counts` rows and shards of `sizes` rows."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, left = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = draw(rng, left, int(before[mid] - before[lo]))
        if part < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def shard(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """docs plus `shard` (0 to shards - 1) and `slot` (0, 1, ... inside the shard), uniformly shuffled.

    Shard sizes are at most one row apart. The rows are written once to the shared folder, so that each has a
    fixed partition and place; nulls and repeated rows are rows like any other, and an empty table gives an empty
    one. Columns of docs named shard or slot (in any case) are renamed with leading underscores.
    """
    spark = docs.sparkSession
    docs = make_room(docs, "shard", "slot")
    place, columns = spare(docs, "place"), docs.columns
    path = fresh_path(spark, "placed")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part, row = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.groupBy(part.alias("part")).agg((F.max(row) + 1).alias("n")).orderBy("part").collect()
    parts, counts = np.array([r.part for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=np.int64)
    sizes = even_sizes(int(counts.sum()), shards)

    def dealt(index: int) -> np.ndarray:
        to = matrix_row(counts, sizes, index, seed)
        order = np.random.default_rng([seed, 1, index]).permutation(int(counts[index]))
        out = np.empty(int(counts[index]), dtype=np.int32)
        out[order] = np.repeat(np.arange(shards, dtype=np.int32), to)
        return out

    @F.pandas_udf("int")
    def to_shard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready: dict[int, np.ndarray] = {}
        for places in batches:
            values = places.to_numpy()
            index, at = np.searchsorted(parts, values >> 33), values & ((1 << 33) - 1)
            out = np.empty(len(values), dtype=np.int32)
            for i in np.unique(index).tolist():
                if i not in ready:
                    if len(ready) >= 16:
                        ready.clear()
                    ready[i] = dealt(i)
                here = index == i
                out[here] = ready[i][at[here]]
            yield pd.Series(out)

    total = int(counts.sum())
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    draw_of = F.xxhash64(F.lit(seed), F.lit("order"), F.col(place))
    rows = placed.withColumn("shard", to_shard(F.col(place)))
    slim = placed.select(place).withColumn("shard", to_shard(F.col(place)))
    cell = F.pmod(draw_of, F.lit(cells)).cast("int")
    sizes_of = slim.groupBy("shard", cell.alias("cell")).agg(F.count("*").alias("n"))
    starts = sizes_of.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    one, shard_of, cell_of, start = (spare(docs, name) for name in ("cell", "shard_of", "cell_of", "start"))
    parts_out = int(min(MOST_PARTS, max(1, -(-total // PART_ROWS))))
    rows = rows.withColumn(one, cell).repartition(parts_out, "shard", one)
    rank = F.row_number().over(Window.partitionBy("shard", one).orderBy(draw_of, place)) - 1
    rows = rows.withColumn("slot", rank.cast("long"))
    starts = starts.select(F.col("shard").alias(shard_of), F.col("cell").alias(cell_of), F.col("start").alias(start))
    joined = rows.join(starts, (F.col("shard") == F.col(shard_of)) & (F.col(one) == F.col(cell_of)))
    return joined.select(*[F.col(f"`{c}`") for c in columns], "shard", (F.col("slot") + F.col(start)).alias("slot"))
