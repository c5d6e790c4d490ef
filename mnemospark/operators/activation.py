"""Activation: the exact k nearest locations of every query.

A codebook is a DataFrame with loc_id, address, counter and write_count. Queries are rows
(qid, query). Similarity is the dot product of the normalised query with the address as
it is stored; ties go to the smaller loc_id. The `matmul` strategy sends a bounded block
of queries to every partition of the codebook, multiplies matrices there and keeps each
partition's best k per query, so only those cross the network; `sql` says the same as a
join with the queries and a ranking, inside arrays of locations first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import vec

#: Queries that one block holds; a block is the only thing that is broadcast.
QUERY_BLOCK = 4_096
#: Queries that one block holds where locations are barred by query.
BARRED_BLOCK = 1_024
#: Locations that the sql strategy ranks inside one row.
SQL_BLOCK = 512
#: Rows of a batch that a task returns.
OUT_ROWS = 4_096
#: Similarities that a task holds at once.
SIM_BLOCK = 4_000_000
LOCATION = "loc_id bigint, address array<double>, counter array<double>, write_count double"
ACTIVATED = f"qid bigint, query array<double>, {LOCATION}, sim double"
NEAR = "qid bigint, loc_id bigint, sim double"


def codebook(df: DataFrame, ident: str = "vec_id", value: str = "embedding", precision: str = "f64") -> DataFrame:
    """A codebook of plain locations: address = counter = the vector, written once."""
    v = vec.cast(value, precision)
    return df.select(F.col(ident).cast("long").alias("loc_id"), v.alias("address"), v.alias("counter"), F.lit(1.0).alias("write_count"))


def queries_of(df: DataFrame, ident: str = "vec_id", value: str = "embedding") -> DataFrame:
    return df.select(F.col(ident).cast("long").alias("qid"), vec.cast(value).alias("query"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("loc_id"))
    return rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def query_parts(queries: DataFrame, block: int) -> list[Column]:
    """Conditions on qid that deal the queries into blocks of about `block` rows."""
    count = max(1, -(-queries.count() // block))
    return [F.pmod(F.xxhash64("qid"), F.lit(count)) == i if count > 1 else F.lit(True) for i in range(count)]


def query_blocks(queries: DataFrame, parts: list[Column]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, Column]]:
    """Queries in blocks: ids, matrix, excluded loc_ids where the queries name one, and the condition of the block."""
    exclude = "exclude" in queries.columns
    for inside in parts:
        found = queries.where(inside).select("qid", "query", *(["exclude"] if exclude else [])).toArrow().combine_chunks()
        if found.num_rows:
            bar = pc.fill_null(found.column("exclude"), -1).to_numpy().astype(np.int64) if exclude else None
            matrix = found.column("query").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
            yield found.column("qid").to_numpy().astype(np.int64), matrix.astype(np.float64), bar, inside


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n < vec.TINY, m, m / np.where(n < vec.TINY, 1.0, n))


def activate(queries: DataFrame, locations: DataFrame, k: int = 20, strategy: str = "matmul", cosine: bool = False, block: int = QUERY_BLOCK, barred: DataFrame | None = None) -> DataFrame:
    """(qid, query, location columns, sim, rk): the k nearest locations of each query.

    A column `exclude` of the queries bars that loc_id, a row (qid, loc_id) of `barred` that pair. cosine divides by the
    address's length as well.
    """
    if strategy == "sql":
        return ranked(_sql_top(queries, locations.select(*LOCATION_COLUMNS), k, cosine, block, barred), k)
    return ranked(_top(queries, locations, k, cosine, block, barred), k)


def nearest(queries: DataFrame, locations: DataFrame, k: int = 20, strategy: str = "matmul", cosine: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, loc_id, sim, rk): activate without the vectors, which then never leave the tasks that read them."""
    if strategy == "sql":
        return activate(queries, locations, k, strategy, cosine, block).select("qid", "loc_id", "sim", "rk")
    return ranked(_top(queries, locations, k, cosine, block, None, narrow=True), k)


def _barring(book: DataFrame, barred: DataFrame | None, inside: Column) -> DataFrame:
    """The codebook plus `bars`, the queries inside a block that each location is barred from (null: none)."""
    if barred is None:
        return book
    bars = barred.where(inside).groupBy("loc_id").agg(F.collect_set(F.col("qid").cast("long")).alias("bars"))
    return book.join(bars, "loc_id", "left").select(*book.columns, "bars")


def _top(queries: DataFrame, locations: DataFrame, k: int, cosine: bool, block: int, barred: DataFrame | None, narrow: bool = False) -> DataFrame:
    book, out = locations.select(*(LOCATION_COLUMNS[:2] if narrow else LOCATION_COLUMNS)), None
    parts = query_parts(queries, block if barred is None else min(block, BARRED_BLOCK))
    if len(parts) > 1 and barred is None:  # every task returns its best k: no more tasks than keep all cores busy
        book = book.coalesce(-(-4 * book.sparkSession.sparkContext.defaultParallelism // len(parts)))
    for qid, matrix, bar, inside in query_blocks(queries, parts):
        part = _block_top(_barring(book, barred, inside), qid, matrix, bar, k, cosine, narrow)
        out = part if out is None else out.unionByName(part)
    return queries.sparkSession.createDataFrame([], NEAR if narrow else ACTIVATED) if out is None else out


def _sql_top(queries: DataFrame, book: DataFrame, k: int, cosine: bool, block: int, barred: DataFrame | None) -> DataFrame:
    """The best k of each query inside each array of locations. Queries are broadcast in blocks, the codebook never is."""
    count = max(1, -(-book.count() // SQL_BLOCK))
    exclude, out = "exclude" in queries.columns, None
    for inside in query_parts(queries, block if barred is None else min(block, BARRED_BLOCK)):
        asked = queries.where(inside).select("qid", "query", *(["exclude"] if exclude else []), vec.normalize("query").alias("unit"))
        rows = _barring(book, barred, inside)
        rows = rows.groupBy(F.pmod(F.xxhash64("loc_id"), F.lit(count)).alias("b")).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows"))
        allowed = lambda r: F.lit(True) if barred is None else r.bars.isNull() | ~F.array_contains(r.bars, F.col("qid"))
        if exclude:
            allowed = lambda r, also=allowed: also(r) & (F.col("exclude").isNull() | (F.col("exclude") != r.loc_id))
        sim = lambda r: vec.cosine("query", r.address) if cosine else vec.dot("unit", r.address)
        each = F.transform("rows", lambda r, i: F.when(allowed(r), F.struct((-sim(r)).alias("less"), r.loc_id.alias("id"), i.alias("at"))))
        best = F.slice(F.sort_array(F.filter(each, lambda x: x.isNotNull())), 1, k)
        whole = F.transform(best, lambda x: F.struct(F.element_at("rows", x["at"] + 1).alias("r"), (-x["less"]).alias("sim")))
        part = rows.crossJoin(F.broadcast(asked)).select("qid", "query", F.explode(whole).alias("x"))
        part = part.select("qid", "query", *[F.col(f"x.r.{c}").alias(c) for c in LOCATION_COLUMNS], "x.sim")
        out = part if out is None else out.unionByName(part)
    return out


LOCATION_COLUMNS = ("loc_id", "address", "counter", "write_count")


def _block_top(book: DataFrame, qid: np.ndarray, matrix: np.ndarray, bar: np.ndarray | None, k: int, cosine: bool, narrow: bool) -> DataFrame:
    """Each task's best k locations of every query; of the narrow form, their ids only."""
    shared = book.sparkSession.sparkContext.broadcast((qid, matrix, bar))
    n_columns = 2 if narrow else 4
    barring = "bars" in book.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, matrix, bar = shared.value
        unit = unit_rows(matrix).T.copy()
        n, most = len(qid), max(1, SIM_BLOCK // len(qid))
        known, of = np.unique(qid, return_inverse=True)
        held: pa.Table | None = None
        owner, at, ids, sims = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64))
        least, least_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # of the queries that have k locations
        size = min(most, max(64, 4 * k))
        for batch in batches:
            if not batch.num_rows:
                continue
            address = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            base, all_ids = held.num_rows if held is not None else 0, batch.column(0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(address):
                some, own = address[lo : lo + size], all_ids[lo : lo + size]
                sim = some @ unit
                if cosine:
                    length = np.linalg.norm(some, axis=1)[:, None]
                    sim = np.where(length < vec.TINY, 0.0, sim / np.where(length < vec.TINY, 1.0, length))
                if bar is not None:
                    sim[own[:, None] == bar[None, :]] = -np.inf
                if barring:
                    bars = batch.column(n_columns).slice(lo, len(own))
                    who = bars.flatten().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(bars), 0).to_numpy(zero_copy_only=False))
                    place = np.minimum(np.searchsorted(known, who), len(known) - 1)
                    real = known[place] == who
                    hit = np.zeros((len(own), len(known)), dtype=bool)
                    hit[row[real], place[real]] = True
                    sim[hit[:, of]] = -np.inf
                row, who = np.nonzero((sim >= least) & np.isfinite(sim))
                got = sim[row, who]
                keep = (got > least[who]) | (own[row] < least_id[who])
                row, who, got = row[keep], who[keep], got[keep]
                owner, at, ids, sims = np.concatenate([owner, who]), np.concatenate([at, base + lo + row]), np.concatenate([ids, own[row]]), np.concatenate([sims, got])
                order = np.lexsort((ids, -sims, owner))
                begin = np.searchsorted(owner[order], np.arange(n))
                order = order[np.arange(len(order)) - begin[owner[order]] < k]
                owner, at, ids, sims = owner[order], at[order], ids[order], sims[order]
                end = np.cumsum(np.bincount(owner, minlength=n))
                full = np.diff(end, prepend=0) == k
                least[full], least_id[full] = sims[end[full] - 1], ids[end[full] - 1]
                lo, size = lo + len(own), min(most, 2 * size)
            table = pa.Table.from_batches([batch.select(range(n_columns))])
            if not narrow:
                held = table if held is None else pa.concat_tables([held, table])
                used, at = np.unique(at, return_inverse=True)
                held = held.take(pa.array(used)).combine_chunks()
        for lo in range(0, len(owner), OUT_ROWS):
            who, sim = owner[lo : lo + OUT_ROWS], pa.array(sims[lo : lo + OUT_ROWS])
            if narrow:
                yield pa.RecordBatch.from_arrays([pa.array(qid[who]), pa.array(ids[lo : lo + OUT_ROWS]), sim], names=["qid", "loc_id", "sim"])
                continue
            rows = held.take(pa.array(at[lo : lo + OUT_ROWS])).combine_chunks()
            query = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(who) + 1) * matrix.shape[1], matrix.shape[1], dtype=np.int32)), pa.array(matrix[who].reshape(-1)))
            columns = [pa.array(qid[who]), query, *(rows.column(i).chunk(0) for i in range(4)), sim]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "query", *LOCATION_COLUMNS, "sim"])

    return book.mapInArrow(run, NEAR if narrow else ACTIVATED)


def activate_subset(queries: DataFrame, locations: DataFrame, allowed: DataFrame, k: int = 20, **how: object) -> DataFrame:
    """activate over the locations whose loc_id is in `allowed`."""
    return activate(queries, locations.join(allowed.select("loc_id"), "loc_id", "left_semi"), k, **how)


def activate_without(queries: DataFrame, locations: DataFrame, barred: DataFrame, k: int = 20, **how: object) -> DataFrame:
    """activate where rows (qid, loc_id) of `barred` never count, for any number of them per query."""
    return activate(queries, locations, k, barred=barred.select("qid", "loc_id"), **how)


def top_location(queries: DataFrame, locations: DataFrame, **how: object) -> DataFrame:
    """(qid, loc_id, sim) of the nearest location."""
    return nearest(queries, locations, 1, **how).select("qid", "loc_id", "sim")


def nearest_neighbors(locations: DataFrame, **how: object) -> DataFrame:
    """(loc_id, nn_id, sim): each location's nearest other by cosine; zero vectors have none and are none."""
    real = locations.where(vec.norm("address") >= vec.TINY)
    asks = real.select(F.col("loc_id").alias("qid"), F.col("address").alias("query"), F.col("loc_id").alias("exclude"))
    return nearest(asks, real, 1, cosine=True, **how).select(F.col("qid").alias("loc_id"), F.col("loc_id").alias("nn_id"), "sim")


def select_landmarks(locations: DataFrame, n: int = 32) -> DataFrame:
    """The n locations with the most writes."""
    return locations.orderBy(F.col("write_count").desc(), "loc_id").limit(n)


def id_lookup(locations: DataFrame) -> DataFrame:
    """(loc_id, idx): the place of each location in id order, ranked inside ranges of ids and shifted by their sizes.

    The ranges are numbered once and checkpointed: both uses below must see the same bounds.
    """
    ranges = locations.select("loc_id").repartitionByRange("loc_id").sortWithinPartitions("loc_id").withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    sizes = ranges.groupBy(part.alias("part")).count()
    before = sizes.select(F.col("part").alias("_part"), (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("_before"))
    return ranges.join(F.broadcast(before), part == F.col("_part")).select("loc_id", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias("idx"))


def graph_ready(locations: DataFrame, k: int = 20) -> DataFrame:
    """One row: whether the neighbour graph is dense enough to search (100 locations, mean degree k / 2)."""
    stats = locations.agg(F.count("*").alias("n_locations"), F.coalesce(F.avg(F.size("neighbors")), F.lit(0.0)).alias("mean_degree"))
    return stats.withColumn("ready", (F.col("n_locations") >= 100) & (F.col("mean_degree") >= k / 2))


def with_neighbors(locations: DataFrame, degree: int = 20, **how: object) -> DataFrame:
    """locations plus `neighbors`, the ids of the `degree` nearest others."""
    asks = locations.select(F.col("loc_id").alias("qid"), F.col("address").alias("query"), F.col("loc_id").alias("exclude"))
    lists = nearest(asks, locations, degree, **how).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rk", "loc_id"))).alias("l"))
    return locations.join(lists.select(F.col("qid").alias("loc_id"), F.transform("l", lambda x: x.loc_id).alias("neighbors")), "loc_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<bigint>")))


def graph_activate(queries: DataFrame, locations: DataFrame, k: int = 20, landmarks: int = 32) -> DataFrame:
    """Approximate activation along neighbour lists: best-first, a frontier of k per round, from the nearest landmark.

    Each round is a join of the frontier with the locations; a query stops when a round finds nothing better
    than its k-th location. Every location enters a query's best k once at most, so the rounds end by themselves.
    """
    locations = locations.checkpoint()  # the lists are made once, not again in every round
    start = activate(queries, select_landmarks(locations, landmarks), 1).select("qid", "query", "loc_id", "sim")
    found, frontier = start, start
    edges = locations.select(F.col("loc_id").alias("from_id"), F.explode("neighbors").alias("loc_id"))
    book = locations.select("loc_id", "address")
    while True:
        steps = frontier.select("qid", "query", F.col("loc_id").alias("from_id")).join(edges, "from_id").select("qid", "query", "loc_id").distinct()
        new = steps.join(found.select("qid", "loc_id"), ["qid", "loc_id"], "left_anti").join(book, "loc_id")
        new = new.select("qid", "query", "loc_id", vec.dot(vec.normalize("query"), "address").alias("sim"))
        both = ranked(found.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))), k).drop("rk").checkpoint()
        found, frontier = both.drop("fresh"), both.where("fresh").drop("fresh")
        if frontier.isEmpty():
            break
    return ranked(found.join(locations.select("loc_id", "counter", "write_count"), "loc_id"), k)


def similarity(a: Column, b: Column) -> Column:
    return vec.dot(vec.normalize(a), b)
