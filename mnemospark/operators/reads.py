"""Reconstruction reads: softmax-weighted patterns of the activated locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import vec
from mnemospark.operators.activation import activate

V = "array<double>"


def gathered(activated: DataFrame) -> DataFrame:
    """One row per query with its activated locations in rank order as `act`."""
    item = F.struct("rk", "loc_id", "sim", "address", "counter", "write_count")
    return activated.groupBy("qid").agg(F.first("query").alias("query"), F.sort_array(F.collect_list(item)).alias("act"))


def _mix(weights: Column, vectors: Column) -> Column:
    """Sum of weights[i] * vectors[i]."""
    return vec.weighted_sum(F.zip_with(weights, vectors, lambda w, v: F.struct(w.alias("w"), v.alias("v"))))


def read_fast(queries: DataFrame, locations: DataFrame, k: int = 20, beta: float = 5.0, **how: object) -> DataFrame:
    """(qid, query, result): one softmax step of beta * cosine over the raw patterns, normalised."""
    rows = gathered(activate(queries, locations, k, **how))
    weights = vec.softmax(F.transform("act", lambda a: vec.cosine("query", a.address)), beta)
    patterns = F.transform("act", lambda a: vec.pattern(a.counter, a.write_count))
    return rows.select("qid", "query", vec.normalize(_mix(weights, patterns)).alias("result"))


def _descended(rows: DataFrame, beta: float, t_max: int, epsilon: float) -> DataFrame:
    """Adds `state`: the fixed point (xi), rounds, whether it settled, and the last weights."""
    rows = rows.withColumn("unit_patterns", F.transform("act", lambda a: vec.unit_pattern(a.counter, a.write_count)))
    start = F.struct(vec.normalize("query").alias("xi"), F.lit(0).alias("rounds"), F.lit(False).alias("converged"), F.array().cast(V).alias("weights"))

    def moved(state: Column, weights: Column, new: Column) -> Column:
        return F.struct(new.alias("xi"), (state.rounds + 1).alias("rounds"), (vec.cosine(state.xi, new) > 1 - epsilon).alias("converged"), weights.alias("weights"))

    def step(state: Column, _: Column) -> Column:
        weights = vec.softmax(F.transform("act", lambda a: vec.cosine(state.xi, a.address)), beta)
        mixed = lambda w: vec.let(vec.normalize(_mix(w, F.col("unit_patterns"))), lambda new: moved(state, w, new))
        return F.when(state.converged, state).otherwise(vec.let(weights, mixed))

    return rows.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(t_max)), start, step))


def read_iterative(queries: DataFrame, locations: DataFrame, k: int = 20, beta: float = 5.0, t_max: int = 10, epsilon: float = 1e-6, **how: object) -> DataFrame:
    """(qid, query, result, iterations, converged): repeated softmax steps over unit patterns of a fixed activation."""
    rows = _descended(gathered(activate(queries, locations, k, **how)), beta, t_max, epsilon)
    return rows.select("qid", "query", F.col("state.xi").alias("result"), F.col("state.rounds").alias("iterations"), F.col("state.converged").alias("converged"))


def read(queries: DataFrame, locations: DataFrame, strategy: str = "iterative", **how: object) -> DataFrame:
    return read_fast(queries, locations, **how) if strategy == "fast" else read_iterative(queries, locations, **how)


def analyze(queries: DataFrame, locations: DataFrame, strategy: str = "iterative", k: int = 20, beta: float = 5.0, t_max: int = 10, epsilon: float = 1e-6, **how: object) -> DataFrame:
    """(qid, result, iterations, converged, loc_id, similarity, weight): one row per contributing location.

    Similarities and weights are those at the final state; the fast read is one step, so those of the query.
    """
    rows = gathered(activate(queries, locations, k, **how))
    if strategy == "fast":
        sims = F.transform("act", lambda a: a.sim)
        weights = vec.softmax(sims, beta)
        result = vec.normalize(_mix(weights, F.transform("act", lambda a: vec.pattern(a.counter, a.write_count))))
        rows = rows.select("qid", "act", result.alias("result"), F.lit(1).alias("iterations"), F.lit(True).alias("converged"), sims.alias("sims"), weights.alias("weights"))
    else:
        rows = _descended(rows, beta, t_max, epsilon)
        final = F.transform("act", lambda a: vec.cosine(F.col("state.xi"), a.address))
        rows = rows.select("qid", "act", F.col("state.xi").alias("result"), F.col("state.rounds").alias("iterations"), F.col("state.converged").alias("converged"), final.alias("sims"), vec.softmax(final, beta).alias("weights"))
    each = F.arrays_zip(F.transform("act", lambda a: a.loc_id).alias("loc_id"), F.col("sims").alias("similarity"), F.col("weights").alias("weight"))
    return rows.select("qid", "result", "iterations", "converged", F.explode(each).alias("c")).select("qid", "result", "iterations", "converged", "c.*")


def centroid(locations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, query): the normalised sum of the counters that were written; keys without any are left out."""
    written = locations.where(F.col("write_count") >= 1e-10)
    return vec.bundle(written, keys, "counter", name="query")


def fingerprint(locations: DataFrame, k: int = 20, beta: float = 5.0, t_max: int = 10, epsilon: float = 1e-6, key: str | None = None, **how: object) -> DataFrame:
    """The fixed point of a codebook's centroid: (key, fingerprint, iterations), or one row without key.

    With key (a string or number column of locations) each of its codebooks is read by its own centroid.
    """
    if key is None:
        asks = centroid(locations.withColumn("qid", F.lit(0).cast("long")), ["qid"])
        return read_iterative(asks, locations, k, beta, t_max, epsilon, **how).select(F.col("result").alias("fingerprint"), "iterations")
    asks = centroid(locations, [key])
    pairs = locations.join(asks, key).withColumn("sim", vec.dot("query", "address"))
    best = Window.partitionBy(key).orderBy(F.col("sim").desc(), "loc_id")
    pairs = pairs.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
    item = F.struct("rk", "loc_id", "sim", "address", "counter", "write_count")
    rows = pairs.groupBy(key).agg(F.first("query").alias("query"), F.sort_array(F.collect_list(item)).alias("act"))
    rows = _descended(rows, beta, t_max, epsilon)
    return rows.select(key, F.col("state.xi").alias("fingerprint"), F.col("state.rounds").alias("iterations"))


def confidence(queries: DataFrame, locations: DataFrame, k: int = 20, beta: float = 5.0, **how: object) -> DataFrame:
    """(qid, confidence): the log-sum-exp of beta * similarity over the activated locations, divided by beta."""
    rows = gathered(activate(queries, locations, k, **how))
    return rows.select("qid", (vec.logsumexp(F.transform("act", lambda a: a.sim), beta) / beta).alias("confidence"))


def compose_read(queries: DataFrame, parents: dict[str, DataFrame], sharpness: float = 20.0, k: int = 20, beta: float = 5.0, **how: object) -> DataFrame:
    """(qid, result, weights, confidences): iterative reads of several codebooks, blended by the softmax of their confidence.

    weights and confidences are maps by name. A codebook that activates nothing answers with the query.
    """
    if len(parents) < 2:
        raise ValueError("at least two codebooks are needed")
    parts = None
    for name, locations in parents.items():
        got = read_iterative(queries, locations, k, beta, **how).select("qid", F.col("result"))
        sure = confidence(queries, locations, k, beta, **how)
        one = queries.select("qid", "query").join(got, "qid", "left").join(sure, "qid", "left")
        one = one.select("qid", F.lit(name).alias("name"), F.coalesce("result", "query").alias("v"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
        parts = one if parts is None else parts.unionByName(one)
    rows = parts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("name", "v", "c"))).alias("p"))
    rows = rows.withColumn("w", vec.softmax(F.transform("p", lambda x: x.c), sharpness))
    names = F.transform("p", lambda x: x["name"])
    return rows.select("qid", vec.normalize(_mix(F.col("w"), F.transform("p", lambda x: x.v))).alias("result"), F.map_from_arrays(names, F.col("w")).alias("weights"), F.map_from_arrays(names, F.transform("p", lambda x: x.c)).alias("confidences"))


def read_with_confidence(queries: DataFrame, locations: DataFrame, k: int = 20, beta: float = 5.0, **how: object) -> DataFrame:
    """(qid, result, confidence): one step over unit patterns; confidence is the best similarity."""
    rows = gathered(activate(queries, locations, k, **how))
    weights = vec.softmax(F.transform("act", lambda a: a.sim), beta)
    result = vec.normalize(_mix(weights, F.transform("act", lambda a: vec.unit_pattern(a.counter, a.write_count))))
    return rows.select("qid", result.alias("result"), F.element_at("act", 1).sim.alias("confidence"))


def fidelity(queries: DataFrame, locations: DataFrame, strategy: str = "iterative", **how: object) -> DataFrame:
    """(qid, fidelity): cosine of each query with its read."""
    return read(queries, locations, strategy, **how).select("qid", vec.cosine("query", "result").alias("fidelity"))
