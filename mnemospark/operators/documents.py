"""Documents under locations: recall through postings, exact ranking, role-scoped scores, paging and upkeep.

documents: doc_id, vector, metadata. postings: loc_id, doc_id, one row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import spectral, vec
from mnemospark.operators.activation import activate
from mnemospark.operators.attention import MDL_GRID, log_grid

#: Temperatures below this do not clean a recovered filler; lower requests are raised to it.
CLEANUP_FLOOR = 30.0


def recall(queries: DataFrame, locations: DataFrame, postings: DataFrame, n: int = 10, k: int = 20, **how: object) -> DataFrame:
    """(qid, query, doc_id): the distinct documents under the max(4 k, n) nearest locations of each query."""
    near = activate(queries, locations, max(4 * k, n), **how).select("qid", "query", "loc_id")
    return near.join(postings.select("loc_id", "doc_id"), "loc_id").select("qid", "query", "doc_id").distinct()


def _best(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n)


def candidates(queries: DataFrame, locations: DataFrame, documents: DataFrame, postings: DataFrame, n: int, k: int, exact: bool, **how: object) -> DataFrame:
    docs = documents.select("doc_id", "vector", "metadata")
    if exact:
        found = activate(queries, docs.select(F.col("doc_id").alias("loc_id"), F.col("vector").alias("address"), F.col("vector").alias("counter"), F.lit(1.0).alias("write_count")), n, cosine=True, **how)
        return found.select("qid", "query", F.col("loc_id").alias("doc_id")).join(docs, "doc_id")
    return recall(queries, locations, postings, n, k, **how).join(docs, "doc_id")


def query_documents(queries: DataFrame, locations: DataFrame, documents: DataFrame, postings: DataFrame, n: int = 10, k: int = 20, exact: bool = False, **how: object) -> DataFrame:
    """(qid, doc_id, score, rk, metadata): the n documents of highest cosine among those recalled.

    exact skips the postings and searches all documents. Metadata that is no JSON is null.
    """
    rows = candidates(queries, locations, documents, postings, n, k, exact, **how)
    rows = rows.withColumn("score", vec.cosine("query", "vector"))
    valid = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    return _best(rows, n).select("qid", "doc_id", "score", "rk", valid.alias("metadata"))


def query_documents_scoped(queries: DataFrame, role: list[float], locations: DataFrame, documents: DataFrame, postings: DataFrame, n: int = 10, k: int = 20, **how: object) -> DataFrame:
    """The same recall, scored by the cosine of what each document binds to the role with the query."""
    rows = candidates(queries, locations, documents, postings, n, k, False, **how)
    fixed = F.array(*[F.lit(float(x)) for x in role])
    return _best(rows.withColumn("score", spectral.role_similarity(F.col("vector"), fixed, F.col("query"))), n).select("qid", "doc_id", "score", "rk")


def _beta(keys: np.ndarray, default: float) -> float:
    if len(keys) < 2:
        return default
    units = spectral.unit(keys)
    gap = units @ units.T - 1
    np.fill_diagonal(gap, -np.inf)
    top = gap.max(axis=1, keepdims=True)
    grid = log_grid(*MDL_GRID)
    fit = [(b * top[:, 0] + np.log(np.exp(b * (gap - top)).sum(axis=1))).sum() + len(keys) * keys.shape[1] / 2 * np.log(b) for b in grid]
    return grid[int(np.argmax(fit))]


def query_documents_multi_role(queries: DataFrame, pairs: list[tuple[list[float], list[float]]], locations: DataFrame, documents: DataFrame, postings: DataFrame, n: int = 10, k: int = 20, cleanup: str | float = "off", default: float = 5.0, **how: object) -> DataFrame:
    """(qid, doc_id, score, rk, role_scores, beta): recall and rank by cosine, one role score per (role, filler) pair.

    cleanup replaces each recovered filler by an attention read over the query's activated locations before it
    is compared: at a given temperature (at least CLEANUP_FLOOR), or with "mdl" at the query's own bandwidth.
    """
    best = _best(candidates(queries, locations, documents, postings, n, k, False, **how).withColumn("score", vec.cosine("query", "vector")), n)
    roles = np.array([r for r, _ in pairs], dtype=np.float64)
    fillers = spectral.unit(np.array([f for _, f in pairs], dtype=np.float64))
    book = activate(queries, locations, k, **how).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rk", "address", vec.pattern("counter", "write_count").alias("value"), "write_count"))).alias("act"))
    rows = best.select("qid", "doc_id", "score", "rk", "vector").join(book, "qid")
    rows = rows.select("qid", "doc_id", "score", "rk", "vector", F.transform("act", lambda a: a.address).alias("keys"), F.transform("act", lambda a: a.value).alias("values"), F.transform("act", lambda a: a.write_count).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, betas = [], []
            for vector, keys, values, counts in zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True):
                found = spectral.unbind_rows(np.array(vector)[None, :], roles)
                beta = None
                if cleanup != "off":
                    key, value, count = np.array(keys), np.array(values), np.array(counts)
                    beta = _beta(key, default) if cleanup == "mdl" else max(float(cleanup), CLEANUP_FLOOR)
                    with np.errstate(divide="ignore"):
                        logit = beta * found @ key.T + np.log(np.maximum(count, 0))
                    weight = np.exp(logit - logit.max(axis=1, keepdims=True))
                    found = weight / weight.sum(axis=1, keepdims=True) @ value
                scores.append((spectral.unit(found) * fillers).sum(axis=1).tolist())
                betas.append(beta)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(scores, pa.list_(pa.float64())), pa.array(betas, pa.float64())], names=["qid", "doc_id", "score", "rk", "role_scores", "beta"])

    return rows.mapInArrow(run, "qid bigint, doc_id bigint, score double, rk int, role_scores array<double>, beta double")


def page(documents: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Documents offset .. offset + limit in id order; the total is documents.count()."""
    return documents.orderBy("doc_id").offset(offset).limit(limit)


def get(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def resolve(references: DataFrame, locations: DataFrame) -> DataFrame:
    """(doc_id, vector, metadata): vectors of documents that point to a location by ref; dangling ones are left out."""
    rows = references.join(locations.select(F.col("loc_id").alias("ref"), "address"), "ref", "left")
    rows = rows.withColumn("vector", F.coalesce("vector", "address"))
    return rows.where(F.col("vector").isNotNull()).select("doc_id", "vector", "metadata")


def postings_of(activated: DataFrame) -> DataFrame:
    """(loc_id, doc_id) of documents (qid) under the locations that they activated."""
    return activated.select("loc_id", F.col("qid").alias("doc_id")).distinct()


def delete(documents: DataFrame, postings: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, postings, doc_ids that existed) without the given doc_ids; what they taught locations stays."""
    ids = doc_ids.select("doc_id").distinct()
    return documents.join(ids, "doc_id", "left_anti"), postings.join(ids, "doc_id", "left_anti"), ids.join(documents, "doc_id", "left_semi")
