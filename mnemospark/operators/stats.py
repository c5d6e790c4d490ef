"""Aggregates over collections and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import vec


def collection_stats(locations: DataFrame, key: str = "collection") -> DataFrame:
    """(key, n_locations, total_writes, avg_writes, max_writes) of every collection."""
    return locations.groupBy(key).agg(
        F.count("*").alias("n_locations"),
        F.coalesce(F.sum("write_count"), F.lit(0.0)).alias("total_writes"),
        F.coalesce(F.avg("write_count"), F.lit(0.0)).alias("avg_writes"),
        F.coalesce(F.max("write_count"), F.lit(0.0)).alias("max_writes"),
    )


def summary(locations: DataFrame) -> DataFrame:
    """(loc_id, write_count, mean_abs_counter) without the vectors."""
    size = vec.total(F.transform("counter", F.abs)) / F.greatest(F.size("counter"), F.lit(1))
    return locations.select("loc_id", "write_count", size.alias("mean_abs_counter"))


def column_mean(vectors: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, mean): the mean vector, by position."""
    keys = keys or []
    parts = vectors.select(*keys, F.posexplode(value).alias("at", "x")).groupBy(*keys, "at").agg(F.avg("x").alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda r: r["m"]).alias("mean"))


def centred(vectors: DataFrame, value: str) -> DataFrame:
    """vectors with the corpus mean taken off and the length made 1 again; the mean is one row."""
    mean = column_mean(vectors, value)
    return vectors.crossJoin(F.broadcast(mean)).withColumn(value, vec.normalize(vec.add_scaled(value, "mean", -1.0))).drop("mean")


def quality(vectors: DataFrame, value: str, d: int) -> DataFrame:
    """(n_rows, n_wrong_size, n_not_finite): a data-quality report of a vector column."""
    return vectors.agg(F.count("*").alias("n_rows"), F.count_if(F.size(value) != d).alias("n_wrong_size"), F.count_if(~vec.finite(value)).alias("n_not_finite"))
