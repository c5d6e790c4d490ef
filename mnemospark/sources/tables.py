"""Reading and writing collections: files, base64 rows, bulk loads, snapshots and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.config import Limits
from mnemospark.functions import spectral, vec
from mnemospark.operators.writes import STATE

COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_vectors(spark: SparkSession, path: str, ident: str, value: str, kind: str = "parquet", **options: str) -> DataFrame:
    """(qid, query) from parquet, orc or json arrays, or from csv/text columns that hold a JSON array."""
    rows = spark.read.format(kind).options(**options).load(path)
    v = F.col(value)
    v = F.from_json(v, vec.V) if dict(rows.dtypes)[value] == "string" else v.cast(vec.V)
    return rows.select(F.col(ident).cast("long").alias("qid"), v.alias("query"))


def read_base64(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(qid, query) from little-endian doubles in base64."""
    return rows.select(F.col(ident).cast("long").alias("qid"), spectral.from_base64(F.col(text)).alias("query"))


def location_scan(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Locations under path; a collection is a partition of the files, so only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def flush(locations: DataFrame, path: str) -> None:
    """Writes locations by collection, replacing only the collections that are in the rows."""
    locations.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def append_postings(postings: DataFrame, path: str) -> None:
    postings.write.mode("append").parquet(path)


def bulk_load(rows: DataFrame, d: int, precision: str = "f64", most: int = Limits.bulk_rows) -> DataFrame:
    """Locations from (pos, address[, counter, write_count]): the new content of a collection, ids from pos."""
    Limits.check(rows.count(), most, "bulk load")
    columns = set(rows.columns)
    address = vec.checked(vec.cast("address", precision), d)
    counter = vec.checked(vec.cast("counter", precision), d) if "counter" in columns else address
    count = F.coalesce(F.col("write_count").cast("double"), F.lit(1.0)) if "write_count" in columns else F.lit(1.0)
    return rows.select(F.col("pos").cast("long").alias("loc_id"), address.alias("address"), F.coalesce(counter, address).alias("counter"), count.alias("write_count"), F.array().cast("array<bigint>").alias("neighbors"), F.lit(0.0).alias("surprise_mass"))


def verify(locations: DataFrame, documents: DataFrame, postings: DataFrame, d: int) -> DataFrame:
    """One row of counts: locations and documents, bad vectors of each, and postings that point nowhere."""
    bad = (F.size("v") != d) | ~vec.finite("v")
    loc = locations.select(F.col("address").alias("v")).agg(F.count("*").alias("n_locations"), F.count_if(bad).alias("bad_locations"))
    doc = documents.select(F.col("vector").alias("v")).agg(F.count("*").alias("n_documents"), F.count_if(bad).alias("bad_documents"))
    lost = postings.join(locations.select("loc_id"), "loc_id", "left_anti").agg(F.count("*").alias("postings_without_location"))
    void = postings.join(documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("postings_without_document"))
    return loc.crossJoin(doc).crossJoin(lost).crossJoin(void)
