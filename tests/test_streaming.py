"""Learning and logging as streams give what the batch gives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mnemospark.config import MemoryConfig
from mnemospark.operators import writes
from mnemospark.streaming import memory

D = 16


def test_stream_learns_like_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(c, i, rng.standard_normal(D).tolist()) for i in range(20) for c in "ab"]
    schema = "collection string, seq bigint, vector array<double>"
    config = MemoryConfig(D, k=4)
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    run = memory.learn_stream(stream, config).writeStream.format("memory").queryName("learned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    run.awaitTermination(120)
    last = {r.collection: r.n for r in spark.table("learned").groupBy("collection").agg(F.max_by("n_locations", "seq").alias("n")).collect()}
    batch = writes.locations_of(writes.learn(spark.createDataFrame(rows, schema), config)).groupBy("collection").count().collect()
    assert last == {r.collection: r["count"] for r in batch} and spark.table("learned").count() == 40


def test_audit_stream_writes_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "seq bigint, route string").write.parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema("seq bigint, route string").parquet(f"file://{tmp_path}/log")
    run = memory.audit_sink(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp2", "0 seconds")
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
