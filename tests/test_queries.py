"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import assert_same, oracle

from mnemospark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, name):
    got = catalog.queries()[name](spark, small).toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        assert_same(got, oracle(catalog.oracle_sql()[name], small))


def _two_classes(folder):
    """Embeddings of 510 and 500 rows of labels 0 and 1, dealt in turn: 255,000 pairs, more than a call allows by default."""
    v = np.random.default_rng(12).standard_normal((1010, 64)).astype(np.float32)
    at = np.arange(len(v))
    made = {"vec_id": pa.array(3 * at + 5), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array(np.where(at < 1000, at % 2, 0), pa.int32())}
    pq.write_table(pa.table(made), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["l1_add", "l2_subtract"])
def test_products_of_classes_are_whole_and_send_no_vectors(spark, tmp_path, name):
    """All pairs of large classes under the numbers of the SQL, and 16 bytes a pair leave Python instead of the vector."""
    sf = _two_classes(tmp_path)
    got = catalog.queries()[name](spark, sf)
    assert "counter" not in got._jdf.queryExecution().optimizedPlan().toString()
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, want = (x.sort_values("loc_id") for x in (got.toPandas(), c.sql(catalog.oracle_sql()[name]).df()))
    assert got["loc_id"].tolist() == want["loc_id"].tolist() == list(range(255_000))
    assert np.abs(got["size"].to_numpy() - want["size"].to_numpy()).max() < 2e-6


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
