from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mnemospark.session import session

    root = tmp_path_factory.mktemp("spark")
    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{root}/shared", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.ui.showConsoleProgress": "false", "spark.driver.extraJavaOptions": f"-Dderby.system.home={root}"}
    made = session("local[4]", "tests", **conf)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"


def oracle(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def assert_same(got, want) -> None:
    """Equal rows in any order; numbers within 1e-5."""
    import numpy as np
    import pandas as pd

    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)

    def ordered(df):
        df = df[columns].copy()
        for c in columns:
            if df[c].dtype == object or str(df[c].dtype) in {"str", "string"}:
                df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
            else:
                df[c] = pd.to_numeric(df[c]).astype(float)
        text = [c for c in columns if df[c].dtype == object or str(df[c].dtype) in {"str", "string"}]
        return df.sort_values(text + [c for c in columns if c not in text]).reset_index(drop=True)

    a, b = ordered(got), ordered(want)
    for c in columns:
        if str(a[c].dtype).startswith("float"):
            assert np.allclose(a[c].fillna(-9e9), b[c].fillna(-9e9), atol=1e-5), c
        else:
            assert (a[c] == b[c]).all(), c
