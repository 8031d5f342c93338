import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sql, sf=SF):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.sql(sql).df()


def rows(df):
    """Rows with columns by name, floats rounded, in any order."""
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else v
    same = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str(tuple(same(fix(v.item() if hasattr(v, "item") else v)) for v in r)) for r in df.itertuples(index=False, name=None))
