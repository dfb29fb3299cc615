import os
import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Check that a query gives the rows of its SQL, in any order."""

    def check(query, sql):
        got = query(spark, sf_dir)
        columns = sorted(got.columns)
        ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        theirs = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
        assert ours == theirs

    return check
