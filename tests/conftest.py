import math
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def plain(x):
    """A value in a form that compares alike whether Spark or DuckDB made it."""
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.fixture(scope="session")
def sql_rows():
    import duckdb

    def rows(sql, sf=SF, **frames):
        con = duckdb.connect()
        for t in TABLES:
            p = f"{sf}/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)

    return rows


@pytest.fixture(scope="session")
def same_as_sql(spark, sql_rows):
    def check(query, sql, sf=SF):
        df = query(spark, sf)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(v) for v in r) for r in df.select(*names).toLocalIterator()), key=repr)
        their_names, theirs = sql_rows(sql, sf)
        assert names == their_names
        assert len(mine) == len(theirs)
        assert mine == theirs
        return len(mine)

    return check
