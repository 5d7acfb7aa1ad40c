import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6))
    return repr(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query of the registry agrees with its SQL at the smallest scale."""

    def of(query, sql):
        df = query(spark, SF)
        cols = sorted(df.columns)
        got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
        assert got == want

    return of
