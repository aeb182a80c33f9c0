import sys
from pathlib import Path

import pytest
from hypothesis import settings

settings.register_profile("repeatable", derandomize=True)
settings.load_profile("repeatable")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value in a form that two engines agree on."""
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return "null" if v is None else str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql, sf=SF):
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        assert got == want
        return len(got)

    return check
