import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


def rows_key(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


def against_sql(spark, query, sql, data=DATA):
    """The query's rows and those of the SQL over the same tables."""
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"create view {name.split('.')[0]} as from '{data}/{name}'")
    df = query(spark, data)
    r = c.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    return rows_key([tuple(x) for x in df.collect()], df.columns), rows_key(r.fetchall(), columns)
