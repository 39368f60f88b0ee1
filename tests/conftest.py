import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def oracle(sf: str):
    """A DuckDB connection with the tables of a folder as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(value):
    """A value that compares across engines."""
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if hasattr(value, "to_eng_string"):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same_rows(df, con, sql: str) -> None:
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    wanted = sorted((tuple(plain(dict(zip(columns, row))[n]) for n in names) for row in result.fetchall()), key=repr)
    assert found == wanted
