import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def oracle(name: str, sql: str, sf_dir: str):
    """Sorted rows of DuckDB for a query's SQL, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([plain(row[i]) for i in order]) for row in got.fetchall())


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
