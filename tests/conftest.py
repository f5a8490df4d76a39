import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compares a registered query with its SQL on a test folder."""
    import duckdb

    def normal(v):
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return v

    def compare(df, sql: str, sf: str) -> int:
        con = duckdb.connect()
        for f in Path(sf).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        found = con.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        columns = sorted(df.columns)
        mine = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
        at = [found.columns.index(c) for c in columns]
        theirs = sorted(repr([normal(r[i]) for i in at]) for r in found.fetchall())
        assert mine == theirs
        return len(mine)

    return compare
