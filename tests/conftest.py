import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sql: str, **tables):
    """Rows of a DuckDB query over pandas frames or Parquet paths."""
    import duckdb

    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table) if not isinstance(table, str) else con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{table}'")
    return con.sql(sql).df()
