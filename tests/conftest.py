import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def same_rows(frame, sql: str, sf_dir: str) -> None:
    """The Spark result and DuckDB's are equal as bags of rows."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    columns = sorted(frame.columns)
    result = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    plain = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else v
    ours = sorted((tuple(map(plain, r)) for r in frame.select(columns).collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in result), key=repr)
    assert ours == theirs
