import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a table as sorted tuples, by name of column."""

    def of(df, *columns, digits=6):
        columns = columns or df.columns
        clean = lambda x: round(x, digits) if isinstance(x, float) else tuple(map(clean, x)) if isinstance(x, list) else x
        return sorted((tuple(clean(r[c]) for c in columns) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))

    return of
