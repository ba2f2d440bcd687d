import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pageproof.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship_package(local_session(4, "pageproof-tests"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate an expression over string columns of one row."""
    from pyspark.sql import functions as F

    def run(build, **columns):
        row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in columns.items()])
        return row.select(build(*[F.col(k) for k in columns]).alias("v")).first()[0]

    return run
