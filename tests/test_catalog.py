from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pageproof.catalog import ORACLES, QUERIES

SMALL = Path(entry.SMOKE_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "expected", "actual", "status", "message"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def kind(name: str) -> str:
    """The family of a type, under both engines' names."""
    name = name.lower()
    if name.endswith("[]") or name.startswith("array"):
        return "list"
    for family, names in {
        "integer": ("int", "bigint", "smallint", "tinyint", "long", "hugeint"),
        "text": ("varchar", "string"),
        "float": ("double", "float", "decimal"),
        "boolean": ("boolean",),
        "time": ("date", "timestamp"),
        "struct": ("struct",),
    }.items():
        if name.startswith(names):
            return family
    return name


def test_columns_and_types_are_those_of_the_sql(spark, duck):
    """Plans are built on several threads, as most of the time is the planner's."""
    with ThreadPoolExecutor(6) as pool:
        found = dict(pool.map(lambda n: (n, dict(QUERIES[n](spark, str(SMALL)).dtypes)), sorted(ORACLES)))
    for name, types in found.items():
        want = {r[0]: kind(r[1]) for r in duck.execute(f"describe {ORACLES[name]}").fetchall()}
        assert {c: kind(t) for c, t in types.items()} == {c: "text" if k == '"null"' else k for c, k in want.items()}, name
