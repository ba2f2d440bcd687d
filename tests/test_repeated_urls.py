"""Queries on tables that are folders of files and hold pages that share a URL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import canonical

# Sheets are ten pages by id, from a multiple of ten.
SHIFT = 1010


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for table in ("pages", "documents", "events"):
        rows = spark.read.parquet(f"{entry.SMOKE_DIR}/{table}.parquet")
        if table == "pages":
            rows = rows.where("page_id < 60")
            rows = rows.unionByName(rows.selectExpr(f"page_id + {SHIFT} as page_id", "url", "html"))
        rows.repartition(3).write.parquet(f"{root}/{table}.parquet")
    db = duckdb.connect()
    for path in root.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}/*.parquet')")
    return str(root), db


NAMES = [
    "stream_audit", "stream_dedup", "stream_live_audit", "canonical_field_check", "image_alt_check",
    "meta_description_check", "open_graph_check", "twitter_check", "sheet_audit",
]


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, folders, name):
    root, db = folders
    found = entry.queries()[name](spark, root)
    cursor = db.execute(entry.oracle_sql()[name])
    wanted = canonical(cursor.fetchall(), [c[0] for c in cursor.description])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == wanted


@pytest.mark.parametrize(("text", "upper"), [("Groß ßa", "GROẞ ẞA"), ("ŉ ᾳ ﬁn", "ŉ ᾼ ﬁN"), ("été 🙂", "ÉTÉ 🙂"), ("", "")])
def test_upper_case_keeps_the_number_of_letters(spark, text, upper):
    from pageproof.catalog.content_queries import UPPER

    row = spark.createDataFrame([(text,)], "x string").selectExpr(UPPER.replace("{}", "x")).first()
    assert row[0] == upper == duckdb.execute("select upper(?)", [text]).fetchone()[0]
