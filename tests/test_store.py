"""The bucketed run store, record import and paging by the last row."""

import random

from pageproof.operators import rollups, store
from pageproof.sources.records import read_run_records

RUN = "id string, filename string, created_at string"


def rows(df):
    return {r.id: (r.filename, r.created_at) for r in df.collect()}


def files_read(df) -> int:
    """Files that the scan of a collected frame listed."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "runs")
    old = [(str(i), f"old {i}", "2024-01-01") for i in range(200)] + [("7", "older", "2023-01-01"), (None, "nameless", "2024-01-01")]
    frame = spark.createDataFrame(old, RUN)
    store.create_store(frame, path, 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "runs").rglob("*.parquet")}
    stored = store.read_store(spark, path, frame.schema)
    incoming = spark.createDataFrame([("7", "new", "2025-01-01"), ("7", "newer", "2025-02-01"), ("x", "added", "2025-01-01"), (None, "n", "z")], RUN)
    touched = store.upsert_store(stored, incoming, path, 16)
    assert 1 <= touched <= 2
    now = store.read_store(spark, path, frame.schema)
    want = {str(i): (f"old {i}", "2024-01-01") for i in range(200)} | {"7": ("newer", "2025-02-01"), "x": ("added", "2025-01-01")}
    assert rows(now) == want
    kept = {p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]}
    assert len({p.parent for p in before}) - len({p.parent for p in kept}) <= touched
    assert store.upsert_store(now, incoming.limit(0), path, 16) == 0


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "runs")
    frame = spark.createDataFrame([(str(i), f"f{i}", "2024") for i in range(500)], RUN)
    store.create_store(frame, path, 32)
    stored = store.read_store(spark, path, frame.schema)
    found = store.find_run(stored, "123", 32)
    assert [tuple(r) for r in found.collect()] == [("123", "f123", "2024")]
    assert files_read(store.find_run(stored, "123", 32)) == 1 < files_read(stored)
    assert store.find_run(stored, "absent", 32).collect() == []


def test_import_keeps_each_failure(spark, tmp_path):
    lines = ['{"id":"1","filename":"a","createdAt":"2024"}', '{"id":"2', '{"filename":"no id"}', '{"id":"","filename":"blank"}']
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / "r.json").write_text("\n".join(lines))
    runs, failures = store.import_records(read_run_records(spark, str(tmp_path / "records"), lines=True))
    assert [(r.id, r.filename, r.created_at) for r in runs.collect()] == [("1", "a", "2024")]
    got = sorted((r.reason, r.record) for r in failures.collect())
    assert got == [("no id", '{"filename":"no id"}'), ("no id", '{"id":"","filename":"blank"}'), ("not readable", '{"id":"2')]


def test_pages_by_the_last_row_are_those_by_offset(spark):
    rng = random.Random(8)
    pick = lambda *values: rng.choice(values)
    data = [
        (i, pick("https://a", "https://b", None), pick("Title", "H1", None), pick("failed", "warning", "passed", "odd", None), pick("x", None))
        for i in range(137)
    ]
    df = spark.createDataFrame(data, "seq int, url string, check_type string, status string, actual string")
    for order in ({"by": "status"}, {"by": "url", "descending": True}, {"by": "check_type"}, {"by": "status", "descending": True}):
        last, seen = None, []
        while page := rollups.page_after(df, last, 10, **order).collect():
            seen += page
            last = page[-1].asDict()
        assert len(seen) == len({r.seq for r in seen}) == 137
        whole = rollups.sort_results(df, **order).collect()
        key = lambda r: (r.status if order["by"] == "status" else None, r.url, r.check_type, r.seq)  # noqa: E731, B023
        ranked = lambda r: (rollups.STATUS_RANK.get(r.status, 9), *key(r)[1:]) if order["by"] == "status" else key(r)  # noqa: E731, B023
        assert [ranked(r) for r in seen] == [ranked(r) for r in whole]
