import datetime as dt
import random


from pageproof.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def drain(spark, stream, tmp_path, mode="append"):
    got = []
    jobs.run_bounded(stream, lambda df: got.extend(df.collect()), str(tmp_path / "checkpoint"), mode)
    return got


def write(spark, rows, schema, path, files=1):
    for k in range(files):
        part = rows[k::files] if files > 1 else rows
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema)


def test_audit_of_arriving_snapshots(spark, tmp_path):
    source = write(spark, [(1, "https://x.com/a", "<title>T</title>"), (2, "https://x.com/b", "<title>Z</title>")], "page_id long, url string, html string", tmp_path / "in").parquet(str(tmp_path / "in"))
    rows = spark.createDataFrame([("/a", "Meta title", "title", "T"), ("/b", "Meta title", "title", "T")], "url string, check_type string, issue_type string, expected string")
    got = drain(spark, jobs.audit_snapshots(source, rows, "https://x.com"), tmp_path)
    assert {(r.url, r.status) for r in got} == {("https://x.com/a", "passed"), ("https://x.com/b", "failed")}


def test_one_audit_per_page_and_period(spark, tmp_path):
    rows = [("https://x.com/a", T0), ("https://X.com/a/?utm_source=q", T0 + dt.timedelta(minutes=5)), ("https://x.com/b", T0)]
    source = write(spark, rows, "url string, fetched_at timestamp", tmp_path / "in").parquet(str(tmp_path / "in"))
    got = drain(spark, jobs.first_per_period(source), tmp_path)
    assert sorted(r.page_key for r in got) == ["https://x.com/a", "https://x.com/b"]


def test_batch_progress(spark, tmp_path):
    jobs.use_rocksdb(spark)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [
        ("b", 0, at(0), -1, "", "created", 3), ("b", 1, at(1), 0, "f0", "running", 3), ("b", 2, at(2), 0, "f0", "done", 3), ("b", 3, at(3), 0, "f0", "done", 3),
        ("b", 4, at(4), 1, "f1", "running", 3), ("c", 0, at(0), -1, "", "created", 2), ("c", 1, at(1), 0, "g0", "error", 2), ("c", 2, at(2), -1, "", "aborted", 2), ("d", 1, at(2), 0, "h", "done", 2),
    ]
    schema = "batch_id string, seq bigint, ts timestamp, idx int, filename string, status string, value bigint"
    source = write(spark, rows, schema, tmp_path / "in").parquet(str(tmp_path / "in"))
    got = {r.batch_id: r for r in drain(spark, jobs.batch_progress(source), tmp_path, "update")}
    assert (got["b"].completed, got["b"].status, got["b"].current_filename) == (1, "running", "f1")
    assert (got["c"].completed, got["c"].errored, got["c"].status) == (2, 2, "done") and "d" not in got


def test_regressions_across_micro_batches(spark, tmp_path):
    jobs.use_rocksdb(spark)
    schema = "source_path string, key string, run_no bigint, run_id string, failing boolean"
    for n, flags in enumerate([(True, False), (True, True), (False, True)]):
        rows = [("s", k, n, f"r{n}", f) for k, f in zip("ab", flags)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.key, r.run_id): r.change for r in drain(spark, jobs.regression_feed(source), tmp_path)}
    assert got == {("a", "r0"): "new", ("a", "r1"): "still", ("a", "r2"): "fixed", ("b", "r1"): "new", ("b", "r2"): "still"}




def test_progress_lasts_across_micro_batches(spark, tmp_path):
    jobs.use_rocksdb(spark)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [
        [("b", 1, at(1), 0, "f0", "running", 2), ("b", 2, at(2), 0, "f0", "done", 2)],
        [("b", 0, at(0), -1, "", "created", 3)],
        [("b", 3, at(3), 1, "f1", "running", 3)],
        [("b", 4, at(4), 1, "f1", "pending", 3)],
        [("b", 5, at(5), 1, "f1", "error", 3), ("b", 6, at(6), 2, "f2", "done", 3)],
    ]
    schema = "batch_id string, seq bigint, ts timestamp, idx int, filename string, status string, value bigint"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, jobs.batch_progress(source), tmp_path, "update")
    assert [(r.completed, r.errored, r.current_filename, r.status) for r in got] == [
        (1, 0, "f0", "running"), (1, 0, "f1", "running"), (1, 0, "f1", "running"), (3, 1, None, "done"),
    ]


def test_a_run_that_comes_too_late_changes_nothing(spark, tmp_path):
    jobs.use_rocksdb(spark)
    schema = "source_path string, key string, run_no bigint, run_id string, failing boolean"
    for n, failing in ((2, True), (1, True), (3, False)):
        spark.createDataFrame([("s", "a", n, f"r{n}", failing)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r.run_id, r.change) for r in drain(spark, jobs.regression_feed(source), tmp_path)]
    assert got == [("r2", "new"), ("r3", "fixed")]


EVENTS = "batch_id string, seq bigint, ts timestamp, idx int, filename string, status string, value bigint"


def progress_of(spark, tmp_path, batches):
    """Rows of the progress of events that arrive in these micro-batches."""
    jobs.use_rocksdb(spark)
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return drain(spark, jobs.batch_progress(source), tmp_path, "update")


def test_progress_of_many_events_does_not_depend_on_their_order(spark, tmp_path):
    at = lambda n: T0 + dt.timedelta(milliseconds=10 * n)
    rows = []
    for b in ("left", "aborted"):
        rows.append((b, 0, at(0), -1, "", "created", 3000))
        for i in range(2500):
            rows.append((b, 2 * i + 1, at(2 * i + 1), i, f"f{i}", "running", 3000))
            rows.append((b, 2 * i + 2, at(2 * i + 2), i, f"f{i}", "error" if i % 5 == 0 else "done", 3000))
        # A second settlement of an item counts for nothing.
        rows.append((b, 9000, at(9000), 1, "f1", "error", 3000))
    rows.append(("aborted", 2001, at(2000), -1, "", "aborted", 3000))
    random.Random(3).shuffle(rows)
    got = {r.batch_id: r for r in progress_of(spark, tmp_path, [rows])}
    left, aborted = got["left"], got["aborted"]
    assert (left.completed, left.errored, left.current_filename, left.status) == (2500, 500, "f2499", "running")
    assert (aborted.completed, aborted.errored, aborted.current_filename, aborted.status) == (3000, 200 + 2000, None, "done")


def test_early_aborts_and_earlier_settlements_count(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [
        [("b", 3, at(3), -1, "", "aborted", 2)],
        [("b", 0, at(0), -1, "", "created", 2)],
        [("b", 2, at(2), 0, "f0", "done", 2)],
        [("b", 4, at(4), 1, "f1", "done", 2)],
    ]
    got = [(r.completed, r.errored, r.status) for r in progress_of(spark, tmp_path, batches)]
    assert got == [(2, 2, "done"), (2, 1, "done"), (2, 1, "done")]


def test_only_finished_batches_are_dropped(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [
        [("b", 0, at(0), -1, "", "created", 2), ("b", 1, at(0), 0, "f0", "done", 2), ("c", 0, at(0), -1, "", "created", 1), ("c", 1, at(0), 0, "g", "error", 1)],
        [("x", 0, at(9), 0, "x", "running", 1)],
        [("x", 1, at(10), 0, "x", "running", 1)],
        [("b", 2, at(11), 1, "f1", "done", 2), ("c", 2, at(11), -1, "", "created", 4)],
    ]
    got = [(r.batch_id, r.total, r.completed, r.errored, r.status) for r in progress_of(spark, tmp_path, batches)]
    assert sorted(got) == [("b", 2, 1, 0, "running"), ("b", 2, 2, 0, "done"), ("c", 1, 1, 1, "done"), ("c", 4, 0, 0, "running")]


RUN_EVENTS = "source_path string, ts timestamp, run_no bigint, run_id string, key string, is_end boolean"


def day(n, hour=0):
    return T0 + dt.timedelta(days=n, hours=hour)


def failing(n, *keys):
    return [("s", day(n, 1), n, f"r{n}", k, False) for k in keys]


def ended(n, source="s"):
    return ("s" if source is None else source, day(n, 2), n, f"r{n}", None, True)


def changes(spark, tmp_path, batches, **kw):
    jobs.use_rocksdb(spark)
    for rows in batches:
        spark.createDataFrame(rows, RUN_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(RUN_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return sorted((r.run_id, r.key, r.change) for r in drain(spark, jobs.run_changes_feed(source, **kw), tmp_path))


def test_absence_from_a_finished_run_is_fixed_and_order_of_arrival_is_not_told(spark, tmp_path):
    batches = [
        [*failing(0, "a", "b"), ended(0)],
        # The end of run 1 comes before its entries, and run 2 before run 1.
        [*failing(2, "c"), ended(2), ended(1)],
        [*failing(1, "b", "c")],
        [ended(3)],
        [ended(60, "tick")],
    ]
    got = changes(spark, tmp_path, batches, lateness="5 days", buckets=3)
    assert got == [
        ("r0", "a", "new"), ("r0", "b", "new"), ("r1", "a", "fixed"), ("r1", "b", "still"), ("r1", "c", "new"),
        ("r2", "b", "fixed"), ("r2", "c", "still"), ("r3", "c", "fixed"),
    ]


class FakeState(dict):
    """A map or value state in memory."""

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def containsKey(self, key):
        return key in self

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return None in self

    def get(self, *_):
        return self[None]

    def update(self, value):
        self[None] = value


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, FakeState())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


def test_late_runs_are_told_and_state_is_empty_after_the_period():
    import pandas as pd

    own, handle = jobs.RunComparison(retention_ms=1000), FakeHandle()
    own.init(handle)

    def take(*rows):
        frame = pd.DataFrame([(pd.Timestamp(at, unit="ms"), n, f"r{n}", k, k is None) for at, n, k in rows], columns=["ts", "run_no", "run_id", "key", "is_end"])
        assert list(own.handleInputRows(("s", 0), iter([frame]), None)) == []

    def until(watermark):
        out = []
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(due[0])
            info = type("Info", (), {"getExpiryTimeInMs": lambda self, at=due[0]: at})()
            out += [tuple(r)[1:] for f in own.handleExpiredTimer(("s", 0), None, info) for r in f.itertuples(index=False)]
        return out

    take((10, 1, "a"), (10, 1, "b"), (20, 1, None))
    assert until(15) == [] and until(20) == [("a", "r1", "new"), ("b", "r1", "new")]
    take((40, 3, "b"), (50, 3, None), (30, 2, "z"))
    assert until(60) == [("a", "r3", "fixed"), ("b", "r3", "still")]
    take((35, 2, "q"), (36, 2, None))
    assert until(70) == [("q", "r2", "late")]
    assert handle.states["failing"] == {("b",): (3,)} and handle.states["waiting"] == {}
    assert until(2000) == [] and not any(handle.states.values()) and not handle.timers


def test_periods_are_told_apart_and_leave_the_state(spark, tmp_path):
    """Days arrive one after another; each page counts once a day, an hour's
    lateness is taken in, a row two days late is not, nor one without a time."""
    day = dt.timedelta(days=1)
    pages = ["https://x.com/a", "https://X.com/a/?utm_source=q", "https://x.com/b"]
    source, got, states = str(tmp_path / "in"), [], []
    for n in range(6):
        rows = [(u, T0 + n * day + dt.timedelta(hours=h)) for u in pages for h in (1, 22)]
        rows += [("https://x.com/a", T0 + (n - 1) * day + dt.timedelta(hours=23)), ("https://x.com/late", T0 + (n - 4) * day), ("https://x.com/c", None)]
        write(spark, rows, "url string, fetched_at timestamp", source)
        stream = jobs.one_per_period(jobs.read_snapshots(spark, source, "url string, fetched_at timestamp"))
        query = (
            stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
            .foreachBatch(lambda df, _: got.extend(df.collect()))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    seen = sorted((r.page_key, r.period) for r in got if r.page_key != "https://x.com/late")
    first = [("https://x.com/a", T0 - day)]
    assert seen == sorted(first + [(p, T0 + n * day) for n in range(6) for p in ("https://x.com/a", "https://x.com/b")])
    assert all(r.period < T0 for r in got if r.page_key == "https://x.com/late") and states[-1] <= 9


def test_rows_and_pages_meet_whichever_comes_first(spark, tmp_path):
    """A row before its page, one after it, one listed too late for it, one
    without a time: results of the first two alone, each once."""
    hour = dt.timedelta(hours=1)
    row = "url string, check_type string, issue_type string, expected string, listed_at timestamp"
    steps = [
        ([("/a", "t", "title", "A", T0), ("/n", "t", "title", "N", None)], [("https://x.com/b", "<title>B</title>", T0 + hour)]),
        ([("/b", "t", "title", "Z", T0 + 2 * hour)], [("https://x.com/a", "<title>A</title>", T0 + 3 * hour), ("https://x.com/n", "<title>N</title>", T0)]),
        ([("/b", "t", "title", "B", T0 + 60 * hour), ("/c", "x", "unknown", "C", T0)], [("https://x.com/c", "<title>C</title>", T0 + 60 * hour)]),
        ([("/d", "t", "title", "D", T0 + 200 * hour)], [("https://x.com/e", "<title>E</title>", T0 + 200 * hour)]),
    ]
    got = []
    for rows, pages in steps:
        write(spark, rows, row, tmp_path / "rows")
        write(spark, pages, "url string, html string, fetched_at timestamp", tmp_path / "pages")
        out = jobs.audit_arriving_rows(
            jobs.read_snapshots(spark, str(tmp_path / "pages"), "url string, html string, fetched_at timestamp"),
            jobs.read_snapshots(spark, str(tmp_path / "rows"), row),
            "https://x.com",
        )
        query = (
            out.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
            .foreachBatch(lambda df, _: got.extend(df.collect()))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    assert sorted((r.url, r.expected, r.status) for r in got) == [("https://x.com/a", "A", "passed"), ("https://x.com/b", "Z", "failed")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_small_batch_needs_few_messages_and_a_large_one_is_stored_in_blocks():
    from pyspark.sql import Row

    calls = []

    class Counting(FakeState):
        def __getattribute__(self, name):
            if name in ("getValue", "updateValue", "containsKey", "exists", "get", "update", "iterator"):
                calls.append(name)
            return super().__getattribute__(name)

        def get(self, *_):
            return dict.get(self, None)

        def getValue(self, key):
            return dict.get(self, key)

    class Handle(FakeHandle):
        def getMapState(self, name, *_):
            return self.states.setdefault(name, Counting())

        getValueState = getMapState

    def event(n, idx, status, value=8):
        return Row(batch_id="b", seq=n, ts=None, us=n * 1000, idx=idx, filename=f"f{idx}", status=status, value=value)

    own, handle = jobs.BatchProgress(), Handle()
    own.init(handle)
    rows = [event(0, -1, "created"), *(event(i + 1, i, "error" if i == 3 else "done") for i in range(8))]
    (got,) = own.handleInputRows(("b",), iter(rows), None)
    assert (got.total, got.completed, got.errored, got.status) == (8, 8, 1, "done")
    assert len(calls) <= 4 and len(handle.timers) == 1

    own, handle = jobs.BatchProgress(), Handle()
    own.init(handle)
    items = [event(i + 1, i, "error" if i % 9 == 0 else "done") for i in range(5000)]
    random.Random(5).shuffle(items)
    (got,) = own.handleInputRows(("b",), iter([*items, event(0, -1, "created", 5000)]), None)
    assert (got.total, got.completed, got.errored, got.status) == (5000, 5000, 556, "done")
    assert handle.states["totals"][None][-1] == 5_000_000 and len(handle.states["settled"]) == 79


def test_waiting_entries_are_stored_in_blocks():
    import pandas as pd

    own, handle = jobs.RunComparison(retention_ms=1000), FakeHandle()
    own.init(handle)
    columns = ["ts", "run_no", "run_id", "key", "is_end"]
    rows = [(pd.Timestamp(10 * n, unit="ms"), n, f"r{n}", f"k{i}", False) for n in (1, 2) for i in range(500 * n, 500 * n + 1000) for _ in range(2)]
    ends = [(pd.Timestamp(10 * n + 5, unit="ms"), n, f"r{n}", None, True) for n in (1, 2)]
    for frame in (pd.DataFrame(rows + ends[:1], columns=columns), pd.DataFrame(ends[1:], columns=columns)):
        assert list(own.handleInputRows(("s", 0), iter([frame]), None)) == []
    assert len(handle.states["waiting"]) == 2
    out = []
    for at in sorted(handle.timers):
        info = type("Info", (), {"getExpiryTimeInMs": lambda self, at=at: at})()
        out += [(r.run_id, r.change) for f in own.handleExpiredTimer(("s", 0), None, info) for r in f.itertuples(index=False)]
    counted = {x: out.count(x) for x in set(out)}
    assert counted == {("r1", "new"): 1000, ("r2", "fixed"): 500, ("r2", "still"): 500, ("r2", "new"): 500}
    assert handle.states["waiting"] == {} and len(handle.states["failing"]) == 1000
