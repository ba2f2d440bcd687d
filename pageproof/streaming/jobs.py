"""The audits as Structured Streaming jobs.

Each job is a transformation of a stream, plus a small ``start_*`` that picks
a sink; state is keyed so that it spreads, and expires so that it stays small.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageproof.functions.urls import normalize_url, resolve_url
from pageproof.operators.checks import check_registry, dispatch, field_results, page_facts

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
RETENTION_MS = 2 * 60 * 60 * 1000
PROGRESS = "batch_id string, total bigint, completed bigint, errored bigint, current_filename string, status string"
CHANGE = "source_path string, key string, run_id string, change string"


def use_rocksdb(spark: SparkSession) -> None:
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)


def read_snapshots(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def audit_snapshots(
    snapshots: DataFrame, audit_rows: DataFrame, base_url: str = "", same: Sequence[str] = ()
) -> DataFrame:
    """Field checks on every arriving snapshot; a stream-static equi-join on
    the resolved URL, stateless, so throughput follows the executors. ``same``
    names columns of both sides that must agree too, as the id of a capture: a
    URL captured twice then meets each row once."""
    rows = dispatch(audit_rows).where("family = 'field'").withColumn(
        "resolved_url", resolve_url("url", F.lit(base_url))
    )
    facts = page_facts(snapshots, tuple(same)).withColumnRenamed("url", "resolved_url")
    joined = facts.join(rows, ["resolved_url", *same]).withColumn("load_error", F.lit(None).cast("string"))
    return field_results(joined, check_registry())


def audit_arriving_rows(
    snapshots: DataFrame,
    audit_rows: DataFrame,
    base_url: str = "",
    fetched: str = "fetched_at",
    listed: str = "listed_at",
    period: str = "1 day",
    same: Sequence[str] = (),
) -> DataFrame:
    """Field checks where check rows arrive too: a row and a snapshot of its page
    at most ``period`` apart, equal in the columns ``same``, give one result,
    whichever came first. Both sides' state is narrow (rows, and facts without markup) and leaves when the
    watermarks are past it. Rows and snapshots without a time meet nothing; names
    of the two time columns must differ."""
    rows = dispatch(audit_rows.withWatermark(listed, period)).where("family = 'field'")
    rows = rows.withColumn("resolved_url", resolve_url("url", F.lit(base_url))).drop("url")
    facts = page_facts(snapshots.withWatermark(fetched, period), (fetched, *same))
    apart = F.expr(f"`{listed}` between `{fetched}` - interval {period} and `{fetched}` + interval {period}")
    facts = facts.withColumnsRenamed({"url": "page_url", **{c: f"_{c}" for c in same}})
    met = reduce(and_, [F.col(f"_{c}") == F.col(c) for c in same], F.col("page_url") == F.col("resolved_url"))
    joined = facts.join(rows, met & apart)
    return field_results(joined.withColumn("load_error", F.lit(None).cast("string")), check_registry())


def first_per_period(snapshots: DataFrame, ts: str = "fetched_at", period: str = "1 day") -> DataFrame:
    """One snapshot per page and period: spellings of one URL are one page,
    and keys leave the state once the watermark passes."""
    return (
        snapshots.withColumn("page_key", normalize_url("url", "url"))
        .withWatermark(ts, period)
        .dropDuplicatesWithinWatermark(["page_key"])
    )


def one_per_period(snapshots: DataFrame, ts: str = "fetched_at", period: str = "1 day") -> DataFrame:
    """One snapshot per page and calendar period of its own clock, with the
    period's start as ``period``. Rows up to one period late count; a period's
    keys leave the state when the watermark is past it, so the state holds three
    periods at most, however long the stream runs. Rows without a time are dropped."""
    keyed = snapshots.where(F.col(ts).isNotNull()).withColumn("page_key", normalize_url("url", "url"))
    return (
        keyed.withColumn("period", F.window(ts, period)["start"])
        .withWatermark(ts, period)
        .dropDuplicatesWithinWatermark(["page_key", "period"])
    )


class BatchProgress(StatefulProcessor):
    """Progress of a batch. Events: created (value = item count), running,
    done, error, aborted; any other is ignored. What a batch comes to depends on
    its events alone, ordered by (ts, seq), and not on the order they arrive in:
    state keeps the first "created" and "aborted", the last "running", and the
    first settlement of each item. Only as many settlements as the batch has items
    count, and none after "aborted", which fails the items left. What arrives
    before its batch's "created" waits for it. A batch is dropped two hours after
    it finished, never before. Rows are taken chunk by chunk, so a large batch is
    never held whole. Settlements are stored in blocks of neighbouring items: each
    call to the state is a message to the JVM, and a small batch needs a handful."""

    FIELDS = {
        "total": "bigint", "created_us": "bigint", "created_seq": "bigint", "aborted_us": "bigint", "aborted_seq": "bigint",
        "running_us": "bigint", "running_seq": "bigint", "current": "string", "settled": "bigint", "errored": "bigint",
        "finished_us": "bigint",
    }
    CHUNK = 2000
    BLOCK = 64
    NO_TIME_US = -(2**63) // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", ", ".join(f"{name} {kind}" for name, kind in self.FIELDS.items()))
        self.settled = handle.getMapState(
            "settled", "block int", "idx array<int>, us array<bigint>, seq array<bigint>, failed array<boolean>"
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.totals.get()
        state = dict.fromkeys(self.FIELDS) | {"settled": 0, "errored": 0}
        if known is not None:
            state = dict(zip(self.FIELDS, known, strict=True))
        blocks = {}
        while chunk := list(islice(rows, self.CHUNK)):
            blocks = self._take(state, chunk)
        completed, errored = self._counted(state, blocks)
        self.totals.update(tuple(state.values()))
        finished = state["finished_us"] is not None
        if finished:
            self.handle.registerTimer(self._expiry_ms(state))
        if state["total"] is None:
            return
        yield Row(
            batch_id=key[0],
            total=state["total"],
            completed=completed,
            errored=errored,
            current_filename=None if finished else state["current"],
            status="done" if finished else "running",
        )

    def _take(self, state: dict, chunk: list[Row]) -> dict[int, dict]:
        """Take events in; returns the blocks of settlements that they touch."""
        found: dict[int, dict] = {}
        for e in chunk:
            status = e.status
            if status not in ("created", "aborted", "running", "done", "error"):
                continue
            at = (self.NO_TIME_US if e.us is None else e.us, int(e.seq))
            if status in ("done", "error"):
                own, item = found.setdefault(int(e.idx) // self.BLOCK, {}), int(e.idx)
                if item not in own or at < own[item][:2]:
                    own[item] = (*at, status == "error")
                continue
            known = (state[f"{status}_us"], state[f"{status}_seq"])
            if known[0] is not None and (at <= known if status == "running" else at >= known):
                continue
            state[f"{status}_us"], state[f"{status}_seq"] = at
            if status == "created":
                state["total"] = int(e.value)
            elif status == "running":
                state["current"] = e.filename
        return {block: self._settle(state, block, own) for block, own in found.items()}

    def _settle(self, state: dict, block: int, own: dict) -> dict:
        stored = self.settled.getValue((block,))
        items = {} if stored is None else self._items(stored)
        changed = False
        for item, at in own.items():
            known = items.get(item)
            if known and known[:2] <= at[:2]:
                continue
            items[item], changed = at, True
            state["settled"] += known is None
            state["errored"] += at[2] - (known is not None and known[2])
        if changed:
            us, seq, failed = (list(column) for column in zip(*items.values(), strict=True))
            self.settled.updateValue((block,), (list(items), us, seq, failed))
        return items

    @staticmethod
    def _items(stored: tuple) -> dict[int, tuple]:
        idx, us, seq, failed = stored
        return dict(zip(idx, zip(us, seq, failed, strict=True), strict=True))

    def _counted(self, state: dict, blocks: dict[int, dict]) -> tuple[int, int]:
        """Completed and failed items; sets ``finished_us``. Items are read again
        only where the batch has finished and ``blocks`` lack some of them."""
        total, aborted = state["total"], (state["aborted_us"], state["aborted_seq"])
        state["finished_us"] = None
        if total is None or (aborted[0] is None and state["settled"] < total):
            return state["settled"], state["errored"]
        whole = sum(map(len, blocks.values())) == state["settled"]

        def items() -> Iterator[tuple]:
            stored = blocks.values() if whole else (self._items(value) for _, value in self.settled.iterator())
            every = (v for own in stored for v in own.values())
            return (v for v in every if aborted[0] is None or v[:2] < aborted)

        n = errored = 0
        last = state["created_us"]
        for us, _, failed in items():
            n, errored, last = n + 1, errored + failed, max(last, us)
        if n > total:
            first = heapq.nsmallest(total, items())
            n, errored = total, sum(failed for _, _, failed in first)
            last = max([state["created_us"], *(us for us, _, _ in first[-1:])])
        if n < total:
            errored, last = errored + total - n, max(state["created_us"], aborted[0])
        state["finished_us"] = last
        return total, errored

    @staticmethod
    def _expiry_ms(state: dict) -> int:
        return state["finished_us"] // 1000 + RETENTION_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.totals.get()
        if known is None:
            return iter([])
        state = dict(zip(self.FIELDS, known, strict=True))
        # A timer of an earlier finish than the one now known does not count.
        if state["finished_us"] is not None and expiredTimerInfo.getExpiryTimeInMs() >= self._expiry_ms(state):
            self.totals.clear()
            self.settled.clear()
        return iter([])

    def close(self) -> None:
        pass


def batch_progress(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """events(batch_id, seq, ts, idx, filename, status, value). Retention
    follows event time, so a replay gives the same states."""
    return (
        events.withWatermark("ts", lateness)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy("batch_id")
        .transformWithState(BatchProgress(), outputStructType=PROGRESS, outputMode="Update", timeMode="EventTime")
    )


class EntryTransitions(StatefulProcessor):
    """Failing state of one entry across a source's runs. Input rows say for
    (source, key) whether it fails in a run; a change is emitted per run. Runs are
    compared in the order of their numbers: one that arrives after a later run
    has been judged comes too late and changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failing = handle.getValueState("failing", "failing boolean, run_no bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        before, last = self.failing.get() if self.failing.exists() else (False, None)
        for r in pd.concat(list(rows)).sort_values("run_no").itertuples(index=False):
            if last is not None and r.run_no <= last:
                continue
            now, last = bool(r.failing), int(r.run_no)
            if before or now:
                out.append((key[0], key[1], r.run_id, "still" if before and now else "new" if now else "fixed"))
            before = now
        self.failing.update((before, last))
        yield pd.DataFrame(out, columns=["source_path", "key", "run_id", "change"])

    def close(self) -> None:
        pass


def regression_feed(observations: DataFrame) -> DataFrame:
    """observations(source_path, key, run_no, run_id, failing). State is one
    flag per (source, key), so no source gathers in one task."""
    return observations.groupBy("source_path", "key").transformWithStateInPandas(
        EntryTransitions(), outputStructType=CHANGE, outputMode="Append", timeMode="None"
    )


class RunComparison(StatefulProcessor):
    """Changes of a source's failing entries from one finished run to the next,
    for one bucket of its keys. Entries of a run wait until it has ended and the
    watermark has passed its end; an entry of the run before that is absent then
    is fixed. Runs that end in time are compared in the order of their numbers,
    however their rows arrive; a run that ends after a later one was judged gives
    rows of change ``late``, one per entry, and moves nothing. Entries of runs
    that never end are dropped with the next run that does. A bucket's state is dropped
    once the source has had no run for the retention period. Waiting entries are
    stored in blocks, one for a chunk of rows and run: each call to the state is a
    message to the JVM."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run_no bigint, block bigint", "keys array<string>")
        self.blocks = handle.getValueState("blocks", "n bigint")
        self.ends = handle.getMapState("ends", "run_no bigint", "run_id string, at_ms bigint")
        self.failing = handle.getMapState("failing", "key string", "run_no bigint")
        self.last = handle.getValueState("last", "run_no bigint, at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = n = self.blocks.get()[0] if self.blocks.exists() else 0
        for chunk in rows:
            is_end = chunk["is_end"].astype(bool)
            for r in chunk[is_end].itertuples(index=False):
                at_ms = r.ts.value // 1_000_000
                self.ends.updateValue((int(r.run_no),), (r.run_id, at_ms))
                self.handle.registerTimer(at_ms)
            for run_no, keys in chunk[~is_end].groupby("run_no")["key"]:
                self.waiting.updateValue((int(run_no), n), (list(keys.unique()),))
                n += 1
        if n > before:
            self.blocks.update((n,))
        return iter([])

    def _judge(self, run_no: int) -> Iterator[tuple[str, str]]:
        """(key, change) of a run; its entries become those of the run before."""
        last = self.last.get()[0] if self.last.exists() else None
        late = last is not None and run_no <= last
        now, past, gone = set(), {}, []
        for (n, block), (keys,) in self.waiting.iterator():
            if n == run_no:
                now.update(keys)
            elif n < run_no and n not in past:
                past[n] = not self.ends.containsKey((n,))
            if n == run_no or past.get(n):
                gone.append((n, block))
        for block in gone:
            self.waiting.removeKey(block)
        if late:
            yield from ((k, "late") for k in sorted(now))
            return
        before = {k[0] for k, _ in self.failing.iterator()}
        for k in sorted(before | now):
            yield k, "still" if k in before and k in now else "new" if k in now else "fixed"
        self.failing.clear()
        for k in now:
            self.failing.updateValue((k,), (run_no,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((n[0], *v) for n, v in self.ends.iterator() if v[1] <= at)
        for run_no, run_id, at_ms in due:
            out = [(key[0], k, run_id, change) for k, change in self._judge(run_no)]
            self.ends.removeKey((run_no,))
            known = self.last.get() if self.last.exists() else (run_no, at_ms)
            self.last.update((max(run_no, known[0]), max(at_ms, known[1])))
            self.handle.registerTimer(max(at_ms, known[1]) + self.retention_ms)
            if out:
                yield pd.DataFrame(out, columns=["source_path", "key", "run_id", "change"])
        if not due and self.last.exists() and at >= self.last.get()[1] + self.retention_ms:
            for state in (self.waiting, self.blocks, self.failing, self.last):
                state.clear()

    def close(self) -> None:
        pass


def run_changes_feed(
    events: DataFrame, lateness: str = "1 day", retention_ms: int = 90 * 24 * 3_600_000, buckets: int = 16
) -> DataFrame:
    """Changes between finished runs. ``events`` (source_path, ts, run_no, run_id,
    key, is_end): a failing entry of a run, or with ``is_end`` that the run is over,
    in event time not before its entries. A source's keys are dealt to ``buckets``,
    each of which hears of every end, so no source gathers in one task."""
    own = F.array(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = events.withColumn("bucket", F.explode(F.when(F.col("is_end"), every).otherwise(own)))
    return (
        dealt.withWatermark("ts", lateness)
        .groupBy("source_path", "bucket")
        .transformWithStateInPandas(
            RunComparison(retention_ms), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"
        )
    )


def start_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", key: str | None = None):
    """Write a stream as parquet; with ``key`` each micro-batch goes through
    foreachBatch under its batch id, so a replay overwrites itself."""
    if key is None:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").start(path)

    def write(batch: DataFrame, batch_no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{key}={batch_no}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def run_bounded(stream: DataFrame, collect: Callable[[DataFrame], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, handing batches to ``collect``."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, _: collect(df))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
