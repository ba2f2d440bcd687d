"""Failing entries, run-to-run comparison, retention and the run store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageproof.operators.ordered import latest_per_key, ordered_scan

KEEP_SNAPSHOTS = 20
STRETCH = 30 * 24 * 3600 * 1_000_000  # 30 days in microseconds
ENTRY = ["run_id", "seq", "key", "category", "url", "description"]


def failing_entries(checks=None, redirects=None, links=None, accessibility=None) -> DataFrame:
    """Keyed entries of the four result families; each input needs run_id and
    seq. Passing families are filtered before anything else."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = []
    if checks is not None:
        parts.append(
            checks.where("status = 'failed'").select(
                "run_id",
                "seq",
                F.concat(F.lit("seoCheck:"), "url", F.lit(":"), "check_type").alias("key"),
                F.lit("seoCheck").alias("category"),
                "url",
                F.concat(
                    "check_type", F.lit(' — expected "'), s("expected"), F.lit('", found "'), s("actual"), F.lit('"')
                ).alias("description"),
            )
        )
    if redirects is not None:
        parts.append(
            redirects.where("result <> 'PASS'").select(
                "run_id",
                "seq",
                F.concat(F.lit("redirect:"), "original_url").alias("key"),
                F.lit("redirect").alias("category"),
                F.col("original_url").alias("url"),
                F.concat("result", F.lit(" (status "), s("status_code"), F.lit(") — "), "recommendation").alias("description"),
            )
        )
    if links is not None:
        parts.append(
            links.where("status <> 'PASS'").select(
                "run_id",
                "seq",
                F.concat(F.lit("brokenLink:"), "page_url", F.lit(":"), "link").alias("key"),
                F.lit("brokenLink").alias("category"),
                F.col("page_url").alias("url"),
                F.concat("message", F.lit(" ("), "link", F.lit(", status "), s("status_code"), F.lit(")")).alias("description"),
            )
        )
    if accessibility is not None:
        v = accessibility.select("run_id", "seq", "url", F.explode("violations").alias("v"))
        parts.append(
            v.select(
                "run_id",
                "seq",
                F.concat(F.lit("accessibility:"), "url", F.lit(":"), "v.id").alias("key"),
                F.lit("accessibility").alias("category"),
                "url",
                F.concat(
                    "v.id",
                    F.lit(" ("),
                    F.coalesce("v.impact", F.lit("n/a")),
                    F.lit(" impact, "),
                    F.col("v.nodeCount").cast("string"),
                    F.lit(" node(s))"),
                ).alias("description"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_entries(entries: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """A repeated key keeps its last entry."""
    return latest_per_key(entries, list(keys), "seq")


def compare_entries(previous: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """fixed / new / still per key, one full outer join; texts come from the
    current run where it has the entry."""
    on = [*keys, "key"]
    side = lambda df, p: unique_entries(df, on).select(
        *on, *[F.col(c).alias(f"{p}_{c}") for c in ("category", "url", "description")], F.lit(True).alias(f"in_{p}")
    )
    both = side(previous, "p").join(side(current, "c"), on, "full_outer")
    pick = lambda c: F.when(F.col("in_c"), F.col(f"c_{c}")).otherwise(F.col(f"p_{c}")).alias(c)
    return both.select(
        *on,
        F.when(F.col("in_p") & F.col("in_c"), "still").when(F.col("in_p"), "fixed").otherwise("new").alias("change"),
        pick("category"),
        pick("url"),
        pick("description"),
    )


def compare_two_runs(entries: DataFrame, baseline: str, target: str) -> DataFrame:
    """Both runs by id, filters pushed to the entry table."""
    return compare_entries(entries.where(F.col("run_id") == baseline), entries.where(F.col("run_id") == target))


def change_counts(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("fixed", "new", "still")])


def previous_runs(runs: DataFrame) -> DataFrame:
    """Add ``previous_run_id`` to runs(source_path, run_id, saved_at), read in
    time order. Runs of a source are scanned in stretches of 30 days, so a
    source holding most runs is split."""
    at = F.unix_micros(F.col("saved_at").cast("timestamp"))
    scanned = ordered_scan(
        runs.withColumn("_at", at), ["source_path"], "_at", prev={"previous_run_id": F.col("run_id")}, segment_rows=STRETCH
    )
    return scanned.drop("_at")


def compare_last_two(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Newest run of every source against the one before; sources with a
    single run have nothing to compare. Two runs per source are kept before
    anything else happens."""
    two = retained_snapshots(runs, 2)
    newest = previous_runs(two).where("previous_run_id is not null").select("source_path", "run_id", "previous_run_id")
    return _changes(newest, entries).drop("run_id")


def run_changes(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every run against its predecessor, all sources at once: an entry of
    the run before is looked up under the next run's id."""
    return _changes(previous_runs(runs).where("previous_run_id is not null"), entries)


def _changes(step: DataFrame, entries: DataFrame) -> DataFrame:
    current = entries.join(step.select("source_path", "run_id"), "run_id")
    previous = (
        entries.withColumnRenamed("run_id", "previous_run_id")
        .join(step.select("source_path", "run_id", "previous_run_id"), "previous_run_id")
        .drop("previous_run_id")
    )
    return compare_entries(previous, current, ["source_path", "run_id"])


def retained_snapshots(runs: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Newest snapshots of each source. ``row_number() <= k`` is cut before
    the shuffle too, so a busy source ships k rows per task at most."""
    newest = Window.partitionBy("source_path").orderBy(F.desc("saved_at"), F.desc("run_id"))
    return runs.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= keep).drop("_r")


def upsert_runs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records replace stored ones of the same id; within incoming
    the last (by seq) wins. Returns the table to write."""
    columns = store.columns
    fresh = latest_per_key(incoming, ["id"], "seq").select(*columns)
    return store.join(fresh.select("id"), "id", "left_anti").select(*columns).unionByName(fresh)


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest first, payload columns left unread except for a flag."""
    return runs.select(
        "id", "type", "filename", "url", "created_at", "status", "error", "summary",
        F.col("expected_content").isNotNull().alias("has_expected_content"),
    ).orderBy(F.desc("created_at"), "id")


def latest_runs(runs: DataFrame, n: int = 6) -> DataFrame:
    return list_runs(runs).limit(n)


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def search_runs(runs: DataFrame, text: str = "", kind: str = "all") -> DataFrame:
    out = runs if kind == "all" else runs.where(F.col("type") == kind)
    q = text.lower()
    hit = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return out.where(hit("filename") | hit("url")) if text else out


def batch_item_lookup(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Batch items with their run record, or why there is none."""
    known = runs.select(F.col("id").alias("audit_id"), F.lit(True).alias("_found"), F.col("status").alias("run_status"))
    note = (
        F.when(
            (F.col("status") == "error") | F.col("audit_id").isNull(),
            F.concat(F.lit("This blog could not be tested: "), F.coalesce("error", F.lit("unknown error")), F.lit(".")),
        ).when(F.col("_found").isNull(), F.lit("This blog's audit record could not be found."))
    )
    return items.join(known, "audit_id", "left").withColumn("note", note).drop("_found")
