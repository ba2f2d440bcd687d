"""Run records as a stored table in hash buckets of their ids.

A bucket is a folder, so what touches a few ids reads and rewrites the buckets of
these alone. Inside a bucket, rows are sorted by id and files carry a Bloom filter
on it, so a lookup reads the pages that can hold the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.operators.ordered import latest_row
from pageproof.session import materialized

BUCKETS = 64


def bucket_of(run_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _write(runs: DataFrame, path: str, buckets: int) -> None:
    """Replace the buckets that ``runs`` has rows of; others stay as they are."""
    placed = runs.withColumn("bucket", bucket_of(F.col("id"), buckets))
    placed.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(path)


def create_store(runs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new table at ``path``; of rows with one id, the greatest by created_at. A
    store without any row needs a first upsert to exist."""
    _write(latest_row(runs.where("id is not null"), ["id"], ["created_at"]), path, buckets)


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored runs; ``schema`` without the bucket. Columns are read as asked."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, bucket int").parquet(path)


def upsert_store(store: DataFrame, incoming: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Put ``incoming`` into the table at ``path``: its rows replace stored ones of
    the same id, and of one id the greatest by created_at comes in. Only buckets of
    incoming ids are read and rewritten; returns how many. ``store`` is the table
    as ``read_store`` gives it."""
    columns = [c for c in store.columns if c != "bucket"]
    fresh = materialized(latest_row(incoming.where("id is not null").select(*columns), ["id"], ["created_at"]))
    # At most as many numbers as there are buckets.
    touched = [r["b"] for r in fresh.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect()]
    if not touched:
        return 0
    kept = store.where(F.col("bucket").isin(touched)).drop("bucket").join(fresh.select("id"), "id", "left_anti")
    # Stored before the folders that it was read from are replaced.
    _write(materialized(kept.select(*columns).unionByName(fresh)), path, buckets)
    return len(touched)


def find_run(store: DataFrame, run_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The run of an id: one bucket is listed, and its files are filtered by id."""
    in_bucket = F.col("bucket") == bucket_of(F.lit(run_id), buckets)
    return store.where(in_bucket & (F.col("id") == run_id)).drop("bucket")


def import_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, failures) of records as ``read_run_records`` gives them: those that can
    be stored, and (record, reason) of each that can't."""
    bad = F.col("corrupt").isNotNull()
    nameless = F.coalesce(F.col("id"), F.lit("")) == ""
    runs = records.where(~bad & ~nameless).drop("corrupt").withColumnsRenamed(
        {"createdAt": "created_at", "expectedContent": "expected_content"}
    )
    reason = F.when(bad, F.lit("not readable")).when(nameless, F.lit("no id"))
    known = F.struct(*[c for c in records.columns if c != "corrupt"])
    record = F.coalesce("corrupt", F.to_json(known))
    return runs, records.where(bad | nameless).select(record.alias("record"), reason.alias("reason"))
