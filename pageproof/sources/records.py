"""Page snapshots, probe logs, engine results and stored run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.session import spread

PAGES = "page_id bigint, url string, fetched_at timestamp, html string"
HTTP_LOG = "url string, final_url string, status int, response_ms bigint, error string"
ACCESSIBILITY = (
    "url string, status string, violations array<struct<id:string,impact:string,description:string,"
    "helpUrl:string,nodeCount:int>>, passCount int, incompleteCount int, fetchedAt string"
)
PERFORMANCE = (
    "url string, scores struct<performance:double,accessibility:double,bestPractices:double,seo:double>, "
    "fetchedAt string, error string"
)
RUN_RECORD = (
    "id string, type string, filename string, url string, createdAt string, status string, error string, "
    "summary string, report string, expectedContent string"
)


def read_pages(spark: SparkSession, path: str, columns: str = PAGES) -> DataFrame:
    return spread(spark.read.schema(columns).parquet(path))


def read_http_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HTTP_LOG).parquet(path)


def read_accessibility(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACCESSIBILITY).json(path)


def read_performance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PERFORMANCE).json(path)


def read_run_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stored JSON records, one document per file, or with ``lines`` one per line,
    so that large files are split; ``corrupt`` holds the text of those that could
    not be read."""
    return (
        spark.read.schema(RUN_RECORD + ", corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .option("multiLine", not lines)
        .json(path)
    )


def import_counts(records: DataFrame) -> DataFrame:
    bad = F.col("corrupt").isNotNull() | F.col("id").isNull()
    return records.agg(
        F.count_if(~bad).alias("migrated"), F.count_if(bad).alias("failed"), F.count("*").alias("total")
    )
