"""What the operators share: tables, the shared folder, fixed definitions.

Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. On UTF-8 bytes, ``bytes.split()`` cuts at just
these six, and ``bytes.lower()`` changes A-Z alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.session import shared_folder, ship_package

#: Bytes of one Arrow batch, so that very long texts keep workers' memory flat.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000

_stored: list[tuple[SparkSession, str]] = []


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and byte-bounded batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later passes read
    results, not the work, and a lost executor loses nothing. ``drop_stored``
    removes the tables once their results have been consumed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pageproof-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Remove every table that ``stored`` has written in this process."""
    while _stored:
        spark, path = _stored.pop()
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text is a multiple of 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0
