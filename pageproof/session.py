"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Page rows are wide: small Arrow batches keep worker memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Skip the per-expression call-site capture: plans here have many nodes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str | int = "*", app: str = "pageproof", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    n = os.cpu_count() or 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, which driver and executors share.
    A local session without it gets a temporary folder for the life of the
    process; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        _own_folders.append(tempfile.TemporaryDirectory(prefix="pageproof-shared-"))
        folder = _own_folders[-1].name
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


def materialized(df: DataFrame) -> DataFrame:
    """The frame as a reliable checkpoint in the shared folder, so that later
    passes read results instead of repeating the work, and a lost executor costs
    no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for markup parsing: a scan with fewer splits than the
    session has cores is redistributed; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_pageproof_shipped", False):
        return spark
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="pageproof-")) / "pageproof.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._pageproof_shipped = True
    return spark
