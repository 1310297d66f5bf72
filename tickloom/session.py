"""Session defaults and the shared scratch area for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tickloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package expects; ``master`` is for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only for local masters, where driver and executors are one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")


def _staged_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/staged/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str, paths: list | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one result feeds several passes (counts, then rows). The written table cuts the
    lineage, survives the loss of executors, prunes columns per pass and gives the optimizer a
    real size, so that joins against it are broadcast only when it is small. ``paths`` gets the folder.
    """
    spark = df.sparkSession
    path = f"{_staged_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared area that :func:`release_staged` removes with the staged tables."""
    return f"{_staged_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_staged(spark: SparkSession) -> None:
    """Remove what this application has staged; call it when no result is needed any more."""
    drop_path(spark, _staged_root(spark))
