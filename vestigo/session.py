"""Session settings the jobs rely on, the shared scratch folder, and durable lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options results depend on (UTC) and the adaptive ones plans rely on."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # the JVM never compiles a method of more than 8,000 bytes; wide projections run faster without fusion
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # batches to Python are bounded in rows and bytes, so long texts do not fill a worker
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder `spark.checkpoint.dir` names.

    Where it is unset, a folder of this application on the default file system, which executors
    share too. A cluster whose default file system is local has no shared folder to offer, so
    there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    file_system = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
    if file_system.getUri().getScheme() == "file" and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = context._jvm.org.apache.hadoop.fs.Path(f"/tmp/vestigo-{context.applicationId}")
    return file_system.makeQualified(root).toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so an iterative job survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_KEPT: dict[str, list[str]] = {}


def stash(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: computed once, column-pruned
    by each reader, and still there when an executor is lost. `release` deletes it. Compressed by the
    session's codec unless one is named."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stashed(spark: SparkSession) -> list[str]:
    """Paths of the tables stashed so far and not released."""
    return list(_KEPT.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete stashed tables (all by default); call it once results that read them are written."""
    context = spark.sparkContext
    kept = _KEPT.setdefault(context.applicationId, [])
    for path in list(kept) if paths is None else paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        if path in kept:
            kept.remove(path)
