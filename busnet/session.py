"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable only, so they also apply to a session somebody else opened.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even if that costs a later shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the tile layers keep up to 1000 rows per tile: prune before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers that see this folder import the package from it; elsewhere it is installed or in --py-files
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    worker = spark.sparkContext.environment
    if root not in worker.get("PYTHONPATH", "").split(os.pathsep):
        worker["PYTHONPATH"] = os.pathsep.join(filter(None, [worker.get("PYTHONPATH"), root]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's checkpoint folder; on one machine else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# shuffle files of a query go as soon as it ends, not when the driver happens to collect its plan
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the copy is compressed and columnar, so later reads prune and push down.  With `release` the shuffle
    files of the write are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/busnet/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
