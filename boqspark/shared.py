"""The folder that driver and executors share, and what is written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a checkpoint folder that the session has set; a temporary one on a single machine only."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="boqspark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A setting of Spark's: the shuffle files of an execution go when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str = "rows") -> DataFrame:
    """Materialise as parquet in the shared folder and read again: compressed, and readers take only the columns that they need.

    The shuffle files of this write are freed at its end: what follows starts from the parquet.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, by a shuffle of its own, for what streams through tasks.

    `repartition(*keys)` falls away behind a join by the same keys, whose partitions Spark then splits at run time if they are large
    or one side is small: nothing after the join asks for whole keys. The struct is no key of such a join.
    """
    return df.repartition(F.struct(*keys))
