"""Bills and the catalog as stored tables: what changes is rewritten by partition, behind its gate.

A bill lies in a folder with a partition per import batch; the catalog in one with a partition per hash of its key. Changes read
the partitions that they touch, write them to the shared folder first, and then replace these partitions only. So a job that
is run again after a failure does the same once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from ..sources import ingest
from . import merge, quality

BUCKETS = 64


def write_batches(rows: DataFrame, path: str) -> None:
    """Rows of some batches in place of what the table has of these."""
    cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_batch_id").parquet(path)


def read_batches(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """The bill, or the partitions of some batches."""
    rows = spark.read.parquet(path)
    return rows if batches is None else rows.filter(F.col("import_batch_id").isin(*batches))


def set_active(spark: SparkSession, path: str, batches: list[int], active: bool) -> int:
    """Soft deletion or restoration of batches with all their rows: only their partitions change. Rows that now are otherwise than before."""
    rows = read_batches(spark, path, batches)
    changed = rows.filter(~F.col("active").eqNullSafe(F.lit(active))).count()
    if changed:
        write_batches(merge.soft_delete(rows, batches, restore=active), path)
    return changed


def _folder(spark: SparkSession, path: str):
    """The folder as Hadoop sees it, and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def purge(spark: SparkSession, path: str, batches: DataFrame, snapshots: str, today: Column, grace_days: int = 30) -> list[int]:
    """Remove deleted batches for good: import_batch_id of those that went. batches: import_batch_id, name, confirm_name, deleted_at.

    First the gate (name repeated, days of grace over), then a snapshot of all rows in `snapshots`, read back and counted; only then is the
    partition dropped. A batch that fails either keeps its partition.
    """
    asked = merge.purge_allowed(batches.withColumn("snapshot_ok", F.lit(True)), today, grace_days).filter("may_purge").select("import_batch_id")
    gone = []
    for (batch,) in asked.orderBy("import_batch_id").collect():  # batches of one request
        ingest.snapshot(read_batches(spark, path, [batch]), batch, f"{snapshots}/batch-{batch}")
        folder, files = _folder(spark, f"{path}/import_batch_id={batch}")
        if files.exists(folder) and not files.delete(folder, True):
            raise OSError(f"could not drop {folder}")
        gone.append(batch)
    return gone


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("match_key"), F.lit(buckets)).cast("int"))


def write_catalog(spark: SparkSession, path: str, lines: DataFrame, manual: list[str], batch: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The catalog after the lines of a batch (of all, without one) have been taken in; the gate's row.

    lines: priced lines with keys, of all batches: a key's numbers come from all its lines. Lines that do not pass the gate (coverage
    and anomalies, over the batch) raise an error before anything is written. Numbers replace old ones, `manual` columns keep what people
    wrote; only the partitions that hold a key of the batch are read and replaced.
    """
    own = lines if batch is None else lines.filter(F.col("import_batch_id") == batch)
    gate = cut(quality.gate(quality.metrics(own)))
    row = gate.first()
    if not row["passes"]:
        raise ValueError(f"the catalog gate is closed: {row['blockers']}")
    keys = own.select("match_key").distinct()
    new = quality.catalog(lines.join(keys.withColumnRenamed("match_key", "_key"), F.col("match_key").eqNullSafe(F.col("_key")), "left_semi"))
    for c in manual:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast("string"))
    new = cut(_bucketed(new, buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets at most
    folder, files = _folder(spark, path)
    merged = new
    if files.exists(folder):
        old = spark.read.parquet(path).filter(F.col("bucket").isin(*touched)).drop("bucket")
        merged = _bucketed(quality.merge_catalog(old.select(*[c for c in new.columns if c != "bucket"]), new.drop("bucket"), manual), buckets)
    cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return gate
