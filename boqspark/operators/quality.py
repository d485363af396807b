"""Data-quality metrics, gates, batch checksums and the cost catalog."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dealt

MIN_COVERAGE, MAX_ANOMALY = 0.80, 0.10


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    """Shares of linked rows, of dictionary or standard keys, and of anomalies; counts by source."""
    share = lambda cond: F.avg(cond.cast("double"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("material_dict_id").isNotNull()).alias("coverage"),
        share(F.col("match_key_source").isin("dict", "std")).alias("key_quality"),
        share(F.col("anomaly_flag") == "error").alias("error_rate"),
        share(F.col("anomaly_flag") != "normal").alias("anomaly_rate"),
        *[F.count_if(F.col("data_source_type") == s).alias(f"n_{s}") for s in ("completed", "control_price", "pending_review")],
    )


def gate(m: DataFrame) -> DataFrame:
    """Whether a set of rows may enter the catalog, and what is missing."""
    covered, calm = F.col("coverage") >= MIN_COVERAGE, F.col("anomaly_rate") < MAX_ANOMALY
    why = F.concat_ws(";", F.when(~covered, "coverage"), F.when(~calm, "anomaly"))
    return m.withColumns({"passes": covered & calm, "blockers": why, "coverage_gap": F.greatest(F.lit(0.0), MIN_COVERAGE - F.col("coverage"))})


def batch_checksum(df: DataFrame) -> DataFrame:
    """Active rows, total and SHA-256 of the rows of each batch in the order of sequence, id.

    The hash runs over one long text by definition: the rows of a batch stream through its task in order, and only the state of
    the hash is held, whatever the length of the batch.
    """
    line = F.concat_ws(":", F.col("sequence").cast("string"), F.coalesce("item_code", F.lit("")), "item_name", F.col("total_cents").cast("string"))
    rows = df.filter("active").select("import_batch_id", "sequence", "id", F.col("total_cents").cast("long").alias("total_cents"), line.alias("line"))
    kind = rows.schema["import_batch_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["import_batch_id", "n", "total_cents", "checksum"]
        key, n, total, digest = None, 0, None, hashlib.sha256()
        for b in batches:
            keys, cents, lines = b.column(0), b.column(3).to_pylist(), b.column(4).to_pylist()
            done = []
            for k, c, text in zip(keys.to_pylist(), cents, lines, strict=True):
                if n and k != key:
                    done.append((key, n, total, digest.hexdigest()))
                    n, total, digest = 0, None, hashlib.sha256()
                digest.update(("|" + text if n else text).encode())
                key, n, total = k, n + 1, total if c is None else (total or 0) + c
            key_type = keys.type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (key_type, pa.int64(), pa.int64(), pa.string()), strict=True)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([digest.hexdigest()])], names)

    ordered = dealt(rows, "import_batch_id").sortWithinPartitions("import_batch_id", "sequence", "id", "line")
    return ordered.mapInArrow(run, f"import_batch_id {kind}, n long, total_cents long, checksum string")


def reconciled(parsed: DataFrame, stated: DataFrame) -> DataFrame:
    """parsed: import_batch_id, total_cents of the lines; stated: the same from the summary row. agrees within one cent or 0.1 percent; null if nothing is stated."""
    j = parsed.join(stated.select("import_batch_id", F.col("total_cents").alias("stated_cents")), "import_batch_id", "left")
    off = F.abs(F.col("total_cents") - F.col("stated_cents"))
    return j.withColumns({"off_cents": off, "agrees": (off <= 1) | (off <= 0.001 * F.abs(F.col("stated_cents")))})


def filled_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, share: how many rows have something in each column."""
    some = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("double")
    one = df.agg(F.count("*").alias("n"), *[F.avg(some(c)).alias(c) for c in columns])
    return one.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', n, {c}" for c in columns) + ") AS (field, n, share)"))


def batch_kpis(items: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: batches, those in the bin, active items, anomalies and their share."""
    b = batches.agg(F.count_if("active").alias("n_batches"), F.count_if(~F.col("active")).alias("n_recycled"))
    odd = F.coalesce(F.col("anomaly_flag") != "normal", F.lit(False))
    i = items.filter("active").agg(F.count("*").alias("n_items"), F.count_if(odd).alias("n_anomalies"))
    return b.join(F.broadcast(i)).withColumn("anomaly_rate", F.coalesce(F.try_divide(F.col("n_anomalies"), F.col("n_items")), F.lit(0.0)))  # one row each


def progress(df: DataFrame) -> DataFrame:
    """One row over active items: shares of standardised, priced and linked ones in percent, and what is left to do of each."""
    done = {"standard": F.col("std_name").isNotNull(), "priced": F.col("unit_rate_cents").isNotNull(), "linked": F.col("material_dict_id").isNotNull()}
    out = df.filter("active").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in done.items()], F.count_if(F.col("anomaly_flag") != "normal").alias("todo_anomalies"))
    pct = {f"pct_{k}": F.round(F.coalesce(F.try_divide(100 * F.col(f"n_{k}"), F.col("n")), F.lit(0.0)), 1) for k in done}
    return out.withColumns(pct | {f"todo_{k}": F.col("n") - F.col(f"n_{k}") for k in done})


def catalog(df: DataFrame) -> DataFrame:
    """A row per match key: plain average, least, greatest, count and the fields of the newest row."""
    newest = F.max(F.struct("price_period", "id", "item_name", "unit_std", "province", "unit_rate_cents"))
    out = df.groupBy("match_key").agg(
        (F.sum("unit_rate_cents") / F.count("unit_rate_cents")).alias("avg_rate"), F.min("unit_rate_cents").alias("min_rate"), F.max("unit_rate_cents").alias("max_rate"),
        F.count("*").alias("n"), newest.alias("_new"),
    )
    last = {"latest_period": "price_period", "item_name": "item_name", "unit_std": "unit_std", "latest_province": "province", "latest_rate": "unit_rate_cents"}
    return out.select("match_key", "avg_rate", "min_rate", "max_rate", "n", *[F.col(f"_new.{v}").alias(k) for k, v in last.items()])


def catalog_preview(c: DataFrame, prefix: str = "", low: int = 3) -> DataFrame:
    # asked of the finished rows: pushed below the aggregation, the test would repeat all branches of the key
    named = F.when(F.col("n") > 0, F.col("match_key"))
    return c.filter(named.startswith(prefix)).select("match_key", "n", "avg_rate", (F.col("n") < low).alias("low_sample"))


def merge_catalog(old: DataFrame, new: DataFrame, manual: list[str]) -> DataFrame:
    """New numbers replace old ones; manual columns keep what people wrote; keys only in old stay."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.match_key").eqNullSafe(F.col("n.match_key")), "full")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}")) if c in manual else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return j.select(*[pick(c).alias(c) for c in old.columns])


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: rows only in a, only in b, equal and different (null equals null)."""
    left = a.select(F.col(key).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(key).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    j = left.join(right, F.col("_a") == F.col("_b"), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    parts = ", ".join(f"'{c}', a_{c} <=> b_{c}" for c in columns)
    long = j.select("_a", "_b", both.alias("both"), F.expr(f"stack({len(columns)}, {parts}) AS (field, same)"))
    return long.groupBy("field").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("both") & F.col("same")).alias("equal"), F.count_if(F.col("both") & ~F.col("same")).alias("different"),
    )
