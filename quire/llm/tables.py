"""Readers, shared-folder tables and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, materialize, ship_package

__all__ = ["bounded_sample", "checkpoint_dir", "materialize", "read", "write_once"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, as stored; Spark's own reader splits it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back (cuts the
    lineage; survives lost executors)."""
    ship_package(df.sparkSession)
    return materialize(df, label)


def bounded_sample(rows: DataFrame, n: int) -> list[Row]:
    """At most ``n`` distinct rows, those of the smallest hash, in a fixed order.

    The distinct rows are counted first (by their hashes, so that only those are
    shuffled) and filtered by a hash bound that about ``n`` of them pass. What reaches
    the driver does not grow with the rows or with the tasks (a sorted limit would send
    ``n`` rows from each task), and copies of a row change nothing."""
    key = F.xxhash64(*rows.columns)
    total = rows.select(key.alias("_key")).distinct().count()
    if total > 1.2 * n:
        rows = rows.where(key < F.lit(int(-(1 << 63) + 1.2 * n / total * (1 << 64))))
    got = rows.distinct().withColumn("_key", key).collect()
    got.sort(key=lambda r: (r["_key"], [str(x) for x in r]))
    return got[:n]
