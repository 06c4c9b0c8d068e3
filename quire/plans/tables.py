"""Readers for the given Parquet tables.

Plans select only the columns they need, so Catalyst prunes the scan
(ReadSchema) and pushes filters into it. A table stored in fewer splits
than the cluster has cores is hash-partitioned by its key after the scan, so
CPU-heavy text work is spread; big inputs already have enough splits and
are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.files import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

TABLE_KEYS = {
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id"], "conversations": ["conv_id", "turn"], "events": ["event_id"],
    "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "nation": ["n_nationkey"], "region": ["r_regionkey"], "lineitem": ["l_orderkey"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TABLE_KEYS.get(name))
