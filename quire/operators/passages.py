"""A stored chunk table that hits are attached to without moving it.

The table is bucketed by chunk id. The distinct ids of a hit list, whatever its size, are
dealt to the same buckets, so the join reads the chunks where they lie: no exchange and
no sort on their side. Only the texts of chunks that were hit go on to the hits.

* A hot chunk (one that a third of the questions hit) is one id in the bucketed join; the
  join of hits and texts after it is an ordinary one, which adaptive execution splits.
* Up to ``max_literals`` distinct ids are also a literal filter, so Spark skips the
  buckets without a hit. It changes what is read, never the rows.

Null ids and ids that the table lacks attach nothing. An id stored twice gives a row for
each. An empty hit list or table gives no rows.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, keep_table

CHUNK_FIELDS = ("chunk_text", "source_file", "page_number")


class ChunkStore(NamedTuple):
    """Name of the bucketed table, its key and its number of buckets."""

    name: str
    key: str
    buckets: int


def store_chunks(chunks: DataFrame, key: str = "chunk_id", name: str | None = None, path: str | None = None,
                 buckets: int | None = None) -> ChunkStore:
    """Write ``chunks`` once, bucketed and sorted by ``key``, one file a bucket. Choose
    ``buckets`` so that one is about a scan split; the default is the session's number of
    shuffle partitions. Without a name the table is temporary (:func:`quire.session.drop_tables`)."""
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name or f"chunk_store_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_dir(spark)}/tables/{table}"
    (chunks.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    if name is None:
        keep_table(table, path)
    return ChunkStore(table, key, buckets)


def fetch(ids: DataFrame, store: ChunkStore, cols=CHUNK_FIELDS, max_literals: int = 1000) -> DataFrame:
    """(iid, fields) of the stored chunks whose id is in the one column of ``ids``."""
    spark = ids.sparkSession
    distinct = ids.toDF("iid").where("iid is not null").distinct()
    chunks = spark.table(store.name).select(F.col(store.key).alias("iid"), *cols)
    few = [r["iid"] for r in distinct.limit(max_literals + 1).collect()] if max_literals else []
    if few and len(few) <= max_literals:
        chunks = chunks.where(F.col("iid").isin(few))
    return chunks.join(distinct.repartition(store.buckets, "iid").hint("shuffle_hash"), "iid")


def attach_stored(hits: DataFrame, store: ChunkStore, cols=CHUNK_FIELDS, max_literals: int = 1000) -> DataFrame:
    """J7 over a :class:`ChunkStore`: hits (qid, iid, ...) + chunk fields. ``hits`` is read
    more than once: pass a written table."""
    return fetch(hits.select("iid"), store, cols, max_literals).join(hits, "iid")
