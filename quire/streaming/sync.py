"""Incremental index sync from arriving files.

``stream_sync`` reads new Parquet files with Structured Streaming
(``Trigger.AvailableNow``: process what is there, then stop; the checkpoint
makes a re-run resume after the last committed batch). Each micro-batch is
upserted into a target folder that is hash-partitioned into buckets on the key,
so a batch rewrites only the buckets it touches (dynamic partition overwrite), some of
them at a time: what a merge shuffles and stages is a share of the target and goes before
the next share, so the disk needed besides source and target does not grow with a batch.
Each stored row keeps its order value, and a deleted key stays as a marker, so the
newest row of a key wins whichever batch brings it: late and repeated files change
nothing, and re-running a batch after a failure writes the same buckets again.
:func:`read_target` leaves the markers out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.index import row_hash
from quire.session import forget, shuffles_dropped, store

BUCKET, ORDER, GONE = "_bucket", "_order", "_gone"     # _order may be missing in a target that a batch build wrote

SHARE = 4, 8        # buckets merged at a time: so many at least, and this part of all


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Write ``df`` as the target layout: Parquet partitioned by key bucket."""
    (df.withColumn(BUCKET, bucket_of(key, buckets))
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path): the target may be in any store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored_schema(schema: T.StructType, key: list[str], values: list[str], order_col: str | None) -> T.StructType:
    """What the target's files hold: key, values, order, deletion marker, bucket."""
    order = schema[order_col].dataType if order_col else T.LongType()
    return T.StructType([*(T.StructField(c, schema[c].dataType) for c in key + values), T.StructField(ORDER, order),
                         T.StructField(GONE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])


def read_target(spark: SparkSession, path: str, schema: T.StructType, key: list[str], values: list[str]) -> DataFrame:
    """The target table (key + values)."""
    known = T.StructType([*(schema[c] for c in key + values), T.StructField(GONE, T.BooleanType())])
    return spark.read.schema(known).parquet(path).where(~F.coalesce(F.col(GONE), F.lit(False))).select(*key, *values)


def upsert(batch: DataFrame, target_path: str, key: list[str], values: list[str], buckets: int,
           deleted_col: str | None = None, order_col: str | None = None) -> None:
    """Merge one batch into the bucketed target (J6 restricted to the batch's buckets).

    Of all rows of one key, stored or new, the one of the largest ``order_col`` stays
    (without it: of the latest batch); a missing order is the smallest, equal ones
    fall back to the largest content hash. Rows with ``deleted_col`` true leave a
    marker. Null keys are keys like others."""
    spark = batch.sparkSession
    schema = stored_schema(batch.schema, key, values, order_col)
    gone = F.coalesce(F.col(deleted_col), F.lit(False)) if deleted_col else F.lit(False)
    order = F.col(order_col) if order_col else F.lit(0).cast("long")
    fresh = batch.select(*key, *values, order.alias(ORDER), gone.alias(GONE)).withColumn(BUCKET, bucket_of(key, buckets))
    touched = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())      # at most ``buckets`` values
    if not touched:
        return
    if not order_col:
        old = spark.read.schema(schema).parquet(target_path).where(F.col(BUCKET).isin(touched))
        fresh = fresh.withColumn(ORDER, F.lit((old.agg(F.max(ORDER)).first()[0] or 0) + 1).cast("long"))
    share = max(SHARE[0], buckets // SHARE[1])
    for at in range(0, len(touched), share):
        some = F.col(BUCKET).isin(touched[at:at + share])
        old = spark.read.schema(schema).parquet(target_path).where(some)
        merged = _latest(old.select(*fresh.columns).unionByName(fresh.where(some)), key, values)
        staged = store(merged, "upsert")  # never overwrite a path the same plan reads
        # by bucket, so that a bucket is one file: tasks times buckets would grow with the square of the input
        with shuffles_dropped(spark):
            (staged.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("compression", "zstd").partitionBy(BUCKET).parquet(target_path))
        forget(staged)


def _latest(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The row of the largest order of each key; grouping keeps null keys together."""
    payload = [*values, ORDER, GONE]
    newest = F.struct(F.col(ORDER).isNotNull(), F.col(ORDER), row_hash([*values, GONE]))
    return rows.groupBy(*key, BUCKET).agg(F.max_by(F.struct(*payload), newest).alias("_v")).select(*key, "_v.*", BUCKET)


def stream_sync(spark: SparkSession, source_path: str, target_path: str, schema: T.StructType,
                key: list[str], values: list[str], checkpoint: str, buckets: int = 64,
                max_files_per_trigger: int | None = None, deleted_col: str | None = None,
                order_col: str | None = None) -> DataFrame:
    """Process every file now in ``source_path`` into ``target_path`` (created if it
    is not there) and return the target table (key + values). ``checkpoint`` names
    the folder that a re-run resumes from."""
    fs, folder = _path(spark, target_path)
    fs.mkdirs(folder)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)
    q = (stream.writeStream
         .foreachBatch(lambda df, _epoch: upsert(df, target_path, key, values, buckets, deleted_col, order_col))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return read_target(spark, target_path, schema, key, values)
