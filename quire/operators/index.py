"""Keyed index snapshots (S13, S14, J6): diff, apply, status, versions.

Only the key and a 64-bit-pair content hash cross the shuffle for the diff;
the full rows are joined back only for inserted or changed keys.

A stored index (:func:`create_index`, :func:`refresh_index`, :func:`read_index`) keeps
its rows in hash buckets of the key, a change log by version, and for every version a
digest tree: the number of rows and an order-free digest of every bucket and of every
group of buckets. A refresh compares the source's tree with the stored one and reads
only the buckets whose digests differ; equal buckets are skipped without reading a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialize

OPS = ("insert", "update", "delete", "unchanged")


def row_hash(cols: list[str]) -> Column:
    """Content hash of the value columns (sha2 of their JSON form)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)


def _keyed(df: DataFrame, key: list[str], values: list[str], name: str) -> DataFrame:
    return df.select(*key, row_hash(values).alias(name))


def diff_snapshots(source: DataFrame, target: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key..., op) for every key in either snapshot; op in
    insert / update / delete / unchanged. Keys must be unique per side."""
    s = _keyed(source, key, values, "_hs")
    t = _keyed(target, key, values, "_ht")
    j = s.join(t, key, "full_outer")
    op = (F.when(F.col("_ht").isNull(), F.lit("insert"))
          .when(F.col("_hs").isNull(), F.lit("delete"))
          .when(F.col("_hs") != F.col("_ht"), F.lit("update"))
          .otherwise(F.lit("unchanged")))
    return j.select(*key, op.alias("op"))


def sync_index(source: DataFrame, target: DataFrame, key: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changes, new target). The new target keeps unchanged target rows
    and takes source rows for inserted and updated keys; deleted keys go.
    Applying the same source twice gives only 'unchanged' the second time."""
    changes = diff_snapshots(source, target, key, values)
    keep = changes.filter(F.col("op") == "unchanged").select(*key)
    take = changes.filter(F.col("op").isin("insert", "update")).select(*key)
    cols = key + values
    new_target = (target.select(*cols).join(keep, key, "left_semi")
                  .unionByName(source.select(*cols).join(take, key, "left_semi")))
    return changes, new_target


def index_status(source: DataFrame, target: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row - indexed (target rows), missing, stale, extra, ready."""
    ch = diff_snapshots(source, target, key, values)
    agg = ch.agg(
        F.sum(F.when(F.col("op") != "insert", 1).otherwise(0)).cast("long").alias("indexed"),
        F.sum(F.when(F.col("op") == "insert", 1).otherwise(0)).cast("long").alias("missing"),
        F.sum(F.when(F.col("op") == "update", 1).otherwise(0)).cast("long").alias("stale"),
        F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).cast("long").alias("extra"),
    )
    return agg.select("*", ((F.col("missing") == 0) & (F.col("stale") == 0)).alias("ready"))


# ---------------------------------------------------------------------------
# a stored index: buckets, digest tree, change log
# ---------------------------------------------------------------------------

BUCKETS, GROUP = 64, 8        # buckets of an index; buckets in a node above them
_BUCKET, _VERSION = "_bucket", "_version"


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int"))


def digest_tree(df: DataFrame, key: list[str], values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(level, node, n, digest): level 1 has the buckets that hold rows, level 0 groups of
    ``GROUP`` buckets. Digests are exclusive ors of row hashes, combined on the map side,
    so one row a bucket and task is shuffled and the order of rows is of no account."""
    row = F.xxhash64(*[F.col(k) for k in key], row_hash(values))
    leaf = _bucketed(df.select(*key, *values), key, buckets).groupBy(F.col(_BUCKET).alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("digest"))
    leaf = materialize(leaf, "digests")
    top = leaf.groupBy(F.floor(F.col("node") / GROUP).cast("int").alias("node")).agg(
        F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node", "n", "digest")).alias("digest"))
    return top.select(F.lit(0).alias("level"), "*").unionByName(leaf.select(F.lit(1).alias("level"), "*"))


def changed_buckets(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets whose digests differ between two trees, looked at below differing groups only."""
    def differing(level: int, nodes: Column | None) -> list[int]:
        x, y = (t.where(F.col("level") == level) for t in (a, b))
        if nodes is not None:
            x, y = x.where(nodes), y.where(nodes)
        j = x.select("node", F.struct("n", "digest").alias("x")).join(y.select("node", F.struct("n", "digest").alias("y")), "node", "full")
        return sorted(r[0] for r in j.where(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())   # a bucket count at most
    groups = differing(0, None)
    return differing(1, F.floor(F.col("node") / GROUP).cast("int").isin(groups)) if groups else []


def create_index(source: DataFrame, path: str, key: list[str], values: list[str], buckets: int = BUCKETS) -> None:
    """Store ``source``, which is read once, as version 0; its digests are those of the stored rows."""
    rows = _bucketed(source.select(*key, *values), key, buckets)
    rows.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/base")
    known = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in key + values)
    stored = source.sparkSession.read.schema(known).parquet(f"{path}/base")
    digest_tree(stored, key, values, buckets).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree/{_VERSION}=0")


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tree")
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(_VERSION))


def _tree(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/tree/{_VERSION}={version}")


def stored_rows(spark: SparkSession, path: str, schema, key: list[str], values: list[str], version: int,
                buckets: list[int] | None = None) -> DataFrame:
    """Key and values as of ``version``, of all buckets or of some (a partition filter).
    Buckets that no log names are read as they were written; in the others the last log
    row of each key counts."""
    known = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in key + values)
    base = spark.read.schema(f"{known}, {_BUCKET} int").parquet(f"{path}/base")
    logs = [v for v in _versions(spark, path) if 0 < v <= version]
    if buckets is not None:
        base = base.where(F.col(_BUCKET).isin(buckets))
    if not logs:
        return base.select(*key, *values)
    log = spark.read.schema(f"{known}, op string, {_VERSION} int, {_BUCKET} int").parquet(f"{path}/log")
    log = log.where(F.col(_VERSION).isin(logs))
    if buckets is not None:
        log = log.where(F.col(_BUCKET).isin(buckets))
    touched = [r[0] for r in log.select(_BUCKET).distinct().collect()]                # a bucket count at most
    old = base.where(F.col(_BUCKET).isin(touched)).withColumn("op", F.lit("insert")).withColumn(_VERSION, F.lit(0))
    last = old.unionByName(log).groupBy(*key).agg(F.max_by(F.struct(*values, "op"), F.col(_VERSION)).alias("_v"))
    last = last.where(F.col("_v.op") != "delete").select(*key, *[F.col("_v")[c].alias(c) for c in values])
    return base.where(~F.col(_BUCKET).isin(touched)).select(*key, *values).unionByName(last)


def read_index(spark: SparkSession, path: str, schema, key: list[str], values: list[str], version: int | None = None) -> DataFrame:
    """The index as of ``version`` (default: the newest)."""
    return stored_rows(spark, path, schema, key, values, _versions(spark, path)[-1] if version is None else version)


def refresh_index(source: DataFrame, path: str, key: list[str], values: list[str], buckets: int = BUCKETS) -> int:
    """Log what changed between the stored index and ``source`` as the next version
    and return its number. The version's tree is written last, so a refresh that stops
    midway is no version and the next one writes it anew. Applying the same source twice
    logs nothing the second time. The source is read once and kept for the tree, the
    comparison and the log."""
    spark = source.sparkSession
    version = _versions(spark, path)[-1]
    source = materialize(source.select(*key, *values), "index-source")
    mine = materialize(digest_tree(source, key, values, buckets), "source-tree")
    changed = changed_buckets(mine, _tree(spark, path, version))
    new = _bucketed(source.select(*key, *values), key, buckets).where(F.col(_BUCKET).isin(changed))
    old = stored_rows(spark, path, source.schema, key, values, version, changed)
    ops = diff_snapshots(new, old, key, values).where("op <> 'unchanged'")
    log = ops.join(new.select(*key, *values), key, "left")
    _bucketed(log, key, buckets).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/log/{_VERSION}={version + 1}")
    mine.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree/{_VERSION}={version + 1}")
    return version + 1


def change_log(spark: SparkSession, path: str, schema, key: list[str]) -> DataFrame:
    """(version, key, op) of all versions after the first."""
    known = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in key)
    log = spark.read.schema(f"{known}, op string, {_VERSION} int, {_BUCKET} int").parquet(f"{path}/log")
    return log.select(F.col(_VERSION).alias("version"), *key, "op")
