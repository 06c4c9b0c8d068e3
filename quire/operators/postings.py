"""Inverted lists for keyword search (J4, A7), with exact early exclusion.

*Table.* Items are taken in blocks of at most ``BLOCK``. A list has a term's items of a block
and type: their places in the block, frequencies and lengths as arrays. One row holds the
lists of a block's terms of one type and bucket, by the term's hash, and is stored by
both. A build reads the items once; each task makes such rows before the shuffle, so
neither a term nor an entry is a row there, and an entry costs a few
bytes there and on disk; ids, which may be long, are kept once an item, in bucket
``IDS``. A search reads only the buckets of its batch's terms, as partition filters, and
knows items by number until the end. A term's dictionary row holds its document
frequency, largest frequency and shortest item, which bound its share of any score.

*Search.* 1. Each query's rarest terms give partial scores; the k-th best partial is a
lower limit of the k-th best score. 2. The query's most common terms whose bounds
together stay below that limit can't bring an item in; only the other, essential terms
make candidates. 3. The k-th best score by essential terms is a closer limit;
candidates that can't reach it with all remaining bounds go, the rest look up the
common terms by (term, item). So a word that stands in every item
makes no rows for every item, and no score is approximate.

Terms are split and searched in DataFrame expressions; the query side is broadcast only after it was
measured, and shuffled on the term beyond that.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.vectors import terms
from quire.operators.topk import FILTER_COL, TYPE_COL, measured_size
from quire.session import checkpoint_dir, materialize

BUCKETS = 8, 4096           # least and most buckets; one for each ITEMS items between
ITEMS = 4000
FILE_ITEMS = 4000           # a bucket is written in files of about so many items' terms
SEED_ITEMS = 20             # items a result place that the rarest terms should give
EPSILON = 1e-5              # scores are rounded to six digits
BROADCAST_BYTES = 64 << 20
NO_TYPE = ""
BLOCK = 1 << 15             # most items of a block: their places are 16-bit
BLOCK_TERMS = 1 << 23       # most terms of a block of several items, with repeats
IDS = -1                    # the bucket that holds the blocks' ids and lengths


class Postings(NamedTuple):
    """``lists``: term, base, at, tf, dl, type and bucket (item number = base + at);
    ``terms``: term, bucket, df, max_tf, min_dl; the number of items and their mean length;
    ``items``: number and iid; ``repeated``: number and the first number of the same id, of
    ids that occur again, if any do."""

    lists: DataFrame
    terms: DataFrame
    n_docs: float
    avgdl: float
    buckets: int
    items: DataFrame
    repeated: DataFrame | None


def _blocks(kind: pa.DataType, buckets: int):
    """Kernel over (number, iid, type, terms): a row per block with its ids and lengths, and
    one per type and bucket of the block with its terms' places, frequencies and lengths."""
    names = ["bucket", "type", "base", "lists", "dl", "ids"]
    entry = pa.struct([("term", pa.string()), ("at", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32())), ("dl", pa.list_(pa.int32()))])

    def rows(held):
        base, (ids, sizes, types, words) = held[0][0], (list(x) for x in zip(*(h[1:] for h in held)))
        dl = np.concatenate(sizes)
        n = len(dl)
        yield pa.RecordBatch.from_arrays([
            pa.array([IDS], pa.int32()), pa.array([NO_TYPE]), pa.array([base], pa.int64()), pa.nulls(1, pa.list_(entry)),
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(dl)),
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(ids).cast(kind))], names)
        if not dl.any():
            return
        words, types = (pa.chunked_array(x).unify_dictionaries().chunks for x in (words, types))
        vocabulary, kinds = words[0].dictionary, types[0].dictionary
        v = len(vocabulary)
        bucket = np.fromiter((zlib.crc32(w) for w in vocabulary.cast(pa.binary()).to_pylist()), np.int64, v) % buckets
        order = np.argsort(bucket, kind="stable")       # words of a bucket next to each other
        place = np.empty(v, np.int64)
        place[order] = np.arange(v)
        key = np.repeat(np.concatenate([x.indices.to_numpy() for x in types]).astype(np.int64), dl)
        key *= v
        key += place[np.concatenate([x.indices.to_numpy() for x in words])]
        key *= n
        key += np.repeat(np.arange(n, dtype=np.int32), dl)
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.append(first, len(key))).astype(np.int32)
        group, at = np.divmod(key[first], n)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = pa.array(np.append(starts, len(group)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int16), tf, dl[at])]
        of_type, word = np.divmod(group[starts], v)
        word = order[word]
        lists = pa.StructArray.from_arrays([vocabulary.take(pa.array(word)), *lists], fields=list(entry))
        bucket = bucket[word]
        new = np.flatnonzero(np.r_[True, (of_type[1:] != of_type[:-1]) | (bucket[1:] != bucket[:-1])])
        m = len(new)
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[new].astype(np.int32)), kinds.take(pa.array(of_type[new])), pa.array(np.full(m, base)),
            pa.ListArray.from_arrays(pa.array(np.append(new, len(word)).astype(np.int32)), lists),
            pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(kind))], names)

    def pieces(batch):
        """The batch in runs of items within both bounds, their words and types as codes."""
        ends = batch.column(3).offsets.to_numpy().astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_TERMS, "right")) - 1)
            hi = min(hi, lo + BLOCK, batch.num_rows)
            part = batch.slice(lo, hi - lo)
            yield (part.column(0)[0].as_py(), part.column(1), np.diff(ends[lo:hi + 1]).astype(np.int32),
                   part.column(2).dictionary_encode(), part.column(3).flatten().dictionary_encode())
            lo = hi

    def run(batches):
        held, n, size = [], 0, 0
        for batch in batches:
            for piece in pieces(batch):
                more, longer = len(piece[2]), len(piece[4])
                if held and (n + more > BLOCK or size + longer > BLOCK_TERMS or piece[0] != held[0][0] + n):
                    yield from rows(held)
                    held, n, size = [], 0, 0
                held.append(piece)
                n, size = n + more, size + longer
        if held:
            yield from rows(held)
    return run


def _bucket(term, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def build_postings(docs: DataFrame, doc_id: str, text: str, item_type: str | None = None, path: str | None = None,
                   buckets: int | None = None) -> Postings:
    """Write the lists below ``path`` (the checkpoint folder if none is given)."""
    spark = docs.sparkSession
    n = docs.count()
    buckets = buckets or int(np.clip(1 << int(np.log2(max(n / ITEMS, 1))), *BUCKETS))
    spread = -(-n // (buckets * FILE_ITEMS)) or 1
    path = path or f"{checkpoint_dir(spark)}/tables/postings-{uuid.uuid4().hex}"
    of_type = F.coalesce(F.col(item_type).cast("string"), F.lit(NO_TYPE)) if item_type else F.lit(NO_TYPE)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col(doc_id).alias("iid"), of_type.alias("type"),
                       terms(text).alias("toks"))
    shape = f"""base long, lists array<struct<term: string, at: array<short>, tf: array<int>, dl: array<int>>>,
        dl array<int>, ids array<{kind.simpleString()}>"""
    rows = rows.mapInArrow(_blocks(to_arrow_type(kind), buckets), f"bucket int, type string, {shape}")
    part = F.pmod(F.xxhash64("base"), F.when(F.col("bucket") == IDS, buckets).otherwise(F.lit(spread)))
    (rows.repartition("bucket", part).write.mode("overwrite").option("compression", "zstd")
     .partitionBy("type", "bucket").parquet(f"{path}/lists"))
    stored = spark.read.schema(f"{shape}, type string, bucket int").parquet(f"{path}/lists")
    lists = stored.where(F.col("bucket") != IDS).select("base", F.coalesce("type", F.lit(NO_TYPE)).alias("type"), "bucket", F.inline("lists"))
    told = lists.groupBy("bucket", "term").agg(F.sum(F.size("at")).alias("df"), F.max(F.array_max("tf")).alias("max_tf"),
                                               F.min(F.array_min("dl")).alias("min_dl"))
    # dealt by bucket, so that one task writes a bucket: a file each, not one for every task and bucket
    told.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    told = spark.read.schema("term string, df long, max_tf int, min_dl int, bucket int").parquet(f"{path}/terms")
    ids = stored.where(F.col("bucket") == IDS)
    total = ids.agg(F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    items = ids.select("base", F.posexplode("ids").alias("at", "iid")).select((F.col("base") + F.col("at")).alias("number"), "iid")
    again = items.groupBy("iid").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = None
    if not again.isEmpty():
        again = materialize(items.join(again, items["iid"].eqNullSafe(again["iid"])).select("number", "first"), "repeated-ids")
        repeated = again.where(F.col("number") != F.col("first"))
    return Postings(lists, told, float(n), float(total or 0) / n if n else 0.0, buckets, items, repeated)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if measured_size(df)[1] <= BROADCAST_BYTES else df


def _allowed(filter_col, type_col) -> Column:
    return F.col(filter_col).isNull() | (F.col(filter_col) == F.col(type_col))


def _ranked(scores: DataFrame, k: int, tie: str = "number") -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(tie).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_plans(index: Postings, queries: DataFrame, query_id: str, query_text: str, k1: float, b: float,
                 query_filter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(query terms with idf and bound, the stored lists of their buckets and types): what a
    search reads. Buckets and types are literal lists, so they are partition filters."""
    q = queries.select(F.col(query_id).alias("qid"),
                       (F.col(query_filter).cast("string") if query_filter else F.lit(None).cast("string")).alias(FILTER_COL),
                       F.explode(F.array_distinct(terms(query_text))).alias("term"))
    q = materialize(q.withColumn("bucket", _bucket("term", index.buckets)), "query-terms")
    told = q.agg(F.collect_set("bucket"), F.collect_set(FILTER_COL), F.bool_or(F.col(FILTER_COL).isNull())).first()
    buckets, types, open_ = sorted(told[0]), sorted(told[1]), told[2]      # at most `buckets` numbers; the types in use
    lists = index.lists.where(F.col("bucket").isin(buckets))
    if not open_:
        lists = lists.where(F.col("type").isin(types))

    def value(tf, dl):
        return _value(index, tf, dl, k1, b)

    idf = F.log(1.0 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = index.terms.where(F.col("bucket").isin(buckets)).select("term", "bucket", "df", "max_tf", "min_dl")
    qt = known.join(_small(q), ["term", "bucket"]).select(
        "qid", FILTER_COL, "term", "bucket", "df", idf.alias("idf"), (idf * value(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
    return materialize(qt, "query-weights"), lists.withColumnRenamed("type", TYPE_COL)


def _value(index: Postings, tf, dl, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / (index.avgdl or 1.0)))


def _entries(index: Postings, lists: DataFrame, k1: float, b: float, *cols: str) -> DataFrame:
    """A row per entry of ``lists``: ``cols``, the item's number and the entry's weight."""
    one = lists.select(*cols, "base", F.explode(F.arrays_zip("at", "tf", "dl")).alias("e"))
    one = one.select(*cols, (F.col("base") + F.col("e.at")).alias("number"), _value(index, F.col("e.tf"), F.col("e.dl"), k1, b).alias("w"))
    if index.repeated is None:
        return one
    return one.join(_small(index.repeated), "number", "left").select(*cols, F.coalesce("first", "number").alias("number"), "w")


def search(index: Postings, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float, b: float,
           query_filter: str | None = None) -> DataFrame:
    """Exact top ``k``: (qid, iid, score, rank)."""
    qt, lists = search_plans(index, queries, query_id, query_text, k1, b, query_filter)

    def partial(some: DataFrame) -> DataFrame:
        hit = lists.join(_small(some.select("qid", FILTER_COL, "term", "bucket", "idf")), ["term", "bucket"])
        hit = _entries(index, hit.where(_allowed(FILTER_COL, TYPE_COL)), k1, b, "qid", "idf")
        return hit.groupBy("qid", "number").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))

    rare = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = qt.withColumn("_before", F.coalesce(F.sum("df").over(rare), F.lit(0))).where(F.col("_before") < SEED_ITEMS * k)
    limit = _ranked(partial(seeds), k).where(F.col("rank") == k).select("qid", F.col("score").alias("limit"))
    up = Window.partitionBy("qid").orderBy("bound", "term")
    split = qt.join(limit, "qid", "left").withColumn("_upto", F.sum("bound").over(up))
    split = materialize(split.withColumn("essential", F.coalesce(F.col("_upto") >= F.col("limit") - EPSILON, F.lit(True))),
                        "query-split")
    common = split.where(~F.col("essential"))
    rest = common.groupBy("qid").agg(F.sum("bound").alias("rest"), F.first("limit").alias("limit"))
    found = materialize(partial(split.where("essential")), "candidates")
    least = _ranked(found, k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))   # a limit as well
    found = found.join(rest.join(least, "qid", "left"), "qid", "left")
    open_ = found.where(F.col("rest").isNull() | (F.col("score") + F.col("rest") >= F.greatest("limit", "least") - EPSILON))
    open_ = _small(materialize(open_.select("qid", "number", "score", "rest"), "open-numbers"))
    open_ = materialize(index.items.join(open_, "number"), "open-candidates")
    look = open_.where("rest is not null and iid is not null").join(common.select("qid", "term", "bucket", "idf"), "qid").select(
        "qid", "number", "iid", "term", "bucket", "idf")
    # the lists of common terms meet the candidates by (term, item): no row for other items
    asked = lists.join(_small(common.select("term", "bucket").distinct()), ["term", "bucket"], "left_semi")
    more = _entries(index, asked, k1, b, "term", "bucket").join(_small(materialize(look, "lookups")), ["term", "bucket", "number"]).select(
        "qid", "iid", (F.col("idf") * F.col("w")).alias("score"))
    total = open_.select("qid", "iid", "score").unionByName(more).groupBy("qid", "iid").agg(F.round(F.sum("score"), 6).alias("score"))
    return _ranked(total.where("score > 0"), k, "iid")
