"""Benchmark decontamination (operator 8): a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (an item of fewer
words is one window). Its shingles of up to three words are ordered by rarity in
the documents; a document that holds the window must hold its rarest shingle, so
a prefix of one shingle per window is enough. Steps:

1. one pass over the documents keeps the positions whose shingle occurs in any
   item (:func:`_positions`); the rarity of an item shingle is its count there;
2. each window's rarest shingle joins those positions; the length and positional
   bounds (the window must lie inside the document) prune;
3. a pair is verified exactly: the words of the whole window, carried with each
   kept position, must be equal.

Documents pass as native rows; the item side is only broadcast after its rows
(of fixed width) were counted, and shuffled beyond that. No document word is
dropped or capped: a shingle that is common in the documents only makes more kept
positions, and its windows join on a rarer one if they have any.

Defined results: null or word-less texts have no words, no hits and the digest of
the empty string; items without words are ignored; items with the same text each
count; repeated rows of one ``doc_id`` and text give equal rows; empty tables give
empty results or documents without hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import write_once

SHINGLE = 3
WIDTH = 10
BROADCAST_ROWS = 2_000_000   # of 16 bytes each: the item side is broadcast up to here
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(t, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def windows_of(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows: window (text), size, items (ids)."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("size"))
    w = w.select("item_id", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    return w.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("words")).distinct()


def _shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    keyed = _keyed(docs, doc_id, text)
    per_doc = contaminated(keyed, items, item_id, item_text, width)
    out = keyed.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    same = out["doc_id"].eqNullSafe(per_doc["doc_id"]) & (out["key"] == per_doc["key"])
    none = F.array().cast("array<string>")
    return out.join(per_doc, same, "left").select(
        out["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", none)), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their own columns.
    Only the ids of the others are joined to the texts: Spark broadcasts them while
    they are below its threshold and shuffles beyond it."""
    bad = contaminated(_keyed(docs, doc_id, text), items, item_id, item_text, width).select("doc_id", "key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(doc_id).alias("doc_id"), _key(text).alias("key"))
    same = rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["key"] == bad["key"])
    return rows.join(bad, same, "left_anti").select("row.*")


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Words per row; a row is known by its id and the hash of its text."""
    return docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"), words(F.col(text)).alias("w"))


def contaminated(keyed: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    """doc_id, key, n_hit, ids (of items, as sorted strings) of rows with a window."""
    windows = write_once(windows_of(items, item_id, item_text, width), "decontaminate-windows")
    distinct = windows.select("words", "size").distinct().withColumn(
        "window", F.xxhash64(F.lit("w"), F.concat_ws(" ", "words")))
    offsets = F.sequence(F.lit(0), F.greatest(F.col("size") - SHINGLE, F.lit(0)))
    sizes = F.least(F.col("size"), F.lit(SHINGLE))
    grams = distinct.select("window", "words", "size", sizes.alias("k"), F.explode(offsets).alias("offset"))
    by_size = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        by_size = F.when(F.col("k") == k, _shingle(F.col("words"), F.col("offset"), k)).otherwise(by_size)
    grams = write_once(grams.withColumn("shingle", by_size), "decontaminate-shingles")
    lookup = grams.select("shingle", "k").distinct()
    n, ks = lookup.agg(F.count(F.lit(1)), F.collect_set("k")).first()  # one row; k is 1, 2 or 3

    keyed = keyed.withColumn("n_words", F.size("w").cast("long"))
    hits = write_once(_positions(keyed, lookup, n, sorted(ks), width), "decontaminate-positions")

    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("found"))
    order = Window.partitionBy("window").orderBy(F.col("found"), F.col("offset"))
    # a window with a shingle found nowhere is in no document
    prefix = (grams.join(rarity, "shingle").withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("window")))
              .where(F.col("have") == F.greatest(F.col("size") - SHINGLE + 1, F.lit(1)))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1)
              .select("shingle", "offset", "size", "words", "window"))
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    # the words around a position are kept from `left` words before it
    equal = F.slice("around", F.col("left") - F.col("offset") + 1, F.col("size")) == F.col("words")
    found = hits.join(prefix, "shingle").where(inside).where(equal)
    found = write_once(found.select("doc_id", "key", start.alias("start"), "size", "words"),
                       "decontaminate-found")

    before = F.max(F.col("start") + F.col("size")).over(
        Window.partitionBy("doc_id", "key").orderBy("start", "size")
        .rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce(before, F.lit(0))))
    spans = found.groupBy("doc_id", "key", "start").agg(F.max("size").alias("size"))
    n_hit = spans.withColumn("new", covered).groupBy("doc_id", "key").agg(F.sum("new").cast("long").alias("n_hit"))
    of_item = (found.select("doc_id", "key", "words").distinct().join(windows, "words")
               .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")))
    return write_once(n_hit.join(of_item, ["doc_id", "key"]), "decontaminate-documents")


def _positions(keyed: DataFrame, lookup: DataFrame, n: int, ks: list[int], width: int) -> DataFrame:
    """Positions of the documents whose shingle occurs in an item, with the words
    around them (``width`` on both sides)."""
    at = keyed.select("doc_id", "key", "n_words", "w", F.posexplode("w").alias("at", "_word"))
    grams = [at.withColumn("k", F.lit(k)).withColumn("shingle", _shingle(F.col("w"), F.col("at"), k)) for k in ks]
    small = lookup.select("shingle")
    if n <= BROADCAST_ROWS:
        small = F.broadcast(small)
    out = None
    for k, g in zip(ks, grams):
        g = g.where(F.col("at") + k <= F.col("n_words")).join(small, "shingle", "left_semi")
        out = g if out is None else out.unionByName(g)
    if out is None:  # no item has a word
        out = at.limit(0).withColumn("k", F.lit(0)).withColumn("shingle", F.lit(0).cast("long"))
    left = F.least(F.col("at"), F.lit(width))
    return out.select("doc_id", "key", "n_words", "at", "shingle", left.alias("left"),
                      F.slice("w", F.col("at") - left + 1, left + width).alias("around"))
