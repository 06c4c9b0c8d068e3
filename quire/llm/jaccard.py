"""N-gram Jaccard join (operator 2): rare-first prefix filtering.

Documents whose sets of distinct word shingles have a Jaccard similarity of at
least ``pct`` per cent are linked; the result is each document's set size and the
smallest id of its component.

1. Documents with equal sets form a class; only its smallest id goes on, so a
   group of copies is one vertex.
2. *Document filter.* In any fixed order of shingles, two sets that link share at
   least ``l`` shingles of their first ``n - ceil(pct n) + l``. In hash order,
   with ``l`` in proportion to the set, documents without that many shared ones
   leave: this is exact, and only a fifth of the shingles is shuffled.
3. *Rare-first prefixes* of the rest: shingles are counted and each set is
   ordered by (count, hash); its first ``n - ceil(pct n) + 1`` are its prefix. A
   set whose prefix has only shingles of its own has no partner.
4. *Pairs* share a prefix shingle and pass the length, positional and suffix
   filters. First each document meets one hub (the document of the fewest rarer
   shingles under its shingles), and links join components; then all pairs that
   still lie in different components are met. Pairs inside one component need no
   check: they can't change the result. So a group of near copies costs pairs in
   proportion to its size, unless its members really differ.
5. Each pair is verified once, by the exact intersection of both sets.

Shingles are 64-bit hashes of word hashes. No cap, sample or cut is applied to
rows, groups or candidates.

Defined results: null or word-less texts have an empty set and link with nothing
(their component is their own id); ids are keys, so rows that repeat an id share
a vertex; a null id takes part in its class but is nobody's component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.components import components
from quire.llm.tables import write_once

SHARE = 0.05                # l of the document filter, as a part of the set
BINS = 16                   # parts of the suffix filter
BROADCAST_ROWS = 1_000_000  # ids (16 bytes each) that may be broadcast; more are shuffled


def _needed(n: np.ndarray, pct: int) -> np.ndarray:
    """Least overlap of a set of n with any set it links to: ceil(pct n / 100)."""
    return -(-(pct * n) // 100)


def _share(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.floor(SHARE * n).astype(np.int64))


def _keys_of(text, shingle, n):
    """Two sums over each set; equal sets have equal sums."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(n), np.uint64)
        np.add.at(sums, text, W.mix(shingle ^ np.uint64(salt)))
        out.append(sums.view(np.int64))
    return out


def _lists(counts, values):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                    pa.array(values.view(np.int64)))


def set_keys(k: int):
    """Kernel: id, size of the set, two keys of the set."""
    def run(batches):
        for batch in batches:
            for block in W.word_blocks(batch.column(1), lower=True):
                text, shingle = W.distinct_shingles(block, k)
                n = np.bincount(text, minlength=block.n_texts)
                k1, k2 = _keys_of(text, shingle, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), pa.array(n.astype(np.int64)),
                     pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"])
    return run


def set_prefixes(k: int, pct: int):
    """Kernel: id, key, least number of shared shingles, prefix in hash order."""
    def run(batches):
        for batch in batches:
            for block in W.word_blocks(batch.column(1), lower=True):
                text, shingle = W.distinct_shingles(block, k)
                n = np.bincount(text, minlength=block.n_texts)
                k1, _ = _keys_of(text, shingle, n)
                size = np.minimum(n, n - _needed(n, pct) + _share(n))
                rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), pa.array(k1),
                     pa.array(_share(_needed(n, pct))), _lists(size, shingle[rank < size[text]])],
                    ["doc_id", "k1", "least", "prefix"])
    return run


def whole_sets(k: int):
    """Kernel: id, key, size, set, sizes of the set's parts by hash."""
    def run(batches):
        for batch in batches:
            for block in W.word_blocks(batch.column(1), lower=True):
                text, shingle = W.distinct_shingles(block, k)
                n = np.bincount(text, minlength=block.n_texts)
                k1, _ = _keys_of(text, shingle, n)
                part = np.bincount(text * BINS + (shingle >> np.uint64(60)).astype(np.int64) % BINS,
                                   minlength=block.n_texts * BINS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), pa.array(k1), pa.array(n.astype(np.int64)),
                     _lists(n, shingle), _lists(np.full(block.n_texts, BINS), part.astype(np.int64))],
                    ["doc_id", "k1", "n", "shingles", "parts"])
    return run


def _long(n: Column, m: Column, pct: int) -> Column:
    """Length filter."""
    return 100 * F.least(n, m) >= pct * F.greatest(n, m)


def _overlap(n: Column, m: Column, pct: int) -> Column:
    """Least intersection of two linked sets of these sizes."""
    return F.ceil(pct * (n + m) / F.lit(100.0 + pct) - F.lit(1e-9))


def _only(df: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` in ``keep``: broadcast up to a counted bound, else shuffled."""
    return df.join(F.broadcast(keep) if keep.count() <= BROADCAST_ROWS else keep, on, "left_semi")


def ngram_jaccard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4,
                  pct: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``."""
    kind = dict(docs.dtypes)[doc_id]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = write_once(source.mapInArrow(set_keys(k), f"doc_id {kind}, n long, k1 long, k2 long"), "jaccard-keys")
    classes = write_once(keys.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("v"), F.first("n").alias("n")).where("v is not null"), "jaccard-classes")

    links = _links(source.where("doc_id is not null"), classes, kind, k, pct)
    comp = write_once(components(links, "jaccard-links"), "jaccard-components")
    of_class = classes.join(comp, "v", "left").select(
        "k1", "k2", F.coalesce("component", "v").alias("component"))
    out = keys.where("n > 0").join(of_class, ["k1", "k2"], "left").unionByName(
        keys.where("n = 0").withColumn("component", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, pct: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id. Rows that
    repeat an id are reduced to one; rows without an id stay.

    Only the ids that go are joined to the texts: Spark broadcasts them while they
    are below its threshold and shuffles beyond it."""
    result = write_once(ngram_jaccard(docs, doc_id, text, k, pct), "jaccard-result")
    gone = write_once(result.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(),
                      "jaccard-gone")
    twice = write_once(result.where("doc_id is not null").groupBy(F.col("doc_id").alias("twice"))
                       .agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("twice"), "jaccard-twice")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"))
    kept = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    once = kept.join(twice, F.col("id") == F.col("twice"), "left_anti")
    again = kept.join(twice, F.col("id") == F.col("twice"), "left_semi")
    first = again.groupBy("id").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return once.select("row.*").unionByName(first.select("row.*"))


def _links(source: DataFrame, classes: DataFrame, kind: str, k: int, pct: int) -> DataFrame:
    """Verified links (a, b) that give the same components as all links."""
    # sets of under 1 / (1 / pct - 1) shingles link with equal sets only
    smallest = int(np.ceil(pct / (100 - pct)))
    vertices = classes.where(F.col("n") >= smallest).select(F.col("v").alias("doc_id"), "k1")
    rows = source.mapInArrow(set_prefixes(k, pct), f"doc_id {kind}, k1 long, least long, prefix array<long>")
    rows = _only(rows.where(F.size("prefix") > 0), vertices, ["doc_id", "k1"])
    tokens = rows.select("doc_id", "k1", "least", F.explode("prefix").alias("h"))
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    shared = tokens.join(common, "h").groupBy("doc_id", "k1").agg(
        F.count(F.lit(1)).alias("c"), F.first("least").alias("least"))
    rest = write_once(shared.where("c >= least").select("doc_id", "k1"), "jaccard-rest")

    sets = _only(source, rest.select("doc_id"), ["doc_id"]).mapInArrow(
        whole_sets(k), f"doc_id {kind}, k1 long, n long, shingles array<long>, parts array<long>")
    sets = write_once(sets.join(F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest, ["doc_id", "k1"],
                                "left_semi").dropDuplicates(["doc_id", "k1"])
                      .withColumnRenamed("doc_id", "v"), "jaccard-sets")
    prefix = write_once(_rare_first(sets, pct), "jaccard-prefixes")

    stars = write_once(_verified(_hub_pairs(prefix, pct), sets, pct), "jaccard-stars")
    comp = write_once(components(stars, "jaccard-stars"), "jaccard-star-components")
    more = _verified(_cross_pairs(prefix, comp, sets, pct), sets, pct)
    return stars.unionByName(write_once(more, "jaccard-more"))


def _rare_first(sets: DataFrame, pct: int) -> DataFrame:
    """(h, v, n, own, pos): prefix shingles that two sets or more have. Shingles of one
    set alone come first in its order, so only their number, ``own``, is needed."""
    tokens = sets.select("v", "n", F.explode("shingles").alias("h"))
    df = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = tokens.join(df, "h").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    size = F.col("n") - F.ceil(F.lit(pct) * F.col("n") / F.lit(100.0)) + 1
    own = F.col("n") - F.size("s")
    mine = mine.withColumn("own", own).withColumn("size", size.cast("int")).where("own < size")
    mine = mine.select("v", "n", "own", F.posexplode(F.slice("s", F.lit(1), F.least(
        F.col("size") - F.col("own"), F.size("s").cast("long")).cast("int"))).alias("at", "x"))
    return mine.select(F.col("x.h").alias("h"), "v", "n", "own", (F.col("own") + F.col("at")).alias("pos"))


def _meet(pct: int) -> Column:
    """Length and positional filters of two rows (n, own, pos) and (m, own2, at) that
    share a shingle.

    Of two linked sets, the first common shingle has no more than n - o before it in
    either order, o being their least overlap; and what can be common is at most the
    shared shingles before this one, this one, and those after it."""
    n, m, pos, at, own, own2 = (F.col(c) for c in ("n", "m", "pos", "at", "own", "own2"))
    o = _overlap(n, m, pct)
    bound = F.least(pos - own, at - own2) + 1 + F.least(n - pos - 1, m - at - 1)
    return _long(n, m, pct) & (pos <= n - o) & (at <= m - o) & (bound >= o)


def _hub_pairs(prefix: DataFrame, pct: int) -> DataFrame:
    """One pair per document: with the hub under which most of its prefix lies."""
    hubs = prefix.groupBy("h").agg(F.min(F.struct("pos", "v", "n", "own")).alias("hub"), F.count(F.lit(1)).alias("c"))
    hubs = hubs.where("c > 1").select("h", F.col("hub.v").alias("b"), F.col("hub.n").alias("m"),
                                      F.col("hub.own").alias("own2"), F.col("hub.pos").alias("at"))
    met = prefix.join(hubs, "h").where((F.col("v") != F.col("b")) & _meet(pct))
    met = met.groupBy("v", "n", "b", "m").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("v").agg(F.max(F.struct("c", "b", "n", "m")).alias("x"))
    return best.select(F.col("v").alias("a"), F.col("x.b").alias("b"))


def _cross_pairs(prefix: DataFrame, comp: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """All pairs that share a prefix shingle, pass the filters and lie in
    different components so far."""
    p = prefix.join(comp, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")
    mixed = p.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
    p = write_once(p.join(mixed, "h", "left_semi"), "jaccard-mixed")
    a = p.select("h", F.col("v").alias("a"), "n", "own", "pos", F.col("c").alias("ca"))
    b = p.select("h", F.col("v").alias("b"), F.col("n").alias("m"), F.col("own").alias("own2"),
                 F.col("pos").alias("at"), F.col("c").alias("cb"))
    n, m, pos, at = (F.col(c) for c in ("n", "m", "pos", "at"))
    met = a.join(b, "h").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _meet(pct))
    met = met.groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("pos"),
                                              F.max("at").alias("at"))
    # up to the last shingle they met by exactly c are common
    met = met.where(F.col("c") + F.least(n - pos - 1, m - at - 1) >= _overlap(n, m, pct))
    parts = sets.select("v", "parts")
    met = met.join(parts.withColumnsRenamed({"v": "a", "parts": "pa"}), "a").join(
        parts.withColumnsRenamed({"v": "b", "parts": "pb"}), "b")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return met.where(apart <= n + m - 2 * _overlap(n, m, pct)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs whose whole sets link."""
    full = sets.select("v", "n", "shingles")
    both = pairs.join(full.withColumnsRenamed({"v": "a", "shingles": "sa"}), "a").join(
        full.withColumnsRenamed({"v": "b", "n": "m", "shingles": "sb"}), "b")
    o = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * o >= pct * (F.col("n") + F.col("m") - o)).select("a", "b")
