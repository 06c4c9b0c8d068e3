"""Ranked lexical search (operator 11) on bit-sliced Bloom signatures.

*Index.* One pass over the documents gives each a Bloom signature of its terms. A term
of frequency tf is entered once for each level of ``LEVELS`` that tf reaches, so a
signature bounds frequencies, not presence alone. Signatures of about the same size
(powers of two) lie side by side as a matrix of bits that is stored by rows: slice b
holds bit b of all documents of the block. The index doesn't depend on any query.

*Bounds.* A term's documents are the conjunction of the slices its hashes name. Bits set
by chance only add documents or raise a level, so the sum over an item's terms of
weight times the value of the highest possible frequency (with the document's own
length) is never below the score; without chance bits and for low frequencies it is the
score. Each task takes the ``probe`` best bounds of every item, those documents are
scored exactly, and the ``top``-th exact score is the item's limit. A second pass over the
slices finds every document whose bound reaches the limit (a bound equal to it only with
an id that sorts before); all others are provably not in the result. Those are scored
exactly from their whole texts and ranked.

*Sizes.* Items are taken in batches of about ``batch_terms`` distinct terms, so what
travels to the tasks (an item's terms, weights, limits) is bounded; candidates are ids
and are joined to the texts. No group of documents is gathered in a task: equal copies
with an equal bound are excluded by their id.

Terms are compared by 64-bit hashes (a chance match of two has a probability of 2^-64).

Defined results: documents that are null, empty or without a term are not counted in N
and never ranked; an item without a term, or whose terms no document holds, has no row.
Repeated document rows are documents each of their own (equal score, equal id, one rank
each); repeated item rows are ranked each on their own. A null doc_id ranks after all
others of the same score; a null item_id is kept. Texts of any length are read whole; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.tables import write_once
from quire.session import ship_package

LEVELS = np.array([1, 2, 3, 4, 6, 9, 14, 24, 48, 100], np.int64)
HASHES, BITS = 4, 12                 # hash functions; bits of a signature per entry at its fullest
SLICE_BYTES, COLUMNS = 1 << 19, 2048  # of a block at most
CELLS = 1 << 22                      # terms times documents that are bounded at once
BATCH_TERMS = 1 << 15
BROADCAST_ROWS = 500_000             # candidate documents of which (doc_id, key, items) are broadcast
TOP, PROBE = 10, 30
NO_ID = (1 << 63) - 1                # stands for a null doc_id inside


def _entries(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The signature entry of a term at a level."""
    return W.mix(hashes + (levels.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _slices(entries: np.ndarray, many: int) -> np.ndarray:
    """Slice numbers (entries, HASHES) in a signature of ``many`` bits."""
    more = W.mix(entries ^ np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64(0xFFFFFFFF)
    halves = np.stack([entries >> np.uint64(32), entries & low, more >> np.uint64(32), more & low], 1)[:, :HASHES]
    return ((halves * np.uint64(many)) >> np.uint64(32)).astype(np.int64)


def term_counts(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, frequency) of every distinct term of every text, in order."""
    h, text = block.word_hashes(), block.text_of_word()
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def term_score(tf, m):
    """Value of a term of frequency ``tf`` in a document of length norm ``m``, weight aside."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n, n_docs: int, n_terms: int):
    return 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)


# --- index ---------------------------------------------------------------------------


class _Matrix:
    """A block under construction: signatures of one size, as slices."""

    def __init__(self, tier: int):
        self.tier, self.many = tier, BITS << tier
        self.columns = int(np.clip(8 * SLICE_BYTES // self.many // 8 * 8, 8, COLUMNS))
        self.bits = np.zeros((self.many, self.columns // 8), np.uint8)
        self.docs: list[int] = []
        self.keys: list[int] = []
        self.sizes: list[int] = []

    def row(self) -> tuple:
        width = -(-len(self.docs) // 8)
        return (self.tier, self.docs, self.keys, self.sizes, np.ascontiguousarray(self.bits[:, :width]).tobytes())


def sign_texts(batches):
    """Kernel over (doc_id, key, text): blocks of signatures; at the end one row of totals."""
    open_: dict[int, _Matrix] = {}
    n_docs = n_terms = 0

    def rows(found):
        cols = list(zip(*found))
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())],
            names)

    names = ["tier", "docs", "keys", "sizes", "slices", "n_docs", "n_terms"]
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for block in W.word_blocks(batch.column(2), W.ALNUM_BREAKS):
            text, h, tf = term_counts(block)
            level = np.searchsorted(LEVELS, tf, "right")
            entries = np.bincount(text, level, block.n_texts).astype(np.int64)
            full = np.flatnonzero(entries)
            n_docs += len(full)
            n_terms += len(block.starts)
            tiers = np.ceil(np.log2(np.maximum(entries, 16))).astype(int)
            size = np.diff(block.bounds)
            bounds = np.searchsorted(text, np.arange(block.n_texts + 1))
            for tier in np.unique(tiers[full]).tolist():
                mine = full[tiers[full] == tier]
                while len(mine):
                    x = open_.setdefault(tier, _Matrix(tier))
                    now, mine = mine[:x.columns - len(x.docs)], mine[x.columns - len(x.docs):]
                    column = np.arange(len(x.docs), len(x.docs) + len(now))
                    many = np.diff(bounds)[now]
                    at = np.repeat(bounds[now] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    each = np.repeat(column, many)
                    upto = level[at]
                    step = np.arange(int(upto.sum())) - np.repeat(np.cumsum(upto) - upto, upto)
                    col = np.repeat(each, upto)
                    where = _slices(_entries(np.repeat(h[at], upto), step), x.many)
                    flat = (where * x.bits.shape[1] + (col >> 3)[:, None]).ravel()
                    np.bitwise_or.at(x.bits.reshape(-1), flat, np.repeat((1 << (col & 7)).astype(np.uint8), HASHES))
                    x.docs += ids[block.first + now].tolist()
                    x.keys += keys[block.first + now].tolist()
                    x.sizes += size[now].tolist()
                    if len(x.docs) == x.columns:
                        yield rows([open_.pop(tier).row()])
    for x in open_.values():
        yield rows([x.row()])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in (pa.int32(), *(pa.list_(pa.int64()),) * 3, pa.binary())] +
                                     [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names)


class Index(NamedTuple):
    """Signature blocks, the documents they are of, and the corpus totals."""

    blocks: DataFrame
    rows: DataFrame       # doc_id (NO_ID for null), key, text
    n_docs: int
    n_terms: int


def signature_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Written once; any number of item tables can be searched in it."""
    ship_package(docs.sparkSession)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("key"),
                       lower.alias("text"))
    got = write_once(rows.mapInArrow(sign_texts, "tier int, docs array<long>, keys array<long>, sizes array<long>, "
                                     "slices binary, n_docs long, n_terms long"), "lexical-signatures")
    n_docs, n_terms = got.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Index(got.where("tier is not null").select("tier", "docs", "keys", "sizes", "slices"), rows, n_docs, n_terms)


# --- items -------------------------------------------------------------------------


class Items(NamedTuple):
    """A batch of items: their distinct terms' hashes (sorted) with weights, and for item i
    the terms ``term[at[i]:at[i+1]]``, each so many ``times``."""

    hashes: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def __len__(self):
        return len(self.at) - 1


def item_terms(batches):
    """Kernel over (item, text): (item, term, times)."""
    for batch in batches:
        for block in W.word_blocks(batch.column(1), W.ALNUM_BREAKS):
            text, h, tf = term_counts(block)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n_texts).take(pa.array(text)),
                                              pa.array(h.view(np.int64)), pa.array(tf)], ["item", "term", "times"])


def count_documents(hashes):
    """Kernel over (text): how many of the task's texts hold each of these terms."""
    def run(batches):
        known = hashes.value
        found = np.zeros(len(known), np.int64)
        for batch in batches:
            for block in W.word_blocks(batch.column(0), W.ALNUM_BREAKS):
                h, text = block.word_hashes(), block.text_of_word()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pairs = np.unique(at[hit] * np.int64(block.n_texts) + text[hit])
                found += np.bincount(pairs // block.n_texts, minlength=len(known))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])
    return run


def _batch(index: Index, terms: DataFrame) -> tuple[Items, list[int]]:
    """The batch's items with weights from exact document frequencies, and their numbers."""
    got = terms.toArrow()                                # about BATCH_TERMS rows
    item, h, times = (got.column(i).to_numpy() for i in range(3))
    numbers, own = np.unique(item, return_inverse=True)
    hashes, term = np.unique(h.view(np.uint64), return_inverse=True)
    spark = terms.sparkSession
    df = np.zeros(len(hashes), np.int64)
    counted = index.rows.select("text").mapInArrow(count_documents(spark.sparkContext.broadcast(hashes)), "term long, n long")
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():     # at most one row a term
        df[r.term] = r.n
    weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * df + 1))).astype(np.int64)
    order = np.lexsort((term, own))
    return Items(hashes, weight, np.searchsorted(own[order], np.arange(len(numbers) + 1)), term[order], times[order]), \
        numbers.tolist()


# --- bounds ------------------------------------------------------------------------


def bounds(row: dict, items: Items, index_totals: tuple[int, int]):
    """(first column, bounds (items, columns)) for runs of a block's documents."""
    many, n = BITS << row["tier"], len(row["docs"])
    bits = np.frombuffer(row["slices"], np.uint8).reshape(many, -1)
    size = np.array(row["sizes"], np.int64)
    norm = length_norm(size, *index_totals)
    where = [_slices(_entries(items.hashes, np.full(len(items.hashes), k)), many) for k in range(len(LEVELS))]
    width = max(1, CELLS // max(len(items.hashes), 1) // 8)
    for lo in range(0, bits.shape[1], width):
        part = bits[:, lo:lo + width]
        cols = slice(8 * lo, min(8 * (lo + part.shape[1]), n))
        value = np.zeros((len(items.hashes), cols.stop - cols.start))
        terms = np.arange(len(items.hashes))
        held = np.full((len(terms), part.shape[1]), 255, np.uint8)
        for k in range(len(LEVELS)):
            held = held & np.bitwise_and.reduce(part[where[k][terms]], axis=1)       # has reached the level
            some = held.any(1)
            terms, held = terms[some], held[some]
            if not len(terms):
                break
            most = np.minimum(LEVELS[k + 1] - 1, size[cols]) if k + 1 < len(LEVELS) else size[cols]
            there = np.unpackbits(held, axis=1, bitorder="little")[:, :value.shape[1]].astype(bool)
            value[terms] = np.where(there, term_score(most, norm[cols])[None, :], value[terms])
        out = np.empty((len(items), value.shape[1]))
        for i in range(len(items)):
            own = slice(items.at[i], items.at[i + 1])
            out[i] = (items.weight[items.term[own]] * items.times[own]).astype(float) @ value[items.term[own]]
        yield cols.start, out


def _rows(batch):
    return batch.to_pylist()


def best_bounds(items, totals, probe: int):
    """Kernel over blocks: for each item the task's documents of the ``probe`` best bounds."""
    def run(batches):
        told = items.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(told))]
        for batch in batches:
            for row in _rows(batch):
                docs, keys = np.array(row["docs"], np.int64), np.array(row["keys"], np.int64)
                for lo, bound in bounds(row, told, totals):
                    d, k = docs[lo:lo + bound.shape[1]], keys[lo:lo + bound.shape[1]]
                    for i in range(len(told)):
                        have = best[i]
                        least = have[0][-1] if len(have[0]) == probe else 0.0
                        some = np.flatnonzero((bound[i] >= least) & (bound[i] > 0))
                        if not len(some):
                            continue
                        b, x, y = (np.concatenate(z) for z in zip(have, (bound[i][some], d[some], k[some])))
                        order = np.lexsort((y, x, -b))[:probe]
                        best[i] = (b[order], x[order], y[order])
        n = np.array([len(x[0]) for x in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(told), dtype=np.int32), n)),
             *(pa.array(np.concatenate([x[i] for x in best] or [np.zeros(0)])) for i in range(3))],
            ["item", "bound", "doc_id", "key"])
    return run


def open_documents(items, totals, limits):
    """Kernel over blocks: (item, doc_id, key) of every document whose bound doesn't exclude
    it: above the item's limit, or equal to it with an id no larger than the limit's."""
    def run(batches):
        told = items.value
        least, least_id = limits.value
        for batch in batches:
            for row in _rows(batch):
                docs, keys = np.array(row["docs"], np.int64), np.array(row["keys"], np.int64)
                for lo, bound in bounds(row, told, totals):
                    d, k = docs[lo:lo + bound.shape[1]], keys[lo:lo + bound.shape[1]]
                    in_ = (bound > least[:, None]) | ((bound == least[:, None]) & (d[None, :] <= least_id[:, None])
                                                      & (bound > 0))
                    i, c = np.nonzero(in_)
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(d[c]), pa.array(k[c])],
                                                     ["item", "doc_id", "key"])
    return run


# --- exact scores ---------------------------------------------------------------------


def exact_scores(items, totals):
    """Kernel over (doc_id, text, items): (item, doc_id, score) of each of the row's items."""
    def run(batches):
        told = items.value
        many = max(len(told.hashes), 1)
        for batch in batches:
            wanted = batch.column(2)
            for block in W.word_blocks(batch.column(1), W.ALNUM_BREAKS):
                text, h, tf = term_counts(block)
                at = np.minimum(np.searchsorted(told.hashes, h), len(told.hashes) - 1)
                hit = told.hashes[at] == h
                have, have_tf = text[hit] * many + at[hit], tf[hit]
                order = np.argsort(have)
                have, have_tf = np.append(have[order], -1), np.append(have_tf[order], 0)
                own = wanted.slice(block.first, block.n_texts)
                n = np.array([len(x) for x in own], np.int64)
                row, item = np.repeat(np.arange(block.n_texts), n), own.flatten().to_numpy().astype(np.int64)
                k = told.at[item + 1] - told.at[item]
                place = np.repeat(told.at[item] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                term, pair = told.term[place], np.repeat(np.arange(len(item)), k)
                key = row[pair] * many + term
                found = np.minimum(np.searchsorted(have[:-1], key), len(have) - 1)
                f = np.where(have[found] == key, have_tf[found], 0)
                norm = length_norm(np.diff(block.bounds)[row[pair]], *totals)
                score = np.zeros(len(item), np.int64)
                np.add.at(score, pair, told.weight[term] * told.times[place] * term_score(f, norm))
                some = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[some].astype(np.int32)), batch.column(0).slice(block.first, block.n_texts).take(pa.array(row[some])),
                     pa.array(score[some])], ["item", "doc_id", "score"])
    return run


def _ranked(scores: DataFrame, top: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("doc_id").asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _score(index: Index, found: DataFrame, items) -> DataFrame:
    """Exact scores of the (item, doc_id, key) of ``found``; each row of a document counts."""
    wanted = write_once(found.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items")), "lexical-candidates")
    if wanted.count() <= BROADCAST_ROWS:                 # an item list is bounded by the batch
        wanted = F.broadcast(wanted)
    rows = index.rows.join(wanted, ["doc_id", "key"]).select("doc_id", "text", "items")
    return rows.mapInArrow(exact_scores(items, (index.n_docs, index.n_terms)), "item int, doc_id long, score long")


def _search(index: Index, terms: DataFrame, top: int, probe: int) -> DataFrame:
    """(item number, rank, doc_id, score) for one batch of items."""
    spark, totals = terms.sparkSession, (index.n_docs, index.n_terms)
    told, numbers = _batch(index, terms)
    items = spark.sparkContext.broadcast(told)
    first = index.blocks.mapInArrow(best_bounds(items, totals, probe), "item int, bound double, doc_id long, key long")
    sure = _ranked(_score(index, _ranked(first, probe, "bound"), items), top)
    least, least_id = np.zeros(len(told)), np.full(len(told), NO_ID)
    for r in sure.where(F.col("rank") == top).collect():           # at most one row an item
        least[r.item], least_id[r.item] = r.score, r.doc_id
    limits = spark.sparkContext.broadcast((least, least_id))
    open_ = index.blocks.mapInArrow(open_documents(items, totals, limits), "item int, doc_id long, key long")
    best = _ranked(_score(index, open_, items), top)
    number = F.element_at(F.lit(np.array(numbers, np.int64)), F.col("item") + 1)
    return best.select(number.alias("item"), F.col("rank").cast("int").alias("rank"),
                       F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame | Index, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
                  doc_id: str = "doc_id", text: str = "text", top: int = TOP, probe: int = PROBE,
                  batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` highest-scoring documents."""
    ship_package(items.sparkSession)
    index = docs if isinstance(docs, Index) else signature_index(docs, doc_id, text)
    lower = F.translate(F.coalesce(F.col(item_text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = write_once(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"),
                                    lower.alias("text")), "lexical-items")         # numbers are fixed once written
    terms = write_once(asked.select("item", "text").mapInArrow(item_terms, "item long, term long, times long"), "lexical-terms")
    batches = max(1, -(-terms.count() // batch_terms))
    ranked = []
    for i in range(batches):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i)
        if not index.n_docs or mine.isEmpty():
            continue
        ranked.append(write_once(_search(index, mine, top, max(probe, top)), "lexical-ranked"))
    if not ranked:
        ranked = [items.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")]
    found = reduce(DataFrame.unionByName, ranked)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
