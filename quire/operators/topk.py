"""Exact top-k per query over a large item set, without all-pairs rows.

Each task scores one block of queries against one block of items in numpy
and emits at most k rows per query; a ``row_number() <= k`` window (planned
with WindowGroupLimit, so it limits before the shuffle too) merges the
partial lists. In the grid, items are assigned to blocks by a hash of their
id, so no block is hot whatever the key distribution.

Two ways to meet queries with item blocks:

* ``broadcast`` - the query side is shipped to every task once, after the
  rows and bytes of all of it are measured and found within the bound; items are scored where they are read (``mapInArrow``,
  a few thousand at a time), so the corpus is never shuffled.
* ``grid`` - queries are hash-split into QB blocks and items into CB blocks;
  each (qb, cb) cell is a cogroup group of at most about ``GRID_ITEMS`` items.
  Items are replicated QB times and queries CB times.

``mode`` names the way: ``broadcast`` (an error beyond the bound), ``grid``, or
``auto`` (broadcast within the bound, else grid). Both give the same rows.
"""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# A scorer gets (items, queries) pandas frames and returns a frame with
# columns qid, iid, score (any subset of pairs; missing pairs do not rank).
Scorer = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]

DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 256 << 20
PARTIAL_ROWS = 100_000  # rows of lists a task may hand on before items are scored in no more tasks than cores
GRID_ITEMS = 20_000     # items in a grid cell
GRID_VECTORS = 3        # cells of vectors, which take fewer bytes than terms, are so many times as large
GRID_QUERY_BYTES = 16 << 20     # measured bytes of queries in a grid cell: items are shuffled once a query block


def top_k_frame(scored: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top-k rows per qid by (score desc, iid asc) from a pandas frame."""
    if scored.empty:
        return scored
    s = scored.sort_values(["qid", "score", "iid"], ascending=[True, False, True], kind="mergesort")
    return s.groupby("qid", sort=False).head(k)


def _out_schema(qid_type: T.DataType, iid_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("qid", qid_type), T.StructField("iid", iid_type),
                         T.StructField("score", T.DoubleType())])


def _merge(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("iid").asc())
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of the whole of ``df``, by one aggregate: the JSON length of every
    row, which is above its binary size for numbers and about it for text."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n, total


def _bounded_collect(df: DataFrame, max_rows: int, max_bytes: int):
    """The whole of ``df`` as an Arrow table if all its rows and bytes, measured first, fit the
    bounds; else None and nothing reaches the driver."""
    n, total = measured_size(df)
    return df.toArrow() if n <= max_rows and total <= max_bytes else None


def _query_blocks(qpdf: pd.DataFrame, block_rows: int) -> list[pd.DataFrame]:
    """Split a query frame into blocks of about ``block_rows`` rows, keeping
    every row of one query id in one block."""
    if len(qpdf) <= block_rows:
        return [qpdf]
    n = math.ceil(len(qpdf) / block_rows)
    codes = pd.util.hash_pandas_object(qpdf["qid"], index=False).to_numpy() % n
    return [qpdf[codes == i].reset_index(drop=True) for i in range(n) if (codes == i).any()]


class TopLists:
    """The ``k`` best (iid, score) of each query of a block so far: score descending, then id."""

    def __init__(self, qids, k: int):
        self.qids, self.k = pd.Index(qids), k
        self.score = np.full((len(self.qids), k), -np.inf)
        self.iid = np.full((len(self.qids), k), None, dtype=object)

    def least(self) -> pd.Series:
        """The k-th best score of the queries that have one."""
        full = self.score[:, -1] > -np.inf
        return pd.Series(self.score[full, -1], index=self.qids[full])

    def add(self, found: pd.DataFrame) -> None:
        q, s = self.qids.get_indexer(found["qid"]), found["score"].to_numpy(float)
        ok = s >= self.score[q, -1]
        q, s, i = q[ok], s[ok], found["iid"].to_numpy()[ok].astype(object)
        if not len(q):
            return
        old = np.unique(q)
        held = self.score[old] > -np.inf
        q, s = np.concatenate([q, np.repeat(old, held.sum(axis=1))]), np.concatenate([s, self.score[old][held]])
        i = np.concatenate([i, self.iid[old][held]])
        order = np.lexsort((-s, q))
        q, s, i = q[order], s[order], i[order]
        same = np.r_[False, (q[1:] == q[:-1]) & (s[1:] == s[:-1])]
        if same.any():                                  # runs of equal scores are few: by id
            starts = np.flatnonzero(same & ~np.r_[False, same[:-1]]) - 1
            ends = np.flatnonzero(same & ~np.r_[same[1:], False]) + 1
            for lo, hi in zip(starts, ends):
                i[lo:hi] = sorted(i[lo:hi], key=lambda x: (x is not None, x))
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        at = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = at < self.k
        self.score[q[top], at[top]], self.iid[q[top], at[top]] = s[top], i[top]

    def frame(self) -> pd.DataFrame:
        q, at = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"qid": self.qids.to_numpy()[q], "iid": self.iid[q, at], "score": self.score[q, at]})


def _terms_type(kind: pa.DataType):
    """Lists of strings stay in their Arrow form: as Python objects they take many times the bytes."""
    lists = pa.types.is_list(kind) or pa.types.is_large_list(kind)
    return pd.ArrowDtype(kind) if lists and (pa.types.is_string(kind.value_type) or pa.types.is_large_string(kind.value_type)) else None


def _item_frames(batch: pa.RecordBatch, rows: int):
    """A batch, which may have many rows, as pandas frames of at most ``rows`` items."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows).to_pandas(types_mapper=_terms_type, date_as_object=True, integer_object_nulls=True)


def _blocks(scorer, queries, rows: int) -> list:
    """Queries, a pandas frame or an Arrow table, in blocks: as the scorer packs them, else frames of about ``rows`` rows."""
    if hasattr(scorer, "pack"):
        return scorer.pack(queries)
    return _query_blocks(queries.to_pandas() if isinstance(queries, pa.Table) else queries, rows)


def _fold(ipdf: pd.DataFrame, qblocks: list, scorer, k: int, batch_rows: int, best: dict[int, TopLists]) -> dict[int, TopLists]:
    """Fold one item frame into the running top-k of each query block. A scorer with
    a ``prepare`` step builds its per-batch item state once for all blocks."""
    for start in range(0, len(ipdf), batch_rows):
        chunk = ipdf.iloc[start:start + batch_rows].reset_index(drop=True)
        state = scorer.prepare(chunk, qblocks) if hasattr(scorer, "prepare") else chunk
        for n, qb in enumerate(qblocks):
            found = scorer(state, qb, best[n].least()) if n in best and getattr(scorer, "bounded", False) else scorer(state, qb)
            if found.empty:
                continue
            if n not in best:
                best[n] = TopLists(pd.unique(pd.Series(qb["qid"])), k)
            best[n].add(found)
    return best


def _score_items(ipdf: pd.DataFrame, qblocks: list[pd.DataFrame], scorer, k: int,
                 batch_rows: int, best: dict[int, pd.DataFrame]) -> dict[int, pd.DataFrame]:
    """:func:`_fold` over frames of lists."""
    lists = {}
    for n, frame in best.items():
        lists[n] = TopLists(pd.unique(qblocks[n]["qid"]), k)
        lists[n].add(frame)
    found = _fold(ipdf, qblocks, scorer, k, batch_rows, lists)
    return {n: top_k_frame(x.frame(), k) for n, x in found.items()}


def cell_top_k(items: DataFrame, queries: DataFrame, scorer: Scorer, k: int,
               item_id: str, query_id: str, mode: str = "auto",
               broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
               item_blocks: int | None = None, query_block_rows: int = 2048,
               batch_rows: int = 2048) -> DataFrame:
    """Exact top-k items per query: (qid, iid, score, rank).

    ``items`` and ``queries`` carry whatever columns the scorer reads, plus
    ``item_id`` / ``query_id``. A query may span several rows (e.g. one per
    term); all rows of one query id go to the same block. Per task, memory is
    bounded by ``batch_rows`` items x ``query_block_rows`` query rows.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = items.sparkSession
    schema = _out_schema(queries.schema[query_id].dataType, items.schema[item_id].dataType)
    items = items.withColumnRenamed(item_id, "iid")
    queries = queries.withColumnRenamed(query_id, "qid")

    qpdf = None
    if mode in ("auto", "broadcast"):
        if hasattr(scorer, "broadcast_rows"):           # packed queries take a fraction of these bytes
            broadcast_rows, broadcast_bytes = scorer.broadcast_rows(broadcast_rows), 2 * broadcast_bytes
        qpdf = _bounded_collect(queries, broadcast_rows, broadcast_bytes)
        if qpdf is None and mode == "broadcast":
            raise ValueError("query side exceeds the broadcast bound; use mode='grid'")
        mode = "broadcast" if qpdf is not None else "grid"

    if mode == "broadcast":
        packed = _blocks(scorer, qpdf, query_block_rows)
        if sum(len(x["qid"]) for x in packed) * k > PARTIAL_ROWS:     # each task hands on a list for every query
            items = items.coalesce(spark.sparkContext.defaultParallelism)
        bq = spark.sparkContext.broadcast(packed)
        out = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

        def per_partition(batches):
            qblocks = bq.value
            best: dict[int, TopLists] = {}
            for b in batches:
                for frame in _item_frames(b, batch_rows):
                    best = _fold(frame, qblocks, scorer, k, batch_rows, best)
            for found in (x.frame() for x in best.values()):
                yield pa.RecordBatch.from_arrays([pa.array(found[c], type=t, from_pandas=True) for c, t in out], [c for c, _ in out])

        return _merge(items.mapInArrow(per_partition, schema), k)

    # grid: hash-split both sides into blocks and cogroup cell by cell
    wide = GRID_VECTORS if isinstance(scorer, CosineScorer) else 1
    qb = max(1, math.ceil(measured_size(queries)[1] / (wide * GRID_QUERY_BYTES)))
    cb = item_blocks or max(1, math.ceil(items.count() / (wide * GRID_ITEMS)))
    q_rep = (queries.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int"))
             .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    i_rep = (items.withColumn("_cb", F.pmod(F.xxhash64("iid"), F.lit(cb)).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))

    return _merge(keyed_partial_top_k(i_rep, q_rep, ["_qb", "_cb"], scorer, k, schema,
                                      query_block_rows, batch_rows), k)


def keyed_partial_top_k(items: DataFrame, queries: DataFrame, keys: list[str], scorer, k: int,
                        schema: T.StructType, query_block_rows: int = 2048,
                        batch_rows: int = 2048) -> DataFrame:
    """Cogroup items and queries on ``keys``; each group emits at most k
    rows per query (qid, iid, score). Callers size the key space so that
    every group is bounded. A scorer with ``tables`` gets a group's two Arrow tables as a whole."""
    if hasattr(scorer, "tables"):
        return items.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda left, right: scorer.tables(left, right), schema)

    def per_cell(ipdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, TopLists] = {}
        if not ipdf.empty and not qpdf.empty:
            best = _fold(ipdf, _blocks(scorer, qpdf, query_block_rows), scorer, k, batch_rows, best)
        if not best:
            return pd.DataFrame({"qid": pd.Series([], dtype=object), "iid": pd.Series([], dtype=object),
                                 "score": pd.Series([], dtype="float64")})
        return pd.concat([x.frame() for x in best.values()], ignore_index=True)

    return (items.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(per_cell, schema))


# ---------------------------------------------------------------------------
# scorers
# ---------------------------------------------------------------------------

# Optional per-query source filter: queries may carry FILTER_COL, items
# TYPE_COL; a pair scores only when the filter is null or equals the type.
FILTER_COL, TYPE_COL = "_source_filter", "_source_type"


def _allowed(filters: np.ndarray, types: np.ndarray) -> np.ndarray:
    f = filters.astype(object)[:, None]
    t = types.astype(object)[None, :]
    return pd.isna(f) | (f == t)


def _matrix(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _candidates(s: np.ndarray, qids: np.ndarray, iids: np.ndarray, k: int) -> pd.DataFrame:
    """Pairs of a (queries x items) score matrix that can be in a top-k:
    per row every finite score >= the row's k-th best (ties kept, so the
    id tie-break downstream stays exact)."""
    if s.size == 0:
        return pd.DataFrame({"qid": qids[:0], "iid": iids[:0], "score": np.zeros(0)})
    # a non-finite score (bad vector) must not count as one of the k best
    s = np.where(np.isfinite(s), s, -np.inf)
    if s.shape[1] > k:
        kth = np.partition(s, -k, axis=1)[:, -k]
        qi, ii = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
    else:
        qi, ii = np.nonzero(np.isfinite(s))
    return pd.DataFrame({"qid": qids[qi], "iid": iids[ii], "score": s[qi, ii]})


def _plain_norms(n: np.ndarray) -> bool:
    """Whether products of these norms neither overflow nor vanish (nor come from bad vectors)."""
    return bool(((n == 0) | (n > 1e-100) & (n < 1e100)).all())


class CosineScorer:
    """Cosine similarity, zero norm -> 0 (M2), rounded to ``digits`` so
    equal-looking scores tie and break on the item id. Given the least score of each
    query's list so far, only pairs that may reach it are rounded and ranked."""

    bounded = True

    def __init__(self, k: int, vec_col: str = "embedding", qvec_col: str = "qvec", digits: int = 6,
                 exclude_self: bool = False):
        self.k, self.vec_col, self.qvec_col, self.digits, self.exclude_self = k, vec_col, qvec_col, digits, exclude_self

    QUERIES = 2048          # of a block
    DENSE = 1 << 19         # pairs of queries without a list that are scored together

    def pack(self, queries: pd.DataFrame | pa.Table) -> list:
        """Blocks with the vectors as one matrix; as objects they take twice the bytes or more."""
        if isinstance(queries, pa.Table):
            col = queries.column(self.qvec_col).combine_chunks()
            flat = col.flatten()
            size = len(flat) // max(len(col), 1)
            if not col.null_count and not flat.null_count and pc.all(pc.equal(pc.list_value_length(col), size)).as_py():
                q = flat.to_numpy().reshape(len(col), size)
                rest = queries.drop_columns([self.qvec_col]).to_pandas()
                return [{"q": q[at:at + self.QUERIES].copy(), **{c: rest[c].to_numpy()[at:at + self.QUERIES] for c in rest.columns}}
                        for at in range(0, len(q), self.QUERIES)]
            queries = queries.to_pandas()
        return _query_blocks(queries, self.QUERIES)

    def prepare(self, items: pd.DataFrame, qblocks) -> dict:
        a = _matrix(items[self.vec_col])
        return {"a": a, "an": np.linalg.norm(a, axis=1) if a.size else np.zeros(len(items)),
                "iids": items["iid"].to_numpy(),
                "types": items[TYPE_COL].to_numpy() if TYPE_COL in items.columns else None}

    def _reaching(self, st: dict, queries, q: np.ndarray, least: np.ndarray) -> pd.DataFrame:
        """Pairs of at least the queries' ``least`` scores: a product of unit vectors in single
        precision, which differs from the score by rounding only, is compared, and what passes is scored."""
        qn = np.linalg.norm(q, axis=1)
        unit = lambda v, n: np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0).astype(np.float32)
        if "unit" not in st:
            st["unit"] = unit(st["a"], st["an"]).T
        with np.errstate(invalid="ignore"):
            near = unit(q, qn) @ st["unit"]
        slack = 10.0 ** -self.digits + 1e-6 + q.shape[1] * 1.2e-7       # rounding of the score, of the product
        qi, ii = np.divmod(np.flatnonzero(near >= (least - slack).astype(np.float32)[:, None]), near.shape[1])
        qids, iids = np.asarray(queries["qid"]), st["iids"]
        keep = (qids[qi] != iids[ii]) if self.exclude_self else np.ones(len(qi), bool)
        if FILTER_COL in queries and st["types"] is not None:
            filters, types = np.asarray(queries[FILTER_COL], object)[qi], st["types"][ii].astype(object)
            keep &= pd.isna(filters) | (filters == types)
        qi, ii = qi[keep], ii[keep]
        denom = qn[qi] * st["an"][ii]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(denom == 0.0, 0.0, np.einsum("nd,nd->n", q[qi], st["a"][ii]) / denom)
        s = np.round(s, self.digits)
        ok = np.isfinite(s) & (s >= least[qi])
        return pd.DataFrame({"qid": qids[qi[ok]], "iid": iids[ii[ok]], "score": s[ok]})

    def __call__(self, st: dict, queries, least: pd.Series | None = None) -> pd.DataFrame:
        q = queries["q"].astype(np.float64) if "q" in queries else _matrix(queries[self.qvec_col])
        qids, iids = np.asarray(queries["qid"]), st["iids"]
        if q.size == 0 or st["a"].size == 0:
            return _candidates(np.zeros((len(qids), 0)), qids, iids, self.k)
        if least is not None and len(least):
            floor = least.reindex(qids).to_numpy(float)
            if "plain" not in st:
                st["plain"] = _plain_norms(st["an"])
            if np.isfinite(floor).all() and st["plain"] and _plain_norms(np.linalg.norm(q, axis=1)):
                return self._reaching(st, queries, q, floor)
        step = max(1, self.DENSE // len(iids))
        filters = np.asarray(queries[FILTER_COL], object) if FILTER_COL in queries and st["types"] is not None else None
        return pd.concat([self._all(st, q[at:at + step], qids[at:at + step], None if filters is None else filters[at:at + step])
                          for at in range(0, len(q), step)], ignore_index=True)

    def _all(self, st: dict, q: np.ndarray, qids: np.ndarray, filters) -> pd.DataFrame:
        iids = st["iids"]
        denom = np.outer(np.linalg.norm(q, axis=1), st["an"])
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(denom == 0.0, 0.0, (q @ st["a"].T) / denom)
        s = np.round(s, self.digits)
        if self.exclude_self:
            s = np.where(qids[:, None] == iids[None, :], -np.inf, s)
        if filters is not None:
            s = np.where(_allowed(filters, st["types"]), s, -np.inf)
        return _candidates(s, qids, iids, self.k)


def cosine_scorer(k_hint: int, vec_col: str = "embedding", qvec_col: str = "qvec", digits: int = 6,
                  exclude_self: bool = False) -> CosineScorer:
    return CosineScorer(k_hint, vec_col, qvec_col, digits, exclude_self)


class QueryTerms(dict):
    """A block of queries for :class:`BM25Scorer`: ``qid``, ``filter`` (or None), and by query in
    the order of term numbers ``row``, ``code``, ``idf``; ``vocab`` is that of all blocks."""


class BM25Scorer:
    """BM25 of items (iid, toks array) against query term rows (qid, term, idf). The
    terms of an item batch are indexed by the query vocabulary once. Terms of a good part of
    the batch's items are scored by one product in single precision, the others entry by
    entry; pairs that may reach a query's list, given the least score of it so
    far, are then scored exactly over all their terms. Only pairs sharing a term rank."""

    bounded = True
    QUERIES = 1024          # of a block
    EXPANDED = 1 << 20      # (query, item) entries made at once
    LOOKED = 1 << 15        # pairs whose terms are looked up at once
    COMMON, MOST = 0.015, 512       # share of a batch's items that a common term is in, most such terms
    SLACK = 1e-3, 1e-5      # rounding of the product: absolute, of the score

    def __init__(self, k: int, k1: float = 1.2, b: float = 0.75, avgdl: float = 1.0, digits: int = 6):
        self.k, self.k1, self.b, self.avgdl, self.digits = k, k1, b, avgdl, digits

    def broadcast_rows(self, rows: int) -> int:
        """Term rows that take no more than ``rows`` vectors: 20 bytes each."""
        return 40 * rows

    def pack(self, queries: pd.DataFrame | pa.Table) -> list[QueryTerms]:
        t = queries if isinstance(queries, pa.Table) else pa.Table.from_pandas(queries, preserve_index=False)
        term, qid = (pc.dictionary_encode(t.column(c).combine_chunks()) for c in ("term", "qid"))
        vocab, code = term.dictionary, term.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        row, ids = qid.indices.to_numpy(zero_copy_only=False), qid.dictionary.to_pandas().to_numpy()
        order = np.lexsort((code, row))
        row, code, idf = row[order], code[order], t.column("idf").to_numpy()[order].astype(np.float64)
        filters = None
        if FILTER_COL in t.column_names:
            filters = np.full(len(ids), None, dtype=object)
            filters[row] = t.column(FILTER_COL).to_pandas().to_numpy(dtype=object)[order]
        out = []
        for lo in range(0, len(ids), self.QUERIES):
            a, b = np.searchsorted(row, [lo, lo + self.QUERIES])
            out.append(QueryTerms(qid=ids[lo:lo + self.QUERIES], filter=None if filters is None else filters[lo:lo + self.QUERIES],
                                  row=(row[a:b] - lo).astype(np.int32), code=code[a:b], idf=idf[a:b], vocab=vocab if lo == 0 else None))
        return out

    def _packed(self, block) -> list[QueryTerms]:
        return [block] if isinstance(block, QueryTerms) else self.pack(block)

    def prepare(self, items: pd.DataFrame, qblocks) -> dict:
        if isinstance(qblocks[0], QueryTerms):
            vocab = qblocks[0]["vocab"]
        else:
            vocab = pc.unique(pa.array(np.concatenate([qb["term"].to_numpy(dtype=object) for qb in qblocks]), pa.string()))
        toks = items["toks"]
        toks = pa.array(toks.array) if isinstance(toks.dtype, pd.ArrowDtype) else pa.array(toks, pa.list_(pa.string()))
        toks = toks.combine_chunks() if isinstance(toks, pa.ChunkedArray) else toks
        dl = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(toks)
        codes = pc.fill_null(pc.index_in(flat, value_set=vocab.cast(flat.type)), -1).to_numpy().astype(np.int64)
        v = max(len(vocab), 1)
        rows = np.repeat(np.arange(len(toks)), dl)
        keep = codes >= 0
        uk, tf = np.unique(rows[keep] * v + codes[keep], return_counts=True)
        r, c = np.divmod(uk, v)
        tf = tf.astype(np.float64)
        w = tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * dl[r] / self.avgdl))
        by_term = np.argsort(c, kind="stable")
        ends = np.searchsorted(c[by_term], np.arange(v + 1))
        df = np.diff(ends)
        common = np.flatnonzero(df > self.COMMON * len(toks))
        common = common[np.argsort(-df[common], kind="stable")[:self.MOST]]
        col = np.full(v, -1, np.int64)
        col[common] = np.arange(len(common))
        dense = np.zeros((len(common), len(toks)), np.float32)
        of = col[c]
        dense[of[of >= 0], r[of >= 0]] = w[of >= 0]
        return {"vocab": vocab, "v": v, "key": uk, "kw": w, "r": r[by_term], "w": w[by_term], "ends": ends, "col": col, "dense": dense,
                "n": len(toks), "iids": items["iid"].to_numpy(),
                "types": items[TYPE_COL].to_numpy() if TYPE_COL in items.columns else None}

    def __call__(self, st: dict, queries, least: pd.Series | None = None) -> pd.DataFrame:
        found = [x for block in self._packed(queries) for x in self._pairs(st, self._known(st, block), least)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"qid": [], "iid": [], "score": []})

    @staticmethod
    def _known(st: dict, block: QueryTerms) -> QueryTerms:
        """The block with its codes in the state's vocabulary (they are, unless it was packed for itself)."""
        if block["vocab"] is None or block["vocab"] is st["vocab"]:
            return block
        code = pc.index_in(block["vocab"], value_set=st["vocab"].cast(block["vocab"].type)).to_numpy(zero_copy_only=False).astype(np.int32)
        return QueryTerms(block, code=code[block["code"]])

    def _pairs(self, st: dict, q: QueryTerms, least: pd.Series | None):
        """Frames of the pairs of the block that may reach a list."""
        nq, n = len(q["qid"]), st["n"]
        row, code, idf = q["row"], q["code"], q["idf"]
        here = st["ends"][code + 1] > st["ends"][code]
        row, code, idf = row[here], code[here], idf[here]
        if not len(row):
            return
        floor = np.zeros(nq)
        if least is not None and len(least):
            floor = np.nan_to_num(least.reindex(q["qid"]).to_numpy(float), nan=0.0)
        size = np.where(st["col"][code] < 0, st["ends"][code + 1] - st["ends"][code], 0)
        for lo, hi in self._parts(row, size, nq, n):
            a, b = np.searchsorted(row, [lo, hi])
            yield self._part(st, q, lo, hi, row[a:b] - lo, code[a:b], idf[a:b], size[a:b], floor[lo:hi])

    def _parts(self, row, size, nq: int, n: int):
        """Runs of queries whose entries and places are made together."""
        per = np.bincount(row, weights=size, minlength=nq) + n
        at = 0
        total = np.cumsum(per)
        while at < nq:
            hi = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.EXPANDED, "right")))
            yield at, min(hi, nq)
            at = hi

    def _part(self, st, q, lo, hi, row, code, idf, size, floor) -> pd.DataFrame:
        n, nq = st["n"], hi - lo
        e = np.flatnonzero(size)
        cnt = size[e].astype(np.int64)
        place = np.arange(cnt.sum()) + np.repeat(st["ends"][code[e]] - (np.cumsum(cnt) - cnt), cnt)
        flat = np.repeat(row[e].astype(np.int64) * n, cnt) + st["r"][place]
        near = np.bincount(flat, weights=np.repeat(idf[e], cnt) * st["w"][place], minlength=nq * n).reshape(nq, n)
        e = np.flatnonzero(st["col"][code] >= 0)
        if len(e):
            asked = np.zeros((nq, len(st["dense"])), np.float32)
            np.add.at(asked, (row[e], st["col"][code[e]]), idf[e])
            near = near + asked @ st["dense"]
        filters = None if q["filter"] is None else q["filter"][lo:hi]
        if filters is not None and st["types"] is not None and not pd.isna(filters).all():
            near = np.where(_allowed(filters, st["types"]), near, 0.0)
        limit = floor.copy()
        new = np.flatnonzero(floor == 0)
        if len(new) and n > self.k:
            limit[new] = np.partition(near[new], -self.k, axis=1)[:, -self.k]
        limit = limit * (1 - self.SLACK[1]) - self.SLACK[0]
        qi, di = np.divmod(np.flatnonzero(near >= np.maximum(limit, np.nextafter(0, 1))[:, None]), n)
        first = np.searchsorted(row, np.arange(nq + 1))
        s = np.zeros(len(qi))
        for at in range(0, len(qi), self.LOOKED):
            some = slice(at, at + self.LOOKED)
            many = np.diff(first)[qi[some]]
            entry = np.arange(many.sum()) + np.repeat(first[qi[some]] - (np.cumsum(many) - many), many)
            key = np.repeat(di[some] * st["v"], many) + code[entry]
            where = np.minimum(np.searchsorted(st["key"], key), len(st["key"]) - 1)
            value = np.where(st["key"][where] == key, idf[entry] * st["kw"][where], 0.0)
            s[some] = np.bincount(np.repeat(np.arange(len(many)), many), weights=value, minlength=len(many))
        s = np.round(s, self.digits)
        ok = s >= floor[qi]
        return pd.DataFrame({"qid": q["qid"][lo:hi][qi[ok]], "iid": st["iids"][di[ok]], "score": s[ok]})


def bm25_scorer(k: int, k1: float = 1.2, b: float = 0.75, avgdl: float = 1.0, digits: int = 6) -> BM25Scorer:
    return BM25Scorer(k, k1, b, avgdl, digits)
