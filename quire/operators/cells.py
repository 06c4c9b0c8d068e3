"""Approximate vector search in k-means cells.

*Fit.* Centroids start at the vectors of the smallest md5 of their id and are refined a
few times: every task sums its vectors by nearest centroid, and Spark adds the sums.
Coordinates are summed as integers (millionths), so a fit does not depend on how rows
are spread. Only sums and centroids (cells x dimensions) are ever gathered.

*Table.* Vectors are stored by cell, so a search reads the probed cells by partition
filter. *Search.* Cells are dealt to blocks of a bounded number of vectors, a cell of many
vectors to several by a hash of their id. A query goes once to each block that holds one
of its ``probes`` nearest cells, with a bit for each cell it probes, and meets those cells there, one
after the other (:mod:`quire.operators.blocks`). So no pair becomes a row, no vector is
sent once a cell, no hot cell is one task, and a task's memory does not grow.

``probes`` may be a number, or None: then it is the least number for which the measured
recall on about ``SAMPLE`` queries (against exact neighbours) reaches ``RECALL``.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators import blocks, topk
from quire.session import checkpoint_dir

MAX_CELLS = 4096
ROUNDS = 2
FILE_ROWS = 50_000      # a cell is written in files of about so many vectors
UNIT = 1_000_000
GROUP_QUERIES = 1 << 16 # most queries that meet a block of cells
SLICE = 1024            # vectors whose cosines with all centroids are held at once
SAMPLE, RECALL = 128, 0.92


class Cells(NamedTuple):
    """Vectors by cell (iid, embedding, cell), their centroids and the cells' sizes."""

    table: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]


def n_cells(n: int) -> int:
    """Cells for ``n`` vectors: about two square roots of them."""
    return max(1, min(MAX_CELLS, math.floor(2 * math.sqrt(n) + 0.5)))


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _usable(df: DataFrame, vec: str, dim: int) -> DataFrame:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(vec) == dim) & ~bad)


def cosines(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosine of every vector with every centroid, to six digits (0 for a zero norm)."""
    norm = np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(centroids, axis=1))
    return np.round(np.divide(v @ centroids.T, norm, out=np.zeros(norm.shape), where=norm > 0), 6)


def _nearest(v: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` cells of largest cosine, of equal ones the smallest number."""
    return np.argsort(-cosines(v, centroids), axis=1, kind="stable")[:, :probes]


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _sums(centroids):
    """Kernel over (embedding): the task's integer sums and counts by nearest centroid."""
    def run(batches):
        c = centroids.value
        total, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in _slices(batches):
            v = _matrix(batch.column(0))
            if len(v):
                at = _nearest(v, c, 1)[:, 0]
                np.add.at(total, at, np.floor(v * UNIT + 0.5).astype(np.int64))
                n += np.bincount(at, minlength=len(c))
        some = np.flatnonzero(n)
        cell, place = np.repeat(some, c.shape[1]), np.tile(np.arange(c.shape[1]), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[some].ravel()),
                                          pa.array(np.repeat(n[some], c.shape[1]))], ["cell", "place", "total", "n"])
    return run


def fit_centroids(items: DataFrame, item_id: str, vec: str, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """(cells, dimensions); ``items`` are usable vectors of one dimension."""
    spark = items.sparkSession
    first = items.orderBy(F.md5(F.col(item_id).cast("string")), item_id).limit(cells).select(vec).collect()
    c = np.array([r[0] for r in first], float)
    for _ in range(rounds):
        got = items.select(vec).mapInArrow(_sums(spark.sparkContext.broadcast(c)), "cell long, place long, total long, n long")
        got = got.groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # cells x dim rows
        cell, place, total, n = (got.column(i).to_numpy() for i in range(4))
        c = c.copy()
        c[cell, place] = total / n / UNIT
    return c


def _cell_of(centroids, probes: int, name: str):
    """Kernel over (id, vector): each row once for every of its ``probes`` nearest cells."""
    def run(batches):
        c = centroids.value
        for batch in _slices(batches):
            v = _matrix(batch.column(1))
            at = _nearest(v, c, probes)
            rows = pa.array(np.repeat(np.arange(len(v)), at.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows),
                                              pa.array(at.ravel().astype(np.int32))], [name, "v", "cell"])
    return run


def _probed(centroids, probes: int):
    """Kernel over (id, vector): both, and as bytes a bit for each of the ``probes`` nearest cells."""
    def run(batches):
        c = centroids.value
        for batch in _slices(batches):
            v = _matrix(batch.column(1))
            bits = np.zeros((len(v), len(c)), bool)
            np.put_along_axis(bits, _nearest(v, c, probes), True, axis=1)
            packed = np.packbits(bits, axis=1)
            ends = pa.py_buffer(np.arange(len(v) + 1, dtype=np.int32) * packed.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, ends, pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["qid", "qvec", "probed"])
    return run


def _bits(packed, cells: int) -> np.ndarray:
    """(rows, cells) of the bytes that :func:`_probed` makes."""
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(rows, axis=1, count=cells).astype(bool)


def _asked(cells: int):
    """Kernel over (probed): which cells the task's queries probe, a row."""
    def run(batches):
        some = np.zeros(cells, bool)
        for batch in _slices(batches):
            some |= _bits(batch.column(0), cells).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(some).astype(np.int32))], ["cell"])
    return run


def _with_blocks(members: np.ndarray):
    """Kernel that adds the blocks that hold a cell which the query probes."""
    def run(batches):
        for batch in _slices(batches):
            hit = (_bits(batch.column(2), len(members)).astype(np.float32) @ members.astype(np.float32)) > 0
            at = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hit.sum(axis=1))].astype(np.int32)),
                                          pa.array(np.nonzero(hit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, at], ["qid", "qvec", "probed", "qb", "ibs"])
    return run


def _deal(sizes: dict[int, int], n: int) -> dict[int, list[int]]:
    """Blocks of each cell: the largest cells first, each to the block that has least; a cell
    beyond a block's share to several."""
    share = max(1, math.ceil(sum(sizes.values()) / n))
    load, at = [0] * n, {}
    for cell in sorted(sizes, key=lambda c: (-sizes[c], c)):
        parts = min(n, math.ceil(sizes[cell] / share)) or 1
        at[cell] = sorted(range(n), key=lambda b: (load[b], b))[:parts]
        for b in at[cell]:
            load[b] += sizes[cell] / parts
    return at


class CellScorer:
    """Every query of a block against the cells that it probes, for :func:`quire.operators.topk.keyed_partial_top_k`."""

    def __init__(self, k: int, cells: int, exclude_self: bool, out):
        self.k, self.cells, self.exclude_self, self.out = k, cells, exclude_self, out

    def tables(self, items, queries):
        if not len(items) or not len(queries):
            return self.out.empty_table()
        items = blocks.by_id(items, "iid")
        iids = items.column("iid")
        best = blocks.Best(blocks.matrix(items.column("embedding")), blocks.matrix(queries.column("qvec")), self.k)
        own = (blocks.codes(queries.column("qid"), iids), blocks.codes(iids, iids)) if self.exclude_self else None
        bits = _bits(queries.column("probed"), self.cells)
        cell = items.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            rows = np.flatnonzero(bits[:, cell[places[0]]])
            step = max(1, blocks.TILE // len(places))
            for s in range(0, len(rows), step):
                best.offer(rows[s:s + step], places, own=own)
        qi, at, score = best.found()
        return pa.table([queries.column("qid").take(pa.array(qi)), iids.take(pa.array(at)), pa.array(score)], schema=self.out)


def build_cells(items: DataFrame, item_id: str, vec: str = "embedding", cells: int | None = None, path: str | None = None,
                rounds: int = ROUNDS) -> Cells:
    """Fit, assign and store below ``path`` (the checkpoint folder if none is given)."""
    spark = items.sparkSession
    path = path or f"{checkpoint_dir(spark)}/tables/cells-{uuid.uuid4().hex}"
    some = items.where(F.size(vec) > 0).select(F.size(vec)).first()
    vectors = items.select(F.col(item_id).alias("iid"), F.col(vec).cast("array<double>").alias("embedding"))
    good = _usable(vectors, "embedding", some[0] if some else 0)
    kind = items.schema[item_id].dataType.simpleString()
    n = good.count()
    c = fit_centroids(good, "iid", "embedding", cells or n_cells(n), rounds) if n else np.zeros((1, 0))
    put = good.mapInArrow(_cell_of(spark.sparkContext.broadcast(c), 1, "iid"), f"iid {kind}, v array<double>, cell int")
    spread = -(-n // (len(c) * FILE_ROWS)) or 1
    put.withColumnRenamed("v", "embedding").repartition("cell", F.pmod(F.xxhash64("iid"), F.lit(spread))).write.mode(
        "overwrite").partitionBy("cell").parquet(path)
    table = spark.read.schema(f"iid {kind}, embedding array<double>, cell int").parquet(path)
    sizes = {r.cell: r.n for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row a cell
    return Cells(table, c, sizes)


def search_cells(index: Cells, queries: DataFrame, k: int, query_id: str, qvec: str = "qvec", probes: int | None = None,
                 exclude_self: bool = False) -> DataFrame:
    """Approximate top ``k``: (qid, iid, score, rank), every score exact."""
    spark, dim = queries.sparkSession, index.centroids.shape[1]
    kind = queries.schema[query_id].dataType
    good = _usable(queries.select(F.col(query_id).alias("qid"), F.col(qvec).cast("array<double>").alias("qvec")), "qvec", dim)
    if probes is None:
        probes = measured_probes(index, good, k, exclude_self)
    probes = max(1, min(probes, len(index.centroids)))
    cells = len(index.centroids)
    sent = good.mapInArrow(_probed(spark.sparkContext.broadcast(index.centroids), probes),
                           f"qid {kind.simpleString()}, qvec array<double>, probed binary")
    told = sent.select("probed").mapInArrow(_asked(cells), "cell int").distinct().collect()             # a row a cell
    probed = sorted(r.cell for r in told if index.sizes.get(r.cell))
    schema = topk._out_schema(kind, index.table.schema["iid"].dataType)
    if not probed:
        return topk._merge(spark.createDataFrame([], schema), k)
    n_items = blocks.n_blocks(sum(index.sizes[c] for c in probed), dim)
    n = sent.count()
    n_queries = max(blocks.n_blocks(n, dim), math.ceil(n / GROUP_QUERIES))
    at = _deal({c: index.sizes[c] for c in probed}, n_items)
    of_cell = F.lit([at.get(c, []) for c in range(cells)]).cast("array<array<int>>")
    members = np.zeros((cells, n_items), bool)
    for c, some in at.items():
        members[c, some] = True

    own = F.element_at(of_cell, F.col("cell") + 1)
    items = index.table.where(F.col("cell").isin(probed)).withColumn(
        "ib", F.element_at(own, F.pmod(F.xxhash64("iid"), F.size(own)).cast("int") + 1))
    sent = sent.withColumn("qb", blocks.block_of("qid", n_queries)).mapInArrow(
        _with_blocks(members), f"qid {kind.simpleString()}, qvec array<double>, probed binary, qb int, ibs array<int>")
    items, sent = blocks.deal(items, sent, n_items, n_queries)
    scorer = CellScorer(k, cells, exclude_self, to_arrow_schema(schema))
    found = topk.keyed_partial_top_k(items, sent, blocks.KEYS, scorer, k, schema)
    return topk._merge(found, k)


def measured_probes(index: Cells, queries: DataFrame, k: int, exclude_self: bool, recall: float = RECALL) -> int:
    """The least number of probed cells that holds ``recall`` of the exact ``k`` nearest of
    about SAMPLE queries: each neighbour's cell is looked up in the query's order of cells."""
    n = queries.count()
    few = queries if n <= SAMPLE else queries.where(F.xxhash64("qid") < F.lit(SAMPLE * (1 << 64) // n - (1 << 63)))
    spark = queries.sparkSession
    near = topk.cell_top_k(index.table.select("iid", "embedding"), few.select("qid", "qvec"),
                           topk.cosine_scorer(k, exclude_self=exclude_self), k, "iid", "qid")
    own = near.select("qid", "iid").join(index.table.select("iid", "cell"), "iid").select("qid", "cell")
    order = few.mapInArrow(_cell_of(spark.sparkContext.broadcast(index.centroids), len(index.centroids), "qid"),
                           f"qid {queries.schema['qid'].dataType.simpleString()}, v array<double>, cell int")
    order = order.groupBy("qid").agg(F.collect_list("cell").alias("order"))            # a cell count a query
    place = [r[0] for r in own.join(order, "qid").select(F.array_position("order", F.col("cell"))).collect()]
    if not place:
        return len(index.centroids)
    return int(np.sort(place)[min(len(place) - 1, math.ceil(recall * len(place)) - 1)])
