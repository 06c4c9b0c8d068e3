"""Vectors that meet in blocks, for approximate search.

Items and queries are dealt to blocks by a hash of their id, or as the caller deals them,
and a kernel sees one block of each: a vector is shuffled once for each block of the other
side, a pair is never a row. A block holds at most ``BLOCK_BYTES`` of doubles, so a task's
memory does not grow with the tables; what is shuffled grows with the rows times the
number of blocks. Small tables are dealt to up to ``LEAST`` blocks, so that cores share them.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["ib", "qb"]     # numbers of an item block and a query block
BLOCK_BYTES = 32 << 20
LEAST, LEAST_ROWS = 6, 2048
TILE = 2 << 20          # pairs a kernel looks at together
HEAD = 1024             # items that give a query's list its first limit
MARGIN = 2e-6           # scores are rounded to six digits
EXACT = 1 << 17         # pairs scored together


def n_blocks(rows: int, dim: int) -> int:
    """Blocks for ``rows`` vectors."""
    return max(1, math.ceil(rows * 8 * max(dim, 1) / BLOCK_BYTES), min(LEAST, rows // LEAST_ROWS))


def block_of(id_col: str, blocks: int):
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def deal(items: DataFrame, queries: DataFrame, item_blocks: int, query_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides once for each block of the other that they meet, to be grouped by ``KEYS``.
    ``items`` have ``ib``, ``queries`` have ``qb`` and may have ``ibs``, the blocks of items they
    ask for (else all)."""
    n = item_blocks * query_blocks
    ibs = F.col("ibs") if "ibs" in queries.columns else F.sequence(F.lit(0), F.lit(item_blocks - 1))
    left = items.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("ib", F.explode(ibs)).drop("ibs")
    return left.repartition(n, *KEYS), right.repartition(n, *KEYS)


def matrix(col) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def by_id(table: pa.Table, col: str) -> pa.Table:
    """The table in the order of an id, so that a row's place breaks ties as its id does."""
    ids = table.column(col).combine_chunks()
    return table.take(pc.array_sort_indices(ids, order="ascending", null_placement="at_start"))


def codes(ids, of) -> np.ndarray:
    """A number for each of ``ids`` that equal ids of ``of`` share; -1 if ``of`` lacks it."""
    ids, of = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, of))
    if ids.type != of.type:
        if not (pa.types.is_integer(ids.type) and pa.types.is_integer(of.type)):
            return np.full(len(ids), -1)
        ids, of = ids.cast(pa.int64()), of.cast(pa.int64())
    return pc.fill_null(pc.index_in(ids, value_set=of), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Best:
    """The ``k`` best items of each query of a block, of those that were offered: by score,
    then by the item's place. Non-finite scores do not count."""

    def __init__(self, items: np.ndarray, queries: np.ndarray, k: int, digits: int = 6):
        self.a, self.q, self.k, self.digits = items, queries, k, digits
        self.an, self.qn = (np.linalg.norm(v, axis=1) if v.size else np.zeros(len(v)) for v in (items, queries))
        # norms whose products overflow or vanish, and bad vectors: a product of unit vectors says nothing there
        self.odd_a, self.odd_q = (~((n == 0) | (n > 1e-100) & (n < 1e100)) for n in (self.an, self.qn))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.ua, self.uq = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0).astype(np.float32)
                                for v, n in ((items, self.an), (queries, self.qn)))
        self.margin = MARGIN + (items.shape[1] if items.ndim > 1 else 0) * 1.2e-7     # of a product in single precision
        self.score = np.full((len(queries), k), -np.inf)
        self.place = np.full((len(queries), k), -1, np.int64)

    def offer(self, rows: np.ndarray, places: np.ndarray, keep: np.ndarray | None = None, own: np.ndarray | None = None) -> None:
        """Queries ``rows`` x items ``places``, all pairs or those of the matrix ``keep``; ``own``
        is each query's mark, each item's mark its other half, and pairs of equal marks are left out.
        One product of unit vectors in single precision, which differs from the score by rounding only, tells which
        pairs may reach a list; they alone are scored."""
        with np.errstate(invalid="ignore", over="ignore"):
            near = self.uq[rows] @ self.ua[places].T
        near[self.odd_q[rows]] = np.inf
        near[:, self.odd_a[places]] = np.inf
        if keep is not None:
            near = np.where(keep, near, np.float32(-np.inf))
        if own is not None:
            qm, im = own
            near[qm[rows][:, None] == im[places][None, :]] = -np.inf
        least = self.score[rows, -1]
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and len(places) > self.k:
            known = near[new]
            known[np.isposinf(known)] = -np.inf
            least[new] = np.partition(known, -self.k, axis=1)[:, -self.k]
        limit = np.maximum((least - self.margin).astype(np.float32), np.finfo(np.float32).min)
        ri, pi = np.divmod(np.flatnonzero(near >= limit[:, None]), near.shape[1])
        for s in range(0, len(ri), EXACT):
            self.take(rows[ri[s:s + EXACT]], places[pi[s:s + EXACT]])

    def take(self, qi: np.ndarray, pi: np.ndarray) -> None:
        """Score these pairs exactly and keep what is among the best."""
        norm = self.qn[qi] * self.an[pi]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            s = np.where(norm == 0, 0.0, np.einsum("nd,nd->n", self.q[qi], self.a[pi]) / norm)
        s = np.round(s, self.digits)
        ok = np.isfinite(s) & (s >= self.score[qi, -1])
        qi, pi, s = qi[ok], pi[ok], s[ok]
        if not len(qi):
            return
        old = np.unique(qi)
        held = self.place[old] >= 0
        qi = np.concatenate([qi, np.repeat(old, held.sum(axis=1))])
        pi, s = np.concatenate([pi, self.place[old][held]]), np.concatenate([s, self.score[old][held]])
        order = np.lexsort((pi, -s, qi))
        qi, pi, s = qi[order], pi[order], s[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        at = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        top = at < self.k
        self.score[qi[top], at[top]], self.place[qi[top], at[top]] = s[top], pi[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of all lists."""
        qi, at = np.nonzero(self.place >= 0)
        return qi, self.place[qi, at], self.score[qi, at]
