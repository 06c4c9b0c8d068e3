"""Embedding helpers (E1-E3, M2): a pluggable encoder interface and a
deterministic hashing encoder whose token hashing is native Spark."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import _c

# Fixed value: term pattern for keyword search and the hashing encoder.
TERM_RE = r"[\p{L}\p{N}']+"

ENCODED = 1024      # texts encoded together


def terms(c) -> Column:
    """All lower-case terms of a text, in order (duplicates kept)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(f"({TERM_RE})"), 1)


def term_buckets(c, dim: int) -> Column:
    """Bucket of every term: first 32 bits of md5(term) mod ``dim``."""
    return F.transform(terms(c), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"),
                                                  F.lit(dim)).cast("int"))


class HashingEncoder:
    """Bag of hashed terms, L2-normalised, as array<float>.

    Token hashing runs in the JVM; only the bincount + normalise step runs
    in an Arrow-batched iterator pandas UDF.
    """

    def __init__(self, dim: int = 128):
        if dim < 1:
            raise ValueError("dim must be >= 1")
        self.dim = dim

    def prepare(self, text) -> Column:
        return term_buckets(text, self.dim)

    def udf(self):
        dim = self.dim

        def vectors(s: pd.Series) -> list:
            lens = s.map(len).to_numpy()
            flat = (np.concatenate([np.asarray(b, dtype=np.int64) for b in s.to_numpy()])
                    if len(s) else np.zeros(0, dtype=np.int64))
            rows = np.repeat(np.arange(len(s)), lens)
            m = np.bincount(rows * dim + flat, minlength=len(s) * dim).reshape(len(s), dim).astype(np.float64)
            n = np.sqrt(np.einsum("ij,ij->i", m, m))
            m = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
            return list(m.astype(np.float32))

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:       # some at a time: a batch's buckets as numbers take many times its bytes
                yield pd.Series([v for at in range(0, len(s), ENCODED) for v in vectors(s.iloc[at:at + ENCODED])], dtype=object)

        return encode


def embed(df: DataFrame, text_col: str, encoder=None, out_col: str = "embedding") -> DataFrame:
    """Add ``out_col`` = encoder(text). The encoder supplies a native
    ``prepare`` expression and an iterator pandas UDF (model loaded once per
    task); swap in any model with the same two methods."""
    encoder = encoder or HashingEncoder()
    return df.withColumn(out_col, encoder.udf()(encoder.prepare(F.col(text_col))))


def check_dim(df: DataFrame, dim: int, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) - valid rows have exactly ``dim`` non-null finite
    elements; rejected rows carry a ``reason``."""
    v = F.col(col)
    reason = (F.when(v.isNull(), F.lit("null vector"))
              .when(F.size(v) != dim, F.concat(F.lit("dimension "), F.size(v).cast("string"),
                                               F.lit(f" != {dim}")))
              .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
                    F.lit("null or non-finite element")))
    tagged = df.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def mean_vector(df: DataFrame, key: str, col: str = "embedding", out: str = "centroid") -> DataFrame:
    """Element-wise mean of the vectors of each key (partial aggregation per
    (key, position), so a hot key costs one row per task per position)."""
    pos = df.select(key, F.posexplode(col).alias("pos", "x"))
    agg = pos.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return (agg.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
            .select(key, F.transform("_v", lambda s: s["x"]).alias(out)))
