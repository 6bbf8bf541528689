"""Vectors for texts: a stable default, and the place to plug in another function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed value: default width
DIMENSIONS = 384
# texts whose hashed words are added up at a time
SLICE = 512
WORD = r"([\p{L}\p{N}]+)"

Embedder = Callable[[Column], Column]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Signed feature hashing of the lower-cased words, scaled to length 1; no words give zeros.

    The JVM hashes the words, Python only adds up the buckets of a batch.
    """

    @F.pandas_udf("array<float>")
    def buckets(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=object)
        # slices bound the sums, which are many times wider than the vectors that are kept
        return pd.Series([v for i in range(0, len(hashes), SLICE) for v in summed(hashes[i : i + SLICE])])

    def summed(hashes: pd.Series) -> np.ndarray:
        lengths = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes])
        row = np.repeat(np.arange(len(hashes)), lengths)
        sign = np.where((flat >> 40) & 1, 1.0, -1.0)
        sums = np.bincount(row * dimensions + flat % dimensions, weights=sign, minlength=len(hashes) * dimensions)
        sums = sums.astype(float).reshape(len(hashes), dimensions)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        return np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).astype(np.float32)

    def embed(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
        return buckets(F.transform(words, lambda w: F.xxhash64(w)))

    return embed


def embed_column(df: DataFrame, text: str = "text", embedder: Embedder | None = None, out: str = "embedding") -> DataFrame:
    """Adds the vector of a text column. Questions and chunks must use the same embedder."""
    return df.withColumn(out, (embedder or hashing_embedder())(F.col(text)))
