"""Text embedding and vector similarity.

The default embedder hashes words into ``dim`` buckets. It is deterministic,
needs no model file and can be recomputed in SQL. Any callable from a text
column to an ``array<float>`` column can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from loomgraph.settings import EMBEDDING_DIM

Embedder = Callable[[Column], Column]

_HUMP = re.compile(r"([a-z0-9])([A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_CACHE_LIMIT = 1_000_000


def hash_embedder(dim: int = EMBEDDING_DIM) -> Embedder:
    """Word counts per hash bucket; identifiers split at case humps and underscores."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        bucket_of: dict[str, int] = {}

        def one(text: str | None) -> np.ndarray:
            vector = np.zeros(dim, dtype=np.float32)
            words = _WORD.findall(_HUMP.sub(r"\1 \2", text or "").lower())
            if words:
                if len(bucket_of) > _CACHE_LIMIT:
                    bucket_of.clear()
                buckets = []
                for word in words:
                    bucket = bucket_of.get(word)
                    if bucket is None:
                        digest = hashlib.md5(word.encode()).hexdigest()
                        bucket = bucket_of[word] = int(digest[:4], 16) % dim
                    buckets.append(bucket)
                vector += np.bincount(buckets, minlength=dim).astype(np.float32)
            return vector

        return texts.map(one)

    return embed


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors, 0 where either has no length."""
    a, b = left.cast("array<double>"), right.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p * q)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
