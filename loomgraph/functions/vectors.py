"""Vector expressions and the hashed bag-of-words embedding."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 128
_TOKEN = re.compile(r"[a-z0-9]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; vectors of different lengths are an error."""
    size = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    scale = norm(a) * norm(b)
    return F.when(size.isNull(), F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale))


def bucket(token: str) -> int:
    return int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "big") % DIMS


def bow(texts, known: dict[str, int]) -> np.ndarray:
    """A row for each text: its token counts in hashed buckets, of length 1 or 0. known: buckets of tokens seen."""
    found = [_TOKEN.findall((text or "").lower()) for text in texts]
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    tokens = [t for f in found for t in f]
    for t in set(tokens).difference(known):  # each token is hashed once
        known[t] = bucket(t)
    at = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    counts = np.bincount(rows * DIMS + at, minlength=len(found) * DIMS).reshape(-1, DIMS).astype(float)
    size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return counts / np.where(size > 0, size, 1.0)


def _bow(texts):
    known: dict[str, int] = {}
    for batch in texts:
        yield pd.Series(list(bow(batch, known)))
        if len(known) > 500_000:
            known.clear()


def bow_embedding(text) -> Column:
    """Unit vector of token counts in hashed buckets; the zero vector without tokens."""
    return F.pandas_udf(_bow, "array<double>", F.PandasUDFType.SCALAR_ITER)(text)


def quantised(vec: Column) -> Column:
    """Normalised components times 127, rounded half to even, within -127 .. 127; a zero vector stays zero."""
    n = norm(vec)
    return F.transform(vec, lambda x: F.when(n == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / n * 127, 0).cast("int")))).cast("tinyint"))


def packed(codes: Column) -> Column:
    """Base64 of signed bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("int").bitwiseAND(F.lit(255))), 2, "0")), "")))


def quantised_score(codes: Column, query: Column) -> Column:
    return dot(codes, query) / 127
