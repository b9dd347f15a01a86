"""Integer vectors, their exact products, and the best few of many, as arrays that merge."""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Below this, sums of products are exact in doubles; scores beyond it have up to DIGITS digits.
EXACT, DIGITS = float(1 << 52), 38


def integer_vectors(df: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    """Rows (id, v) and `more`: ids and integer vectors of the rows that take part."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.where(F.col(key).isNotNull() & good).select(F.col(key).cast("long").alias("id"), ints.alias("v"), *more)


@dataclass(frozen=True)
class Space:
    """Rows, components and the largest squared length of vectors, which bounds their products and all parts of these sums."""

    n: int
    width: int
    length: float

    @property
    def wide(self) -> bool:
        return self.length >= EXACT

    @property
    def kind(self) -> str:
        return f"decimal({DIGITS},0)" if self.wide else "long"

    @property
    def row_bytes(self) -> int:
        return 8 * max(1, self.width)

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Lists as the rows of a matrix, padded with zeros, of doubles or (where sums need more digits) Python integers, held to what sums of DIGITS digits allow."""
        offsets = column.offsets.to_numpy()
        values, n = column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)
        if (n == self.width).all():
            out = values.reshape(len(n), self.width)
        else:
            out = np.zeros((len(n), self.width), np.int64)
            out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], n)] = values
        if not self.wide:
            return out.astype(np.float64)
        most = math.isqrt((10**DIGITS - 1) // max(1, self.width))
        return np.clip(out, -min(most, 2**63 - 1), min(most, 2**63 - 1)).astype(object)

    def array(self, scores: np.ndarray) -> pa.Array:
        """Scores as a column of `kind`."""
        if not self.wide:
            return pa.array(scores.astype(np.int64))
        return pa.array([decimal.Decimal(int(x)) for x in scores], pa.decimal128(DIGITS, 0))

    def nullable(self, scores: np.ndarray) -> pa.Array:
        """As `array`, null where there is none (-inf)."""
        known = np.array([x != -math.inf for x in scores], bool)
        return self.array(np.where(known, scores, 0)).take(pa.array(np.arange(len(known)), mask=~known))

    def numbers(self, column: pa.Array) -> np.ndarray:
        """A column of `kind` as numbers that compare; null is below all."""
        return np.array([-math.inf if x is None else int(x) for x in column.to_pylist()], object if self.wide else np.float64)


def space(rows: DataFrame) -> Space:
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return Space(*rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first())


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: of a space's matrices as they are, of integers in doubles where all sums fit, else in Python's integers."""
    if object in (a.dtype, b.dtype) or np.float64 in (a.dtype, b.dtype):
        return a @ b.T
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if size(a) * size(b) * max(1, a.shape[1]) < 2 * EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    fits = whole.size and -(2**63) <= whole.min() and whole.max() < 2**63
    return whole.astype(np.int64) if fits else whole


def long_score(column: str) -> Column:
    """A score held to 64 bits."""
    most = 2**63 - 1
    return F.least(F.greatest(F.col(column), F.lit(-most - 1)), F.lit(most)).cast("long")


#: The best of each of n lists, k at most, as matrices of n rows and k columns: scores, ids, and whether there is one.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def nothing(n: int, k: int) -> Best:
    return np.full((n, k), -math.inf), np.zeros((n, k), np.int64), np.zeros((n, k), bool)


def best_columns(score: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Of each row's scores that count the k highest, from the left in ties: `ids`, of the columns, rise."""
    every, (out, own, has) = np.arange(len(score)), nothing(len(score), k)
    left = np.where(counts, score, -math.inf)
    out = out.astype(left.dtype)
    for j in range(min(k, left.shape[1])):
        at = left.argmax(1)
        out[:, j], own[:, j] = left[every, at], ids[at]
        has[:, j] = counts[every, at] & (out[:, j] > -math.inf)
        if not has[:, j].any():
            break
        left[every, at] = -math.inf
    return out, own, has


def merged(a: Best, b: Best, k: int) -> Best:
    """The k best of two lists each, ties to smaller ids."""
    score, ids, has = (np.concatenate(x, 1) for x in zip(a, b, strict=True))
    if score.dtype == object:
        order = np.array([sorted(range(len(s)), key=lambda j, s=s, i=i, h=h: (not h[j], -s[j], i[j]))[:k] for s, i, h in zip(score, ids, has, strict=True)], np.int64).reshape(len(score), -1)
    else:
        order = np.lexsort((ids, -score, ~has), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (score, ids, has))
