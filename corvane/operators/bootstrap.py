"""Bootstrap intervals of average precision by deterministic draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import ranking

#: The modulus of draws, and from which draw on a row's weight is 1, 2 and so on: a Poisson distribution of mean 1, to the last of these draws.
MODULUS = 2147483647
WEIGHTS = [math.floor(MODULUS * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, 13)]
#: Weights worked out at once.
BATCH_NUMBERS = 2_000_000


def with_draws(rows: DataFrame, row: Column, resample: Column) -> DataFrame:
    """`rows` with __draw, a number below MODULUS from a row's and a resample's number: integer arithmetic that any engine repeats.
    Squares keep the draws of neighbours apart; each is a column of its own, so that it is worked out once."""
    d = F.col("__draw")
    done = rows.withColumn("__draw", ((row % MODULUS + 1) * 1103515245 + (resample + 1) * 12345) % MODULUS)
    for add in ((resample + 1) * 69621, row % MODULUS + 1, (resample + 1) * 40503):
        done = done.withColumn("__draw", (d * d + add) % MODULUS)
    return done


def weights(rows: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row is in each resample, rows by resamples: by the draws of `with_draws`."""
    own, b = np.fmod(rows, MODULUS)[:, None] + 1, np.arange(1, resamples + 1)[None, :]
    d = np.fmod(own * 1103515245 + b * 12345, MODULUS)
    for add in (b * 69621, own, b * 40503):
        d = np.fmod(d * d + add, MODULUS)
    return np.searchsorted(WEIGHTS, d, "right")


def _orders(s: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(kind, number) that rise as scores fall: NaN first, nulls last."""
    x, none = s.fill_null(0.0).to_numpy(zero_copy_only=False), s.is_null().to_numpy(zero_copy_only=False)
    odd = np.isnan(x)
    return np.where(none, 2, np.where(odd, 0, 1)), np.where(odd | none, 0.0, -x)


def _ties(kind: np.ndarray, fall: np.ndarray) -> np.ndarray:
    """Where scores change along sorted rows."""
    return np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (fall[1:] != fall[:-1]))) if len(kind) else np.zeros(0, np.int64)


#: Laid out: rows of one score apart, or (with tp and n, an element a resample) many of them as one.
LAID = "y long, s double, row long, tp array<long>, n array<long>"


def merged_ties(rows: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """Rows (keys, y, s, row) where they are, those of one score in a batch as one row of sums where that is smaller."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in range(len(keys))]
            y, s, row = (batch.column(len(keys) + i) for i in range(3))
            kind, fall = _orders(s)
            order = np.lexsort((fall, kind, *codes))
            same = np.stack([x[order] for x in (*codes, kind, fall)])
            first = np.flatnonzero(np.append(True, (same[:, 1:] != same[:, :-1]).any(0))) if len(order) else np.zeros(0, np.int64)
            stop = np.append(first[1:], len(order))
            many = stop - first > max(8, resamples // 3)
            single = np.sort(np.concatenate([order[a:b] for a, b in zip(first[~many], stop[~many], strict=True)] or [np.zeros(0, np.int64)]))
            none = pa.nulls(len(single), pa.list_(pa.int64()))
            own = batch.take(pa.array(single))
            yield pa.RecordBatch.from_arrays([*own.columns, none, none], [*keys, "y", "s", "row", "tp", "n"])
            for a, b in zip(first[many], stop[many], strict=True):
                tp, n = _sums(y.take(pa.array(order[a:b])).to_numpy(), row.take(pa.array(order[a:b])).to_numpy(), resamples)
                head = batch.slice(int(order[a]), 1)
                whole = [*(head.column(i) for i in range(len(keys))), pa.nulls(1, pa.int64()), head.column(len(keys) + 1), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays([*whole, pa.array([tp], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], [*keys, "y", "s", "row", "tp", "n"])

    schema = rows.select(*keys).schema
    for f in rows.sparkSession.createDataFrame([], LAID).schema:
        schema = schema.add(f)
    return rows.select(*keys, "y", "s", "row").mapInArrow(merge, schema)


def _sums(y: np.ndarray, row: np.ndarray, resamples: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights, of positive rows and of all, a number a resample."""
    tp, n = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
    step = max(1, BATCH_NUMBERS // resamples)
    for at in range(0, len(row), step):
        w = weights(row[at : at + step], resamples)
        n += w.sum(0)
        tp += y[at : at + step] @ w
    return tp, n


def _by_tie(table: pa.Table, resamples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tp, n), ties by resamples, of laid-out rows of one range, by falling score, some ties at a time."""
    table = table.combine_chunks()
    kind, fall = _orders(table["s"].combine_chunks() if table.num_rows else pa.array([], pa.float64()))
    order = np.lexsort((fall, kind))
    first = _ties(kind[order], fall[order])
    y, row = (table[c].fill_null(0).to_numpy()[order] for c in ("y", "row"))
    whole = table["tp"].is_valid().to_numpy()[order]
    held = {c: table[c] for c in ("tp", "n")}
    step = max(1, BATCH_NUMBERS // resamples)
    at = 0
    while at < len(first):
        # Ties that together have about `step` rows; a larger one alone.
        stop = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1) if first[-1] >= first[at] + step else len(first)
        a, b = first[at], first[stop] if stop < len(first) else len(order)
        tp, n = np.zeros((stop - at, resamples), np.int64), np.zeros((stop - at, resamples), np.int64)
        tie = np.searchsorted(first[at:stop], np.arange(a, b), "right") - 1
        for lo in range(0, b - a, step):
            own = np.flatnonzero(~whole[a + lo : min(b, a + lo + step)]) + lo
            if len(own):
                w = weights(row[a + own], resamples)
                starts = np.flatnonzero(np.append(True, np.diff(tie[own])))
                n[tie[own[starts]]] += np.add.reduceat(w, starts, axis=0)
                tp[tie[own[starts]]] += np.add.reduceat(w * y[a + own][:, None], starts, axis=0)
        for i in np.flatnonzero(whole[a:b]):
            n[tie[i]] += held["n"][int(order[a + i])].values.to_numpy()
            tp[tie[i]] += held["tp"][int(order[a + i])].values.to_numpy()
        yield tp, n
        at = stop


def intervals(scored: DataFrame, group: str, order: str, resamples: int = 1000, confidence: float = 0.95) -> DataFrame:
    """ci_lower and ci_upper of average precision per `group`: percentiles over resamples of its rows.

    Each row (told by `order`, a number) has a weight in each resample, drawn from a Poisson distribution of mean
    1: the bootstrap of rows that nobody has to count or number first. Rows are laid out by group and range of scores; a
    range's weights are a matrix, rows by resamples, of which only sums leave its task: first a range's own, which give each
    range its start, then its part of each resample's precision. Many rows of one score are summed where they are read.
    Resamples without positives or without negatives are left out; a group of one kind only has no row.
    """
    rows = scored.select(group, F.col("y").cast("long").alias("y"), F.col("s").cast("double").alias("s"), F.col(order).cast("long").alias("row"))
    n = ranking.n_ranges(scored)
    cut = rows.withColumn("range", F.lit(0)) if n == 1 else ranking.in_ranges(rows, "s", "range", n)
    keys = [group, "range"]
    laid = merged_ties(cut, keys, resamples)
    kind = laid.schema[group].dataType.simpleString()
    arrays = "tp array<long>, n array<long>"

    def summed(table: pa.Table) -> pa.Table:
        tp, n = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
        for a, b in _by_tie(table, resamples):
            tp, n = tp + a.sum(0), n + b.sum(0)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "tp": pa.array([tp], pa.list_(pa.int64())), "n": pa.array([n], pa.list_(pa.int64()))})

    sums = laid.groupBy(*keys).applyInArrow(summed, f"`{group}` {kind}, range int, {arrays}")
    each = sums.select(*keys, F.posexplode(F.arrays_zip("tp", "n")).alias("b", "x")).select(*keys, "b", "x.tp", "x.n")  # ranges times resamples
    own = Window.partitionBy(group, "b")
    above = own.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    started = each.select(*keys, "b", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("q0"), F.sum("tp").over(own).alias("p"), F.sum("n").over(own).alias("q"))
    packed = started.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "p0", "q0", "p", "q"))).alias("x"))
    starts = packed.select(*keys, *(F.col("x")[c].alias(c) for c in ("p0", "q0", "p", "q")))  # an array each

    def part(table: pa.Table, start: pa.Table) -> pa.Table:
        """A range's part of each resample's precision; null for those of one kind."""
        p0, q0, p, q = (start[c][0].values.to_numpy() for c in ("p0", "q0", "p", "q"))
        good, out = (p > 0) & (p < q), np.zeros(resamples)
        for tp, n in _by_tie(table, resamples):
            ctp, cn = p0 + np.cumsum(tp, 0), q0 + np.cumsum(n, 0)
            out += (tp * ctp / np.maximum(1, cn) / np.maximum(1, p)).sum(0)
            p0, q0 = ctp[-1], cn[-1]
        parts = pa.array(np.where(good, out, 0.0)).take(pa.array(np.arange(resamples), mask=~good))
        return pa.table({group: table[group].slice(0, 1), "ap": pa.ListArray.from_arrays(pa.array([0, resamples], pa.int32()), parts)})

    parts = laid.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(part, f"`{group}` {kind}, ap array<double>")
    points = parts.select(group, F.posexplode("ap").alias("b", "ap")).where("ap IS NOT NULL").groupBy(group, "b").agg(F.sum("ap").alias("ap"))
    tail = (1 - confidence) / 2
    # As many points a group as resamples.
    return points.groupBy(group).agg(F.percentile("ap", tail).alias("ci_lower"), F.percentile("ap", 1 - tail).alias("ci_upper"))
