"""Exact top-k by integer inner product through a pivot-distance index.

Vectors become integers, floor(256 x). A further component lifts all of them to one length, so a larger
inner product is a smaller distance. Pivots come from a bounded sample. Each row is keyed by its nearest
pivot and its distance to it; rows are laid out in that order and cut into regions, each what a task can
hold, and these into cells, annuli of one pivot. A directory keeps each cell's pivot and least and largest
distance.

A query's sample rows give a first bound on its k-th score, so a radius. By the triangle inequality a cell
whose distances differ from the query's own by more than the radius cannot hold a result. Queries are rows
all along, dealt to regions: first to the one with the nearest cell, whose best tighten the radius, then to
all others that have a cell within reach. A vector so moves once a region at most, however little the bounds
leave out. In a region, cells are met in the order of their distance, each by the queries it is still in
reach of, and what they find tightens their radius for the next. Queries of a region that very many reach are met in
parts. `Search.looked` counts the products that were worked out.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; a query's candidates are rows of other ids; rows of one id and
vector are one query, but each is a candidate; rows of one id and different vectors are queries of
their own; fewer candidates than k give fewer rows; ties go to the smaller id; scores are ranked whole and
held to 64 bits only in the result, components to 18 digits or so; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import written
from corvane.llm.scores import best_columns, integer_vectors, long_score, merged, nothing, products, space

#: Rows that pivots and first bounds come from; pivots.
SAMPLE_ROWS, PIVOTS = 4_096, 64
#: Rows of a cell at least, and cells at about most: the directory goes to all tasks.
CELL_ROWS, CELLS = 2_048, 200_000
#: Queries that a task streams past a region: more of them, as where many rows are copies, are split, each part with the region's rows.
PART_QUERIES = 20_000
#: Numbers worked on at once, and bytes of a region and of a task's queries.
BATCH_NUMBERS, TASK_BYTES = 4_000_000, 64_000_000
REGION_BITS = 32  # of a cell's number: above are the region's


def lifted(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with a component more, so that their squared length is `square`."""
    v = v.astype(np.float64)
    return np.concatenate((v, np.sqrt(np.maximum(0, square - (v * v).sum(1)))[:, None]), 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(0, squares))


def choose_pivots(points: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Means of clusters around spread-out points."""
    if not len(points):
        return points
    chosen = [0]
    gap = distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    pivots = points[chosen]
    for _ in range(rounds):
        own = distances(points, pivots).argmin(1)
        pivots = np.stack([points[own == i].mean(0) if (own == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


def reached(far: np.ndarray, radius: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float, first: int, count: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers (query, cell): of each query's cells by rising gap those from place `first` on, `count` at most, that its radius reaches.

    far: distances of queries to pivots; a gap is how much a cell's distances differ from the query's at least.
    """
    gaps = np.maximum(0, np.maximum(far[:, pivot] - high[None, :], low[None, :] - far[:, pivot]))
    near = gaps <= (radius + slack)[:, None]
    if first == 0 and count is None:
        return np.nonzero(near)
    order = np.argsort(gaps, axis=1, kind="stable")[:, first : None if count is None else first + count]
    query, place = np.nonzero(np.take_along_axis(near, order, 1))
    return query, order[query, place]


class Search:
    """An index and what a search in it needs; see the module."""

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        self.spark = vectors.sparkSession
        self.rows = integer_vectors(vectors, key, vector)
        self.space = space(self.rows)
        # Lengths and distances come from differences of squares: errors are of the order of the root of a double's step.
        self.slack = 1e-6 * (1 + self.space.length**0.5)
        taken = self.rows.orderBy(F.xxhash64("id", F.lit(6)), "id", F.xxhash64("v")).limit(SAMPLE_ROWS).toArrow()
        self.sample_ids = taken["id"].to_numpy()
        self.sample = self.space.matrix(taken["v"].combine_chunks()) if len(taken) else np.zeros((0, self.space.width))
        self.pivots = choose_pivots(lifted(self.sample, self.space.length), PIVOTS)
        self.looked = self.spark.sparkContext.accumulator(0)

    def tasks(self, rows: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * self.space.row_bytes // TASK_BYTES))

    def index(self) -> tuple[DataFrame, DataFrame]:
        """(cell, id, v) of all rows, and (cell, pivot, low, high) of all cells, both written. A file is a region."""
        where, pivots = self.space, self.pivots
        cell_rows = max(CELL_ROWS, -(-where.n // CELLS))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                apart = distances(lifted(where.matrix(batch.column(1)), where.length), pivots)
                near = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(apart[np.arange(len(near)), near]), *batch.columns], ["pivot", "dist", "id", "v", "row"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of one pivot in their order, `cell_rows` at most, with a number no other task gives."""
            cell, held, last = TaskContext.get().partitionId() << REGION_BITS, 0, None
            for batch in batches:
                pivot = batch.column(0).to_numpy()
                own = np.empty(len(pivot), np.int64)
                turn = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else []
                for a, b in zip(turn, np.append(turn[1:], len(pivot)), strict=True):
                    if pivot[a] != last:
                        cell, held, last = cell + 1, 0, pivot[a]
                    number = (held + np.arange(b - a)) // cell_rows
                    own[a:b] = cell + number
                    cell, held = cell + int(number[-1]), held + (b - a) - int(number[-1]) * cell_rows
                yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns[:4]], ["cell", "pivot", "dist", "id", "v"])

        layout = ["pivot", "dist", "id", "row"]
        # Equal rows are told apart by where they were read, so that none of their ranges grows beyond a file.
        placed = self.rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(keyed, "pivot int, dist double, id long, v array<long>, row long")
        rows = written(placed.repartitionByRange(self.tasks(where.n), *layout).sortWithinPartitions(*layout).mapInArrow(cut, "cell long, pivot int, dist double, id long, v array<long>"), "pivot-index")
        directory = written(rows.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("dist").alias("low"), F.max("dist").alias("high")), "pivot-directory")
        cells = directory.orderBy("cell").toArrow()  # CELLS rows or a few more
        self.cells = self.spark.sparkContext.broadcast(tuple(cells[c].to_numpy() for c in ("cell", "pivot", "low", "high")))
        return rows.select("cell", "id", "v"), directory

    def bounded(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries (q, id, v) with floor: the k-th best score among the sample's rows of other ids; null if these are fewer."""
        sample, sample_ids, where = self.sample, self.sample_ids, self.space

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v = batch.column(1).to_numpy(), where.matrix(batch.column(2))
                floor = np.full(len(ids), -np.inf)
                if len(sample) >= k:
                    score = np.where(ids[:, None] != sample_ids[None, :], products(v, sample), -np.inf)
                    floor = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
                yield pa.RecordBatch.from_arrays([*batch.columns, where.nullable(floor)], ["q", "id", "v", "floor"])

        return queries.mapInArrow(bound, f"q long, id long, v array<long>, floor {where.kind}")

    def dealt(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """(region, q, id, v, floor): queries (q, id, v, floor, seen) to the region of their nearest cell, or to all but the `seen` one with a cell in reach."""
        shared, where, pivots, slack = self.cells, self.space, self.pivots, self.slack

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, pivot, low, high = shared.value
            region = cell >> REGION_BITS
            step = max(1, BATCH_NUMBERS // max(1, len(cell), 64 * where.width))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    lift, radius = around(where.matrix(part.column(2)), where.numbers(part.column(3)), where.length)
                    query, place = reached(distances(lift, pivots), np.full(len(radius), np.inf) if nearest else radius, pivot, low, high, slack, 0, 1 if nearest else None)
                    both = np.unique(np.stack((query, region[place]), 1), axis=0)
                    if not nearest:
                        both = both[both[:, 1] != part.column(4).to_numpy()[both[:, 0]]]
                    for a in range(0, len(both), 4_096):
                        own = both[a : a + 4_096]
                        yield pa.RecordBatch.from_arrays([pa.array(own[:, 1]), *part.take(pa.array(own[:, 0])).columns[:4]], ["region", "q", "id", "v", "floor"])

        return queries.mapInArrow(deal, f"region long, q long, id long, v array<long>, floor {where.kind}")

    def met(self, index: DataFrame, dealt: DataFrame, n_dealt: int, k: int) -> DataFrame:
        """(q, query_id, vec_id, score): the k best of each dealt query's region, not under the query's floor."""
        shared, where, pivots, slack, looked = self.cells, self.space, self.pivots, self.slack, self.looked
        regions = F.broadcast(dealt.groupBy("region").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("parts")))  # no more than the index has files
        every, own = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.pmod(F.hash("q"), F.col("parts"))
        none = F.lit(None).cast("long")
        rows = index.withColumn("region", F.shiftright("cell", REGION_BITS)).join(regions, "region")
        held = rows.select("region", every.alias("part"), F.lit(0).alias("side"), "cell", none.alias("q"), "id", "v", F.lit(None).cast(where.kind).alias("floor"))
        both = held.unionByName(dealt.join(regions, "region").select("region", own.alias("part"), F.lit(1).alias("side"), none.alias("cell"), "q", "id", "v", "floor"))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A region's rows, by cell and id, come before the queries that are dealt to this part of it."""
            current, waiting, cells = None, [], []
            for batch in batches:
                region, number, side = (batch.column(i).to_numpy() for i in range(3))
                turn = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (number[1:] != number[:-1]) | (side[1:] != side[:-1]))) if len(region) else []
                for a, b in zip(turn, np.append(turn[1:], len(region)), strict=True):
                    if (region[a], number[a]) != current:
                        current, waiting, cells = (region[a], number[a]), [], []
                    part = batch.slice(a, b - a)
                    if side[a] == 0:
                        waiting.append((part.column(3).to_numpy(), part.column(5).to_numpy(), where.matrix(part.column(6))))
                        continue
                    if waiting:
                        cell, ids, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
                        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                        cells, waiting = [(cell[i], ids[i:j], v[i:j]) for i, j in zip(first, np.append(first[1:], len(cell)), strict=True)], []
                    step = max(1, BATCH_NUMBERS // max(len(ids) for _, ids, _ in cells))
                    for at in range(0, part.num_rows, step):
                        own = part.slice(at, step)
                        q, own_ids, v, floor = own.column(4).to_numpy(), own.column(5).to_numpy(), where.matrix(own.column(6)), where.numbers(own.column(7))
                        (score, found, has), n = best_in(cells, shared.value, v, own_ids, floor, k, pivots, where.length, slack)
                        looked.add(n)
                        row, col = np.nonzero(has)
                        yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(own_ids[row]), pa.array(found[row, col]), where.array(score[row, col])], ["q", "query_id", "vec_id", "score"])

        tasks = self.tasks(n_dealt + where.n)
        return both.repartition(tasks, "region", "part").sortWithinPartitions("region", "part", "side", "cell", "id").mapInArrow(look, f"q long, query_id long, vec_id long, score {where.kind}")


def around(v: np.ndarray, floor: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries in the lifted space, and the radii within which scores are at least `floor`."""
    v = v.astype(np.float64)
    lift = np.concatenate((v, np.zeros((len(v), 1))), 1)
    return lift, np.sqrt(np.maximum(0, (v * v).sum(1) + length - 2.0 * floor.astype(np.float64)))


def best_in(cells: list, directory: tuple, v: np.ndarray, own_ids: np.ndarray, floor: np.ndarray, k: int, pivots: np.ndarray, length: float, slack: float):
    """The k best of each query in these cells (number, ids, vectors), not under its floor, and how many products were worked out."""
    number, pivot, low, high = directory
    at = np.searchsorted(number, [c[0] for c in cells])
    lift, radius = around(v, floor, length)
    far = distances(lift, pivots)
    gaps = np.maximum(0, np.maximum(far[:, pivot[at]] - high[at][None, :], low[at][None, :] - far[:, pivot[at]]))
    best, n = nothing(len(v), k), 0
    if floor.dtype == object:
        best = (best[0].astype(object), *best[1:])
    for c in np.argsort(gaps.mean(0), kind="stable"):
        near = np.flatnonzero(gaps[:, c] <= radius + slack)
        if not len(near):
            continue
        _, ids, rows = cells[c]
        score = products(v[near], rows)
        n += score.size
        counts = (score >= floor[near, None]) & (ids[None, :] != own_ids[near, None])
        some = counts.any(1)
        near, score, counts = near[some], score[some], counts[some]
        if not len(near):
            continue
        new = merged(tuple(x[near] for x in best), best_columns(score, counts, ids, k), k)
        for old, x in zip(best, new, strict=True):
            old[near] = x
        full = near[new[2][:, -1]]
        floor[full] = np.maximum(floor[full], best[0][full, -1])
        radius[full] = around(v[full], floor[full], length)[1]
    return best, n


def best_rows(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that `is_query` (over `id`, the key), the k best of all others."""
    search = Search(vectors, key, vector)
    index, _ = search.index()
    numbered = written(search.rows.where(is_query).distinct().select(F.monotonically_increasing_id().alias("q"), "id", "v"), "pivot-ids")
    state = written(search.bounded(numbered, k), "pivot-queries")
    first = written(search.dealt(state.withColumn("seen", F.lit(-1).cast("long")), nearest=True), "pivot-dealt")
    best = written(best_rows(search.met(index, first, first.count(), k), k), "pivot-best")
    floors = best.where(F.col("rank") == k).select("q", F.col("score").alias("better"))
    tighter = first.join(floors, "q", "left").select("q", "id", "v", F.coalesce(F.greatest("floor", "better"), "floor", "better").alias("floor"), F.col("region").alias("seen"))
    rest = written(search.dealt(written(tighter, "pivot-queries"), nearest=False), "pivot-dealt")
    found = search.met(index, rest, rest.count(), k).unionByName(best.drop("rank"))
    return best_rows(found, k).select("query_id", "rank", "vec_id", long_score("score").alias("score"))
