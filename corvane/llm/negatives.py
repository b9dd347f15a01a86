"""Hard negatives by blocked dense products: anchors in blocks against blocks of all rows.

Vectors become integers, floor(256 x), so that products in float64 are exact while all sums stay below
2^53; beyond that the same blocks are worked out in Python's integers. Anchors are written once and cut
into blocks of bounded bytes. A block goes to all tasks, each of which multiplies it with one batch of
rows after another and keeps the best rows of each anchor's label in an array; two batches' or two
tasks' arrays merge into one of the same size. A second pass over the rows keeps, for each anchor and
positive, the best of those with another label whose score lies in the window below the positive's. What
is shuffled are the arrays of tasks: anchors times positives times negatives at most.

Defined results: rows take no part whose key, label or vector is null or whose vector holds null or
non-finite components; shorter vectors count as padded with zeros; positives are rows of other keys;
anchors of one key, vector and label are one anchor, but every such row is a candidate; ties go to the
smaller key; fewer candidates give fewer rows, an empty window none; scores are ranked and compared
whole and held to 64 bits only in the result, components to 18 digits or so; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import written
from corvane.llm.scores import Best, Space, best_columns, integer_vectors, long_score, merged, nothing, products, space

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's: at least, at most.
WINDOW = (50, 95)
#: Bytes of a block of anchors, which a pass sends to all tasks; numbers worked on at once.
BLOCK_BYTES, BATCH_NUMBERS = 32_000_000, 2_000_000
RANK_BITS = 33  # of monotonically_increasing_id: below are places in a task, above its number

ANCHORS = "q long, id long, v array<long>, label long"


def blocks_of(batches: Iterator[pa.RecordBatch], where: Space, anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, labels) of rows (id, v, label), in parts whose products with `anchors` rows are few enough at once, by rising id."""
    step = max(1, BATCH_NUMBERS // max(1, anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], where.matrix(part.column(1))[order], part.column(2).to_numpy()[order]


def kept(rows: DataFrame, where: Space, block: DataFrame | pa.Table, pick: Callable, lists: int, k: int) -> DataFrame:
    """Rows (q, slot, id, score): what `pick` keeps of each task's rows, `lists` lists of `k` for each anchor of the block.

    pick(score, anchor ids, anchor labels, ids, labels) gives what counts for each list, as masks."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        q, own, labels = (held[c].to_numpy() for c in ("q", "id", "label"))
        vectors = where.matrix(held["v"].combine_chunks())
        best: list[Best] = [nothing(len(q), k) for _ in range(lists)]
        for ids, v, of in blocks_of(batches, where, len(q)):
            score = products(vectors, v)
            for slot, counts in enumerate(pick(score, own, labels, ids, of)):
                better = counts & (score >= best[slot][0][:, -1:])
                some = np.flatnonzero(better.any(1))
                if len(some):
                    new = merged(tuple(x[some] for x in best[slot]), best_columns(score[some], better[some], ids, k), k)
                    best[slot] = tuple(_put(x, some, y) for x, y in zip(best[slot], new, strict=True))
        for slot, (score, ids, has) in enumerate(best):
            row, col = np.nonzero(has)
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(np.full(len(row), slot, np.int32)), pa.array(ids[row, col]), where.array(score[row, col])], ["q", "slot", "id", "score"])

    return rows.mapInArrow(look, f"q long, slot int, id long, score {where.kind}")


def _put(x: np.ndarray, rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = x.astype(np.promote_types(x.dtype, new.dtype))
    out[rows] = new
    return out


def first_rows(found: DataFrame, k: int, *by: str) -> DataFrame:
    """Of each list the first k of all tasks' rows, numbered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `is_anchor` is over `id`, the key, `label` over the given columns."""
    rows = integer_vectors(vectors.where(label.isNotNull()), key, vector, label.cast("long").alias("label"))
    where = space(rows)
    most = max(1, BLOCK_BYTES // (where.row_bytes * (4 if where.wide else 1)))
    anchors = rows.where(is_anchor).distinct()
    anchors = written(anchors.repartition(max(1, -(-anchors.count() // most))).select(F.monotonically_increasing_id().alias("q"), "id", "v", "label"), "anchors")
    run = F.shiftright("q", RANK_BITS), F.floor(F.pmod("q", F.lit(1 << RANK_BITS)) / most)
    runs = anchors.groupBy(run[0].alias("task"), run[1].alias("run")).count().orderBy("task", "run").collect()  # a row a block
    spark, found = vectors.sparkSession, None
    low, high = window

    def same(score, own, labels, ids, of):
        yield (labels[:, None] == of[None, :]) & (own[:, None] != ids[None, :])

    for r in runs:
        block = anchors.where((run[0] == r["task"]) & (run[1] == r["run"])).orderBy("q").toArrow()  # `most` rows at most
        best = first_rows(kept(rows, where, block, same, 1, positives), positives, "q").select("q", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        best = written(best, "positives")
        least, top, some = _limits(best.toArrow(), block["q"].to_numpy(), where, positives, low, high)  # `positives` rows an anchor of the block

        def inside(score, own, labels, ids, of, least=least, top=top, some=some):
            other = labels[:, None] != of[None, :]
            for p in range(positives):
                yield other & some[:, p, None] & (score >= least[:, p, None]) & (score <= top[:, p, None])

        taken = first_rows(kept(rows, where, block, inside, positives, negatives), negatives, "q", "slot").withColumn("place", F.col("slot") + 1)
        ids = anchors.where((run[0] == r["task"]) & (run[1] == r["run"])).select("q", F.col("id").alias("anchor_id"))
        part = taken.join(best, ["q", "place"]).join(ids, "q")
        part = part.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), long_score("positive_score").alias("positive_score"), long_score("score").alias("negative_score"))
        found = written(part, "negatives") if found is None else found.unionByName(written(part, "negatives"))
    if found is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], schema)
    return found


def _limits(best: pa.Table, q: np.ndarray, where: Space, positives: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and highest score of negatives, and whether there is one, by anchor of the block (`q` rises) and positive."""
    kind = object if where.wide else np.float64
    least, top, some = np.zeros((len(q), positives), kind), np.zeros((len(q), positives), kind), np.zeros((len(q), positives), bool)
    row, place = np.searchsorted(q, best["q"].to_numpy()), best["place"].to_numpy() - 1
    scores = [int(x) for x in best["positive_score"].to_pylist()]
    least[row, place], top[row, place], some[row, place] = [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores], True
    return least, top, some
