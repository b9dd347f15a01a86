"""Ranking metrics over scored rows (group columns, y 0/1, s).

Rows of one score are summed first, so ties count as one step. Where the planner expects the distinct scores
to be few (by the sizes of the files read), running sums are windows over groups. Beyond that the scores
are cut into ranges, as many as their size asks for, summed per group and range, and the ranges' sums give
each its start: a window holds one range of one group, never all rows or all of a group. Both give the
same numbers, and neither runs anything before its result is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import estimated_bytes

#: Bytes that a window may be expected to hold whole, and bytes of a range about.
WINDOW_BYTES, RANGE_BYTES = 64_000_000, 64_000_000
#: Ranges at least (and where there is no estimate) and at most, and the accuracy of their edges.
RANGES, MOST_RANGES, ACCURACY = 256, 4_096, 20_000


def n_ranges(df: DataFrame) -> int:
    """How many ranges to cut the rows of `df` into; 1 where a window may hold them all."""
    size = estimated_bytes(df)
    if size <= WINDOW_BYTES:
        return 1
    return RANGES if size > 1 << 60 else min(MOST_RANGES, max(RANGES, size // RANGE_BYTES))


def in_ranges(df: DataFrame, value: str, column: str, n: int, *kept: str) -> DataFrame:
    """`df` with `column`: which of about `n` ranges of about equally many rows `value` falls into; nulls first, NaN last.

    The edges are one row, worked out within the plan. `kept`: columns that this reading of `df` takes along, so that its
    shuffles are the same as those of the other readings, and are made once."""
    finite = F.when(F.abs(value) < float("inf"), F.col(value).cast("double"))  # not NaN either, which is above all
    rest = [F.max(c).alias(f"__{i}") for i, c in enumerate(kept)]
    marks = df.agg(F.percentile_approx(finite, [i / n for i in range(1, n)], ACCURACY).alias("__marks"), *rest)
    marks = marks.select(F.array_sort(F.array_distinct(F.coalesce("__marks", F.array().cast("array<double>")))).alias("__marks"))
    middle = lambda acc: F.floor((acc["a"] + acc["b"]) / 2).cast("int")

    def halve(acc: Column, _: Column) -> Column:
        """Marks before a are at or under the value, those from b on above it."""
        under = F.get("__marks", middle(acc)) <= F.col(value)
        moved = F.struct(F.when(under, middle(acc) + 1).otherwise(acc["a"]).alias("a"), F.when(under, acc["b"]).otherwise(middle(acc)).alias("b"))
        return F.when(acc["a"] < acc["b"], moved).otherwise(acc)

    start = F.struct(F.lit(0).alias("a"), F.size("__marks").alias("b"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, halve, lambda acc: acc["a"])
    return df.crossJoin(F.broadcast(marks)).withColumn(column, F.when(F.col(value).isNull(), -1).otherwise(found)).drop("__marks")


def tie_groups(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and score: tp and n, the positives and rows that have it."""
    return scored.groupBy(*by, "s").agg(F.sum(F.col("y").cast("long")).alias("tp"), F.count("*").alias("n"))


def running(ties: DataFrame, by: list[str]) -> DataFrame:
    """`ties` with ctp and cn (sums over this score and all above), tp_all and n_all (of the group)."""
    by = list(by)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    n = n_ranges(ties)
    if n == 1:
        down = group.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
        return ties.withColumns({"ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down), "tp_all": F.sum("tp").over(group), "n_all": F.sum("n").over(group)})
    keys = [*by, "range"]
    parts = in_ranges(ties, "s", "range", n, *by, "tp", "n")
    down = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    above = group.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    sums = parts.groupBy(*keys).agg(F.sum("tp").alias("p"), F.sum("n").alias("q"))
    starts = sums.select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q0"), F.sum("p").over(group).alias("tp_all"), F.sum("q").over(group).alias("n_all")
    )
    own = parts.withColumns({"ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down)})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    found = own.join(starts if by else F.broadcast(starts), same)
    return found.withColumns({"ctp": F.col("ctp") + F.col("p0"), "cn": F.col("cn") + F.col("q0")}).drop("range", "p0", "q0", *(f"__{k}" for k in keys))


def percentiles(rows: DataFrame, value: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """A column per name of `qs` for each group: the percentile with linear interpolation between the sorted values, from running
    counts of distinct values: no group is held whole."""
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, (-F.col(value).cast("double")).alias("s")).agg(F.lit(0).cast("long").alias("tp"), F.count("*").alias("n"))
    steps = running(counts, by)
    place = {name: (F.col("n_all") - 1) * q for name, q in qs.items()}
    at = lambda rank: F.min(F.when(F.col("cn") > rank, -F.col("s")))
    marks = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"{name}_low"), at(F.ceil(p)).alias(f"{name}_high"), F.first(p - F.floor(p)).alias(f"{name}_part"))]
    return _grouped(steps, by, *marks).select(*by, *((F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in qs))


def _grouped(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def average_precision(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """ap, n_positive, n_total per group: the sum over scores of the step in recall times precision; 0 without positives."""
    by = list(by)
    steps = running(tie_groups(scored, by), by)
    step = F.try_divide(F.col("tp").cast("double"), F.col("tp_all")) * F.col("ctp") / F.col("cn")
    return _grouped(steps, by, F.coalesce(F.sum(step), F.lit(0.0)).alias("ap"), F.sum("tp").alias("n_positive"), F.sum("n").alias("n_total"))


def mean_average_precision(per_class: DataFrame, exclude_empty: bool = False) -> DataFrame:
    """cmap: the mean of per-class precisions; NaN does not count, classes without positives count 0 unless excluded."""
    kept = per_class.where("n_positive > 0") if exclude_empty else per_class
    return kept.agg(F.avg(F.nanvl("ap", F.lit(None).cast("double"))).alias("cmap"))


def roc_auc(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """auc per group: the share of pairs of a positive and a negative in the right order, ties half; NaN without either."""
    by = list(by)
    steps = running(tie_groups(scored, by), by)
    negatives = F.col("n") - F.col("tp")
    below = (F.col("n_all") - F.col("tp_all")) - (F.col("cn") - F.col("ctp"))  # negatives of lower scores
    pairs = F.sum(F.col("tp") * (2 * below + negatives))
    p, q = F.max("tp_all"), F.max("n_all") - F.max("tp_all")
    return _grouped(steps, by, F.coalesce(F.try_divide(pairs.cast("double"), 2.0 * p * q), F.lit(float("nan"))).alias("auc"))


def best_thresholds(scored: DataFrame, by: list[str], floor: float = 1e-12) -> DataFrame:
    """threshold and f1 per group: the lowest of the scores with the largest F1; 0.5 and 0 without positives."""
    steps = running(tie_groups(scored, by), by)
    precision, recall = F.col("ctp") / F.col("cn"), F.try_divide(F.col("ctp").cast("double"), F.col("tp_all"))
    f1 = F.coalesce(2 * precision * recall / (precision + recall + floor), F.lit(0.0))
    best = steps.withColumn("f1", f1).groupBy(*by).agg(F.max_by("s", F.struct("f1", (-F.col("s")).alias("lowest"))).alias("s"), F.max("f1").alias("f1"), F.max("tp_all").alias("p"))
    return best.select(*by, F.when(F.col("p") > 0, F.col("s")).otherwise(0.5).alias("threshold"), "f1")


def det_curve(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """threshold, far, frr at each score (s >= threshold counts as positive); the single point 0.5, 0, 0 without positives or negatives."""
    by = list(by)
    steps = running(tie_groups(scored, by), by)
    q = F.col("n_all") - F.col("tp_all")
    points = steps.where((F.col("tp_all") > 0) & (q > 0)).select(
        *by, F.col("s").alias("threshold"), ((F.col("cn") - F.col("ctp")) / q).alias("far"), ((F.col("tp_all") - F.col("ctp")) / F.col("tp_all")).alias("frr")
    )
    sums = _grouped(scored, by, F.sum(F.col("y").cast("long")).alias("p"), F.count("*").alias("m"))
    alone = sums.where("p = 0 OR p = m").select(*by, F.lit(0.5).alias("threshold"), F.lit(0.0).alias("far"), F.lit(0.0).alias("frr"))
    return points.unionByName(alone)


def precision_recall_points(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """threshold, precision, recall at each score."""
    by = list(by)
    steps = running(tie_groups(scored, by), by)
    return steps.select(*by, F.col("s").alias("threshold"), (F.col("ctp") / F.col("cn")).alias("precision"), F.coalesce(F.try_divide(F.col("ctp").cast("double"), F.col("tp_all")), F.lit(0.0)).alias("recall"))


def micro_scores(scored: DataFrame, threshold: float = 0.5, floor: float = 1e-12) -> DataFrame:
    """precision, recall, f1 over all rows."""
    hit = (F.col("s") >= threshold).cast("long")
    sums = scored.agg(F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("pp"), F.sum(F.col("y").cast("long")).alias("p"))
    rates = sums.select((F.col("tp") / (F.col("pp") + floor)).alias("precision"), (F.col("tp") / (F.col("p") + floor)).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def top_classes(scored: DataFrame, k: int = 1, file: str = "file", cls: str = "class") -> DataFrame:
    """The k best classes of each file with their rank; the first class wins ties."""
    order = Window.partitionBy(file).orderBy(F.desc("s"), cls)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def confusion(scored: DataFrame, threshold: float | None = 0.5, file: str = "file", cls: str = "class") -> DataFrame:
    """true, pred, n over files: the top class, or -1 where the top score is under the threshold; a file's truth is its class with y = 1."""
    top = scored.groupBy(file).agg(
        F.max_by(cls, F.struct("s", (-F.col(cls)).alias("first"))).alias("pred"), F.max("s").alias("top"), F.max_by(cls, F.struct("y", (-F.col(cls)).alias("first"))).alias("true"), F.max("y").alias("known")
    )
    shown = top.where("known > 0").select("true", (F.when(F.col("top") < threshold, F.lit(-1)).otherwise(F.col("pred")) if threshold is not None else F.col("pred")).alias("pred"))
    return shown.groupBy("true", "pred").agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """accuracy of a confusion table; files under the threshold (pred -1) do not count."""
    shown = matrix.where("pred >= 0")
    return shown.agg((F.coalesce(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("accuracy"))


def ends(per_class: DataFrame, k: int = 10, cls: str = "class") -> DataFrame:
    """The k classes of best and of worst precision, NaN left out: side `top` or `bottom`, and the rank there."""
    known = per_class.where(~F.isnan("ap"))
    sides = [known.orderBy(F.desc("ap"), cls).limit(k).withColumn("side", F.lit("top")), known.orderBy("ap", F.desc(cls)).limit(k).withColumn("side", F.lit("bottom"))]
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col("ap")).otherwise(F.col("ap")), F.when(F.col("side") == "top", F.col(cls)).otherwise(-F.col(cls)))
    return sides[0].unionByName(sides[1]).select("side", F.row_number().over(order).alias("rank"), cls, "ap")
