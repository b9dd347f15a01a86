"""Places of rows in the order of their group, however large groups are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.ranking import in_ranges, n_ranges


def numbered(rows: DataFrame, by: list[str], order: list[Column], column: str = "place") -> DataFrame:
    """`rows` with `column`: places from 1 on in the order of each group, nulls first.

    Few rows (as the planner expects) are numbered by a window over the group. Beyond that the first key of the order, a
    number, is cut into ranges with about equally many rows, as many as the rows' size asks for: a window holds one range of
    one group, and the counts of the ranges before give its start. Rows with one first key are in one range.
    """
    n = n_ranges(rows)
    if n == 1:
        return rows.withColumn(column, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    parts = in_ranges(rows.withColumn("__key", order[0].cast("double")), "__key", "__range", n).drop("__key")
    keys = [*by, "__range"]
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    starts = parts.groupBy(*keys).agg(F.count("*").alias("__n")).select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = parts.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    return own.join(starts, same).withColumn(column, F.col(column) + F.col("__start")).select(*rows.columns, column)
