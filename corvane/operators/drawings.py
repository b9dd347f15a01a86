"""Curves and heatmaps as SVG text, drawn from aggregates over pixels: as long as the picture asks for, whatever the number of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width and height of curves; the side of a heatmap and its cells at most along it.
CURVE, HEATMAP, CELLS = (400, 300), 600, 200


def _svg(width: int, height: int, body: Column) -> Column:
    return F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'), body, F.lit("</svg>"))


def _pixel(value: Column, low: Column, high: Column, size: int) -> Column:
    inside = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(high > low, F.floor(inside * (size - 1))).otherwise(0).cast("int")


def curve(points: DataFrame, x: str, y: str, by: str | None = None, bounds: tuple[float, float, float, float] | None = None, size: tuple[int, int] = CURVE) -> DataFrame:
    """One row, svg: a line for each of the few values of `by`, over `bounds` (x from, to, y from, to) or all there is.

    Of each column of pixels the line has the lowest and the highest point; points without a number are left out."""
    width, height = size
    rows = points.select((F.col(by) if by else F.lit(0)).alias("series"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    ends = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if bounds:
        rows = rows.select("*", *(F.lit(float(v)).alias(c) for c, v in zip(("x0", "x1", "y0", "y1"), bounds, strict=True)))
    else:
        rows = rows.crossJoin(F.broadcast(ends))  # a row
    dots = rows.select("series", _pixel(F.col("x"), F.col("x0"), F.col("x1"), width).alias("px"), (height - 1 - _pixel(F.col("y"), F.col("y0"), F.col("y1"), height)).alias("py"))
    columns = dots.groupBy("series", "px").agg(F.min("py").alias("top"), F.max("py").alias("low"))
    dot = lambda c, p: F.concat(c["px"].cast("string"), F.lit(","), c[p].cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("px", "top", "low"))), lambda c: F.concat(dot(c, "top"), F.lit(" "), dot(c, "low"))), " ")
    lines = columns.groupBy("series").agg(F.concat(F.lit('<polyline fill="none" stroke="black" points="'), text, F.lit('"/>')).alias("line"))
    return lines.agg(_svg(width, height, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", "line"))), lambda s: s["line"]), "")).alias("svg"))


def heatmap(matrix: DataFrame, classes: int, true: str = "true", pred: str = "pred", n: str = "n") -> DataFrame:
    """One row, svg: a cell a pair of classes (numbers from 0 on), or of neighbouring classes beyond CELLS of them, as dark as it has rows
    of the most that a cell has; pairs of other numbers are left out."""
    cells = max(1, min(classes, CELLS))
    side = HEATMAP // cells
    bin_of = lambda c: F.floor(F.col(c) * cells / classes).cast("int")
    inside = F.col(true).between(0, classes - 1) & F.col(pred).between(0, classes - 1)
    sums = matrix.where(inside).groupBy(bin_of(true).alias("t"), bin_of(pred).alias("p")).agg(F.sum(n).alias("n"))
    most = sums.agg(F.max("n").alias("most"))  # a row
    rect = F.concat(F.format_string(f'<rect x="%d" y="%d" width="{side}" height="{side}" fill="navy" fill-opacity="', F.col("p") * side, F.col("t") * side), F.format_string("%.3f", F.floor(1000 * F.col("n") / F.col("most")) / 1000), F.lit('"/>'))
    listed = sums.crossJoin(F.broadcast(most)).select("t", "p", rect.alias("r"))
    return listed.agg(_svg(cells * side, cells * side, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "p", "r"))), lambda c: c["r"]), "")).alias("svg"))
