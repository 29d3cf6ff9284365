"""Numeric and array expressions: boxes, probabilities, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def box_round(v: Column, size: Column) -> Column:
    """A coordinate on the 0..1000 grid, rounded half to even; 0 for an empty page."""
    return F.when(size > 0, clamp(F.rint(v * 1000.0 / size), 0.0, 1000.0)).otherwise(F.lit(0.0)).cast("int")


def box_floor(v: Column, size: Column) -> Column:
    """The same, cut off."""
    return F.when(size > 0, clamp((v * 1000.0 / size).cast("int"), 0, 1000)).otherwise(F.lit(0)).cast("int")


def unit(v: Column, size: Column) -> Column:
    """A coordinate as a share of the page, in 0..1; 0 for an empty page."""
    return F.when(size > 0, clamp(v / size, 0.0, 1.0)).otherwise(F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes x0, y0, x1, y1; 0 when the union is empty."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def boxes_close(a: list[Column], b: list[Column], limit: int = 50) -> Column:
    """Centres less than `limit` apart on both axes."""
    near = lambda i: F.abs((a[i] + a[i + 2]) / 2 - (b[i] + b[i + 2]) / 2) < limit
    return near(0) & near(1)


def box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, cut: bool = False) -> Column:
    """array<int> x0, y0, x1, y1 on the 0..1000 grid. Rounded, a box without width or height gets one unit, but for the grid's end; cut off, ends in the wrong order change places."""
    grid = box_floor if cut else box_round
    x0, y0, x1, y1 = grid(left, width), grid(top, height), grid(right, width), grid(bottom, height)
    if cut:
        return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    grown = lambda a, b: F.when(b <= a, F.least(F.lit(1000), a + 1)).otherwise(b)
    return F.array(x0, y0, grown(x0, x1), grown(y0, y1))


def softmax(x: Column) -> Column:
    """Of an array<double>, shifted by its largest entry."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return normalized(e)


def normalized(p: Column) -> Column:
    """An array divided by its sum; by 1 when that is 0."""
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.transform(p, lambda v: v / F.when(total == 0, F.lit(1.0)).otherwise(total))


def first_max(p: Column, labels: list[str]) -> Column:
    """The label of the first largest entry."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))


def aligned(p: Column, classes: Sequence[str], labels: Sequence[str]) -> Column:
    """Probabilities p in the order of classes, brought into the order of labels and divided by their sum (by 1 when that is 0); a label that is no class has 0."""
    at = {c: i for i, c in enumerate(classes)}
    return normalized(F.array(*[F.coalesce(F.get(p, F.lit(at[x])).cast("double"), F.lit(0.0)) if x in at else F.lit(0.0) for x in labels]))


def unit_vector(v: Column, least: float = 1e-12) -> Column:
    """A vector divided by its length and a little more."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / (length + least))


def margin(p: Column) -> Column:
    """Largest less second largest entry; 0 with fewer than two."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) < 2, F.lit(0.0)).otherwise(F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def proximity(line: Column, anchor: Column, most: int = 5) -> Column:
    d = F.abs(line - anchor)
    return F.when(d > most, F.lit(0.0)).otherwise(1.0 - d / most)


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column a struct of median (exact), and mean and population deviation after filling nulls with the median."""
    med = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])
    filled = df.select(*columns).crossJoin(F.broadcast(med.select(*[F.col(c).alias(f"_{c}") for c in columns])))  # one row of medians
    stats = [F.struct(F.first(f"_{c}").alias("median"), F.avg(F.coalesce(c, f"_{c}")).alias("mean"), F.stddev_pop(F.coalesce(c, f"_{c}")).alias("std")).alias(c) for c in columns]
    return filled.agg(*stats)


def scale(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Columns filled with the median, less the mean, over the deviation (1 where that is 0)."""
    s = scaler.select(*[F.col(c).alias(f"_{c}") for c in columns])
    z = lambda c: (F.coalesce(F.col(c), F.col(f"_{c}.median")) - F.col(f"_{c}.mean")) / F.when(F.coalesce(F.col(f"_{c}.std"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_{c}.std"))
    return df.crossJoin(F.broadcast(s)).withColumns({c: z(c) for c in columns}).drop(*[f"_{c}" for c in columns])
