"""Exact R2 indicator of two objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import Direction, Names, Points, match
from .dominance import skyline_points

HUGE = 1.7976931348623157e308


def r2_exact(df: DataFrame, objectives: Names, ref: float | Sequence[float], maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """One row per group: the expected Tchebycheff utility over uniform weights, against the point ``ref``.

    Points that are better than ``ref`` in an objective count as on it; a group with a point better in both is 0.
    """
    p = Points.of(objectives, maximise, by)
    if p.d != 2:
        raise ValueError("two objectives are needed")
    r1, r2 = p.point(ref)
    costs = p.costs(df)
    a, b = p.names
    # left of the ideal, a point says only whether the set reaches below it
    left = costs.where(F.col(a) < r1).groupBy(*p.by).agg(F.min_by(b, F.struct(F.lit(1), -F.col(a), -F.col(b))).alias("_last"))
    front = skyline_points(costs.where(F.col(a) >= r1), list(p.by), p.names)
    w = Window.partitionBy(*p.by).orderBy(a)
    low = front.withColumn("_first", F.row_number().over(w) == 1)
    zero = low.groupBy(*p.by).agg(F.bool_or(F.col("_first") & (F.col(b) < r2)).alias("_zero"))
    steps = low.where(F.col(b) >= r2).withColumn("y1", F.col(a) - r1).withColumn("y2", F.col(b) - r2)
    steps = steps.withColumn("up", F.lag("y2").over(w)).withColumn("right", F.lead("y1").over(w))

    def utility(x: Column, y: Column, to: Column) -> Column:
        edge = F.coalesce(F.pow(to / (x + to), F.lit(2.0)), F.lit(1.0))
        return F.when(x == 0, F.lit(0.0)).otherwise(x * (edge - F.pow(y / (x + y), F.lit(2.0))))

    total = steps.groupBy(*p.by).agg((F.sum(utility(F.col("y1"), F.col("y2"), F.col("up")) + utility(F.col("y2"), F.col("y1"), F.col("right"))) * 0.5).alias("_r2"))
    keys = list(p.by)
    groups = costs.select(*keys).distinct() if keys else df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    out = groups
    for part in (total, zero, left):
        out = match(out, part, keys, "left")
    only_left = F.when(F.col("_last") <= r2, 0.0).otherwise(HUGE)
    value = F.when(F.col("_zero"), 0.0).when(F.col("_zero").isNull(), only_left).otherwise(F.coalesce("_r2", F.lit(0.0)))
    return out.select(*keys, value.alias("r2"))
