"""Hypervolume weighted by rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import Names, Points, match
from .hypervolume import _all_groups, fronts_below, hypervolume

CORNERS = ("xmin", "ymin", "xmax", "ymax", "diff")


def whv_rect(df: DataFrame, rectangles: DataFrame, objectives: Names, ref: float | Sequence[float], by: Names | str = (), on: Names | str = ()) -> DataFrame:
    """One row per group: the sum over the rectangles of their colour times their area that the group's points dominate.

    ``rectangles`` has xmin, ymin, xmax, ymax and diff; corners beyond ``ref`` are clipped.  Objectives are minimised.
    ``on``: group columns that the rectangles have too, and are matched by.
    """
    p = Points.of(objectives, False, by)
    if p.d != 2:
        raise ValueError("two objectives are needed")
    on = [on] if isinstance(on, str) else [*on]
    r1, r2 = p.point(ref)
    clipped = rectangles.withColumn("xmax", F.least("xmax", F.lit(r1))).withColumn("ymax", F.least("ymax", F.lit(r2))).where("xmin < xmax AND ymin < ymax AND diff <> 0").withColumn("_rect", F.monotonically_increasing_id())
    front = fronts_below(df, p, [r1, r2])
    a, b = p.names
    hit = match(front, clipped, on).where((F.col(a) < F.col("xmax")) & (F.col(b) < F.col("ymax")))
    hit = hit.select(*p.by, F.greatest(a, "xmin").alias("x"), F.greatest(b, "ymin").alias("y"), "xmax", "ymax", "diff", "_rect")
    low = F.min("y").over(Window.partitionBy(*p.by, "_rect").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1))
    area = (F.col("xmax") - F.col("x")) * F.greatest(F.coalesce(low, F.col("ymax")) - F.col("y"), F.lit(0.0))
    total = hit.withColumn("_v", area * F.col("diff")).groupBy(*p.by).agg(F.sum("_v").alias("whv"))
    return _all_groups(df, total, p, "whv")


def total_whv_rect(df: DataFrame, rectangles: DataFrame, objectives: Names, ref: float | Sequence[float], ideal: float | Sequence[float] | None = None, scalefactor: float = 0.1, by: Names | str = ()) -> DataFrame:
    """Hypervolume plus the weighted one, scaled by ``scalefactor`` times the volume between ``ideal`` and ``ref``.

    ``ideal`` defaults to the best value of each objective over all rows.
    """
    if not 0 < scalefactor <= 1:
        raise ValueError("scalefactor must be in (0, 1]")
    p = Points.of(objectives, False, by)
    low = p.point(ideal, "ideal") if ideal is not None else list(p.costs(df).agg(*(F.min(n) for n in p.names)).first())
    box = abs(float((p.point(ref)[0] - low[0]) * (p.point(ref)[1] - low[1])))
    v, w = hypervolume(df, objectives, ref, False, by), whv_rect(df, rectangles, objectives, ref, by)
    return match(v, w, p.by).select(*p.by, (F.col("hypervolume") + F.lit(scalefactor * box) * F.col("whv")).alias("total_whv"))
