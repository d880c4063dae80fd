"""Empirical attainment functions (EAF), their differences, and Vorob'ev statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.folders import materialize
from ..functions.numbering import numbered
from ..functions.points import Direction, Names, Points, match, small
from .dominance import skyline_points
from .fronts import cells
from .hypervolume import front_volumes, hypervolume
from .weighted import whv_rect

TOLERANCE = 1.4901161193847656e-08


def level_of(percentile: float, n: int) -> int:
    """The number of sets that a percentile asks for, at least 1."""
    return max(1, int(np.ceil(n * percentile / 100 - TOLERANCE)))


#: Grid columns that one row is spread over at a time; points of a block of three-objective surfaces, and its most blocks.
SPREAD = 4096
#: Distinct first objectives of a group that one task sorts.
COLUMNS_A_TASK = 200_000
BLOCK_POINTS, MOST_BLOCKS = 2_000, 64


def _columns(xs: DataFrame, by: list[str], x: str) -> DataFrame:
    """Distinct first objectives with their place ``_from`` in the group and their number ``_columns``; by ranges of values, unless a task can sort a group's."""
    counts = xs.groupBy(*by).agg(F.count("*").alias("_columns"))
    if (counts.agg(F.max("_columns")).first()[0] or 0) > COLUMNS_A_TASK:
        return match(numbered(xs, [x], by, "_from"), small(materialize(counts)), by)
    group = Window.partitionBy(*by)
    return xs.withColumn("_from", F.row_number().over(group.orderBy(x))).withColumn("_columns", F.count("*").over(group))


def _cells(costs: DataFrame, by: list[str], sets: str, names: list[str], carry: Names = (), blank: bool = False) -> tuple[DataFrame, bool]:
    """Rows for each column of a group's grid, the columns being its sets' first objectives, numbered ``_i`` in their order; and whether the two objectives have changed places.

    They do where the fronts have fewer values of the second one, as a set has a row for each column from its first point on.

    Where a set attains something, a row with ``_cell`` 1 has the least second objective ``_v`` that it attains there; where
    that has just fallen, a row with ``_cell`` 0 has what it was before.  ``_kept`` is 1 for the values of the column before.
    ``blank``: also rows without ``_v`` for the sets that attain nothing yet (``_cell`` 0, ``_kept`` 0).

    Sets are first reduced to their fronts.  A front point is spread over the columns up to the set's next one, so no
    column is joined with the sets.
    """
    front = materialize(skyline_points(costs, [*by, sets, *carry], names))
    values = front.agg(*(F.count_distinct(F.struct(*by, n)) for n in names)).first()
    turned = values[1] < values[0]
    names = names[::-1] if turned else names
    xs = _columns(front.select(*by, names[0]).distinct(), by, names[0])
    own = Window.partitionBy(*by, sets, *carry).orderBy("_from")
    runs = match(front, xs, [*by, names[0]]).withColumn("_to", F.coalesce(F.lead("_from").over(own) - 1, "_columns").cast("int")).withColumn("_was", F.lag(names[1]).over(own))
    run = lambda lo, hi, v, cell, kept: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), v.cast("double").alias("_v"), F.lit(cell).alias("_cell"), F.lit(kept).alias("_kept"))
    at, to, nothing = F.col("_from"), F.col("_to"), F.array().cast("array<struct<lo:int,hi:int,_v:double,_cell:int,_kept:int>>")
    steps = lambda lo, hi, v, cell, kept: F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi), F.lit(SPREAD)), lambda c: run(c, F.least(c + SPREAD - 1, hi), v, cell, kept))).otherwise(nothing)
    parts = [F.array(run(at, at, F.col(names[1]), 1, 0)), steps(at + 1, to, F.col(names[1]), 1, 1)]
    parts.append(F.when(F.col("_was").isNotNull(), F.array(run(at, at, F.col("_was"), 0, 1))).otherwise(nothing))
    if blank:
        parts.append(F.when(F.col("_was").isNull(), steps(F.lit(1), at - 1, F.lit(None), 0, 0)).otherwise(nothing))
    spread = runs.select(*by, sets, *carry, F.col(names[0]).alias("_x"), "_from", F.inline(F.concat(*parts)))
    spread = spread.select(*by, sets, *carry, "_x", "_from", "_v", "_cell", "_kept", F.explode(F.sequence("lo", "hi")).alias("_i"))
    return spread.withColumn("_x", F.when(F.col("_i") == F.col("_from"), F.col("_x"))).drop("_from"), turned


def _surfaces(cells: DataFrame, turned: bool, by: list[str], levels: bool = True, **counts: Column) -> DataFrame:
    """Corner points ``_x``, ``_m`` of all levels ``_t``; ``counts``: conditions, for how many sets that attain the point they hold.

    Level t is the t-th least value of a column.  It never rises from a column to the next, so it has a corner
    where fewer than t values of the column before are as low: a column alone tells its corners.  Sets of one value in a column are counted before
    they meet there, so it has no more rows than values.  Without ``levels`` a point has one row, not one for each level.
    """
    held = cells.where(F.col("_v").isNotNull()).groupBy(*by, "_i", "_v").agg(
        F.sum("_cell").alias("_own"), F.sum("_kept").alias("_before"), F.max("_x").alias("_x"), *(F.count_if((F.col("_cell") == 1) & c).alias(n) for n, c in counts.items())
    )
    column = Window.partitionBy(*by, "_i")
    up_to = column.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    t = held.withColumns({"_t": F.sum("_own").over(up_to), **{n: F.sum(n).over(up_to) for n in ("_before", *counts)}, "_x": F.max("_x").over(column)})
    t = t.withColumn("_least", F.greatest(F.col("_t") - F.col("_own"), "_before") + 1).where("_own > 0 AND _least <= _t")
    if levels:
        t = t.withColumn("_t", F.explode(F.sequence(F.col("_least").cast("int"), F.col("_t").cast("int"))))
    t = t.drop("_own", "_before", "_least")
    return t.withColumnRenamed("_x", "_m").withColumnRenamed("_v", "_x") if turned else t.withColumnRenamed("_v", "_m")


def eaf(df: DataFrame, objectives: Names, sets: str, percentiles: Sequence[float] | None = None, maximise: Direction = False, groups: Names | str = (), levels: Sequence[int] | None = None) -> DataFrame:
    """Attainment surfaces: (groups, objectives, percentile).

    A level-t surface has the minimal points that t sets attain.  By default all levels t of a group's n sets, as
    percentiles t * 100 / n; given ``percentiles`` are reported as given.  Two or three objectives.
    """
    p = Points.of(objectives, maximise, groups)
    if p.d not in (2, 3):
        raise ValueError("two or three objectives are needed")
    by = list(p.by)
    costs = p.add(df).select(*by, sets, *p.names)
    n = costs.groupBy(*by).agg(F.count_distinct(F.coalesce(F.col(sets).cast("string"), F.lit(""))).alias("_n"))
    t = _surfaces(*_cells(costs, by, sets, p.names), by).select(*by, F.col("_x").alias("_f0"), F.col("_m").alias("_f1"), "_t") if p.d == 2 else _eaf3(costs, by, sets, p.names)
    joined = match(t, n, by)
    values = [p.back(i).alias(c) for i, c in enumerate(p.objectives)]
    if levels is not None:
        joined = joined.where(F.col("_t").isin([int(v) for v in levels]))
    if percentiles is None:
        return joined.select(*by, *values, (F.col("_t") * 100.0 / F.col("_n")).alias("percentile"))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in sorted(set(percentiles)))))
    asked = joined.withColumn("percentile", wanted)
    level = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("percentile") / 100 - TOLERANCE))
    return asked.where(F.col("_t") == level).select(*by, *values, "percentile")


def _eaf3(costs: DataFrame, by: list[str], sets: str, names: list[str], side: str | None = None, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Points of all levels ``_t`` with ``_left`` and ``_right``, the numbers of sets with ``side`` 0 and of others that attain them.

    A group's points are cut into blocks by quantiles of the third objective.  A block's sweep begins from what lies below it:
    each set's staircase of the first two objectives over all earlier blocks.  So blocks don't wait for each other, and a task holds one block and those
    staircases.
    """
    keys = [*by, sets, *([side] if side else [])]
    front = materialize(skyline_points(costs, keys, names))
    largest = front.groupBy(*by).agg(F.count("*").alias("_size")).agg(F.max("_size")).first()[0] or 0
    cuts = min(MOST_BLOCKS, -(-largest // block_points))
    if cuts > 1:
        own = materialize(cells(front, by, [names[2]], cuts).withColumn("_block", F.element_at("_cell", 1)).drop("_cell"))
        steps = skyline_points(own.drop(names[2]), [*keys, "_block"], names[:2]).withColumn("_later", F.explode(F.sequence(F.col("_block") + 1, F.greatest(F.col("_block") + 1, F.lit(cuts - 1)))))
        steps = steps.where(F.col("_later") < cuts).select(*keys, F.col("_later").alias("_block"), *names[:2])
        state = skyline_points(steps, [*keys, "_block"], names[:2]).withColumn(names[2], F.lit(0.0))
        rows = own.withColumn("_below", F.lit(False)).unionByName(state.withColumn("_below", F.lit(True)))
    else:
        rows = front.withColumn("_block", F.lit(0)).withColumn("_below", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, marked = pd.factorize(pdf[sets].astype(str) if side is None else pdf[side].astype(str) + ":" + pdf[sets].astype(str))[0], None if side is None else (pdf[side] == 0).to_numpy()
        below = pdf["_below"].to_numpy(bool)
        out = kernels.eaf3(pdf[names].to_numpy(float), labels, list(range(1, labels.max() + 2)), marked, below) if not below.all() else [np.empty((0, 5))]
        rows = np.concatenate([np.column_stack([s, np.full(len(s), k)]) for k, s in enumerate(out, 1)])
        head = {c: pdf[c].iloc[0] for c in by}
        counts = {c: rows[:, i].astype(np.int32) for i, c in ((5, "_t"), (3, "_left"), (4, "_right"))}
        return pd.DataFrame({**{names[i]: rows[:, i] for i in range(3)}, **counts}).assign(**head)[[*by, *names, "_t", "_left", "_right"]]

    schema = ", ".join([*(f"`{c}` {front.schema[c].dataType.simpleString()}" for c in by), *(f"{n} double" for n in names), "_t int, _left int, _right int"])
    return rows.groupBy(*by, "_block").applyInPandas(run, schema)


def eaf_named_levels(df: DataFrame, objectives: Names, sets: str, maximise: Direction = False, groups: Names | str = ()) -> DataFrame:
    """The best, median and worst surfaces: :func:`eaf` with a column ``level``."""
    p = Points.of(objectives, maximise, groups)
    by = list(p.by)
    n = p.add(df).groupBy(*by).agg(F.count_distinct(F.coalesce(F.col(sets).cast("string"), F.lit(""))).alias("_n"))
    e = eaf(df, objectives, sets, None, maximise, groups)
    e = match(e, n, by)
    t = F.round(F.col("percentile") * F.col("_n") / 100).cast("int")
    name = F.explode(F.filter(F.array(F.when(t == 1, F.lit("best")), F.when(t == F.ceil(F.col("_n") / 2), F.lit("median")), F.when(t == F.col("_n"), F.lit("worst"))), lambda x: x.isNotNull()))
    return e.select(*by, *p.objectives, "percentile", name.alias("level"))


def eaf_attained(df: DataFrame, objectives: Names, sets: str, maximise: Direction = False, groups: Names | str = ()) -> DataFrame:
    """Surfaces with ``attained``: an array of booleans, in order of the set labels, of the sets that attain the point."""
    p = Points.of(objectives, maximise, groups)
    by = list(p.by)
    cells, turned = _cells(p.add(df).select(*by, sets, *p.names), by, sets, p.names, blank=True)
    own = F.when((F.col("_cell") == 1) | F.col("_v").isNull(), F.struct(F.col(sets).alias("s"), F.col("_v").alias("m")))
    each = cells.groupBy(*by, "_i").agg(F.array_sort(F.collect_list(own)).alias("_all"))
    t = match(_surfaces(cells, turned, by), each, [*by, "_i"])
    attained = F.transform("_all", lambda s: F.coalesce(s["m"] <= F.col("_x" if turned else "_m"), F.lit(False)))
    percentile = F.col("_t") * 100.0 / F.size("_all")
    return t.select(*by, p.back(0, F.col("_x")).alias(p.objectives[0]), p.back(1, F.col("_m")).alias(p.objectives[1]), percentile.alias("percentile"), attained.alias("attained"))


def eaf_as_dict(surfaces: DataFrame, percentiles: Sequence[float]) -> dict[float, DataFrame]:
    """One DataFrame per percentile."""
    return {q: surfaces.where(F.col("percentile") == q).drop("percentile") for q in percentiles}


def attsurf2df(surfaces: dict[float, DataFrame], objectives: Names) -> DataFrame:
    """Surfaces in order as one frame; of equal points the last stays."""
    out = None
    for k, (q, s) in enumerate(surfaces.items()):
        s = s.select(*objectives, F.lit(float(q)).alias("percentile"), F.lit(k).alias("_k"))
        out = s if out is None else out.unionByName(s)
    last = out.groupBy(*objectives).agg(F.max_by("percentile", "_k").alias("percentile"))
    return last


def _differences(x: DataFrame, y: DataFrame, p: Points, sets: str, intervals: int | None, levels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(surfaces of the union with ``_left`` and ``_right`` counts and ``_diff``, number of sets a group); without ``levels`` their points, once each."""
    by = list(p.by)
    side = lambda df, k: p.add(df).select(*by, F.struct(F.lit(k).alias("side"), F.col(sets).cast("string").alias("label")).alias("_set"), F.lit(k).alias("_side"), *p.names)
    both = side(x, 0).unionByName(side(y, 1))
    return _count_sides(both, by, p.names, intervals, levels)


def _count_sides(both: DataFrame, by: list[str], names: list[str], intervals: int | None, levels: bool = True) -> tuple[DataFrame, DataFrame]:
    labels = both.select(*by, "_set", "_side").distinct()
    n = labels.groupBy(*by).agg(F.count_if(F.col("_side") == 0).alias("_nl"), F.count_if(F.col("_side") == 1).alias("_nr"))
    s = _surfaces(*_cells(both, by, "_set", names, ["_side"]), by, levels, _left=F.col("_side") == 0, _right=F.col("_side") == 1)
    s = match(s, n, by)
    cap = F.floor((F.col("_nl") + F.col("_nr")) / 2)
    k = cap if intervals is None else F.least(F.lit(int(intervals)), cap)
    return s.withColumn("_diff", k * (F.col("_left") / F.col("_nl") - F.col("_right") / F.col("_nr"))), n


def eafdiff(x: DataFrame, y: DataFrame, objectives: Names, sets: str, intervals: int | None = None, maximise: Direction = False, groups: Names | str = ()) -> DataFrame:
    """Points of all surfaces of the union of two datasets with ``diff``, the scaled difference of the shares of their sets that attain them."""
    p = Points.of(objectives, maximise, groups)
    if p.d == 3:
        return _eafdiff3(x, y, p, sets, intervals)
    s, _ = _differences(x, y, p, sets, intervals, levels=False)
    return s.select(*p.by, p.back(0, F.col("_x")).alias(p.objectives[0]), p.back(1, F.col("_m")).alias(p.objectives[1]), F.col("_diff").alias("diff"))


def _eafdiff3(x: DataFrame, y: DataFrame, p: Points, sets: str, intervals: int | None) -> DataFrame:
    by = list(p.by)
    part = lambda df, k: p.add(df).select(*by, F.col(sets).cast("string").alias("_set"), F.lit(k).alias("_side"), *p.names)
    both = part(x, 0).unionByName(part(y, 1))
    points = _eaf3(both, by, "_set", p.names, "_side").drop("_t").distinct()
    n = both.select(*by, "_set", "_side").distinct().groupBy(*by).agg(F.count_if(F.col("_side") == 0).alias("_nl"), F.count_if(F.col("_side") == 1).alias("_nr"))
    out = match(points, n, by)
    cap = F.floor((F.col("_nl") + F.col("_nr")) / 2)
    k = cap if intervals is None else F.least(F.lit(int(intervals)), cap)
    return out.select(*by, *(p.back(i).alias(c) for i, c in enumerate(p.objectives)), (k * (F.col("_left") / F.col("_nl") - F.col("_right") / F.col("_nr"))).alias("diff"))


def _strips(s: DataFrame, by: list[str]) -> DataFrame:
    """Rectangles between consecutive levels, as costs: ``_lx _ly _ux _uy _diff`` and the level ``_t``."""
    nothing, x = F.lit(None).cast("double"), F.col("_x")
    end = lambda t, xa, xb, d: F.struct(t.cast("int").alias("_t"), xa.alias("xa"), xb.alias("xb"), d.alias("d"))
    ends = F.array(end(F.col("_t"), x, nothing, F.col("_diff")), end(F.col("_t") - 1, nothing, x, nothing))
    both = s.select(*by, F.col("_m").alias("y"), (F.col("_nl") + F.col("_nr")).alias("_last"), F.inline(ends)).where("_t >= 1 AND _t < _last").drop("_last")
    level = Window.partitionBy(*by, "_t")
    up = level.orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    y = both.withColumn("_xa", F.min("xa").over(up)).withColumn("_xb", F.min("xb").over(up)).withColumn("_d", F.min_by("d", "xa").over(up))
    y = y.groupBy(*by, "_t", "y").agg(F.first("_xa").alias("_lx"), F.first("_xb").alias("_ux"), F.first("_d").alias("_diff"))
    y = y.withColumn("_uy", F.coalesce(F.lead("y").over(level.orderBy("y")), F.lit(float("inf")))).withColumn("_ux", F.coalesce("_ux", F.lit(float("inf"))))
    return y.where("_lx IS NOT NULL AND _lx < _ux").withColumnRenamed("y", "_ly")


def eafdiff_rectangles(x: DataFrame, y: DataFrame, objectives: Names, sets: str, intervals: int | None = None, maximise: Direction = False, groups: Names | str = ()) -> DataFrame:
    """EAF differences as rectangles (xmin, ymin, xmax, ymax, diff); open ends are infinite.

    Of a maximised objective the corners are negated back and keep their places.
    """
    p = Points.of(objectives, maximise, groups)
    if p.d != 2:
        raise ValueError("two objectives are needed")
    s, _ = _differences(x, y, p, sets, intervals)
    r = _strips(s, list(p.by))
    return r.select(*p.by, *(p.back(i, F.col(c)).alias(n) for c, n, i in (("_lx", "xmin", 0), ("_ly", "ymin", 1), ("_ux", "xmax", 0), ("_uy", "ymax", 1))), F.col("_diff").alias("diff")).distinct()


def choose_eafdiff(differences: DataFrame, left: bool = True) -> DataFrame:
    """Differences in favour of the left side, or of the right side as positive values."""
    return differences.where("diff > 0") if left else differences.where("diff < 0").withColumn("diff", -F.col("diff"))


def eafdiff_polygons(x: DataFrame, y: DataFrame, objectives: Names, sets: str, intervals: int | None = None, groups: Names | str = ()) -> DataFrame:
    """EAF differences as closed polygons: (groups, level, colour, side, vertices array<struct<x, y>>).

    Touching rectangles of one level and colour (truncated to whole) make a polygon; colour 0 is left out.
    """
    p = Points.of(objectives, False, groups)
    by = list(p.by)
    s, _ = _differences(x, y, p, sets, intervals)
    r = _strips(s, by).withColumn("colour", F.col("_diff").cast("int"))
    w = Window.partitionBy(*by, "_t").orderBy(F.desc("_uy"))
    joined = (F.lag("colour").over(w) == F.col("colour")) & (F.lag("_ly").over(w) == F.col("_uy")) & (F.lag("_lx").over(w) < F.col("_ux")) & (F.lag("_ux").over(w) > F.col("_lx"))
    r = r.withColumn("_run", F.sum(F.when(joined, 0).otherwise(1)).over(w)).where("colour <> 0")
    runs = r.groupBy(*by, "_t", "colour", "_run").agg(F.sort_array(F.collect_list(F.struct("_ly", "_uy", "_lx", "_ux"))).alias("c"))
    vertex = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    up = F.flatten(F.transform("c", lambda c: F.array(vertex(c["_lx"], c["_ly"]), vertex(c["_lx"], c["_uy"]))))
    down = F.flatten(F.transform(F.reverse("c"), lambda c: F.array(vertex(c["_ux"], c["_uy"]), vertex(c["_ux"], c["_ly"]))))
    ring = F.concat(up, down)
    return runs.select(*by, F.col("_t").alias("level"), "colour", F.when(F.col("colour") > 0, "left").otherwise("right").alias("side"), F.concat(ring, F.slice(ring, 1, 1)).alias("vertices"))


def largest_eafdiff_table(df: DataFrame, objectives: Names, dataset: str, sets: str, ref: float | Sequence[float], maximise: Direction = False, intervals: int = 5, ideal: float | Sequence[float] | None = None) -> DataFrame:
    """For each pair of datasets a < b the smaller of its two one-sided differences: (left_dataset, right_dataset, value)."""
    p = Points.of(objectives, maximise)
    point = p.point(ref)
    costs = p.add(df).select(F.col(dataset).alias("_d"), F.col(sets).cast("string").alias("label"), *p.names)
    best = p.point(ideal, "ideal") if ideal is not None else list(costs.agg(*(F.min(n) for n in p.names)).first())
    names = costs.select("_d").distinct()
    pairs = names.select(F.col("_d").alias("a")).join(names.select(F.col("_d").alias("b")), F.col("a") < F.col("b"))
    both = None
    for side, key in ((0, "a"), (1, "b")):
        part = costs.join(F.broadcast(pairs), F.col("_d") == F.col(key)).select("a", "b", F.struct(F.lit(side).alias("side"), "label").alias("_set"), F.lit(side).alias("_side"), *p.names)
        both = part if both is None else both.unionByName(part)
    s, _ = _count_sides(both, ["a", "b"], p.names, intervals)
    r = _strips(s, ["a", "b"]).select("a", "b", F.col("_lx").alias("xmin"), F.col("_ly").alias("ymin"), F.col("_ux").alias("xmax"), F.col("_uy").alias("ymax"), "_diff")
    at = pairs.select("a", "b", *(F.lit(v).alias(n) for v, n in zip(best, p.names, strict=True)))
    sums = []
    for keep, name in ((F.col("_diff") >= 1, "left"), (F.col("_diff") <= -1, "right")):
        w = whv_rect(at, r.where(keep).withColumn("diff", F.lit(1.0)).drop("_diff"), p.names, point, by=["a", "b"], on=["a", "b"])
        sums.append(w.withColumnRenamed("whv", name))
    return sums[0].join(sums[1], ["a", "b"]).select(F.col("a").alias("left_dataset"), F.col("b").alias("right_dataset"), F.least("left", "right").alias("value"))


def largest_eafdiff(df: DataFrame, objectives: Names, dataset: str, sets: str, ref: float | Sequence[float], maximise: Direction = False, intervals: int = 5, ideal: float | Sequence[float] | None = None) -> tuple[tuple | None, float]:
    """The pair of datasets with the largest difference, the first of equal ones, and its value; (None, 0.0) if none differ."""
    t = largest_eafdiff_table(df, objectives, dataset, sets, ref, maximise, intervals, ideal)
    best = t.orderBy(F.desc("value"), "left_dataset", "right_dataset").first()
    return ((best[0], best[1]), best[2]) if best and best[2] > 0 else (None, 0.0)


class VorobT(NamedTuple):
    threshold: float
    expectation: DataFrame
    average: float


def level_volumes(df: DataFrame, objectives: Names, sets: str, ref: float | Sequence[float], maximise: Direction = False) -> DataFrame:
    """(level, hypervolume) of every attainment surface, in one job."""
    p = Points.of(objectives, maximise)
    costs = p.add(df).select(sets, *p.names)
    t = _surfaces(*_cells(costs, [], sets, p.names), [])
    q = Points.of(("_x", "_m"), False, "_t")
    point = p.point(ref)
    front = t.select("_t", F.col("_x").alias("_f0"), F.col("_m").alias("_f1")).where((F.col("_f0") < point[0]) & (F.col("_f1") < point[1]))
    return front_volumes(front, q, point).select(F.col("_t").alias("level"), "hypervolume")


def vorob_t(df: DataFrame, objectives: Names, sets: str, ref: float | Sequence[float], maximise: Direction = False) -> VorobT:
    """Vorob'ev threshold and expectation: the surface whose hypervolume is nearest, from below, to the sets' average.

    Volumes of all levels come from one job; the bisection over percentiles runs on them.
    """
    average = hypervolume(df, objectives, ref, maximise, sets).agg(F.avg("hypervolume")).first()[0]
    n = df.select(sets).distinct().count()
    volumes = {r["level"]: r["hypervolume"] for r in level_volumes(df, objectives, sets, ref, maximise).collect()}
    a, b, before, c = 0.0, 100.0, None, 50.0
    for _ in range(200):
        c = (a + b) / 2
        now = volumes.get(level_of(c, n), 0.0)
        a, b = (c, b) if now > average else (a, c)
        if now == before:
            break
        before = now
    return VorobT(c, eaf(df, objectives, sets, [c], maximise).drop("percentile"), average)


def vorob_dev(df: DataFrame, objectives: Names, sets: str, ref: float | Sequence[float], maximise: Direction = False, expectation: DataFrame | None = None) -> float:
    """Mean hypervolume of the symmetric difference between the sets and the expectation."""
    ve = vorob_t(df, objectives, sets, ref, maximise).expectation if expectation is None else expectation
    ve = ve.select(*objectives)
    labels = df.select(sets).distinct()
    joined = df.select(sets, *objectives).unionByName(labels.join(F.broadcast(ve), F.lit(True)).select(sets, *objectives))
    mean = lambda d: hypervolume(d, objectives, ref, maximise, sets).agg(F.avg("hypervolume")).first()[0]
    return 2 * mean(joined) - mean(df) - hypervolume(ve, objectives, ref, maximise).first()[0]
