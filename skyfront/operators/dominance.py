"""Pareto dominance: skylines, masks, comparison of sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.folders import materialize
from ..functions.points import Direction, Names, Points, all_of, match, small, unwrap
from .fronts import MERGE_ROWS, matrix, nondominated_rows

#: Parts that an ungrouped table is dealt into before a single sweep sees the survivors.
PARTS = 64


def skyline_points(costs: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Distinct nondominated points (group and cost columns) of each group.

    One objective: a minimum.  Two: the least second per first objective (combined before the shuffle), then a
    running minimum, first inside hash parts and then over the survivors.  More: :mod:`fronts`.
    """
    if len(names) == 1:
        return costs.groupBy(*by).agg(F.min(names[0]).alias(names[0])).where(F.col(names[0]).isNotNull())
    if len(names) == 2:
        f1, f2 = names
        best = costs.groupBy(*by, f1).agg(F.min(f2).alias(f2))

        def sweep(df: DataFrame, parts: list[str]) -> DataFrame:
            w = Window.partitionBy(*parts).orderBy(f1).rowsBetween(Window.unboundedPreceding, -1)
            return df.withColumn("_best", F.min(f2).over(w)).where(F.col("_best").isNull() | (F.col(f2) < F.col("_best"))).drop("_best")

        dealt = best.withColumn("_part", F.pmod(F.hash(f1), F.lit(PARTS)))
        return sweep(sweep(dealt, [*by, "_part"]).drop("_part"), by)
    return nondominated_rows(costs.select(*by, *names), by, names).distinct()


def is_nondominated(df: DataFrame, objectives: Names, maximise: Direction = False, keep_weakly: bool = False, by: Names | str = (), order: Names | str = ()) -> DataFrame:
    """The rows with a boolean ``nondominated``.

    Of equal nondominated rows of a group only the first in ``order`` is, unless ``keep_weakly``.
    Rows with a null or NaN objective go; a column of that name is replaced.
    """
    p = Points.of(objectives, maximise, by)
    rows = p.wrap(df)
    best = skyline_points(rows.select(*p.by, *p.names), list(p.by), p.names).withColumn("_front", F.lit(True))
    on = [*p.by, *p.names]
    out = match(rows, best, on, "left").withColumn("nondominated", F.coalesce("_front", F.lit(False)))
    if not keep_weakly:
        # row_number is needed only on the front: rows off it are dealt out by themselves
        w = Window.partitionBy(*on).orderBy(*_turn(order))
        out = out.withColumn("nondominated", F.col("nondominated") & (F.row_number().over(w) == 1))
    return out.select(*unwrap(df, "nondominated"), "nondominated")


def _turn(order: Names | str) -> list:
    return [F.col(f"_whole.`{c}`") for c in ([order] if isinstance(order, str) else order)] or [F.lit(0)]


def filter_dominated(df: DataFrame, objectives: Names, maximise: Direction = False, keep_weakly: bool = False, by: Names | str = (), order: Names | str = (), merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The nondominated rows of each group; for ``merge_rows`` see :mod:`fronts`."""
    p = Points.of(objectives, maximise, by)
    rows = p.wrap(df)
    on = [*p.by, *p.names]
    if p.d > 2:  # rows go through the merge themselves, so nothing is joined
        out = nondominated_rows(rows, list(p.by), p.names, merge_rows)
    else:
        out = match(rows, skyline_points(rows.select(*on), list(p.by), p.names), on, "left_semi")
    if not keep_weakly:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*_turn(order)))).where("_n = 1")
    return out.select("_whole.*")


def is_nondominated_within_sets(df: DataFrame, objectives: Names, sets: Names | str, maximise: Direction = False, keep_weakly: bool = False, order: Names | str = ()) -> DataFrame:
    return is_nondominated(df, objectives, maximise, keep_weakly, sets, order)


def filter_dominated_within_sets(df: DataFrame, objectives: Names, sets: Names | str, maximise: Direction = False, keep_weakly: bool = False, order: Names | str = ()) -> DataFrame:
    return filter_dominated(df, objectives, maximise, keep_weakly, sets, order)


def any_dominated(df: DataFrame, objectives: Names, maximise: Direction = False, keep_weakly: bool = False, by: Names | str = ()) -> DataFrame:
    """One row per group: is any row weakly dominated by another (``keep_weakly``: equal rows don't count)?

    The row of least sum is a strong one, and most groups with a dominated row have one that it dominates: a scan decides them.
    Only groups that are still open have their front counted.
    """
    p = Points.of(objectives, maximise, by)
    keys, costs = list(p.by), p.costs(df)
    best = costs.groupBy(*keys).agg(F.min_by(F.struct(*p.names), reduce(Column.__add__, map(F.col, p.names))).alias("_best"))
    met = match(costs, small(materialize(best)), keys)
    weak = all_of([F.col(f"_best.{n}") <= F.col(n) for n in p.names])
    same = all_of([F.col(f"_best.{n}") == F.col(n) for n in p.names])
    hit = F.count_if(weak & ~same) > 0
    seen = materialize(met.groupBy(*keys).agg((hit if keep_weakly else hit | (F.count_if(same) > 1)).alias("any_dominated")))
    open_ = seen.where("NOT any_dominated").select(*keys)
    if not open_.limit(1).count():
        return seen
    left = match(costs, small(open_), keys, "left_semi") if keys else costs
    n = (left.distinct() if keep_weakly else left).groupBy(*keys).agg(F.count("*").alias("_n"))
    front = skyline_points(left, keys, p.names).groupBy(*keys).agg(F.count("*").alias("_front"))
    counted = match(n, front, keys).select(*keys, (F.col("_n") > F.col("_front")).alias("any_dominated"))
    return seen.where("any_dominated").unionByName(counted)


def compare_sets(df: DataFrame, objectives: Names, sets: str, maximise: Direction = False, other: DataFrame | None = None) -> DataFrame:
    """``better`` for each pair of sets: -1 if the left set is better, 1 if the right one is, 0 otherwise.

    A set is better if it weakly dominates every point of the other and either dominates one of them or has
    another number of points.  Sets are compared as they are; the pairs are those of the labels.

    One set covers another if its front covers the other's front, which is looked into only where its best values are
    nowhere worse; it dominates none of the points that it covers only if all of them are on its own front.
    """
    p = Points.of(objectives, maximise, sets)
    sides = [p.costs(x).withColumnRenamed(sets, "_set").where(F.col("_set").isNotNull()) for x in ([df] if other is None else [df, other])]
    points = [materialize(x.groupBy("_set", *p.names).agg(F.count("*").alias("_rows"))) for x in sides]
    fronts = [materialize(skyline_points(x, ["_set"], p.names)) for x in points]
    best = lambda x: x.groupBy("_set").agg(F.sum("_rows").alias("n"), F.count("*").alias("m"), *(F.min(n).alias(n) for n in p.names))
    tables = [materialize(best(x)) for x in points]
    side = lambda x, s: small(x.toDF(*(f"{s}{c}" for c in x.columns)))
    distinct = F.col("left_set") != F.col("right_set") if other is None else F.lit(True)
    # the result has a row for every pair of sets
    pairs = side(tables[0], "left").join(side(tables[-1], "right"), distinct)
    wins = []
    for own, against in (("left", "right"), ("right", "left")):
        k, j = (0, -1) if own == "left" else (-1, 0)
        maybe = pairs.where(all_of([F.col(f"{own}{n}") <= F.col(f"{against}{n}") for n in p.names])).select(F.col(f"{own}_set").alias("_own"), F.col(f"{against}_set").alias("_other"), F.col(f"{against}m").alias("_m"))
        weak = materialize(_covers(maybe, fronts[k], fronts[j], p).join(maybe, ["_own", "_other"]))
        own_front = fronts[k].withColumnRenamed("_set", "_own")
        shared = weak.join(points[j].withColumnRenamed("_set", "_other").select("_other", *p.names), "_other").join(own_front.toDF(*own_front.columns), ["_own", *p.names]).groupBy("_own", "_other").agg(F.count("*").alias("_shared"))
        won = weak.join(shared, ["_own", "_other"], "left").select(F.col("_own").alias(f"{own}_set"), F.col("_other").alias(f"{against}_set"), F.lit(True).alias(f"{own}_weak"), (F.coalesce("_shared", F.lit(0)) < F.col("_m")).alias(f"{own}_strict"))
        wins.append(won.toDF(*won.columns))
    both = pairs.select("left_set", "right_set", (F.col("leftn") != F.col("rightn")).alias("uneven"))
    for won in wins:
        both = both.join(won, ["left_set", "right_set"], "left")
    better = F.when(F.col("left_weak"), F.when(F.col("uneven") | F.col("left_strict"), -1).otherwise(0)).when(F.col("right_weak") & (F.col("uneven") | F.col("right_strict")), 1).otherwise(0)
    return both.select("left_set", "right_set", better.alias("better"))


#: Parts that the points to be tested against one front are dealt into.
SLOTS = 16


def _covers(pairs: DataFrame, fronts: DataFrame, others: DataFrame, p: Points) -> DataFrame:
    """The pairs (``_own``, ``_other``) in which the front of the one weakly dominates every point of the other's.

    Two objectives: a merge of both in the order of the first, with a running minimum of the second.  More: a front
    meets the others' points in a kernel.
    """
    slot = F.pmod(F.hash("_other"), F.lit(SLOTS))
    asked = pairs.select("_own", "_other").join(others.withColumnRenamed("_set", "_other"), "_other").withColumn("_slot", slot).select("_own", "_slot", "_other", *p.names)
    owners = pairs.select("_own", slot.alias("_slot")).distinct()
    own = owners.toDF("_own", "_slot").join(fronts.withColumnRenamed("_set", "_own"), "_own").select("_own", "_slot", *p.names)
    if p.d <= 2:
        f1, f2 = p.names[0], p.names[-1]
        rows = own.withColumn("_other", F.lit(None).cast(asked.schema["_other"].dataType)).withColumn("_asks", F.lit(0)).unionByName(asked.withColumn("_asks", F.lit(1)))
        w = Window.partitionBy("_own", "_slot").orderBy(f1, "_asks").rowsBetween(Window.unboundedPreceding, 0)
        met = rows.withColumn("_least", F.min(F.when(F.col("_asks") == 0, F.col(f2))).over(w)).where("_asks = 1")
        return met.groupBy("_own", "_other").agg(F.bool_and(F.coalesce(F.col("_least") <= F.col(f2), F.lit(False))).alias("all")).where("all").select("_own", "_other")
    schema = asked.select("_own", "_other").schema

    def meet(front: pa.Table, points: pa.Table) -> pa.Table:
        if not points.num_rows:
            return points.select(["_own", "_other"])
        out = kernels.covered(matrix(points, p.names), matrix(front, p.names))
        first = [at[0] for at in _by_value(points.column("_other")).values() if out[at].all()]
        return points.select(["_own", "_other"]).take(pa.array(first, pa.int64()))

    asked, own = asked.toDF(*asked.columns), own.toDF(*own.columns)
    return own.groupBy("_own", "_slot").cogroup(asked.groupBy("_own", "_slot")).applyInArrow(meet, schema)


def _by_value(column: pa.ChunkedArray) -> dict:
    out: dict = {}
    for i, v in enumerate(column.to_pylist()):
        out.setdefault(repr(v), []).append(i)
    return {k: np.array(v) for k, v in out.items()}


def set_better_counts(df: DataFrame, objectives: Names, sets: str, dataset: str, maximise: Direction = False) -> DataFrame:
    """For each pair of datasets: how many pairs of their sets the left one wins, and the right one."""
    d = df.withColumn("_set", F.struct(F.col(dataset).alias("d"), F.col(sets).alias("s")))
    c = compare_sets(d, objectives, "_set", maximise)
    c = c.select(F.col("left_set.d").alias("left_dataset"), F.col("right_set.d").alias("right_dataset"), "better").where("left_dataset < right_dataset")
    return c.groupBy("left_dataset", "right_dataset").agg(F.count_if(F.col("better") == -1).alias("left_better"), F.count_if(F.col("better") == 1).alias("right_better"), F.count("*").alias("pairs"))


def set_better_shares(df: DataFrame, objectives: Names, sets: str, dataset: str, maximise: Direction = False) -> DataFrame:
    """:func:`set_better_counts` as percentages of the pairs, with the percentage that neither wins."""
    c = set_better_counts(df, objectives, sets, dataset, maximise)
    share = lambda n: 100.0 * n / F.col("pairs")
    left, right = F.col("left_better"), F.col("right_better")
    return c.select("left_dataset", "right_dataset", share(left).alias("left_percent"), share(right).alias("right_percent"), share(F.col("pairs") - left - right).alias("neither_percent"))
