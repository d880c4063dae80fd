"""Exact hypervolume, relative hypervolume and contributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.folders import materialize
from ..functions.numbering import numbered
from ..functions.points import Direction, Names, Points, all_of, match, unwrap
from .dominance import skyline_points
from .fronts import matrix

Ref = float | Sequence[float]


def default_reference(df: DataFrame, objectives: Names, maximise: Direction = False) -> list[float]:
    """The worst value of each objective, and a tenth of its range beyond."""
    p = Points.of(objectives, maximise)
    row = p.costs(df).agg(*(f(n) for n in p.names for f in (F.max, F.min))).first()
    return [(hi + 0.1 * (hi - lo)) * (-1 if m else 1) for hi, lo, m in zip(row[::2], row[1::2], p.maximise, strict=True)]


def fronts_below(df: DataFrame, p: Points, ref: list[float]) -> DataFrame:
    """Distinct nondominated points of each group that are strictly better than ``ref``."""
    costs = p.costs(df).where(all_of([F.col(n) < r for n, r in zip(p.names, ref, strict=True)]))
    return skyline_points(costs, list(p.by), p.names)


def _all_groups(df: DataFrame, volumes: DataFrame, p: Points, name: str = "hypervolume") -> DataFrame:
    """Groups without a point below the reference have volume 0."""
    if not p.by:
        return volumes.agg(F.coalesce(F.sum(name), F.lit(0.0)).alias(name))
    groups = df.select(*p.by).distinct()
    return match(groups, volumes, p.by, "left").select(*p.by, F.coalesce(name, F.lit(0.0)).alias(name))


def front_volumes(front: DataFrame, p: Points, ref: list[float]) -> DataFrame:
    """Volume of each group's front: a minimum, a staircase window, slabs of staircases, or a kernel, by the number of objectives."""
    by, f = list(p.by), p.names
    if p.d == 1:
        return front.groupBy(*by).agg((F.lit(ref[0]) - F.min(f[0])).alias("hypervolume"))
    if p.d == 2:
        w = Window.partitionBy(*by).orderBy(f[0])
        width = F.coalesce(F.lead(f[0]).over(w), F.lit(ref[0])) - F.col(f[0])
        return front.withColumn("_v", width * (F.lit(ref[1]) - F.col(f[1]))).groupBy(*by).agg(F.sum("_v").alias("hypervolume"))

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        v = kernels.hypervolume(pdf[f].to_numpy(float), np.array(ref))
        return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in by}, "hypervolume": [v]})

    schema = ", ".join([*(f"`{c}` {front.schema[c].dataType.simpleString()}" for c in by), "hypervolume double"])
    return front.groupBy(*by).applyInPandas(volume, schema)


def hypervolume(df: DataFrame, objectives: Names, ref: Ref | None = None, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """One row per group: the volume that its points dominate, bounded by ``ref`` (default: :func:`default_reference` of all rows)."""
    p = Points.of(objectives, maximise, by)
    if p.d > 31:
        raise ValueError("at most 31 objectives")
    ref = default_reference(df, objectives, maximise) if ref is None else ref
    point = p.point(ref)
    return _all_groups(df, front_volumes(fronts_below(df, p, point), p, point), p)


def hypervolume_slabs(df: DataFrame, objectives: Names, ref: Ref, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """Three objectives in DataFrame operations: a staircase for every distinct third value, times the height up to the next."""
    p = Points.of(objectives, maximise, by)
    if p.d != 3:
        raise ValueError("slabs are for three objectives")
    point, keys, (a, b, c) = p.point(ref), list(p.by), p.names
    front = fronts_below(df, p, point)
    z = front.select(*keys, c).distinct().withColumn("_h", F.coalesce(F.lead(c).over(Window.partitionBy(*keys).orderBy(c)), F.lit(point[2])) - F.col(c)).withColumnRenamed(c, "_z")
    x, y = front.alias("x"), z.alias("y")
    inside = x.join(y, all_of([F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]) & (F.col(f"x.{c}") <= F.col("y._z"))).select(*(F.col(f"x.{k}") for k in keys), a, b, "_z", "_h")
    low = F.min(b).over(Window.partitionBy(*keys, "_z").orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1))
    area = (F.lit(point[0]) - F.col(a)) * F.greatest(F.coalesce(low, F.lit(point[1])) - F.col(b), F.lit(0.0))
    volumes = inside.withColumn("_v", area * F.col("_h")).groupBy(*keys).agg(F.sum("_v").alias("hypervolume"))
    return _all_groups(df, volumes, p)


class Hypervolume:
    """:func:`hypervolume` with its reference point and directions set."""

    def __init__(self, ref: Ref, maximise: Direction = False) -> None:
        self.ref, self.maximise = ref, maximise

    def __call__(self, df: DataFrame, objectives: Names, by: Names | str = ()) -> DataFrame:
        return hypervolume(df, objectives, self.ref, self.maximise, by)


class RelativeHypervolume(Hypervolume):
    """1 - hypervolume / that of a reference set."""

    def __init__(self, ref: Ref, ref_set: DataFrame, objectives: Names, maximise: Direction = False) -> None:
        super().__init__(ref, maximise)
        self.whole = hypervolume(ref_set, objectives, ref, maximise).first()[0]
        if not self.whole:
            raise ValueError("the hypervolume of the reference set is zero")

    def __call__(self, df: DataFrame, objectives: Names, by: Names | str = ()) -> DataFrame:
        v = super().__call__(df, objectives, by)
        return v.select(*v.columns[:-1], (1 - F.col("hypervolume") / F.lit(self.whole)).alias("relative_hypervolume"))


def hv_contributions(df: DataFrame, objectives: Names, ref: Ref, maximise: Direction = False, ignore_dominated: bool = True, by: Names | str = ()) -> DataFrame:
    """The rows with ``hv_contribution``: the volume that only the row dominates; 0 for dominated and for equal rows.

    With ``ignore_dominated`` dominated rows take nothing from nondominated ones.  Two objectives stay in the JVM; three are one
    sweep a group, n log n; more measure each point against the others.
    """
    p = Points.of(objectives, maximise, by)
    if p.d < 2:
        raise ValueError("at least two objectives are needed")
    point, by_, f = p.point(ref), list(p.by), p.names
    rows = p.wrap(df)
    inside = rows.where(all_of([F.col(n) < r for n, r in zip(f, point, strict=True)]))
    counted = inside.groupBy(*by_, *f).agg(F.count("*").alias("_n"))
    if p.d == 2 and ignore_dominated:
        front = skyline_points(counted, by_, f)
        front = match(front.select(*by_, *f), counted, [*by_, *f])
        w = Window.partitionBy(*by_).orderBy(f[0])
        area = (F.coalesce(F.lead(f[0]).over(w), F.lit(point[0])) - F.col(f[0])) * (F.coalesce(F.lag(f[1]).over(w), F.lit(point[1])) - F.col(f[1]))
        own = front.withColumn("_c", F.when(F.col("_n") == 1, area).otherwise(0.0))
    else:

        def each(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf[f].to_numpy(float)
            twice = np.repeat(x, np.minimum(pdf["_n"], 2), axis=0)
            at = np.cumsum(np.minimum(pdf["_n"], 2)) - 1
            return pdf.assign(_c=kernels.contributions(twice, np.array(point), ignore_dominated)[at])

        schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in counted.schema), "_c double"])
        own = counted.groupBy(*by_).applyInPandas(each, schema)
    return match(rows, own, [*by_, *f], "left").select(*unwrap(df, "hv_contribution"), F.coalesce("_c", F.lit(0.0)).alias("hv_contribution"))


#: Points of a block; subproblems of four and more objectives that a task row holds.
TREE_BLOCK, TREE_SPLIT = 512, 64


def hypervolume_tree(df: DataFrame, objectives: Names, ref: Ref, maximise: Direction = False, by: Names | str = (), block: int = TREE_BLOCK, split: int = TREE_SPLIT) -> DataFrame:
    """:func:`hypervolume` of large sets of four and more objectives: exclusive volumes as rows, split where they are large.

    In the order of the last objective, the worst first, each point adds what it dominates and no later point does: its box less the
    volume, in one objective less, of the later points moved up to it.  Blocks of points meet pair by pair and leave, for each point of the
    first, what is nondominated of the second's moved points; these limit sets are merged by point.  A limit set of over ``split`` points in
    four or more objectives goes on as rows of ``split`` subproblems each.  No task holds more than two blocks, or one point's limit set.
    """
    p = Points.of(objectives, maximise, by)
    if p.d < 4:
        return hypervolume(df, objectives, ref, maximise, by)
    point, keys, names = p.point(ref), list(p.by), p.names
    front = numbered(fronts_below(df, p, point), [F.desc(names[-1]), *names[:-1]], keys, "_place")
    placed = materialize(front.select(*keys, F.col("_place").alias("_i"), F.floor((F.col("_place") - 1) / block).cast("int").alias("_block"), *names))
    r = np.array(point)
    head = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in keys)

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        return pa.table({c: rows.column(c).slice(0, 1) for c in [*keys, "_block"]} | {"_first": rows.column("_i").slice(0, 1), "_x": pa.array([matrix(rows, names).tobytes()], pa.binary())})

    blocks = materialize(placed.groupBy(*keys, "_block").applyInArrow(packed, f"{head}_block int, _first long, _x binary"))
    other = blocks.toDF(*(f"_b_{c}" for c in blocks.columns))
    pairs = blocks.join(other, all_of([F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys]) & (F.col("_block") <= F.col("_b__block")))
    pairs = pairs.select(*keys, "_first", "_x", (F.col("_block") == F.col("_b__block")).alias("_same"), F.col("_b__x").alias("_y")).repartition(8 * df.sparkSession.sparkContext.defaultParallelism)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py()).reshape(-1, len(names)) for c in ("_x", "_y"))
                same, out = batch.column("_same")[k].as_py(), []
                for i in range(len(x)):
                    moved = np.maximum(y[i + 1 :, :-1] if same else y[:, :-1], x[i, :-1])
                    moved = moved[(moved < r[:-1]).all(1)]
                    out.append(moved[kernels.skyline(moved)].tobytes())
                at = pa.array(np.full(len(x), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(batch.column("_first")[k].as_py() + np.arange(len(x))), pa.array([v.tobytes() if same else None for v in x], pa.binary()), pa.array(out, pa.binary())], [*keys, "_i", "_p", "_limit"])

    met = pairs.mapInArrow(limits, f"{head}_i long, _p binary, _limit binary")

    def merge(rows: pa.Table) -> pa.Table:
        own = next(v.as_py() for v in rows.column("_p") if v.is_valid)
        x = np.concatenate([np.frombuffer(v.as_py()) for v in rows.column("_limit")]).reshape(-1, len(names) - 1)
        x = x[kernels.skyline(x)]
        x = x[np.argsort(-x[:, -1], kind="stable")]
        starts = range(0, len(x), split) if len(names) > 4 and len(x) > split else [0]
        at = pa.array(np.zeros(len(starts), np.int64))
        return pa.table({c: rows.column(c).take(at) for c in keys} | {"_p": pa.array([own] * len(starts), pa.binary()), "_x": pa.array([x[s:].tobytes() for s in starts], pa.binary()), "_from": pa.array([*starts], pa.int64()), "_whole": pa.array([len(starts) == 1] * len(starts))})

    tasks = materialize(met.groupBy(*keys, "_i").applyInArrow(merge, f"{head}_p binary, _x binary, _from long, _whole boolean"))

    def volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, raw, start, whole in zip(*(batch.column(c).to_pylist() for c in ("_p", "_x", "_from", "_whole")), strict=True):
                q, x = np.frombuffer(own), np.frombuffer(raw).reshape(-1, len(names) - 1)
                box = float(np.prod(r[:-1] - q[:-1])) if not start else 0.0
                taken = kernels.hypervolume(x, r[:-1]) if whole else kernels.first_volumes(x, r[:-1], split)
                out.append((box - taken) * (r[-1] - q[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(out, pa.float64())], [*keys, "_v"])

    found = tasks.repartition(8 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(volumes, f"{head}_v double")
    return _all_groups(df, found.groupBy(*keys).agg(F.sum("_v").alias("hypervolume")), p)


def hypervolume_parallel(df: DataFrame, objectives: Names, ref: Ref, maximise: Direction = False) -> float:
    """The volume of one large set of four or more objectives, by :func:`hypervolume_tree`."""
    return hypervolume_tree(df, objectives, ref, maximise).first()[0]
