"""Distances of sets to a reference set, and epsilon indicators.

A group's points meet the reference set in a task, where box trees find the nearest points without comparing all pairs; what
leaves the task is a row a group.  A reference set of a checked size is sent to every task, a larger one is cut into blocks.  Points of groups of over
``GROUP_ROWS`` are dealt into parts, whose least values are packed, a row a part and block, and merged.  All indicators of a call come from one pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.folders import materialize
from ..functions.numbering import numbered
from ..functions.points import Direction, Names, Points, match, small
from .dominance import skyline_points
from .fronts import matrix

#: A reference set of up to this many values (points times objectives) is sent to every task, as is each block of a larger one; points of a group, or of a part of it, in a task.
BROADCAST_VALUES, GROUP_ROWS = 1_000_000, 500_000
#: Kind of measure by indicator; gd is taken over the points, the others over the reference points.
KINDS = {"gd": "distance", "igd": "distance", "igd_plus": "plus", "epsilon_additive": "additive", "epsilon_mult": "ratio"}
SQUARED = ("gd", "igd", "igd_plus")


def _indicators(df: DataFrame, ref: DataFrame, p: Points, names: list[str], power: int = 1) -> DataFrame:
    """One row per group: the indicators ``names``, gd and igd as power means."""
    by, over_ref = list(p.by), [n for n in names if n != "gd"]
    costs = p.costs(df)
    if not {"gd", "igd"} & {*names}:  # dominated points change nothing
        costs = materialize(skyline_points(costs, by, p.names))
    known = Points.of(p.objectives, p.maximise).costs(ref)
    most = BROADCAST_VALUES // p.d
    some = known.limit(most + 1).toPandas().to_numpy(float)
    if not len(some):
        return costs.limit(0).select(*by, *(F.lit(0.0).alias(n) for n in names))
    sizes = costs.groupBy(*by).agg(F.count("*").alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    if largest > GROUP_ROWS:  # a point takes the part that its values say, so equal ones meet
        large = small(materialize(sizes.where(F.col("_size") > GROUP_ROWS)))
        parts = F.when(F.col("_size").isNotNull(), F.pmod(F.xxhash64(*p.names), F.ceil(F.col("_size") / GROUP_ROWS))).otherwise(0)
        costs = match(costs, large, by, "left").withColumn("_part", parts.cast("int")).drop("_size") if by else costs.withColumn("_part", F.pmod(F.xxhash64(*p.names), F.lit(-(-largest // GROUP_ROWS))).cast("int"))
    else:
        costs = costs.withColumn("_part", F.lit(0))
    if len(some) <= most and largest <= GROUP_ROWS:
        return _means(_whole_groups(costs, some, p, names, power), by, names, power)
    if len(some) <= most:
        met = _against(costs.withColumn("_block", F.lit(0)), some, None, p, names)
    else:
        met = _against(costs, None, known, p, names)
    head = ", ".join([*(f"`{c}` {costs.schema[c].dataType.simpleString()}" for c in by), _SUMS.format(names="".join(f"_{n} double, " for n in over_ref))])
    out = []
    if over_ref:  # the least over a group's parts, for each reference point of a block
        out.append(met.where("_part >= 0").groupBy(*by, "_block").applyInArrow(_merge(by, over_ref, power), head))
    if "gd" in names:  # the least over the blocks, for each point of a part
        out.append(met.where("_part < 0").groupBy(*by, "_part").applyInArrow(_merge(by, over_ref, power, True), head))
    return _means(reduce(DataFrame.unionByName, out), by, names, power)


#: Columns of partial sums: the sum (of a maximum, the largest) of each indicator, how many reference points it is over, and sum and number of distances of points.
_SUMS = "{names}_refs long, _sum double, _n long"


def _means(sums: DataFrame, by: list[str], names: list[str], power: int) -> DataFrame:
    """The indicators from partial sums."""
    root = lambda x: x if power == 1 else F.pow(x, F.lit(1.0 / power))
    out = []
    for n in names:
        if n == "gd":
            out.append(root(F.sum("_sum") / F.sum("_n")).alias(n))
        elif n.startswith("epsilon"):
            out.append(F.max(f"_{n}").alias(n))
        else:
            mean = F.sum(f"_{n}") / F.sum("_refs")
            out.append((root(mean) if n == "igd" else mean).alias(n))
    return sums.groupBy(*by).agg(*out)


def _values(kind: str, tree: kernels.Boxes, q: np.ndarray, up: list[bool]) -> np.ndarray:
    v = tree.least(KINDS[kind], q, up)
    return np.sqrt(v) if kind in SQUARED else v


def _total(name: str, v: np.ndarray, power: int) -> float | None:
    v = v[~np.isnan(v)]
    if not len(v):
        return None
    return float(v.max()) if name.startswith("epsilon") else float((v**power if name == "igd" else v).sum())


def _whole_groups(costs: DataFrame, ref: np.ndarray, p: Points, names: list[str], power: int) -> DataFrame:
    """Partial sums, one row a group: its points meet the whole reference set in one task."""
    by, over_ref, up = list(p.by), [n for n in names if n != "gd"], list(p.maximise)
    shared = costs.sparkSession.sparkContext.broadcast(ref)
    known: list[kernels.Boxes] = []  # one a worker

    def run(points: pa.Table) -> pa.Table:
        r, x = shared.value, matrix(points, p.names)
        tree = kernels.Boxes(np.unique(x, axis=0)) if over_ref else None
        row = {c: points.column(c).slice(0, 1) for c in by} | {f"_{n}": pa.array([_total(n, _values(n, tree, r, up), power)], pa.float64()) for n in over_ref}
        d = np.zeros(0)
        if "gd" in names:
            if not known:
                known.append(kernels.Boxes(r))
            d = np.sqrt(known[0].least("distance", x)) ** power
        return pa.table(row | {"_refs": pa.array([len(r)]), "_sum": pa.array([float(d.sum())]), "_n": pa.array([len(d)])})

    schema = ", ".join([*(f"`{c}` {costs.schema[c].dataType.simpleString()}" for c in by), _SUMS.format(names="".join(f"_{n} double, " for n in over_ref))])
    return costs.groupBy(*by).applyInArrow(run, schema)


def _against(costs: DataFrame, ref: np.ndarray | None, known: DataFrame | None, p: Points, names: list[str]) -> DataFrame:
    """(groups, ``_part``, ``_block``, packed least values): each part of a group against each block of the reference set.

    The reference set is one block that every task has (``ref``), or is cut into blocks of ``BROADCAST_VALUES`` in the order of its first objective
    (``known``), which the points meet by slots of groups: points go once to each block, a block once to each slot.  What is over the points has
    ``_part`` -1 - part, and follows the points' order by value.
    """
    by, over_ref, up = list(p.by), [n for n in names if n != "gd"], list(p.maximise)
    fields = [*by, "_part", "_block", *(f"_{n}" for n in over_ref), "_near"]
    schema = ", ".join([*(f"`{c}` {costs.schema[c].dataType.simpleString()}" for c in by), "_part int, _block int", *(f"_{n} binary" for n in over_ref), "_near binary"])

    def meet(points: pa.Table, r: np.ndarray, block: int) -> pa.Table:
        tree, rows = kernels.Boxes(r) if "gd" in names else None, []
        keys = points.select([*by, "_part"]).to_pandas().groupby([*by, "_part"], dropna=False, sort=False).indices
        x, parts, first = matrix(points, p.names), points.column("_part").to_numpy(), []
        for at in keys.values():
            if over_ref:
                own = kernels.Boxes(np.unique(x[at], axis=0))
                rows.append((int(parts[at[0]]), block, *(_values(n, own, r, up).tobytes() for n in over_ref), None)), first.append(at[0])
            if tree is not None:
                own = x[at][np.lexsort(x[at].T[::-1])]
                rows.append((-1 - int(parts[at[0]]), block, *(None for _ in over_ref), np.sqrt(tree.least("distance", own)).tobytes())), first.append(at[0])
        kinds = [pa.int32(), pa.int32(), *(pa.binary() for _ in over_ref), pa.binary()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        head = [points.column(c).take(pa.array(first, pa.int64())) for c in by]
        return pa.table([*head, *columns], names=fields)

    if known is None:
        shared = costs.sparkSession.sparkContext.broadcast(ref)
        return costs.groupBy(*by, "_part").applyInArrow(lambda points: meet(points, shared.value, 0), schema)
    placed = materialize(numbered(known, p.names, name="_place"))
    size = max(1, BROADCAST_VALUES // p.d)
    blocks = -(-placed.count() // size)
    slots = max(1, costs.sparkSession.sparkContext.defaultParallelism)
    slot = F.pmod(F.xxhash64(*by, "_part"), F.lit(slots)).cast("int")
    points = costs.withColumn("_slot", slot).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.floor((F.col("_place") - 1) / size).cast("int")
    rows = placed.select(*p.names, block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_slot"))

    def pair(points: pa.Table, r: pa.Table) -> pa.Table:
        block = points.column("_block")[0].as_py() if points.num_rows else 0
        return meet(points, matrix(r, p.names), block)

    return points.groupBy("_block", "_slot").cogroup(rows.groupBy("_block", "_slot")).applyInArrow(pair, schema)


def _merge(by: list[str], over_ref: list[str], power: int, points: bool = False):  # noqa: ANN202
    """Partial sums from packed least values of the same reference points (or points)."""

    def least(column: pa.ChunkedArray) -> np.ndarray:
        return np.fmin.reduce([np.frombuffer(v.as_py()) for v in column])

    def run(rows: pa.Table) -> pa.Table:
        head = {c: rows.column(c).slice(0, 1) for c in by}
        if points:
            d = least(rows.column("_near")) ** power
            return pa.table(head | {f"_{n}": pa.array([None], pa.float64()) for n in over_ref} | {"_refs": pa.array([0]), "_sum": pa.array([float(d.sum())]), "_n": pa.array([len(d)])})
        values = {n: least(rows.column(f"_{n}")) for n in over_ref}
        sums = {f"_{n}": pa.array([_total(n, v, power)], pa.float64()) for n, v in values.items()}
        return pa.table(head | sums | {"_refs": pa.array([len(values[over_ref[0]])]), "_sum": pa.array([0.0]), "_n": pa.array([0])})

    return run


def _power(p: int) -> int:
    if p != int(p) or p < 1:
        raise ValueError("p must be a positive integer")
    return int(p)


def indicators(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), names: Names = ("gd", "igd", "igd_plus", "epsilon_additive")) -> DataFrame:
    """One row per group with several of gd, igd, igd_plus, epsilon_additive and epsilon_mult, from one pass."""
    return _indicators(df, ref, Points.of(objectives, maximise, by), list(names))


def igd(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), p: int = 1) -> DataFrame:
    """Mean (power mean for ``p`` > 1) over the reference points of the distance to the nearest point."""
    return _indicators(df, ref, Points.of(objectives, maximise, by), ["igd"], _power(p))


def igd_plus(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """As :func:`igd`, counting only what a point is worse than the reference point."""
    return _indicators(df, ref, Points.of(objectives, maximise, by), ["igd_plus"])


def gd(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), p: int = 1) -> DataFrame:
    """Mean (power mean for ``p`` > 1) over the points of the distance to the nearest reference point."""
    return _indicators(df, ref, Points.of(objectives, maximise, by), ["gd"], _power(p))


def avg_hausdorff_dist(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), p: int = 1) -> DataFrame:
    """The larger of the power means of :func:`gd` and :func:`igd`."""
    q = Points.of(objectives, maximise, by)
    return _indicators(df, ref, q, ["gd", "igd"], _power(p)).select(*q.by, F.greatest("gd", "igd").alias("avg_hausdorff"))


def epsilon_additive(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """The least amount by which a set must be shifted to weakly dominate the reference set."""
    return _indicators(df, ref, Points.of(objectives, maximise, by), ["epsilon_additive"])


def epsilon_mult(df: DataFrame, ref: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """The least factor by which a set must be scaled to weakly dominate the reference set; all values must be positive."""
    p = Points.of(objectives, maximise, by)
    for rows in (df, ref):
        if rows.where(F.least(*objectives) <= 0 if p.d > 1 else F.col(p.objectives[0]) <= 0).limit(1).count():
            raise ValueError("all values must be positive")
    return _indicators(df, ref, p, ["epsilon_mult"])


def epsilon_compare(a: DataFrame, b: DataFrame, objectives: Names, maximise: Direction = False) -> int:
    """-1 if set ``a`` is better by both additive epsilons, 1 if ``b`` is, 0 otherwise."""
    ab, ba = (epsilon_additive(x, y, objectives, maximise).first()[0] for x, y in ((a, b), (b, a)))
    return -1 if ab <= 0 < ba else 1 if ba <= 0 < ab else 0
