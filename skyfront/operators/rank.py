"""Pareto ranks."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import kernels
from ..functions.folders import materialize, shared_folder
from ..functions.points import Direction, Names, Points, match, small, unwrap
from .dominance import skyline_points
from .fronts import cells, matrix

#: Distinct points of a group that one task ranks; parts at most that an objective of a larger group is cut into.
TASK_ROWS, MOST_TILES = 20_000, 16
#: Rows of a wave: results, and what goes to the next tile of the row, of the column, and across.
OWN, ROW, COLUMN, ACROSS = range(4)
#: Fronts that ``pareto_rank_peel`` takes one by one, at most.
ROUNDS = 16


def pareto_rank(df: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), base: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows with an integer ``rank``: the front that peeling puts them on, counted from ``base``; equal rows share it.

    One objective is a dense rank.  Otherwise the distinct points of groups of up to ``task_rows`` are ranked by a kernel,
    larger groups by :func:`_waves`.
    """
    p = Points.of(objectives, maximise, by)
    rows = p.wrap(df)
    if p.d == 1:
        w = Window.partitionBy(*p.by).orderBy(p.names[0])
        return rows.withColumn("rank", (F.dense_rank().over(w) - 1 + base).cast("int")).select(*unwrap(df, "rank"), "rank")
    points = materialize(rows.select(*p.by, *p.names).distinct())
    sizes = points.groupBy(*p.by).agg(F.count("*").alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(rank=kernels.pareto_rank(pdf[p.names].to_numpy(float)).astype(np.int32))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), "rank int"])
    if largest <= task_rows:
        ranked = points.groupBy(*p.by).applyInPandas(rank, schema)
    elif not p.by:
        ranked = _waves(points, [], p.names, largest, task_rows)
    else:
        large = small(materialize(sizes.where(F.col("_size") > task_rows)))
        ranked = match(points, large, p.by, "left_anti").groupBy(*p.by).applyInPandas(rank, schema).unionByName(_waves(match(points, large, p.by, "left_semi"), list(p.by), p.names, largest, task_rows))
    return match(rows, ranked, [*p.by, *p.names]).select(*unwrap(df, "rank"), (F.col("rank") + base).cast("int").alias("rank"))


def _waves(points: DataFrame, by: list[str], names: list[str], largest: int, task_rows: int) -> DataFrame:
    """Ranks of distinct points of large groups, tile by tile of a grid of quantiles of two objectives.

    Only points of tiles whose two numbers are nowhere larger can dominate a tile's points, so the tiles whose numbers have one
    sum don't depend on each other: they are a wave, ranked in tasks of their own.  A tile gets from the two tiles before it what later ones need of all earlier
    ones, and passes that on with its own points: to the next of its row, to the next of its column, and to the one across.  An objective by which the receiver lies wholly after no longer
    matters, and of the others and the rank only the front (low values, high ranks) can count.  So a wave reads the two before it, whatever came earlier.
    """
    cuts = max(2, min(MOST_TILES, round((4 * largest / task_rows) ** 0.5)))
    if len(names) > 2:  # the two objectives of the most values are cut
        values = points.agg(*(F.approx_count_distinct(n) for n in names)).first()
        names = [names[i] for i in sorted(range(len(names)), key=lambda i: -values[i])]
    numbers = points.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()) if by else points.sparkSession.range(1).select(F.col("id").alias("_g"))
    dealt = match(cells(points, by, names[:2], cuts), small(materialize(numbers)), by)
    dealt = dealt.select(*by, *names, "_g", *(F.element_at("_cell", k + 1).alias(c) for k, c in enumerate(("_i", "_j"))))
    path = f"{shared_folder(points.sparkSession)}/skyfront-tiles-{uuid.uuid4().hex}"
    wave = F.col("_i") + F.col("_j")
    dealt.repartitionByRange(wave, "_g", "_i").withColumn("_wave", wave).write.partitionBy("_wave").parquet(path)
    tiles = points.sparkSession.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "_wave int"])).parquet(path)
    ends = tiles.agg(F.max("_i"), F.max("_j")).first()
    schema = StructType([*(StructField(f.name, f.dataType) for f in dealt.schema), StructField("rank", IntegerType()), StructField("_to", IntegerType())])
    keys = ["_g", "_i", "_j"]

    def rank(key: tuple, own: pa.Table, before: pa.Table) -> pa.Table:
        g, i, j = (k.as_py() for k in key)
        x, old = matrix(own, names), matrix(before, names)
        ranks, to = before.column("rank").to_numpy().astype(np.int64), before.column("_to").to_numpy()
        new = kernels.rank_after(x, old, ranks)
        out = [own.append_column("rank", pa.array(new, pa.int32())).append_column("_to", pa.array(np.full(len(x), OWN, np.int32)))]
        for kind, from_, passed, (di, dj) in ((ROW, (ROW,), [0], (1, 0)), (COLUMN, (COLUMN,), [1], (0, 1)), (ACROSS, (ROW, COLUMN, ACROSS), [0, 1], (1, 1))):
            if i + di > ends[0] or j + dj > ends[1]:
                continue
            seen = np.isin(to, from_)
            rows, high = np.concatenate([old[seen], x]), np.concatenate([ranks[seen], new])
            rows[:, passed] = -np.inf
            kept = kernels.skyline(np.column_stack([np.delete(rows, passed, 1), -high]))
            place = {"_g": (g, pa.int64()), "_i": (i + di, pa.int32()), "_j": (j + dj, pa.int32()), "_to": (kind, pa.int32())}
            columns = {n: pa.array(rows[kept, k]) for k, n in enumerate(names)} | {"rank": pa.array(high[kept], pa.int32())}
            columns |= {n: pa.array(np.full(len(kept), v), t) for n, (v, t) in place.items()}
            out.append(pa.table([columns[f.name] if f.name in columns else pa.nulls(len(kept), f.type) for f in out[0].schema], out[0].schema))
        return pa.concat_tables(out)

    done, last = [], []
    for number in range(ends[0] + ends[1] + 1):
        own = tiles.where(F.col("_wave") == number).drop("_wave")
        before = reduce(DataFrame.unionByName, last).where((F.col("_to") != OWN) & (wave == number)) if last else own.limit(0).withColumns({"rank": F.lit(0), "_to": F.lit(ROW)})
        before = before.select(*keys, *names, "rank", "_to")
        new = materialize(own.toDF(*own.columns).groupBy(*keys).cogroup(before.toDF(*before.columns).groupBy(*keys)).applyInArrow(rank, schema))
        done.append(new.where(F.col("_to") == OWN).select(*by, *names, "rank"))
        last = [*last, new][-2:]
    return reduce(DataFrame.unionByName, done)


def pareto_rank_peel(df: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), base: int = 0) -> DataFrame:
    """:func:`pareto_rank` by rounds of distributed skylines: for groups of any size and few fronts.

    What is left is checkpointed in every round.  A front that is less than a ``ROUNDS``-th of it tells of many more fronts, and so
    do ``ROUNDS`` rounds: what is left then is ranked by :func:`pareto_rank`, from the next number on.
    """
    p = Points.of(objectives, maximise, by)
    rows = p.wrap(df)
    left = rows.select(*p.by, *p.names).distinct()
    fronts, level = None, base
    left = materialize(left)
    size, share = left.count(), 1.0
    while size:
        if share < 1 / ROUNDS or level - base == ROUNDS:
            fronts = fronts.unionByName(pareto_rank(left, p.names, by=p.by, base=level).select(*fronts.columns))
            break
        front = materialize(skyline_points(left, list(p.by), p.names))
        ranked = front.withColumn("rank", F.lit(level).cast("int"))
        fronts = ranked if fronts is None else fronts.unionByName(ranked)
        left = materialize(match(left, front, [*p.by, *p.names], "left_anti"))
        before, size, level = size, left.count(), level + 1
        share = 1 - size / before
    if fronts is None:
        return rows.withColumn("rank", F.lit(None).cast("int")).select(*unwrap(df, "rank"), "rank")
    return match(rows, fronts, [*p.by, *p.names]).select(*unwrap(df, "rank"), "rank")


def ndsort(df: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """The rows with ``rank`` and ``order``: the rank, refined inside a front by 1 minus the contribution.

    Each front is rescaled to 0 .. 0.9 in every objective (a constant one to 0) and contributions are taken to 1.
    """
    from .hypervolume import hv_contributions
    from .transform import normalise

    p = Points.of(objectives, maximise, [*Points.of(objectives, maximise, by).by, "rank"])
    ranked = pareto_rank(df, objectives, maximise, by)
    scaled = normalise(p.wrap(ranked), p.names, to_range=(0.0, 0.9), by=p.by)
    out = hv_contributions(scaled, p.names, 1.0, by=p.by)
    return out.select(*unwrap(df, "rank", "order"), "rank", (F.col("rank") + (1 - F.col("hv_contribution"))).alias("order"))
