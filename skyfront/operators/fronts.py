"""Nondominated rows for three and more objectives, without a task that sees a group whole.

Each input partition keeps its own nondominated rows.  What is left of a group of up to ``MERGE_ROWS`` rows is merged in one
task; a larger one is dealt into cells of a grid of quantiles.  A cell whose best corner is weakly dominated by another
cell's worst corner goes as a whole.  Of the others each first filters itself; then two cells meet, in a task of their own,
only where the one's best corner is not worse than the other's worst, and only with the rows that can matter to each other.

Equal rows are all kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.folders import materialize
from ..functions.points import all_of, match, small

#: Rows of a group that one task merges; cells an objective is cut into at most.
MERGE_ROWS, MOST_CUTS = 50_000, 32


def matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy(zero_copy_only=False) for n in names]) if table.num_rows else np.empty((0, len(names)))


def _group_rows(table: pa.RecordBatch | pa.Table, by: list[str]) -> list[np.ndarray]:
    if not by:
        return [np.arange(table.num_rows)]
    return [*table.select(by).to_pandas().groupby(by, dropna=False, sort=False).indices.values()]


def local_rows(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The rows that are nondominated within their group and input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            kept = new if kept is None else pa.concat_tables([kept, new])
            x, stay = matrix(kept, names), np.zeros(kept.num_rows, bool)
            for at in _group_rows(kept, by):
                stay[at] = kernels.nondominated(x[at])
            kept = kept.filter(pa.array(stay))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def _within(names: list[str]):  # noqa: ANN202
    return lambda table: table.filter(pa.array(kernels.nondominated(matrix(table, names)), pa.bool_()))


def _equal(by: list[str], a: str, b: str) -> Column:
    return all_of([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])


def cells(rows: DataFrame, by: list[str], names: list[str], cuts: int) -> DataFrame:
    """The rows with ``_cell``, an array of how many of the group's quantiles of each objective are below."""
    shares = [k / cuts for k in range(1, cuts)]
    quantiles = rows.groupBy(*by).agg(*(F.percentile_approx(n, shares, 1000).alias(f"_q{n}") for n in names))
    below = lambda n: F.size(F.filter(F.array_distinct(f"_q{n}"), lambda q: q < F.col(n)))
    return match(rows, small(materialize(quantiles)), by).withColumn("_cell", F.array(*map(below, names))).drop(*(f"_q{n}" for n in names))


def corners(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Best and worst corner of each cell's rows: ``_lo...``, ``_hi...``."""
    return rows.groupBy(*by, "_cell").agg(*(F.min(n).alias(f"_lo{n}") for n in names), *(F.max(n).alias(f"_hi{n}") for n in names))


def _merge_cells(rows: DataFrame, by: list[str], names: list[str], largest: int, merge_rows: int) -> DataFrame:
    cuts = max(2, min(MOST_CUTS, round((8 * largest / merge_rows) ** (1 / (len(names) - 1)))))
    dealt = cells(rows, by, names, cuts)
    own = materialize(dealt.groupBy(*by, "_cell").applyInArrow(_within(names), dealt.schema).withColumn("_row", F.monotonically_increasing_id()))
    c = materialize(corners(own, by, names))
    a, b = c.alias("a"), c.alias("b")
    other = _equal(by, "a", "b") & (F.col("a._cell") != F.col("b._cell"))
    beaten = b.join(a, other & all_of([F.col(f"a._hi{n}") <= F.col(f"b._lo{n}") for n in names]), "left_semi")
    alive = materialize(match(c, beaten.select(*by, "_cell"), [*by, "_cell"], "left_anti"))
    a, b = alive.alias("a"), alive.alias("b")
    near = a.join(b, other & all_of([F.col(f"a._lo{n}") <= F.col(f"b._hi{n}") for n in names]))
    near = near.select(*(F.col(f"b.{k}") for k in by), F.col("a._cell").alias("_by"), F.col("b._cell").alias("_cell"), *(F.col(f"a._lo{n}").alias(f"_lo{n}") for n in names), *(F.col(f"b._hi{n}").alias(f"_hi{n}") for n in names))
    near = materialize(near.withColumn("_pair", F.monotonically_increasing_id()))
    points = own.select(*by, "_cell", "_row", *names)
    left = match(points, near.select(*by, "_cell", "_pair", *(f"_lo{n}" for n in names)), [*by, "_cell"]).where(all_of([F.col(n) >= F.col(f"_lo{n}") for n in names])).select("_pair", "_row", *names)
    right = match(points.withColumnRenamed("_cell", "_by"), near.select(*by, "_by", "_pair", *(f"_hi{n}" for n in names)), [*by, "_by"]).where(all_of([F.col(n) <= F.col(f"_hi{n}") for n in names])).select("_pair", "_row", *names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = kernels.covered(matrix(left, names), matrix(right, names)) if left.num_rows and right.num_rows else np.zeros(left.num_rows, bool)
        return left.select(["_row"]).filter(pa.array(out, pa.bool_()))

    # toDF gives new columns, as both sides come from one table
    left, right = (side.toDF(*side.columns) for side in (left, right))
    out = left.groupBy("_pair").cogroup(right.groupBy("_pair")).applyInArrow(meet, "_row long")
    held = match(own, alive.select(*by, "_cell"), [*by, "_cell"], "left_semi")
    return held.join(out.distinct(), "_row", "left_anti").select(*rows.columns)


def nondominated_rows(rows: DataFrame, by: list[str], names: list[str], merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The rows that no row of their group dominates, equal ones included; all columns are kept."""
    near = materialize(local_rows(rows, by, names))
    sizes = near.groupBy(*by).agg(F.count("*").alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    if largest <= merge_rows:
        return near.groupBy(*by).applyInArrow(_within(names), near.schema)
    if not by:
        return _merge_cells(near, by, names, largest, merge_rows)
    large = small(materialize(sizes.where(F.col("_size") > merge_rows)))
    rest = match(near, large, by, "left_anti").groupBy(*by).applyInArrow(_within(names), near.schema)
    return rest.unionByName(_merge_cells(match(near, large, by, "left_semi"), by, names, largest, merge_rows))
