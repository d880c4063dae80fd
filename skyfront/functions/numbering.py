"""Consecutive numbers for the rows of a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import materialize

#: (partition, group) counts up to which they are sent to every task.
COUNTS_BROADCAST = 100_000


def numbered(df: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """The rows with ``name``, their place from 1 in the given order, within each group of equal ``by``.

    One range shuffle sorts the table; a partition's rows then need only the number of rows of their group in the
    partitions before, so no task sees more than its range.  Rows that tie in ``order`` are numbered in any order, and
    are kept in one partition: end the order with columns that tell rows apart where many may tie.  Nulls in ``by`` are a group.
    """
    by = list(by or [])
    keys = [F.asc(c) for c in by] + [F.asc(c) if isinstance(c, str) else c for c in order]
    place = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*df.columns).alias("row"), place.alias("place")))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    group = F.struct(F.lit(0).alias("_"), *(F.col(f"row.`{c}`").alias(f"_{i}") for i, c in enumerate(by)))
    rows = rows.select("row", part.alias("part"), at.alias("at"), group.alias("group"))
    counts = rows.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("group", "part", (before - F.col("first") + 1).alias("start")))
    starts = F.broadcast(starts) if starts.limit(COUNTS_BROADCAST + 1).count() <= COUNTS_BROADCAST else starts
    return rows.join(starts, ["group", "part"]).select(*(F.col(f"row.`{c}`") for c in df.columns), (F.col("at") + F.col("start")).alias(name))
