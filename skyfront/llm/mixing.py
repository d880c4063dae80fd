"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

A run has as many words as all sources together.  Each source gets a target by weight, at most
``epochs`` times its own size (what is above is shared again by weight).  Its *schedule* says how its
share moves over the run: integrated, it gives the words the source must have supplied by time t.
The source's documents, in hash order and repeated for as many epochs as needed, are laid end to end;
inverting the cumulative demand at the first word of a copy gives the copy's time, its *training
position*.  Documents are then range-sorted by the position of their first copy.

A running total over a source is taken in two steps, over 4096 hash buckets of the source and inside a
bucket, so that no task holds a source.  The table of sources is taken to be one that a mixture can be
configured for: its water level is found with one sorted window over one row per source.

Defined results: a null text has 0 words and takes 0; a null source is a source of its own, sorted last;
sources without words have target 0; repeated rows are documents of their own; of documents with equal
ids, the smaller size comes first; an empty table gives an empty result; very long texts are only counted; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count


@dataclass(frozen=True)
class Schedule:
    """A weight and the knots (time, share) of its piecewise linear course over the run, times 0 to 1."""

    weight: float
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(t, share, slope, demand at t, demand at its end) of each piece, demand scaled to 1 in all."""
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(self.knots, self.knots[1:], strict=False)]
        total, out, done = sum(areas), [], 0.0
        for ((t0, a), (t1, b)), area in zip(zip(self.knots, self.knots[1:], strict=False), areas, strict=True):
            out.append((t0, a / total, (b - a) / total / (t1 - t0), done, done + area / total))
            done += area / total
        return out


#: Production parameters: heavy sources fade over the run, light ones come in late; weights 5, 2, 1 in turn.
CURRICULUM = (Schedule(5.0, ((0.0, 1.2), (0.5, 1.0), (1.0, 0.8))), Schedule(2.0), Schedule(1.0, ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4))))
BUCKETS = 3  # leading hex digits of the hash


def position_at(demand: Column, schedule: Schedule) -> Column:
    """The time by which a source's cumulative demand reaches a fraction; beyond 1, the line goes on past the end of the run."""
    out = demand
    for t, share, slope, lo, hi in schedule.pieces():
        u = demand - F.lit(lo)
        root = (F.sqrt(F.greatest(F.lit(share * share) + 2 * F.lit(slope) * u, F.lit(0.0))) - share) / slope if slope else u / share
        out = F.when((demand >= lo) & (demand < hi), F.lit(t) + root).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """One row per source key: source_size, rank, target. ``sizes``: key, size."""
    every = Window.partitionBy()
    t = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    t = t.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / rest)
    water = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key"))).over(every)
    return t.withColumn("target", F.least(F.col("cap").cast("double"), water * F.col("w"))).select("key", "source_size", "rank", "target")


def mix(docs: DataFrame, curriculum: tuple[Schedule, ...] = CURRICULUM, epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, range-sorted by training position.

    Columns: id, source, size, source_size, target, copies array<struct<position, words>> and taken.
    The k-th source in code-point order has the schedule ``curriculum[k % len(curriculum)]``.  The copy that
    crosses its source's target is cut there, so that the words taken of a source are its target, rounded.
    """
    src = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), src.alias("source"), word_count(F.col(text_col)).alias("size"),
        F.when(src.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), src)).alias("key"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("hash"),
    ).withColumn("bucket", F.substring("hash", 1, BUCKETS))
    rows = materialize(rows)
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))
    targets = source_targets(rows.select("key", "size"), tuple(s.weight for s in curriculum), epochs)
    inside = Window.partitionBy("key", "bucket").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(buckets, ["key", "bucket"]).join(targets, "key").withColumn("start", F.col("bucket_start") + F.col("own_start"))
    quota = F.floor(F.col("target") + 0.5)

    def at(first: Column) -> Column:
        demand = first.cast("double") / F.greatest(F.col("target"), F.lit(1.0))
        out = demand
        for k, s in enumerate(curriculum):
            out = F.when(F.col("rank") % len(curriculum) == k, position_at(demand, s)).otherwise(out)
        return out

    copies = [F.struct(at(first).alias("position"), F.greatest(F.lit(0), F.least(F.col("size"), quota - first)).cast("long").alias("words")) for first in (F.col("start") + e * F.col("source_size") for e in range(epochs))]
    rows = rows.withColumn("all_copies", F.array(*copies)).withColumn("first", F.col("all_copies")[0]["position"])
    rows = rows.withColumn("copies", F.filter("all_copies", lambda c: c["words"] > 0))
    rows = rows.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    rows = rows.repartitionByRange("first", "hash").sortWithinPartitions("first", "hash")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken")


def training_stream(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy that the run takes, range-sorted by training position: id, position, words."""
    out = mixed.select(id_col, F.explode("copies").alias("c")).select(id_col, "c.position", "c.words")
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)
