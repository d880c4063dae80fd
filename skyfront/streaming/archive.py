"""An archive of nondominated points that micro-batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.points import Direction, Names
from ..operators.dominance import filter_dominated


def merge(archive: DataFrame | None, batch: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """The nondominated rows of the archive and the batch together."""
    both = batch if archive is None else archive.unionByName(batch)
    return filter_dominated(both, objectives, maximise, by=by)


def skyline_archive(stream: DataFrame, path: str, checkpoint: str, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> StreamingQuery:
    """Starts a query that keeps the skyline of all rows seen so far, one Parquet folder per batch under ``path``.

    A batch that is run again after a failure reads the archive of the batch before it, so its result is the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/batch={number - 1}") if number > 0 else None
        merge(before, batch, objectives, maximise, by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").start()
