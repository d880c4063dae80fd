"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: blank and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/skyfront-checkpoint"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    The files go when nothing refers to the result any more, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, without copying it; nulls have none."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at.astype(np.int64) - at[0]


def slices(raw: np.ndarray, offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts of at most ``size`` bytes, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def text_slices(batch: pa.RecordBatch, name: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch by runs of rows whose texts have at most ``size`` bytes (or by one row), with the texts."""
    for lo, hi, _, _ in slices(*utf8(batch.column(name)), size):
        part = batch.slice(lo, hi - lo)
        yield part, part.column(name).to_pylist()


def release() -> None:
    """Give a task's freed memory back to the system, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128-bit key of a text; equal texts, and only they, share it.  Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(0))


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but white space, as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows (all, if fewer) whose keys hash lowest: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(n)


#: Bits of the map that :func:`bit_map` makes: 4 MB, whatever the input.
MAP_BITS = 1 << 25


def _bits(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = name.view(np.uint64) if name.dtype == np.int64 else name.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        v = u * np.uint64(0x9E3779B97F4A7C15)
    return (u ^ v >> np.uint64(32)) % np.uint64(MAP_BITS), (v >> np.uint64(20)) % np.uint64(MAP_BITS)


def bit_map(names: DataFrame) -> np.ndarray:
    """A bit map of fixed size of a column ``name`` of longs, for sparing a shuffle rows that can't have a partner.

    It answers "may be there": a full map lets everything pass, and the join that follows decides.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(MAP_BITS // 64, np.uint64)
        for pdf in batches:
            for bit in _bits(pdf["name"].to_numpy(np.int64)):
                np.bitwise_or.at(words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pd.DataFrame({"at": at, "bits": words[at].view(np.int64)})

    got = names.mapInPandas(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(MAP_BITS // 64, np.uint64)
    words[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def may_hold(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.ones(len(names), bool)
    for bit in _bits(names):
        out &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the least vertex of the component of each vertex that has an edge.

    Each round takes the least label of the neighbours, then the label of that label, so that chains
    halve; every round is checkpointed, and nothing but a count comes to the driver.
    """
    both = materialize(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct())
    labels = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("near")), "u").groupBy("v").agg(F.min("near").alias("near"))
        hop = labels.join(seen, "v").select("v", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("v").alias("new"), F.col("label").alias("far"))
        new = materialize(hop.join(jump, "new", "left").select("v", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        labels = new.select("v", F.col("new").alias("label"))
        if not new.where("label <> new").limit(1).count():
            return labels
