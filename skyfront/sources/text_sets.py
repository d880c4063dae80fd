"""The text format of sets: rows of numbers, sets separated by blank lines or comments."""

from __future__ import annotations

import io
import lzma
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folders import materialize
from ..functions.points import Names, small

#: Names of the errors, by code.
ERRORS = ("NO_ERROR", "READ_INPUT_FILE_EMPTY", "READ_INPUT_WRONG_INITIAL_DIM", "ERROR_FOPEN", "ERROR_CONVERSION", "ERROR_COLUMNS")
_NUMBER = re.compile(r"[+-]?(?:inf(?:inity)?|nan|0x[0-9a-f]+(?:\.[0-9a-f]*)?(?:p[+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.IGNORECASE)
LONGEST_TOKEN = 127


class ReadDatasetsError(Exception):
    """A file of sets can't be read; ``error`` is the code, ``message`` its name."""

    def __init__(self, code: int) -> None:
        self.error, self.message = code, ERRORS[abs(code)]
        super().__init__(self.message)


def _number(token: str) -> float:
    """The number that a token starts with."""
    m = _NUMBER.match(token)
    if not m or len(token) > LONGEST_TOKEN:
        raise ReadDatasetsError(4)
    return float.fromhex(m[0]) if "x" in m[0].lower() else float(m[0])


def parse_sets(text: str) -> list[tuple[list[float], int]]:
    """(row, set number from 1) of a text.  A blank line or a comment ends the set."""
    rows, current, open_, width = [], 0, False, None
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens or tokens[0].startswith("#"):
            open_ = False
            continue
        values = [_number(t) for t in tokens]
        if width is None:
            width = len(values)
        if len(values) != width:
            raise ReadDatasetsError(5)
        current, open_ = (current, True) if open_ else (current + 1, True)
        rows.append((values, current))
    if not rows:
        raise ReadDatasetsError(1)
    return rows


def read_datasets(spark: SparkSession, path: str | io.StringIO, objectives: Names | None = None, per_file: bool = False, union: bool = False) -> DataFrame:
    """Sets from text files, also compressed (.gz, .bz2, .xz): objectives as doubles and ``set_id`` from 1.

    Files are parsed in tasks, one file being a unit; ``per_file`` adds ``file``.  ``union`` makes one set of all.
    The number of columns is taken from the first file, unless ``objectives`` name them.
    """
    if isinstance(path, io.StringIO):
        rows = parse_sets(path.getvalue())
        names = list(objectives or [f"f{i + 1}" for i in range(len(rows[0][0]))])
        if len(names) != len(rows[0][0]):
            raise ReadDatasetsError(2)
        return spark.createDataFrame([(*v, 1 if union else s) for v, s in rows], ", ".join([*(f"`{n}` double" for n in names), "set_id long"]))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def text(name: str, content: bytes) -> str:
        import bz2
        import gzip

        opener = {".xz": lzma.decompress, ".gz": gzip.decompress, ".bz2": bz2.decompress}.get(Path(name).suffix, bytes)
        return opener(bytes(content)).decode()

    if objectives is None:
        first = files.orderBy("path").first()
        if first is None:
            raise ReadDatasetsError(3)
        objectives = [f"f{i + 1}" for i in range(len(parse_sets(text(first["path"], first["content"]))[0][0]))]
    names = list(objectives)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = parse_sets(text(name, content))
                if len(rows[0][0]) != len(names):
                    raise ReadDatasetsError(2)
                yield pd.DataFrame([v for v, _ in rows], columns=names).assign(set_id=[1 if union else s for _, s in rows], file=name)

    out = files.mapInPandas(run, ", ".join([*(f"`{n}` double" for n in names), "set_id long", "file string"]))
    return out if per_file else out.drop("file")


def read_split_sets(spark: SparkSession, path: str, objectives: Names | None = None, per_file: bool = False) -> DataFrame:
    """:func:`read_datasets` for files of any size: a file is read in as many pieces as Spark cuts it into.

    Each piece numbers the sets that begin in it and tells whether its first and last lines are rows; a running sum over a
    file's pieces, a row each, then gives every set its number, and joins the set that goes on across two pieces.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tell(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True)] or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        schema = pa.schema([("file", pa.string()), ("piece", pa.int64()), ("local", pa.int64()), ("row", pa.list_(pa.float64())), ("begins", pa.bool_()), ("ends", pa.bool_())])
        kinds, at, local, begins, ends = schema.types, None, 0, False, False
        for batch in batches:
            rows = []
            for file, piece, line in zip(*(batch.column(c).to_pylist() for c in ("file", "piece", "value")), strict=True):
                tokens = line.split()
                is_row = bool(tokens) and not tokens[0].startswith("#")
                if (file, piece) != at:
                    if at is not None:
                        rows.append((*at, local, None, begins, ends))
                    at, local, begins, ends = (file, piece), 0, is_row, is_row
                elif is_row and not ends:
                    local += 1
                ends = is_row
                if is_row:
                    rows.append((file, piece, local, [_number(t) for t in tokens], None, None))
            yield tell(rows)
        if at is not None:
            yield tell([(*at, local, None, begins, ends)])

    parsed = materialize(lines.mapInArrow(run, "file string, piece long, local long, row array<double>, begins boolean, ends boolean"))
    rows = parsed.where("row IS NOT NULL")
    least, most = rows.agg(F.min(F.size("row")), F.max(F.size("row"))).first()
    if least is None:
        raise ReadDatasetsError(1)
    if least != most:
        raise ReadDatasetsError(5)
    names = list(objectives or [f"f{i + 1}" for i in range(least)])
    if len(names) != least:
        raise ReadDatasetsError(2)
    in_order = Window.partitionBy("file").orderBy("piece")
    new = (F.col("begins") & ~F.coalesce(F.lag("ends").over(in_order), F.lit(False))).cast("long")
    pieces = parsed.where("row IS NULL").withColumn("new", new)
    before = F.coalesce(F.sum(F.col("local") + F.col("new")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("file", "piece", (before + F.col("new")).alias("before"))
    numbered_rows = rows.drop("begins", "ends").join(small(materialize(pieces)), ["file", "piece"])
    values = [F.col("row")[i].alias(n) for i, n in enumerate(names)]
    return numbered_rows.select(*values, (F.col("before") + F.col("local")).alias("set_id"), *(["file"] if per_file else []))


#: Fixed value: the padded number format.
PADDED = "%-22.15g"


def write_datasets(df: DataFrame, path: str, objectives: Names, sets: str = "set_id", keep: Column | str | None = None, number: str | None = None) -> None:
    """Text files of sets, in order of their labels; each set is headed by the names and followed by a blank line.

    ``keep``: a condition; only rows for which it is true are written, and no set without any.  ``number``: a printf format
    (:data:`PADDED`); by default a number is as short as it can be.  A set's rows stand in one file, by their objectives; they are sorted and written as a
    stream, and never held together.
    """
    df = df if keep is None else df.where(keep)
    rows = df.select(F.col(sets).alias("_set"), *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(objectives)))
    values = [f"_v{i}" for i in range(len(objectives))]
    ordered = rows.repartitionByRange("_set").sortWithinPartitions("_set", *values)
    ordered = ordered.select("_set", *(F.col(v).cast("string").alias(v) for v in values) if number is None else values)
    head = "# " + " ".join(objectives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last = False, None
        for batch in batches:
            labels, columns, lines = batch.column("_set").to_pylist(), [batch.column(v).to_pylist() for v in values], []
            for label, row in zip(labels, zip(*columns, strict=True), strict=True):
                if not begun or label != last:
                    lines += ["", head] if begun else [head]
                    begun, last = True, label
                lines.append(" ".join(row if number is None else (number % v for v in row)))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([""])], ["value"])

    ordered.mapInArrow(run, "value string").write.mode("overwrite").text(path)
