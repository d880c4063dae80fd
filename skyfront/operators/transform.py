"""Projections and filters of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folders import materialize
from ..functions.numbering import numbered
from ..functions.points import Direction, Names, Points, all_of, match, parse_maximise, parse_point, small


def transform_maximise(df: DataFrame, objectives: Names, maximise: Direction) -> DataFrame:
    """Negates the maximised objectives."""
    flags = parse_maximise(maximise, len(objectives))
    return df.withColumns({c: -F.col(c).cast("double") for c, m in zip(objectives, flags, strict=True) if m})


def normalise(df: DataFrame, objectives: Names, to_range: tuple[float, float] = (0.0, 1.0), lower: float | Sequence[float] | None = None, upper: float | Sequence[float] | None = None, maximise: Direction = False, by: Names | str = ()) -> DataFrame:
    """Each objective rescaled affinely to a range, a maximised one reversed; bounds default to a group's own.

    Values beyond given bounds are not clamped; a range of 0 counts as 1.
    """
    p = Points.of(objectives, maximise, by)
    lo, hi = to_range
    lows = None if lower is None else parse_point(lower, p.d, "lower")
    highs = None if upper is None else parse_point(upper, p.d, "upper")
    for i, c in enumerate(p.objectives):
        df = df.withColumn(c, F.col(c).cast("double"))
    if lows is None or highs is None:
        bounds = df.groupBy(*p.by).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate(p.objectives) for f, n in ((F.min, "lo"), (F.max, "hi"))))
        joined = match(df, bounds if p.by else F.broadcast(bounds), p.by)
    else:
        joined = df
    out = {}
    for i, c in enumerate(p.objectives):
        lb = F.col(f"_lo{i}") if lows is None else F.lit(lows[i])
        ub = F.col(f"_hi{i}") if highs is None else F.lit(highs[i])
        diff = F.when(ub - lb == 0, F.lit(1.0)).otherwise(ub - lb)
        above = (ub - F.col(c)) if p.maximise[i] else (F.col(c) - lb)
        out[c] = F.lit(lo) + F.lit(hi - lo) * above / diff
    return joined.withColumns(out).select(*df.columns)


def bounds(df: DataFrame, objectives: Names, lower: float | Sequence[float] | None = None, upper: float | Sequence[float] | None = None) -> DataFrame:
    """The rows between the bounds."""
    keep = []
    for values, above in ((lower, True), (upper, False)):
        if values is not None:
            keep += [F.col(c) >= v if above else F.col(c) <= v for c, v in zip(objectives, parse_point(values, len(objectives)), strict=True)]
    return df.where(all_of(keep))


def log10(df: DataFrame, objectives: Names) -> DataFrame:
    return df.withColumns({c: F.log10(F.col(c).cast("double")) for c in objectives})


def agree(df: DataFrame, objectives: Names, maximise: Direction, to_maximise: bool = False) -> DataFrame:
    """All objectives turned the same way: minimised, or maximised."""
    flags = parse_maximise(maximise, len(objectives))
    return transform_maximise(df, objectives, [m != to_maximise for m in flags])


def rbind_datasets(x: DataFrame, y: DataFrame, sets: str = "set_id") -> DataFrame:
    """Union of two datasets; the sets of the second are numbered after those of the first. Both must start at 1."""
    first = x.agg(F.min(sets).alias("a"), F.max(sets).alias("n")).crossJoin(y.agg(F.min(sets).alias("b"))).first()
    for name in ("a", "b"):
        if first[name] is not None and first[name] != 1:
            raise ValueError("sets must be numbered from 1")
    return x.unionByName(y.withColumn(sets, F.col(sets) + (first["n"] or 0)))


def numbered_sets(df: DataFrame, sets: str, into: str = "set_id") -> DataFrame:
    """Labels as numbers from 1, in order."""
    labels = numbered(df.select(sets).distinct(), [sets], name=into)
    return df.join(small(materialize(labels)), sets)


def as_points(df: DataFrame, objectives: Names) -> DataFrame:
    """Checked and cast: at least one row and two numeric columns."""
    from pyspark.sql import types as T

    if len(objectives) < 2:
        raise ValueError("at least two columns are needed")
    for c in objectives:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"column {c} is not numeric")
    if not df.limit(1).count():
        raise ValueError("at least one row is needed")
    return df.withColumns({c: F.col(c).cast("double") for c in objectives})
