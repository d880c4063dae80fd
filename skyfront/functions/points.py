"""How a DataFrame is read as points: objectives, directions, groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str]
Direction = bool | Sequence[bool]


def parse_maximise(maximise: Direction, d: int) -> list[bool]:
    """One flag per objective; a single flag holds for all."""
    flags = [bool(maximise)] * d if isinstance(maximise, (bool, int)) else [bool(m) for m in maximise]
    if len(flags) == 1:
        flags *= d
    if len(flags) != d:
        raise ValueError(f"maximise has {len(flags)} values for {d} objectives")
    return flags


def parse_point(point: float | Sequence[float], d: int, name: str = "ref") -> list[float]:
    """A point of d values; a single number is repeated."""
    values = [float(point)] if isinstance(point, (int, float)) else [float(p) for p in point]
    if len(values) == 1:
        values *= d
    if len(values) != d:
        raise ValueError(f"{name} has {len(values)} values for {d} objectives")
    return values


def parse_objectives(spec: str, columns: Names) -> tuple[list[str], list[bool]]:
    """Objectives and directions from a string of ``+`` (maximise), ``-`` (minimise) and ``i`` or ``0`` (ignore)."""
    if len(spec) != len(columns) or set(spec) - set("+-i0"):
        raise ValueError(f"objective directions {spec!r} do not fit {len(columns)} columns")
    kept = [(c, s == "+") for c, s in zip(columns, spec, strict=True) if s in "+-"]
    if not kept:
        raise ValueError("every objective is ignored")
    return [c for c, _ in kept], [m for _, m in kept]


@dataclass(frozen=True)
class Points:
    """Rows seen as points to be minimised: columns ``_f0``, ``_f1``, ... beside the group columns."""

    objectives: tuple[str, ...]
    maximise: tuple[bool, ...]
    by: tuple[str, ...]

    @classmethod
    def of(cls, objectives: Names, maximise: Direction = False, by: Names | str = ()) -> Points:
        objectives = [objectives] if isinstance(objectives, str) else list(objectives)
        if not 1 <= len(objectives) <= 255:
            raise ValueError("points have 1 to 255 objectives")
        return cls(tuple(objectives), tuple(parse_maximise(maximise, len(objectives))), (by,) if isinstance(by, str) else tuple(by))

    @property
    def d(self) -> int:
        return len(self.objectives)

    @property
    def names(self) -> list[str]:
        return [f"_f{i}" for i in range(self.d)]

    def cost(self, i: int) -> Column:
        c = F.col(self.objectives[i]).cast("double")
        return -c if self.maximise[i] else c

    def add(self, df: DataFrame) -> DataFrame:
        """The rows with the cost columns; rows with a null or NaN objective go."""
        df = df.withColumns({n: self.cost(i) for i, n in enumerate(self.names)})
        return df.where(reduce(Column.__and__, (F.col(n).isNotNull() & ~F.isnan(n) for n in self.names)))

    def wrap(self, df: DataFrame) -> DataFrame:
        """As :meth:`add`, with the row in a struct ``_whole`` beside group and cost columns, so that no name of the caller's clashes with ours."""
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_whole"), *self.by, *(self.cost(i).alias(n) for i, n in enumerate(self.names)))
        return rows.where(reduce(Column.__and__, (F.col(n).isNotNull() & ~F.isnan(n) for n in self.names)))

    def costs(self, df: DataFrame) -> DataFrame:
        """Group and cost columns alone."""
        return self.wrap(df).drop("_whole")

    def back(self, i: int, c: Column | None = None) -> Column:
        """A cost as a value of the objective."""
        c = F.col(f"_f{i}") if c is None else c
        return -c if self.maximise[i] else c

    def point(self, value: float | Sequence[float], name: str = "ref") -> list[float]:
        return [-v if m else v for v, m in zip(parse_point(value, self.d, name), self.maximise, strict=True)]


def unwrap(df: DataFrame, *new: str) -> list[Column]:
    """The columns of ``df`` out of ``_whole``, without those that ``new`` ones of the same name replace."""
    return [F.col(f"_whole.`{c}`") for c in df.columns if c not in new]


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def match(left: DataFrame, right: DataFrame, on: Names, how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls being equal; the other columns of ``right`` are added. Without columns: every row with every row."""
    own = {c: f"_of_right_{c}" for c in on}
    right = right.toDF(*(own.get(c, c) for c in right.columns))
    joined = left.join(right, all_of([F.col(c).eqNullSafe(F.col(r)) for c, r in own.items()]), how)
    return joined.drop(*own.values())


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has no more rows than that; ``df`` should be cheap to read twice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
