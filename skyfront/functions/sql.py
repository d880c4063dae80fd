"""Indicators for SQL text: grouped aggregates over array columns, and table functions whose state is a front or a staircase.

``hv`` and ``front_size`` take a group's points in a task.  Where groups are large, two phases do without: ``set_front`` runs where the rows are and hands on
each task's front points, ``set_hv`` measures what is left of a group::

    SELECT * FROM set_hv(TABLE(SELECT * FROM set_front(TABLE(SELECT label, point FROM t))) PARTITION BY (label), array(1500D, -10D))

``set_eaf`` makes the attainment surfaces of two objectives from rows in the order of the first::

    SELECT * FROM set_eaf(TABLE(SELECT label, s, point FROM t) PARTITION BY (label) ORDER BY (point[0]))
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from . import kernels

#: Points of a group that are taken in before its front is formed anew.
BUFFER = 2048


class SetFront:
    """(label, point) of a task's nondominated points of each label; ``point``: an array of costs, rows of null or NaN ones being left out."""

    def __init__(self) -> None:
        self.points: dict[str | None, list[list[float]]] = {}
        self.limit: dict[str | None, int] = {}

    def eval(self, row: Row) -> None:
        label, point = row[0], row[1]
        if point is None or any(v is None or v != v for v in point):
            return
        own = self.points.setdefault(label, [])
        own.append([float(v) for v in point])
        if len(own) >= self.limit.get(label, BUFFER):
            self.points[label] = own = self._front(own)
            self.limit[label] = 2 * len(own) + BUFFER

    def _front(self, own: list[list[float]]) -> list[list[float]]:
        x = np.array(own)
        return x[kernels.skyline(x)].tolist()

    def terminate(self) -> Iterator[tuple]:
        for label, own in self.points.items():
            for point in self._front(own):
                yield label, point


class SetHypervolume(SetFront):
    """(label, hypervolume) of a partition's points up to ``ref``."""

    def __init__(self) -> None:
        super().__init__()
        self.ref: np.ndarray | None = None

    def eval(self, row: Row, ref: list[float]) -> None:
        self.ref = np.array(ref, float)
        super().eval(row)

    def terminate(self) -> Iterator[tuple]:
        for label, own in self.points.items():
            yield label, kernels.hypervolume(np.array(own), self.ref)


class SetEaf:
    """(label, x, y, level) of the corners of all surfaces of a partition, whose rows (label, s, point) come in the order of the first objective.

    The state is the least second objective of each set so far; a level has a corner where its value falls.
    """

    def __init__(self) -> None:
        self.least: dict[str | None, float] = {}
        self.before: list[float] = []
        self.label, self.x, self.begun = None, 0.0, False

    def _corners(self) -> Iterator[tuple]:
        now: list[float] = []
        for y in self.least.values():
            insort(now, y)
        for t, y in enumerate(now):
            if t >= len(self.before) or y < self.before[t]:
                yield self.label, self.x, y, t + 1
        self.before = now

    def eval(self, row: Row) -> Iterator[tuple]:
        label, s, point = row[0], row[1], row[2]
        if point is None or any(v is None or v != v for v in point):
            return
        x, y = map(float, point)
        if self.begun and x != self.x:
            yield from self._corners()
        self.label, self.x, self.begun = label, x, True
        self.least[s] = min(y, self.least.get(s, y))

    def terminate(self) -> Iterator[tuple]:
        if self.begun:
            yield from self._corners()


def register(spark: SparkSession) -> None:
    """Registers the aggregates ``hv(point, ref)`` and ``front_size(point)`` and the table functions ``set_front``, ``set_hv`` and ``set_eaf``."""

    @F.pandas_udf("double")
    def hv(points: pd.Series, ref: pd.Series) -> float:
        return kernels.hypervolume(np.array([*points], float), np.array(ref.iloc[0], float)) if len(points) else 0.0

    @F.pandas_udf("long")
    def front_size(points: pd.Series) -> int:
        return len(kernels.skyline(np.array([*points], float))) if len(points) else 0

    spark.udf.register("hv", hv)
    spark.udf.register("front_size", front_size)
    for name, made, schema in (("set_front", SetFront, "label string, point array<double>"), ("set_hv", SetHypervolume, "label string, hypervolume double"), ("set_eaf", SetEaf, "label string, x double, y double, level int")):
        spark.udtf.register(name, F.udtf(made, returnType=schema))
