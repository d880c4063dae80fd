"""User functions over sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.points import Names


def apply_within_sets(df: DataFrame, sets: Names | str, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType | None = None) -> DataFrame:
    """``func`` of each set's rows; it returns one row, or as many as it got (any other number is an error).

    The schema defaults to that of the rows.
    """
    by = [sets] if isinstance(sets, str) else [*sets]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = func(pdf)
        if len(out) not in (1, len(pdf)):
            raise ValueError(f"the function returned {len(out)} rows for a set of {len(pdf)}")
        return out

    return df.groupBy(*by).applyInPandas(run, df.schema if schema is None else schema)
