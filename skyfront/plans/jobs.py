"""Batch jobs over sets: filtering, indicators against a reference, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.points import Direction, Names
from ..operators import distance, transform
from ..operators.dominance import filter_dominated
from ..operators.hypervolume import hv_contributions, hypervolume


def nondominated(df: DataFrame, objectives: Names, maximise: Direction = False, by: Names | str = (), lower: Sequence[float] | float | None = None, upper: Sequence[float] | float | None = None, log: bool = False, agree: str | None = None, to_range: tuple[float, float] | None = None, keep_weakly: bool = False, order: Names | str = ()) -> DataFrame:
    """Bounds, the nondominated filter, logarithms, one direction for all objectives ("min" or "max"), and rescaling, in this order."""
    out = filter_dominated(transform.bounds(df, objectives, lower, upper), objectives, maximise, keep_weakly, by, order)
    if log:
        out = transform.log10(out, objectives)
    if agree:
        out, maximise = transform.agree(out, objectives, maximise, agree == "max"), agree == "max"
    return transform.normalise(out, objectives, to_range, maximise=maximise) if to_range else out


def hv_job(df: DataFrame, objectives: Names, sets: Names | str = (), ref: Sequence[float] | float | None = None, maximise: Direction = False, union: bool = False, contributions: bool = False) -> DataFrame:
    """Volumes, or contributions, of each set or of the union of all."""
    by = () if union else sets
    if not contributions:
        return hypervolume(df, objectives, ref, maximise, by)
    from ..operators.hypervolume import default_reference

    return hv_contributions(df, objectives, default_reference(df, objectives, maximise) if ref is None else ref, maximise, by=by)


def indicators(df: DataFrame, ref: DataFrame, objectives: Names, sets: str, maximise: Direction = False, filter_ref: bool = False) -> DataFrame:
    """gd, igd, igd_plus, avg_hausdorff and epsilon_additive of each set in one table; ``filter_ref`` drops dominated reference points."""
    ref = filter_dominated(ref, objectives, maximise) if filter_ref else ref
    out = distance.indicators(df, ref, objectives, maximise, sets)
    return out.select(sets, "gd", "igd", "igd_plus", F.greatest("gd", "igd").alias("avg_hausdorff"), "epsilon_additive")
