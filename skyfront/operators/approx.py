"""Approximate and sampled hypervolume."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.points import Direction, Names, Points
from .hypervolume import _all_groups, fronts_below, hypervolume

METHODS = ("Rphi-FWE+", "DZ2019-HW", "DZ2019-MC")
CHUNK = 16_384


def hv_approx(df: DataFrame, objectives: Names, ref: float | Sequence[float], maximise: Direction = False, nsamples: int = 262_144, seed: int | None = None, method: str = "Rphi-FWE+", by: Names | str = ()) -> DataFrame:
    """One row per group: the hypervolume estimated from rays in ``nsamples`` directions.

    (group, chunk of directions) pairs are tasks.  ``DZ2019-MC`` draws one stream for a seed: a task begins where its chunk does
    (:func:`kernels.skip_normal`), so the estimate is that of one stream however it is dealt out.
    """
    p = Points.of(objectives, maximise, by)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if not 0 < nsamples <= 1 << 31:
        raise ValueError("nsamples must be in 1 .. 2^31")
    if p.d == 1:
        return hypervolume(df, objectives, ref, maximise, by)
    point, d = p.point(ref), p.d
    front = fronts_below(df, p, point).select(*p.by, F.array(*(F.lit(r) - F.col(n) for n, r in zip(p.names, point, strict=True))).alias("z"))
    groups = front.groupBy(*p.by).agg(F.collect_list("z").alias("z")).where(F.size("z") > 0)
    chunk = 4 * CHUNK if method == "DZ2019-MC" else CHUNK
    starts = F.sequence(F.lit(0).cast("long"), F.lit(nsamples - 1).cast("long"), F.lit(chunk).cast("long"))
    tasks = groups.select(*p.by, "z", F.explode(starts).alias("start"))
    tasks = tasks.repartition(max(1, min(200, 2 * df.sparkSession.sparkContext.defaultParallelism)), *p.by, "start")
    keep = list(p.by)
    seed = int(np.random.default_rng().integers(1 << 31)) if seed is None else seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for z, start in zip(pdf["z"], pdf["start"], strict=True):
                n = min(chunk, nsamples - start)
                if method == "Rphi-FWE+":
                    w = kernels.rphi_directions(d, start, n)
                elif method == "DZ2019-HW":
                    w = kernels.lattice_directions(d, nsamples, start, n)
                else:
                    w = kernels.normal_directions(d, kernels.skip_normal(kernels.legacy_rng(seed), start, d), n)
                sums.append(kernels.mean_power(np.array([*z], float), w))
            yield pdf[keep].assign(_s=sums)

    schema = ", ".join([*(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in keep), "_s double"])
    total = tasks.mapInPandas(run, schema).groupBy(*p.by).agg((F.sum("_s") * F.lit(kernels.sphere_constant(d) / nsamples)).alias("hypervolume"))
    return _all_groups(df, total, p)


def rphi_2d(df: DataFrame, objectives: Names, ref: float | Sequence[float], maximise: Direction = False, nsamples: int = 4096) -> DataFrame:
    """The default method for two objectives in column expressions alone."""
    p = Points.of(objectives, maximise)
    if p.d != 2:
        raise ValueError("two objectives are needed")
    point = p.point(ref)
    z = fronts_below(df, p, point).agg(F.collect_list(F.array(*(F.lit(r) - F.col(n) for n, r in zip(p.names, point, strict=True)))).alias("z"))
    golden = (5**0.5 - 1) / 2
    u = F.pmod(F.lit(0.5) + (F.col("id") + 1) * F.lit(golden), F.lit(1.0))
    rays = df.sparkSession.range(nsamples).withColumn("a", u * F.lit(np.pi / 2)).crossJoin(F.broadcast(z))
    best = F.aggregate("z", F.lit(0.0), lambda m, q: F.greatest(m, F.least(q[0] / F.sin("a"), q[1] / F.cos("a"))))
    return rays.agg((F.avg(best * best) * F.lit(kernels.sphere_constant(2))).alias("hypervolume"))


def whv_hype(df: DataFrame, objectives: Names, ref: float | Sequence[float], ideal: float | Sequence[float], maximise: Direction = False, nsamples: int = 100_000, seed: int | None = None, dist: str = "uniform", mu: float | Sequence[float] | None = None, by: Names | str = ()) -> DataFrame:
    """One row per group: the volume weighted by a distribution of samples, two objectives.

    Samples are one stream for the seed, between ``ideal`` and ``ref``, the same for all groups; (group, chunk of samples) pairs are tasks, each of which
    begins the stream where its chunk does.  The estimate is the share of samples that a group's points weakly dominate, times the volume of the box.
    """
    p = Points.of(objectives, maximise, by)
    if p.d != 2:
        raise ValueError("two objectives are needed")
    if dist not in ("uniform", "exponential", "point"):
        raise ValueError(f"unknown distribution {dist!r}")
    high, low = np.array(p.point(ref)), np.array(p.point(ideal, "ideal"))
    seed = int(np.random.default_rng().integers(1 << 31)) if seed is None else seed
    rate = 0.2 if mu is None or dist != "exponential" else float(mu)
    centre = (np.array(p.point(mu, "mu")) - low) / (high - low) if dist == "point" else None
    front = fronts_below(df, p, p.point(ref)).groupBy(*p.by).agg(F.collect_list(F.array(*p.names)).alias("z")).where(F.size("z") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.lit(nsamples - 1).cast("long"), F.lit(4 * CHUNK).cast("long"))
    tasks = front.select(*p.by, "z", F.explode(starts).alias("start"))
    tasks = tasks.repartition(max(1, min(200, 2 * df.sparkSession.sparkContext.defaultParallelism)), *p.by, "start")
    keep = list(p.by)

    def samples(start: int, n: int) -> np.ndarray:
        rng = kernels.legacy_rng(seed)
        if dist == "point":
            return centre + 0.25 * kernels.skip_normal(rng, start, 2).standard_normal((n, 2))[:, :1]
        for at in range(0, start, CHUNK):
            rng.random((min(CHUNK, start - at), 2))
        out = rng.random((n, 2))
        if dist == "exponential":  # the first half of the stream along the one axis, the second along the other
            first = np.arange(start, start + n) < nsamples // 2
            out[first, 0], out[~first, 1] = -rate * np.log(out[first, 0]), -rate * np.log(out[~first, 1])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, np.ndarray] = {}
        for pdf in batches:
            out = []
            for z, start in zip(pdf["z"], pdf["start"], strict=True):
                if start not in drawn:
                    drawn = {start: samples(start, min(4 * CHUNK, nsamples - start))}
                s, x = drawn[start], (np.array([*z], float) - low) / (high - low)
                x = x[np.argsort(x[:, 0], kind="stable")]
                at = np.searchsorted(x[:, 0], s[:, 0], "right") - 1
                out.append(int(((at >= 0) & (np.minimum.accumulate(x[:, 1])[np.maximum(at, 0)] <= s[:, 1])).sum()))
            yield pdf[keep].assign(_hits=out)

    schema = ", ".join([*(f"`{c}` {front.schema[c].dataType.simpleString()}" for c in keep), "_hits long"])
    share = F.sum("_hits") / F.lit(nsamples) * F.lit(float(np.prod(high - low)))
    return _all_groups(df, tasks.mapInPandas(run, schema).groupBy(*keep).agg(share.alias("hypervolume")), p)
