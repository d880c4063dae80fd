"""Forms for groups that no task should see whole, against the kernels and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfront.functions import kernels, sql
from skyfront.functions.numbering import numbered
from skyfront.operators import attainment, dominance, fronts, hypervolume, rank


def cloud(spark, d, n=900, seed=0):
    """Three groups (one of them null): a grid with many equal rows, a front of a sphere, and noise; an extra column with a name of our own."""
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 12, (n, d)).astype(float)
    ball = rng.normal(size=(n, d))
    ball = np.abs(ball / np.linalg.norm(ball, axis=1)[:, None])
    rows = [(g, i, -1, *map(float, v)) for g, x in (("a", grid), ("b", ball), (None, rng.normal(size=(n // 3, d)))) for i, v in enumerate(x)]
    rows = [(g, k, *rest) for k, (g, _, *rest) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "g string, id long, _cell long, " + ", ".join(f"_f{i} double" for i in range(d))).repartition(4)


@pytest.mark.parametrize("d", [3, 4])
@pytest.mark.parametrize("merge_rows", [10**6, 200, 15])
def test_nondominated_rows(spark, d, merge_rows):
    rows, df = cloud(spark, d)
    names = [f"_f{i}" for i in range(d)]
    want = set()
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want |= {r[1] for r, k in zip(own, kernels.nondominated(np.array([r[3:] for r in own])), strict=True) if k}
    got = fronts.nondominated_rows(df.drop("_cell"), ["g"], names, merge_rows)
    assert {r["id"] for r in got.collect()} == want
    every = {r[1] for r, k in zip(rows, kernels.nondominated(np.array([r[3:] for r in rows])), strict=True) if k}
    assert {r["id"] for r in fronts.nondominated_rows(df.drop("_cell"), [], names, merge_rows).collect()} == every
    assert fronts.nondominated_rows(df.drop("_cell").limit(0), [], names, merge_rows).count() == 0


def test_nondominated_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 700, 2000):
        x = rng.integers(0, 9, (n, 3)).astype(float)
        want = ~((x[:, None] <= x[None]).all(2) & (x[:, None] < x[None]).any(2)).any(0) if n else np.empty(0, bool)
        assert (kernels.nondominated(x) == want).all()


@pytest.mark.parametrize("d", [2, 3])
@pytest.mark.parametrize("task_rows", [10**6, 120])
def test_ranks_in_waves(spark, d, task_rows):
    rows, df = cloud(spark, d, 500, 1)
    names = [f"_f{i}" for i in range(d)]
    want = {}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want |= {r[1]: k for r, k in zip(own, kernels.pareto_rank(np.array([r[3:] for r in own])).tolist(), strict=True)}
    df = df.withColumnsRenamed({n: f"y{i}" for i, n in enumerate(names)})
    got = rank.pareto_rank(df, [f"y{i}" for i in range(d)], by="g", task_rows=task_rows)
    assert {r["id"]: r["rank"] for r in got.collect()} == want
    one = kernels.pareto_rank(np.array([r[3:] for r in rows])).tolist()
    got = rank.pareto_rank(df, [f"y{i}" for i in range(d)], base=1, task_rows=task_rows)
    assert {r["id"]: r["rank"] - 1 for r in got.collect()} == {r[1]: k for r, k in zip(rows, one, strict=True)}


def test_rank_after_is_the_longest_chain():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 20, (600, 3)).astype(float), axis=0)
    whole = kernels.pareto_rank(x)
    before = x[:, 0] < 8  # all that can dominate a later row is here or among the later rows
    assert (kernels.rank_after(x[~before], x[before], whole[before]) == whole[~before]).all()
    assert (kernels.rank_after(x, x[:0], whole[:0]) == whole).all()


@pytest.mark.parametrize("d", [2, 3])
def test_rank_after_fronts_of_earlier_rows(d):
    """Of earlier rows only the front by the later objectives and the rank is passed on, so that ranks below it may be missing."""
    rng = np.random.default_rng(8)
    x = np.unique(np.column_stack([rng.integers(0, 200, 500), *(rng.integers(0, 4, 500) for _ in range(d - 1))]).astype(float), axis=0)
    whole = kernels.pareto_rank(x)
    before = x[:, 0] < 120
    old, high = x[before], whole[before]
    old[:, 0] = -np.inf
    kept = kernels.skyline(np.column_stack([old[:, 1:], -high]))
    assert len(kept) < len(old) / 4
    assert (kernels.rank_after(x[~before], old[kept], high[kept]) == whole[~before]).all()


def test_a_wave_reads_two_waves(spark, monkeypatch):
    """What a wave gets does not grow with the waves before it: one group of long chains."""
    rng = np.random.default_rng(9)
    x = np.unique(np.column_stack([rng.integers(0, 900, 1500), rng.integers(0, 5, 1500), rng.integers(0, 3, 1500)]).astype(float), axis=0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    sizes, write = [], rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda d: (made := write(d), sizes.append(made.count()))[0])
    monkeypatch.setattr(rank, "MOST_TILES", 6)
    got = {r["id"]: r["rank"] for r in rank.pareto_rank(df, ["a", "b", "c"], task_rows=100).collect()}
    assert got == dict(enumerate(kernels.pareto_rank(x).tolist()))
    assert sum(sizes) < 5 * len(x)


def test_peel_of_many_fronts(spark, monkeypatch):
    """A chain of 300 points has 300 fronts; they aren't taken by a round each."""
    rounds, take = [], rank.skyline_points
    monkeypatch.setattr(rank, "skyline_points", lambda *a: (rounds.append(1), take(*a))[1])
    rows = [(g, i, float(i // 2), float(i // 3)) for g in ("a", None) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    got = {(r["g"], r["id"]): r["rank"] for r in rank.pareto_rank_peel(df, ["x", "y"], by="g", base=2).collect()}
    want = (kernels.pareto_rank(np.array([r[2:] for r in rows[:600]])) + 2).tolist()
    assert got == {(g, i): want[i] for g in ("a", None) for i in range(600)}
    assert len(rounds) <= rank.ROUNDS


@pytest.mark.parametrize("few", [0, 1])
def test_surfaces_are_spread_over_the_objective_of_fewer_values(spark, monkeypatch, few):
    """Many sets whose first points are early and whose values of one objective are all different: the grid has a column for each of three values, whichever objective has them."""
    rng = np.random.default_rng(6)
    many, three = rng.permutation(900).astype(float), rng.integers(0, 3, 900).astype(float)
    x = np.column_stack([three, many] if not few else [many, three])
    names, sets = ["a", "b"], 300
    df = spark.createDataFrame([(k % sets, *map(float, v)) for k, v in enumerate(x)], "s long, a double, b double")
    spread, make = [], attainment._cells
    monkeypatch.setattr(attainment, "_cells", lambda *a, **k: (made := make(*a, **k), spread.append(made[0].count()))[0])
    left, right = df.where("s % 2 = 0"), df.where("s % 2 = 1")
    got = {(r["a"], r["b"], round(r["diff"], 6)) for r in attainment.eafdiff(left, right, names, "s").collect()}
    assert spread[0] <= 6 * sets
    v = [np.unique(c) for c in x.T]
    hit = np.stack([(x[k::sets, 0, None, None] <= v[0][:, None]) & (x[k::sets, 1, None, None] <= v[1][None]) for k in range(sets)]).reshape(sets, -1, len(v[0]), len(v[1])).any(1)
    count = hit.sum(0)
    west, south = np.pad(count, ((1, 0), (0, 0)))[:-1], np.pad(count, ((0, 0), (1, 0)))[:, :-1]
    diff = hit[::2].sum(0) - hit[1::2].sum(0)
    assert got == {(v[0][i], v[1][j], float(diff[i, j])) for i, j in zip(*np.nonzero(count > np.maximum(west, south)), strict=True)}
    levels = {(r["a"], r["b"], round(r["percentile"] * sets / 100)) for r in attainment.eaf(df, names, "s").collect()}
    assert levels == {(v[0][i], v[1][j], t) for i, j in np.ndindex(count.shape) for t in range(max(west[i, j], south[i, j]) + 1, count[i, j] + 1)}
    every = attainment.eaf_attained(df, names, "s").collect()
    assert len(every) == len(levels) and all(list(r["attained"]) == hit[:, v[0].searchsorted(r["a"]), v[1].searchsorted(r["b"])].tolist() for r in every)


def test_surfaces_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, k, *map(float, rng.integers(0, 15, 3))) for g in ("a", None) for k in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, _set long, _f0 double, _f1 double, _f2 double").withColumn("_side", F.col("_set") % 2)
    names = ["_f0", "_f1", "_f2"]
    whole = sorted(map(str, attainment._eaf3(df, ["g"], "_set", names, "_side").collect()))
    for points in (30, 4):
        assert sorted(map(str, attainment._eaf3(df, ["g"], "_set", names, "_side", points).collect())) == whole
    one = sorted(map(str, attainment._eaf3(df, [], "_set", names).collect()))
    assert sorted(map(str, attainment._eaf3(df, [], "_set", names, None, 10).collect())) == one


def test_columns_are_numbered_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(g, k, float(x), float(y)) for g in ("a", None) for k in range(6) for x, y in rng.integers(0, 30, (8, 2))], "g string, s long, x double, y double")
    for groups in ((), ("g",)):
        whole = sorted(map(str, attainment.eaf(df, ["x", "y"], "s", groups=groups).collect()))
        monkeypatch.setattr(attainment, "COLUMNS_A_TASK", 5)
        assert sorted(map(str, attainment.eaf(df, ["x", "y"], "s", groups=groups).collect())) == whole
        monkeypatch.undo()


def brute_comparison(left, right, same):
    def wins(a, b):
        low = (a[:, None] <= b[None]).all(2)
        return low.any(0).all(), (low & (a[:, None] < b[None]).any(2)).any()

    out = []
    for s, a in left.items():
        for t, b in right.items():
            if same and s == t:
                continue
            uneven, (weak, strict), (back, back_strict) = len(a) != len(b), wins(np.array(a), np.array(b)), wins(np.array(b), np.array(a))
            out.append((s, t, (-1 if uneven or strict else 0) if weak else 1 if back and (uneven or back_strict) else 0))
    return sorted(out)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_sets_are_compared_by_fronts(spark, d):
    rng = np.random.default_rng(4)
    sets = {f"s{k}": [tuple(map(float, v)) for v in rng.integers(k // 2, k // 2 + 4, (rng.integers(1, 5), d))] for k in range(9)}
    sets |= {"same": list(sets["s3"]), "more": sets["s3"] + sets["s3"][:1]}
    names = [f"y{i}" for i in range(d)]
    frame = lambda m: spark.createDataFrame([(k, *v) for k, points in m.items() for v in points] + [(None, *[0.0] * d)], "g string, " + ", ".join(f"{n} double" for n in names))
    assert sorted(map(tuple, dominance.compare_sets(frame(sets), names, "g").collect())) == brute_comparison(sets, sets, True)
    few = dict([*sets.items()][:4])
    assert sorted(map(tuple, dominance.compare_sets(frame(sets), names, "g", other=frame(few)).collect())) == brute_comparison(sets, few, False)


@pytest.mark.parametrize("ignore", [True, False])
def test_contributions_of_three_objectives(ignore):
    """The sweep against leaving each row out, with ties, equal and dominated rows."""
    rng, ref = np.random.default_rng(7), np.array([9.0, 8.0, 10.0])
    for _ in range(300):
        x = rng.integers(0, rng.integers(3, 12), (rng.integers(1, 25), 3)).astype(float)
        inside = (x < ref).all(1)
        best = kernels.nondominated(x)
        got = kernels.contributions(x, ref, ignore)
        for i in range(len(x)):
            others = inside & (np.arange(len(x)) != i) & (best if ignore else True)
            alone = inside[i] and best[i] and not (x[others] == x[i]).all(1).any()
            assert got[i] == pytest.approx(kernels.exclusive(x[i], x[others], ref) if alone else 0.0)


def test_skyline_of_three_objectives():
    rng = np.random.default_rng(8)
    for t in range(300):
        x = rng.integers(0, rng.integers(2, 12), (rng.integers(1, 40) if t % 30 else 800, 3)).astype(float)
        x[rng.random(x.shape) < 0.05] = np.inf if t % 2 else -np.inf
        low, less = (x[:, None] <= x[None]).all(2), (x[:, None] < x[None]).any(2)
        assert kernels.skyline(x).tolist() == np.flatnonzero(~(low & (less | (np.arange(len(x))[:, None] < np.arange(len(x))[None]))).any(0)).tolist()


@pytest.mark.parametrize(("d", "sizes"), [(4, {}), (4, {"block": 7, "split": 3}), (5, {"block": 9, "split": 2}), (6, {"block": 50, "split": 4})])
def test_hypervolume_as_a_tree_of_tasks(spark, d, sizes):
    rng = np.random.default_rng(9)
    rows = [(g, *map(float, np.round(rng.random(d), 2))) for g in ("a", None) for _ in range(60)] + [("far", *[2.0] * d)]
    names = [f"y{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in names))
    got = {r["g"]: r["hypervolume"] for r in hypervolume.hypervolume_tree(df, names, 0.9, by="g", **sizes).collect()}
    for g in ("a", None, "far"):
        assert got[g] == pytest.approx(kernels.hypervolume(np.array([r[1:] for r in rows if r[0] == g]), np.full(d, 0.9)))
    assert hypervolume.hypervolume_parallel(df, names, 0.9) == pytest.approx(kernels.hypervolume(np.array([r[1:] for r in rows]), np.full(d, 0.9)))


@pytest.mark.parametrize("keep_weakly", [False, True])
def test_any_dominated_goes_on_where_the_strongest_row_tells_nothing(spark, keep_weakly):
    sets = {"no": [(0, 3), (3, 0)], "by the best": [(0, 0), (1, 1)], "by another": [(0, 0.5), (5, -1), (6, -0.5)], "equal": [(0, 1), (1, 0), (1, 0)], None: [(1, 1)], "equal best": [(0, 0), (0, 0)]}
    df = spark.createDataFrame([(g, float(x), float(y)) for g, points in sets.items() for x, y in points], "g string, x double, y double")
    want = dict.fromkeys(sets, False) | {"by the best": True, "by another": True, "equal": not keep_weakly, "equal best": not keep_weakly}
    assert {r["g"]: r["any_dominated"] for r in dominance.any_dominated(df, ["x", "y"], keep_weakly=keep_weakly, by="g").collect()} == want
    assert [r[0] for r in dominance.any_dominated(df, ["x", "y"], keep_weakly=keep_weakly).collect()] == [True]


def test_names_of_the_caller_stay(spark):
    """Columns called as ours are handed back unchanged; one called as the result is replaced."""
    rows = [(float(i % 4), float(-i), 7, 8, "n", 9, 1.5) for i in range(12)]
    df = spark.createDataFrame(rows, "y0 double, y1 double, _f0 long, _front long, nondominated string, rank long, order double")
    names, kept = ["y0", "y1"], ["y0", "y1", "_f0", "_front"]
    for out, new in ((dominance.is_nondominated(df, names), "nondominated"), (rank.pareto_rank(df, names), "rank"), (rank.ndsort(df, names), "order"), (rank.pareto_rank_peel(df, names), "rank"), (dominance.filter_dominated(df, names), "rank")):
        assert len(set(out.columns)) == len(out.columns) == len(df.columns) and new in out.columns
        assert {tuple(r) for r in out.select(*kept).collect()} <= {r[:4] for r in rows}
    three = dominance.filter_dominated(df.withColumn("y2", F.lit(1.0)), [*names, "y2"], keep_weakly=True)
    assert {tuple(r) for r in three.select(*kept).collect()} <= {r[:4] for r in rows} and three.count() == 4


def test_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", int(v), i) for i, v in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(7)
    got = {r["id"]: r["number"] for r in numbered(df, ["v", "id"]).collect()}
    assert got == {r[2]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    got = {r["id"]: r["number"] for r in numbered(df, [F.desc("v"), "id"], by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [*range(1, len(own) + 1)]
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_table_functions_keep_a_front(monkeypatch):
    """Fronts are formed while rows come in, null and NaN points are left out, and surfaces follow a moving staircase."""
    monkeypatch.setattr(sql, "BUFFER", 16)
    rng = np.random.default_rng(12)
    rows = [("a" if i % 3 else None, v.tolist()) for i, v in enumerate(rng.integers(0, 20, (300, 3)).astype(float))] + [("a", None), ("a", [1.0, None, 1.0]), ("b", [float("nan")] * 3)]
    front, volume = sql.SetFront(), sql.SetHypervolume()
    for row in rows:
        front.eval(row)
    for row in front.terminate():
        volume.eval(row, [21.0, 21.0, 21.0])
    want = {g: kernels.hypervolume(np.array([p for h, p in rows[:300] if h == g]), np.full(3, 21.0)) for g in ("a", None)}
    assert dict(volume.terminate()) == pytest.approx(want)
    eaf = sql.SetEaf()
    rows = sorted([("g", "s", [1.0, 5.0]), ("g", "t", [1.0, 4.0]), ("g", "s", [2.0, 3.0]), ("g", "t", [2.0, 4.0]), ("g", "t", None)], key=lambda r: r[2] or [0.0])
    assert [*(c for r in rows for c in eaf.eval(r)), *eaf.terminate()] == [("g", 1.0, 4.0, 1), ("g", 1.0, 5.0, 2), ("g", 2.0, 3.0, 1), ("g", 2.0, 4.0, 2)]
