"""Values known from the literature and from worked examples."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfront.functions import kernels
from skyfront.functions.points import parse_maximise, parse_objectives
from skyfront.operators import approx, attainment, distance, dominance, hypervolume, r2, rank, transform, weighted
from skyfront.operators.apply import apply_within_sets
from skyfront.plans import jobs
from skyfront.sources import generate, text_sets

HV4 = [(5.0, 5.0), (4.0, 6.0), (2.0, 7.0), (7.0, 4.0)]
XY = ["f1", "f2"]


def frame(spark, rows, extra="", d=2):
    return spark.createDataFrame([tuple(map(lambda v: float(v) if not isinstance(v, str) else v, r)) for r in rows], ", ".join(f"f{i + 1} double" for i in range(d)) + extra)


def one(df):
    return df.first()[0]


def test_directions():
    assert parse_maximise(True, 3) == [True] * 3
    assert parse_objectives("+i-", ["a", "b", "c"]) == (["a", "c"], [True, False])
    with pytest.raises(ValueError):
        parse_maximise([True, False], 3)


def test_nondominated(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0), (0.0, 1.0, 1), (1.0, 0.0, 2), (1.0, 0.0, 3)], "f1 double, f2 double, i int")
    mask = lambda **k: [r["nondominated"] for r in dominance.is_nondominated(rows, XY, order="i", **k).orderBy("i").collect()]
    assert mask() == [False, True, True, False]
    assert mask(keep_weakly=True) == [False, True, True, True]
    assert [r["i"] for r in dominance.filter_dominated(rows, XY, order="i").orderBy("i").collect()] == [1, 2]
    assert one(dominance.any_dominated(rows, XY)) is True
    assert one(dominance.any_dominated(rows.where("i < 3 AND i > 0"), XY)) is False
    assert one(dominance.any_dominated(rows.where("i > 0"), XY, keep_weakly=True)) is False
    assert dominance.filter_dominated(rows.where("false"), XY).count() == 0


def test_dimensions_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (200, 4)).astype(float)
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(x.tolist())], "a double, b double, c double, d double, g int")
    for names in (["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]):
        k = len(names)
        got = {(r["g"], *(r[n] for n in names)) for r in dominance.filter_dominated(df, names, by="g").collect()}
        want = set()
        for g in range(3):
            y = x[np.arange(200) % 3 == g, :k]
            want |= {(g, *r) for r in y[[not any((q <= p).all() and (q < p).any() for q in y) for p in y]].tolist()}
        assert got == want


def test_rank(spark):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3):
        x = rng.integers(0, 8, (80, d)).astype(float)
        names = [f"f{i + 1}" for i in range(d)]
        df = frame(spark, x.tolist(), d=d)
        left, want, level = {tuple(r) for r in x.tolist()}, {}, 0
        while left:
            front = {p for p in left if not any(all(a <= b for a, b in zip(q, p)) and q != p for q in left)}
            want |= dict.fromkeys(front, level)
            left, level = left - front, level + 1
        got = rank.pareto_rank(df, names).collect()
        assert len(got) == 80 and all(r["rank"] == want[tuple(r[n] for n in names)] for r in got)
        if d == 2:
            assert sorted(map(tuple, rank.pareto_rank_peel(df, names).collect())) == sorted(map(tuple, got))


def test_hypervolume(spark):
    df = frame(spark, HV4)
    assert one(hypervolume.hypervolume(df, XY, 10)) == 38
    assert one(hypervolume.hypervolume(df, XY, 0, maximise=True)) == 39
    assert one(hypervolume.hypervolume(df, ["f1"], 10)) == 8
    assert one(hypervolume.hypervolume(df.where("false"), XY, 10)) == 0
    assert hypervolume.Hypervolume(10)(df, XY).first()[0] == 38
    assert hypervolume.RelativeHypervolume(10, df, XY)(df.limit(4), XY).first()[0] == 0
    assert [r[2] for r in sorted(hypervolume.hv_contributions(df, XY, 10).collect())] == [6.0, 1.0, 2.0, 3.0]
    five = frame(spark, [(5, 1), (1, 5), (4, 2), (4, 4), (5, 1)])
    want = {(1.0, 5.0): 3.0, (4.0, 2.0): 3.0, (4.0, 4.0): 0.0, (5.0, 1.0): 0.0}
    assert {(a, b): c for a, b, c in hypervolume.hv_contributions(five, XY, 6).collect()} == want
    assert {(a, b): c for a, b, c in hypervolume.hv_contributions(five, XY, 6, ignore_dominated=False).collect()} == want | {(4.0, 2.0): 2.0}


def test_hypervolume_in_more_dimensions(spark):
    rng = np.random.default_rng(1)
    for d, n in ((3, 40), (4, 25), (5, 12)):
        x = rng.integers(0, 6, (n, d)).astype(float)
        grid = np.stack(np.meshgrid(*[np.arange(6)] * d, indexing="ij"), -1).reshape(-1, d)
        want = sum((x <= cell).all(1).any() for cell in grid)
        names = [f"f{i + 1}" for i in range(d)]
        df = frame(spark, x.tolist(), d=d)
        assert one(hypervolume.hypervolume(df, names, 6)) == want
        assert hypervolume.hypervolume_parallel(df, names, 6) == want
        if d == 3:
            assert one(hypervolume.hypervolume_slabs(df, names, 6)) == want
        own = kernels.contributions(x, np.full(d, 6.0), False)
        i = int(own.argmax())
        assert own[i] == want - sum((np.delete(x, i, 0) <= cell).all(1).any() for cell in grid)


def test_distances(spark):
    ref = frame(spark, [(10, 0), (6, 1), (2, 2), (1, 6), (0, 10)])
    sets = frame(spark, [(4, 2, "A"), (3, 3, "A"), (2, 4, "A"), (8, 2, "B"), (4, 4, "B"), (2, 8, "B")], ", s string")
    value = lambda f, **k: {r[0]: round(r[1], 6) for r in f(sets, ref, XY, by="s", **k).collect()}
    assert value(distance.igd) == {"A": 3.707092, "B": 2.591483}
    assert value(distance.igd_plus) == {"A": 1.482843, "B": 2.260113}
    assert all(v >= w - 1e-9 for v, w in zip(value(distance.avg_hausdorff_dist).values(), value(distance.gd).values()))
    other, a = frame(spark, [(10, 1), (6, 1), (2, 2), (1, 6), (1, 10)]), sets.where("s = 'A'")
    assert one(distance.epsilon_additive(a, other, XY)) == 1 and one(distance.epsilon_mult(a, other, XY)) == 2
    assert one(distance.epsilon_additive(a, other, XY, True)) == 6 and one(distance.epsilon_mult(a, other, XY, True)) == 2.5
    logs = lambda d: d.select(*(F.log(c).alias(c) for c in XY))
    assert math.isclose(one(distance.epsilon_mult(a, other, XY)), math.exp(one(distance.epsilon_additive(logs(a), logs(other), XY))))
    with pytest.raises(ValueError):
        distance.igd(a, ref, XY, p=0)


def test_r2(spark):
    assert one(r2.r2_exact(frame(spark, HV4), XY, 0)) == pytest.approx(2.5941919191919194)
    assert one(r2.r2_exact(frame(spark, [(0, 0)]), XY, 0)) == 0
    assert one(r2.r2_exact(frame(spark, [(2, 2)]), XY, 1)) == pytest.approx(0.75)
    assert one(r2.r2_exact(frame(spark, [(0, 1), (1, 0)]), XY, 0)) == pytest.approx(0.25)
    assert one(r2.r2_exact(frame(spark, [(1 - i / 5, i / 5) for i in range(6)]), XY, 0)) == pytest.approx(0.18333, abs=1e-4)


def test_normalise(spark):
    df = frame(spark, [(0, 8), (1, 3), (6, 4), (20, 2)])
    got = [tuple(r) for r in transform.normalise(df, XY).collect()]
    assert got == [(0.0, 1.0), (0.05, pytest.approx(1 / 6)), (0.3, pytest.approx(1 / 3)), (1.0, 0.0)]
    assert [r[0] for r in transform.normalise(df, XY, maximise=True).collect()] == [1.0, 0.95, 0.7, 0.0]
    assert [r[0] for r in transform.normalise(frame(spark, [(3, 1), (3, 2)]), XY).collect()] == [0.0, 0.0]


EAF_A = "3 2\n2 3\n\n2.5 1\n1 2\n\n1 2\n"
EAF_B = "4 2.5\n3 3\n2.5 3.5\n\n3 3\n2.5 3.5\n\n2 1\n"


def test_eaf_differences(spark):
    a, b = (text_sets.read_datasets(spark, io.StringIO(t)) for t in (EAF_A, EAF_B))
    got = sorted(map(tuple, attainment.eafdiff(a, b, XY, "set_id").collect()))
    assert got == sorted([(1, 2, 2), (2, 1, -1), (2.5, 1, 0), (2, 2, 1), (2, 3, 2), (3, 2, 2), (2.5, 3.5, 0), (3, 3, 0), (4, 2.5, 1)])
    inf = math.inf
    want = [(2, 1, 2.5, 2, -1), (1, 2, 2, inf, 2), (2.5, 1, inf, 2, 0), (2, 2, 3, 3, 1), (2, 3.5, 2.5, inf, 2), (2, 3, 3, 3.5, 2), (3, 2.5, 4, 3, 2), (3, 2, inf, 2.5, 2), (4, 2.5, inf, 3, 1)]
    rectangles = attainment.eafdiff_rectangles(a, b, XY, "set_id")
    assert sorted(map(tuple, rectangles.collect())) == sorted(want)
    assert attainment.choose_eafdiff(rectangles, left=False).first()["diff"] == 1
    polygons = attainment.eafdiff_polygons(a, b, XY, "set_id").collect()
    assert polygons and all(p["vertices"][0] == p["vertices"][-1] and p["colour"] != 0 for p in polygons)
    both = a.withColumn("d", F.lit("a")).unionByName(b.withColumn("d", F.lit("b")))
    pair, value = attainment.largest_eafdiff(both, XY, "d", "set_id", 5)
    assert value == 0 or pair == ("a", "b")


def test_eaf_levels(spark):
    a = text_sets.read_datasets(spark, io.StringIO(EAF_A))
    e = attainment.eaf(a, XY, "set_id")
    by = {}
    for x, y, q in e.collect():
        by.setdefault(round(q, 3), set()).add((x, y))
    assert by == {33.333: {(1.0, 2.0), (2.5, 1.0)}, 66.667: {(1.0, 2.0)}, 100.0: {(2.0, 3.0), (3.0, 2.0)}}
    assert {r["percentile"] for r in attainment.eaf(a, XY, "set_id", [0, 100]).collect()} == {0.0, 100.0}
    got = {(r[0], r[1], r[2]): list(r["attained"]) for r in attainment.eaf_attained(a, XY, "set_id").collect()}
    assert all(sum(v) >= round(k[2] * 3 / 100) for k, v in got.items())
    # three objectives with a constant third one have the two-objective surfaces
    flat = attainment.eaf(a.withColumn("z", F.lit(1.0)), [*XY, "z"], "set_id")
    assert sorted((r[0], r[1], r[3]) for r in flat.collect()) == sorted(map(tuple, e.collect()))


def test_eaf_in_three_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(*rng.integers(0, 5, 3).astype(float).tolist(), i % 4) for i in range(24)]
    df = spark.createDataFrame(rows, "f1 double, f2 double, f3 double, s long")
    x, s = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    grid = np.stack(np.meshgrid(*[np.arange(5.0)] * 3, indexing="ij"), -1).reshape(-1, 3)
    count = np.array([len({*s[(x <= g).all(1)]}) for g in grid])
    want = set()
    for t in range(1, 5):
        z = grid[count >= t]
        want |= {(*p, t * 25.0) for p in z[[not any((q <= p).all() and (q < p).any() for q in z) for p in z]].tolist()}
    assert {tuple(r) for r in attainment.eaf(df, ["f1", "f2", "f3"], "s").collect()} == want
    halves = attainment.eafdiff(df.where("s < 2"), df.where("s >= 2"), ["f1", "f2", "f3"], "s")
    for *p, diff in halves.collect():
        hit = {*s[(x <= np.array(p)).all(1)]}
        assert diff == len(hit & {0, 1}) - len(hit & {2, 3})


def test_weighted(spark):
    inf = math.inf
    r = spark.createDataFrame([(1.0, 3.0, 2.0, inf, 1.0), (2.0, 3.5, 2.5, inf, 2.0), (2.0, 3.0, 3.0, 3.5, 3.0)], "xmin double, ymin double, xmax double, ymax double, diff double")
    for point, w, total in (((2, 2), 4.0, 26.0), ((2, 1), 4.0, 30.0), ((1, 2), 7.0, 37.5)):
        df = frame(spark, [point])
        assert one(weighted.whv_rect(df, r, XY, 6)) == w
        assert one(weighted.total_whv_rect(df, r, XY, 6, ideal=1)) == total


def test_hype(spark):
    for point, kind, mu, want in (((2, 2), "uniform", None, 3.99807), ((3, 1), "uniform", None, 3.00555), ((2, 2), "exponential", 0.2, 1.14624), ((3, 1), "exponential", 0.2, 1.66815), ((2, 2), "point", [2.9, 0.9], 0.64485), ((3, 1), "point", [2.9, 0.9], 4.03632)):
        assert one(approx.whv_hype(frame(spark, [point]), XY, 4, 1, seed=42, dist=kind, mu=mu)) == pytest.approx(want, abs=1e-5), (point, kind)


def test_streams_are_the_same_however_dealt_out(spark, monkeypatch):
    df = frame(spark, [(2, 2, "a"), (3, 1, "a"), (3, 3, "b")], ", s string")
    runs = [lambda: approx.hv_approx(df, XY, 10, seed=7, nsamples=1000, method="DZ2019-MC", by="s")]
    runs += [lambda k=k, mu=mu: approx.whv_hype(df, XY, 4, 1, seed=7, nsamples=1001, dist=k, mu=mu, by="s") for k, mu in (("uniform", None), ("exponential", 0.3), ("point", [2.9, 0.9]))]
    table = lambda f: {r["s"]: r["hypervolume"] for r in f().collect()}
    whole = [table(f) for f in runs]
    monkeypatch.setattr(approx, "CHUNK", 33)
    for f, want in zip(runs, whole, strict=True):
        assert table(f) == pytest.approx(want, rel=1e-12)


def test_approximations(spark):
    df = frame(spark, HV4)
    for method, want in (("Rphi-FWE+", 37.99998), ("DZ2019-HW", 37.99996), ("DZ2019-MC", 38.00081)):
        assert one(approx.hv_approx(df, XY, 10, seed=42, method=method)) == pytest.approx(want, abs=1e-5), method
    assert one(approx.rphi_2d(df, XY, 10)) == pytest.approx(38, abs=0.05)
    with pytest.raises(ValueError):
        approx.hv_approx(df, XY, 10, method="none")
    x = generate.generate_ndset(spark, 12, 5, "sphere", seed=4)
    names = x.columns
    exact = one(hypervolume.hypervolume(x, names, 1.1))
    for method in approx.METHODS:
        assert one(approx.hv_approx(x, names, 1.1, seed=1, method=method)) == pytest.approx(exact, rel=0.01), method


def test_vorob(spark):
    n = 15
    df = spark.createDataFrame([(i / n, j / n, i * (n + 1) + j) for i in range(n + 1) for j in range(n + 1)], "f1 double, f2 double, s long")
    v = attainment.vorob_t(df, XY, "s", 1)
    assert one(hypervolume.hypervolume(v.expectation, XY, 1)) == pytest.approx(0.25, abs=0.02)
    assert attainment.vorob_dev(df, XY, "s", 1) == pytest.approx(0.218, abs=0.02)


def test_sets_are_compared(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.0, 2), (2.0, 0.5, 3), (1.0, 1.0, 4)], "f1 double, f2 double, s int")
    got = {(a, b): c for a, b, c in dominance.compare_sets(df, XY, "s").collect()}
    assert got[1, 2] == -1 and got[2, 1] == 1 and got[1, 3] == 0 and got[1, 4] == 0


@pytest.mark.parametrize("method", sorted(generate.SHAPES))
def test_generators(method):
    x = generate.nondominated_array(30, 3, method, seed=7)
    assert len(kernels.skyline(x)) == 30
    assert len(kernels.skyline(generate.nondominated_array(10, 2, method, 7, True).astype(float))) == 10


def test_text_sets(spark, tmp_path):
    import lzma

    (tmp_path / "a.dat").write_text("# head\n1 2\n3 4\n\n5 6\n# next\n7 8x\n")
    df = text_sets.read_datasets(spark, str(tmp_path / "a.dat"))
    assert sorted(map(tuple, df.collect())) == [(1.0, 2.0, 1), (3.0, 4.0, 1), (5.0, 6.0, 2), (7.0, 8.0, 3)]
    (tmp_path / "b.dat.xz").write_bytes(lzma.compress(b"1 2\n\n3 4\n"))
    assert text_sets.read_datasets(spark, str(tmp_path / "b.dat.xz")).count() == 2
    text_sets.write_datasets(df, str(tmp_path / "out"), XY)
    again = text_sets.read_datasets(spark, str(tmp_path / "out" / "*.txt"))
    assert sorted(map(tuple, again.select(*XY).collect())) == sorted(map(tuple, df.select(*XY).collect()))
    for text, code in (("", 1), ("1 2\n3\n", 5), ("1 x\n", 4)):
        with pytest.raises(text_sets.ReadDatasetsError) as e:
            text_sets.parse_sets(text)
        assert e.value.error == code
    both = transform.rbind_datasets(df, df)
    assert both.agg(F.max("set_id")).first()[0] == 6


def test_apply_and_jobs(spark):
    df = frame(spark, [(1, 4, "a"), (2, 3, "a"), (5, 5, "b")], ", s string")
    top = apply_within_sets(df, "s", lambda p: p.nlargest(1, "f1"))
    assert sorted(r["f1"] for r in top.collect()) == [2.0, 5.0]
    assert jobs.indicators(df, df, XY, "s").count() == 2
    assert jobs.nondominated(df, XY, to_range=(0.0, 1.0), upper=4.5).count() == 2
    assert rank.ndsort(df, XY).count() == 3


def test_streaming_archive(spark, tmp_path):
    from skyfront.streaming.archive import skyline_archive

    for k, rows in enumerate(([(1.0, 5.0), (3.0, 3.0)], [(2.0, 2.0), (9.0, 9.0)])):
        spark.createDataFrame(rows, "f1 double, f2 double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("f1 double, f2 double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = skyline_archive(stream, str(tmp_path / "archive"), str(tmp_path / "check"), XY)
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "archive/batch=1"))
    assert sorted(map(tuple, last.select(*XY).collect())) == [(1.0, 5.0), (2.0, 2.0)]


def test_sql_aggregates(spark):
    from skyfront.functions.sql import register

    register(spark)
    frame(spark, HV4).createOrReplaceTempView("points4")
    assert spark.sql("SELECT hv(array(f1, f2), array(10D, 10D)) AS v FROM points4").first()[0] == 38
    assert spark.sql("SELECT front_size(array(f1, f2)) AS n FROM points4").first()[0] == 4


@pytest.mark.parametrize("d", [1, 2, 4])
def test_boxes_find_the_least(d):
    rng = np.random.default_rng(d)
    x, q = np.round(rng.uniform(1, 9, (700, d)), 1), np.round(rng.uniform(1, 9, (300, d)), 1)
    x[:200] = x[0]
    for kind in ("distance", "plus", "additive", "ratio"):
        up = [i % 2 == 1 for i in range(d)]
        a, b = (v * np.where(up, -1, 1) if kind == "ratio" else v for v in (x, q))
        assert (kernels.Boxes(a, 16).least(kind, b, up) == kernels.measure(kind, a, b, up).min(1)).all()


def test_large_reference_sets_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(s, *map(float, v)) for s in (1, None, 3) for v in np.round(rng.uniform(1, 9, (40, 3)), 1)]
    df = spark.createDataFrame([*rows, (3, None, 1.0, 1.0)], "s long, x double, y double, z double")
    ref = spark.createDataFrame([tuple(map(float, v)) for v in np.round(rng.uniform(1, 9, (30, 3)), 1)], "x double, y double, z double")
    names = ["gd", "igd", "igd_plus", "epsilon_additive", "epsilon_mult"]
    table = lambda: {r["s"]: [r[n] for n in names] for r in distance.indicators(df, ref, ["x", "y", "z"], [False, True, False], "s", names).collect()}
    trees = table()
    one = lambda: [distance.indicators(df, ref, ["x", "y", "z"], names=names).first()[n] for n in names]
    whole = one()
    for limits in ({"BROADCAST_VALUES": 30}, {"GROUP_ROWS": 7}, {"BROADCAST_VALUES": 30, "GROUP_ROWS": 7}):
        for name, value in limits.items():
            monkeypatch.setattr(distance, name, value)
        dealt, at_once = table(), one()
        monkeypatch.undo()
        assert set(trees) == set(dealt) == {1, None, 3}
        assert all(np.allclose(trees[s], dealt[s], rtol=1e-12) for s in trees) and np.allclose(whole, at_once, rtol=1e-12)
    assert distance.indicators(df.limit(0), ref, ["x", "y", "z"], by="s", names=names).count() == 0
    assert distance.indicators(df, ref.limit(0), ["x", "y", "z"], by="s", names=names).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_files_are_read_in_pieces(spark, tmp_path, seed):
    """Sets keep their numbers wherever Spark cuts a file, also inside a set, a comment or a run of blank lines."""
    rng = np.random.default_rng(seed)
    for k in range(2):
        lines = []
        for _ in range(rng.integers(5, 30)):
            lines += [["", "# a comment", " "][rng.integers(3)] for _ in range(rng.integers(0, 3))]
            lines += [f"{rng.random():.3f} {i}" for i in range(rng.integers(0, 6))]
        (tmp_path / f"{k}.txt").write_text("\n".join([*lines, "1 2"]) + "\n" * int(rng.integers(0, 2)))
    order = lambda df: sorted(map(tuple, df.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = text_sets.read_split_sets(spark, str(tmp_path), ["a", "b"])
        assert order(got) == order(text_sets.read_datasets(spark, str(tmp_path), ["a", "b"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_padded_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, 1e300), (1, -2.0, 1 / 3), (2, 5.0, 6.0)], "set_id long, a double, b double")
    text_sets.write_datasets(df, str(tmp_path / "out"), ["a", "b"], number=text_sets.PADDED)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n") if x and x[0] != "#"]
    assert sorted(lines) == sorted(f"{a:<22.15g} {b:<22.15g}" for _, a, b in df.collect())
    assert sorted(map(tuple, text_sets.read_split_sets(spark, str(tmp_path / "out"), ["a", "b"]).select("a", "b").collect())) == [(-2.0, 0.333333333333333), (0.1, 1e300), (5.0, 6.0)]
    (tmp_path / "ragged").write_text("1 2\n3\n")
    (tmp_path / "none").write_text("# nothing\n\n")
    for name, code in (("ragged", 5), ("none", 1)):
        with pytest.raises(text_sets.ReadDatasetsError) as e:
            text_sets.read_split_sets(spark, str(tmp_path / name))
        assert e.value.error == code
