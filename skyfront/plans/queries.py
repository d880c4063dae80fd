"""One query per operator over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.folders import shared_folder
from ..operators import approx, attainment, distance, dominance, hypervolume, r2, rank, transform, weighted
from ..operators.apply import apply_within_sets
from ..functions.points import parse_objectives
from ..sources import generate, text_sets
from ..sources.catalog import Catalog
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PS = ["p_retailprice", "p_size"]
UP = [False, True]  # a low price and a large size are wanted
REF = [1500.0, 10.0]  # of these
COSTS = "p_retailprice AS f1, -CAST(p_size AS DOUBLE) AS f2"
R1, R2 = 1500.0, -10.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", *PS)


def r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def beats(d: int, weak: bool = False, tie: str = "") -> str:
    """SQL: q dominates p (or equals it and comes first by ``tie``); ``weak``: dominates or equals."""
    low = " AND ".join(f"q.f{i} <= p.f{i}" for i in range(1, d + 1))
    if weak:
        return f"({low})"
    less = " OR ".join([f"q.f{i} < p.f{i}" for i in range(1, d + 1)] + ([f"q.{tie} < p.{tie}"] if tie else []))
    return f"({low} AND ({less}))"


def staircase(source: str, keys: str, r1: str = str(R1), r2: str = str(R2)) -> str:
    """SQL: hypervolume of the points f1, f2 of ``source`` by ``keys``."""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {keys + ', ' if keys else ''}sum(v) AS hypervolume FROM (SELECT *, ({r1} - f1) * greatest(coalesce(min(f2) OVER ({over}ORDER BY f1, f2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {r2}) - f2, 0) AS v FROM {source} WHERE f1 < {r1} AND f2 < {r2}){group}"


# --- dominance


@query(f"WITH p AS (SELECT p_partkey, p_brand, p_retailprice, p_size, {COSTS} FROM part) SELECT p_partkey, p_brand, p_retailprice, p_size FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_brand = p.p_brand AND {beats(2, tie='p_partkey')})")
def skyline_2d_within_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.filter_dominated_within_sets(part(spark, sf_dir), PS, "p_brand", UP, order="p_partkey").drop("p_type")


@query(f"WITH p AS (SELECT p_partkey, p_type, {COSTS} FROM part) SELECT p_partkey, p_type, NOT EXISTS (SELECT 1 FROM p q WHERE q.p_type = p.p_type AND {beats(2)}) AS nondominated FROM p")
def skyline_2d_keep_weakly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.is_nondominated_within_sets(part(spark, sf_dir), PS, "p_type", UP, keep_weakly=True).select("p_partkey", "p_type", "nondominated")


@query(f"WITH p AS (SELECT s_suppkey, -s_acctbal AS f1, CAST(s_nationkey AS DOUBLE) AS f2 FROM supplier) SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM p q WHERE {beats(2, tie='s_suppkey')}) AS nondominated FROM p")
def is_nondominated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.is_nondominated(read(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"], [True, False], order="s_suppkey").select("s_suppkey", "nondominated")


@query("SELECT o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderpriority")
def skyline_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return dominance.filter_dominated(orders, ["o_totalprice"], by="o_orderpriority", order="o_orderkey").select("o_orderpriority", "o_totalprice")


ORDER_COSTS = "l_orderkey, min(l_extendedprice) AS f1, -max(l_quantity) AS f2, -max(l_discount) AS f3, min(l_tax) AS f4 FROM lineitem GROUP BY l_orderkey"


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.min("l_tax").alias("tax"))


@query(f"WITH p AS (SELECT {ORDER_COSTS}) SELECT l_orderkey, f1 AS price, -f2 AS quantity, -f3 AS discount FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE {beats(3, tie='l_orderkey')})")
def skyline_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.filter_dominated(order_points(spark, sf_dir).drop("tax"), ["price", "quantity", "discount"], [False, True, True], order="l_orderkey")


@query(f"WITH p AS (SELECT {ORDER_COSTS}) SELECT l_orderkey, f1 AS price, -f2 AS quantity, -f3 AS discount, f4 AS tax FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE {beats(4)})")
def skyline_4d_mixed_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.filter_dominated(order_points(spark, sf_dir), ["price", "quantity", "discount", "tax"], [False, True, True, False], keep_weakly=True)


@query("WITH p AS (SELECT l_orderkey, -min(l_extendedprice) AS f1, max(l_extendedprice) AS f2, -max(l_discount) AS f3 FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE " + beats(3) + ")")
def skyline_3d_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives that pull against each other (no order of one line beats another by its lowest and highest price), so that the front is long; merged by cells."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"), F.max("l_discount").alias("discount"))
    return dominance.filter_dominated(lines, ["lowest", "highest", "discount"], [True, False, True], keep_weakly=True, merge_rows=500).select("l_orderkey")


@query(f"WITH p AS (SELECT p_partkey, p_brand, {COSTS} FROM part) SELECT p_brand, bool_or(EXISTS (SELECT 1 FROM p q WHERE q.p_brand = p.p_brand AND {beats(2, tie='p_partkey')})) AS any_dominated FROM p GROUP BY p_brand")
def any_dominated_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.any_dominated(part(spark, sf_dir), PS, UP, by="p_brand")


def comparison(source: str, d: int = 2) -> str:
    """SQL: ``g``, for each pair of sets whether the left one covers the right one and dominates a point of it, and ``n``, the sets' sizes."""
    weak = " AND ".join(f"a.f{i} <= p.f{i}" for i in range(1, d + 1))
    less = " OR ".join(f"a.f{i} < p.f{i}" for i in range(1, d + 1))
    return f"""p AS ({source}), n AS (SELECT s, count(*) AS n FROM p GROUP BY s),
w AS (SELECT a.s AS ls, p.s AS rs, p.id, bool_or({weak}) AS weak, bool_or({weak} AND ({less})) AS strict FROM p JOIN p a ON a.s <> p.s GROUP BY a.s, p.s, p.id),
g AS (SELECT ls, rs, bool_and(weak) AS weak, bool_or(strict) AS strict FROM w GROUP BY ls, rs)"""


BETTER = "SELECT a.ls AS left_set, a.rs AS right_set, CASE WHEN a.weak THEN CASE WHEN x.n <> y.n OR a.strict THEN -1 ELSE 0 END WHEN b.weak AND (x.n <> y.n OR b.strict) THEN 1 ELSE 0 END AS better FROM g a JOIN g b ON a.ls = b.rs AND a.rs = b.ls JOIN n x ON x.s = a.ls JOIN n y ON y.s = a.rs"
PAIRS = comparison(f"SELECT p_brand AS s, p_partkey AS id, {COSTS} FROM part")


@query(f"WITH {PAIRS} {BETTER}")
def compare_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.compare_sets(part(spark, sf_dir), PS, "p_brand", UP)


@query(f"WITH {comparison('SELECT s_nationkey AS s, s_suppkey AS id, -s_acctbal AS f1, CAST(s_suppkey % 7 AS DOUBLE) AS f2, CAST(s_suppkey % 3 AS DOUBLE) AS f3 FROM supplier', 3)} {BETTER}")
def compare_sets_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = supplier(spark, sf_dir).withColumn("fourth", F.col("s_suppkey") % 3)
    return dominance.compare_sets(df, ["s_acctbal", "third", "fourth"], "s_nationkey", [True, False, False])


@query(f"""WITH b AS (SELECT p_type AS d, p_brand AS s, p_partkey AS id, {COSTS} FROM part), n AS (SELECT d, s, count(*) AS n FROM b GROUP BY d, s),
w AS (SELECT a.d AS ld, a.s AS ls, p.d AS rd, p.s AS rs, p.id, bool_or(a.f1 <= p.f1 AND a.f2 <= p.f2) AS weak, bool_or(a.f1 <= p.f1 AND a.f2 <= p.f2 AND (a.f1 < p.f1 OR a.f2 < p.f2)) AS strict FROM b p JOIN b a ON a.d <> p.d GROUP BY ALL),
g AS (SELECT ld, ls, rd, rs, bool_and(weak) AS weak, bool_or(strict) AS strict FROM w GROUP BY ld, ls, rd, rs),
c AS (SELECT a.ld, a.rd, CASE WHEN a.weak THEN CASE WHEN x.n <> y.n OR a.strict THEN -1 ELSE 0 END WHEN b.weak AND (x.n <> y.n OR b.strict) THEN 1 ELSE 0 END AS better
  FROM g a JOIN g b ON a.ld = b.rd AND a.ls = b.rs AND a.rd = b.ld AND a.rs = b.ls JOIN n x ON x.d = a.ld AND x.s = a.ls JOIN n y ON y.d = a.rd AND y.s = a.rs)
SELECT ld AS left_dataset, rd AS right_dataset, count(*) FILTER (better = -1) AS left_better, count(*) FILTER (better = 1) AS right_better, count(*) AS pairs FROM c WHERE ld < rd GROUP BY ld, rd""")
def set_better_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.set_better_counts(part(spark, sf_dir), PS, "p_brand", "p_type", UP)


SQL["set_better_shares"] = f"SELECT left_dataset, right_dataset, round(100.0 * left_better / pairs, 6) AS left_percent, round(100.0 * right_better / pairs, 6) AS right_percent, round(100.0 * (pairs - left_better - right_better) / pairs, 6) AS neither_percent FROM ({SQL['set_better_counts']})"


@query()
def set_better_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dominance.set_better_shares(part(spark, sf_dir), PS, "p_brand", "p_type", UP)
    return c.select("left_dataset", "right_dataset", r("left_percent"), r("right_percent"), r("neither_percent"))


# --- ranks


@query("SELECT s_suppkey, s_nationkey, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) - 1 AS INTEGER) AS rank FROM supplier")
def pareto_rank_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pareto_rank(read(spark, sf_dir, "supplier"), ["s_acctbal"], True, by="s_nationkey").select("s_suppkey", "s_nationkey", "rank")


SUPPLIER = "SELECT s_suppkey AS id, -s_acctbal AS f1, CAST(s_nationkey AS DOUBLE) AS f2, CAST(s_suppkey % 7 AS DOUBLE) AS f3 FROM supplier"


def ranks(d: int, source: str = SUPPLIER) -> str:
    return f"p AS ({source}), d AS (SELECT q.id AS better, p.id AS worse FROM p JOIN p q ON {beats(d)}), r(id, lvl) AS (SELECT id, 0 FROM p UNION SELECT d.worse, r.lvl + 1 FROM r JOIN d ON d.better = r.id), k AS (SELECT id, CAST(max(lvl) AS INTEGER) AS rank FROM r GROUP BY id)"


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 7).alias("third"))


@query(f"WITH RECURSIVE {ranks(2)} SELECT id AS s_suppkey, rank FROM k")
def pareto_rank_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pareto_rank(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey"], [True, False]).select("s_suppkey", "rank")


@query(f"WITH RECURSIVE {ranks(3)} SELECT id AS s_suppkey, rank FROM k")
def pareto_rank_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pareto_rank(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey", "third"], [True, False, False]).select("s_suppkey", "rank")


@query(f"WITH RECURSIVE {ranks(2)} SELECT id AS s_suppkey, rank FROM k")
def pareto_rank_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.pareto_rank_peel(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey"], [True, False]).select("s_suppkey", "rank")


CUSTOMER = "SELECT c_custkey AS id, -c_acctbal AS f1, CAST(c_nationkey AS DOUBLE) AS f2, CAST(c_custkey % 11 AS DOUBLE) AS f3 FROM customer"


@query(f"WITH RECURSIVE {ranks(3, CUSTOMER)} SELECT id AS c_custkey, rank FROM k")
def pareto_rank_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group in many tasks, whatever its size."""
    customers = read(spark, sf_dir, "customer").withColumn("third", F.col("c_custkey") % 11)
    return rank.pareto_rank(customers, ["c_acctbal", "c_nationkey", "third"], [True, False, False], task_rows=500).select("c_custkey", "rank")


@query(f"""WITH RECURSIVE {ranks(2)}, b AS (SELECT p.id, rank, f1, f2 FROM p JOIN k USING (id)),
m AS (SELECT rank, min(f1) AS l1, max(f1) AS u1, min(f2) AS l2, max(f2) AS u2 FROM b GROUP BY rank),
s AS (SELECT id, rank, 0.9 * (f1 - l1) / CASE WHEN u1 = l1 THEN 1 ELSE u1 - l1 END AS x, 0.9 * (f2 - l2) / CASE WHEN u2 = l2 THEN 1 ELSE u2 - l2 END AS y FROM b JOIN m USING (rank)),
g AS (SELECT rank, x, y, count(*) AS n FROM s GROUP BY rank, x, y),
c AS (SELECT rank, x, y, CASE WHEN n > 1 THEN 0 ELSE (coalesce(lead(x) OVER w, 1) - x) * (coalesce(lag(y) OVER w, 1) - y) END AS c FROM g WINDOW w AS (PARTITION BY rank ORDER BY x))
SELECT id AS s_suppkey, rank, round(rank + 1 - c, 6) AS "order" FROM s JOIN c USING (rank, x, y)""")
def ndsort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ndsort(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey"], [True, False]).select("s_suppkey", "rank", r("order"))


# --- transforms


@query("SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) - min(p_retailprice) FROM part)), 9) AS p_retailprice, round((CAST(p_size AS DOUBLE) - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) - min(p_size) FROM part)), 9) AS p_size FROM part")
def normalise_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.normalise(part(spark, sf_dir), PS).select("p_partkey", r("p_retailprice", 9), r("p_size", 9))


@query("SELECT p_partkey, round(1 + (p_retailprice - 500) / 1500, 9) AS p_retailprice, round(1 + (60 - CAST(p_size AS DOUBLE)) / 60, 9) AS p_size FROM part")
def normalise_bounds_maximise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.normalise(part(spark, sf_dir), PS, (1.0, 2.0), [500, 0], [2000, 60], UP).select("p_partkey", r("p_retailprice", 9), r("p_size", 9))


@query("SELECT p_partkey, round(log10(p_retailprice), 9) AS p_retailprice, round(-log10(CAST(p_size AS DOUBLE)), 9) AS p_size FROM part WHERE p_retailprice BETWEEN 950 AND 1800 AND p_size BETWEEN 5 AND 40")
def bounds_log_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = transform.log10(transform.bounds(part(spark, sf_dir), PS, [950, 5], [1800, 40]), PS)
    return transform.agree(kept, PS, UP).select("p_partkey", r("p_retailprice", 9), r("p_size", 9))


@query(f"WITH p AS (SELECT p_partkey, {COSTS} FROM part WHERE p_retailprice <= 1800), n AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE {beats(2)})) SELECT p_partkey, round((f1 - (SELECT min(f1) FROM n)) / (SELECT CASE WHEN max(f1) = min(f1) THEN 1 ELSE max(f1) - min(f1) END FROM n), 9) AS p_retailprice, round((f2 - (SELECT min(f2) FROM n)) / (SELECT CASE WHEN max(f2) = min(f2) THEN 1 ELSE max(f2) - min(f2) END FROM n), 9) AS p_size FROM n")
def nondominated_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.nondominated(part(spark, sf_dir), PS, UP, upper=[1800, 1e9], agree="min", to_range=(0.0, 1.0), keep_weakly=True)
    return out.select("p_partkey", r("p_retailprice", 9), r("p_size", 9))


@query("SELECT p_partkey, p_retailprice, -CAST(p_size AS DOUBLE) AS p_size FROM part")
def transform_maximise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.transform_maximise(part(spark, sf_dir), PS, UP).select("p_partkey", *PS)


@query("WITH s AS (SELECT s_suppkey, s_acctbal, dense_rank() OVER (ORDER BY s_nationkey) AS set_id FROM supplier) SELECT s_suppkey, s_acctbal, set_id FROM s UNION ALL SELECT s_suppkey, s_acctbal, set_id + (SELECT max(set_id) FROM s) FROM s")
def rbind_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = transform.numbered_sets(read(spark, sf_dir, "supplier"), "s_nationkey").select("s_suppkey", "s_acctbal", "set_id")
    return transform.rbind_datasets(s, s)


@query("SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY p_brand")
def apply_within_sets_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_within_sets(part(spark, sf_dir).select("p_brand", "p_retailprice"), "p_brand", lambda p: p.groupby("p_brand", as_index=False).agg(top=("p_retailprice", "max")), "p_brand string, top double")


# --- hypervolume

POINTS = f"p AS (SELECT p_partkey, p_brand, p_type, {COSTS} FROM part)"


@query(f"WITH {POINTS}, v AS ({staircase('p', 'p_brand')}) SELECT p_brand, round(coalesce(hypervolume, 0), 4) AS hypervolume FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN v USING (p_brand)")
def hv_2d_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hypervolume(part(spark, sf_dir), PS, REF, UP, "p_brand").select("p_brand", r("hypervolume", 4))


@query(f"WITH {POINTS}, d AS (SELECT max(f1) + 0.1 * (max(f1) - min(f1)) AS r1, max(f2) + 0.1 * (max(f2) - min(f2)) AS r2 FROM p), x AS (SELECT * FROM p, d), v AS ({staircase('x', 'p_type', 'r1', 'r2')}) SELECT p_type, round(hypervolume, 4) AS hypervolume FROM v")
def hv_2d_default_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hypervolume(part(spark, sf_dir), PS, None, UP, "p_type").select("p_type", r("hypervolume", 4))


@query(f"WITH {POINTS}, a AS ({staircase('p', '')}), v AS ({staircase('p', 'p_type')}) SELECT p_type, round(1 - v.hypervolume / a.hypervolume, 9) AS relative_hypervolume FROM v, a")
def relative_hv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return hypervolume.RelativeHypervolume(REF, p, PS, UP)(p, PS, "p_type").select("p_type", r("relative_hypervolume", 9))


@query("SELECT o_orderpriority, greatest(0, 5000 - min(o_totalprice)) AS hypervolume FROM orders GROUP BY o_orderpriority")
def hv_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hypervolume(read(spark, sf_dir, "orders"), ["o_totalprice"], 5000, by="o_orderpriority")


HV3 = f"""WITH p AS (SELECT p_type, {COSTS}, CAST(p_partkey % 37 AS DOUBLE) AS f3 FROM part), f AS (SELECT * FROM p WHERE f1 < 1500 AND f2 < -10 AND f3 < 30),
z AS (SELECT p_type, c, coalesce(lead(c) OVER (PARTITION BY p_type ORDER BY c), 30) - c AS h FROM (SELECT DISTINCT p_type, f3 AS c FROM f)),
s AS (SELECT f.p_type, c, h, f1, f2 FROM f JOIN z ON f.p_type = z.p_type AND f.f3 <= z.c), v AS ({staircase('s', 'p_type, c, h')})
SELECT p_type, round(sum(hypervolume * h), 3) AS hypervolume FROM v GROUP BY p_type"""


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).withColumn("third", (F.col("p_partkey") % 37).cast("double"))


@query(HV3)
def hv_3d_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hypervolume(three(spark, sf_dir), [*PS, "third"], [*REF, 30.0], [*UP, False], "p_type").select("p_type", r("hypervolume", 3))


@query(HV3)
def hv_3d_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hypervolume_slabs(three(spark, sf_dir), [*PS, "third"], [*REF, 30.0], [*UP, False], "p_type").select("p_type", r("hypervolume", 3))


@query(f"""WITH p AS (SELECT p_type, {COSTS}, CAST(p_partkey % 37 AS DOUBLE) AS f3, CAST(p_partkey % 11 AS DOUBLE) AS f4 FROM part), f AS (SELECT DISTINCT * FROM p WHERE f1 < 1500 AND f2 < -10 AND f3 < 30 AND f4 < 9),
y AS (SELECT p_type, d, coalesce(lead(d) OVER (PARTITION BY p_type ORDER BY d), 9) - d AS g FROM (SELECT DISTINCT p_type, f4 AS d FROM f)),
z AS (SELECT p_type, c, coalesce(lead(c) OVER (PARTITION BY p_type ORDER BY c), 30) - c AS h FROM (SELECT DISTINCT p_type, f3 AS c FROM f)),
s AS (SELECT f.p_type, c, h, d, g, f1, f2 FROM f JOIN z ON f.p_type = z.p_type AND f.f3 <= z.c JOIN y ON f.p_type = y.p_type AND f.f4 <= y.d), v AS ({staircase('s', 'p_type, c, h, d, g')})
SELECT p_type, round(sum(hypervolume * h * g), 2) AS hypervolume FROM v GROUP BY p_type""")
def hv_4d_per_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = three(spark, sf_dir).withColumn("fourth", (F.col("p_partkey") % 11).cast("double"))
    return hypervolume.hypervolume(four, [*PS, "third", "fourth"], [*REF, 30.0, 9.0], [*UP, False, False], "p_type").select("p_type", r("hypervolume", 2))


@query(f"""WITH {POINTS}, i AS (SELECT * FROM p WHERE f1 < {R1} AND f2 < {R2}), g AS (SELECT p_type, f1, f2, count(*) AS n FROM i p WHERE NOT EXISTS (SELECT 1 FROM i q WHERE q.p_type = p.p_type AND {beats(2)}) GROUP BY p_type, f1, f2),
c AS (SELECT p_type, f1, f2, CASE WHEN n > 1 THEN 0 ELSE (coalesce(lead(f1) OVER w, {R1}) - f1) * (coalesce(lag(f2) OVER w, {R2}) - f2) END AS c FROM g WINDOW w AS (PARTITION BY p_type ORDER BY f1))
SELECT p_partkey, p_type, round(coalesce(c, 0), 6) AS hv_contribution FROM p LEFT JOIN c USING (p_type, f1, f2)""")
def hv_contributions_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypervolume.hv_contributions(part(spark, sf_dir), PS, REF, UP, by="p_type").select("p_partkey", "p_type", r("hv_contribution"))


@query(f"""WITH p AS (SELECT s_suppkey AS id, -s_acctbal AS f1, CAST(s_nationkey AS DOUBLE) AS f2 FROM supplier), a AS ({staircase('p', '', '10000', '26')}),
x AS (SELECT o.id AS out, p.f1, p.f2 FROM p JOIN p o ON o.id <> p.id), v AS ({staircase('x', 'out', '10000', '26')})
SELECT out AS s_suppkey, round(a.hypervolume - v.hypervolume, 4) AS hv_contribution FROM v, a""")
def hv_contributions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hypervolume.hv_contributions(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey"], [-10000.0, 26.0], [True, False], ignore_dominated=False)
    return c.select("s_suppkey", r("hv_contribution", 4))


# --- distances

SETS = f"""p AS (SELECT p_brand, row_number() OVER () AS id, {COSTS} FROM part), n AS (SELECT row_number() OVER () AS rid, f1 AS r1, f2 AS r2 FROM p WHERE p.p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND NOT EXISTS (SELECT 1 FROM p q WHERE q.p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND {beats(2, tie='id')})),
c AS (SELECT p_brand, id, rid, sqrt((f1 - r1) * (f1 - r1) + (f2 - r2) * (f2 - r2)) AS d, sqrt(greatest(f1 - r1, 0) * greatest(f1 - r1, 0) + greatest(f2 - r2, 0) * greatest(f2 - r2, 0)) AS dp, greatest(f1 - r1, f2 - r2) AS e, greatest(f1 / r1, r2 / f2) AS m FROM p, n)"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = part(spark, sf_dir).where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    return dominance.filter_dominated(some, PS, UP)


def over_ref(value: str, name: str, outer: str = "avg", key: str = "rid") -> str:
    return f"WITH {SETS} SELECT p_brand, round({outer}(x), 6) AS {name} FROM (SELECT p_brand, {key}, min({value}) AS x FROM c GROUP BY p_brand, {key}) GROUP BY p_brand"


def _measure(f: Callable, name: str, **more) -> Query:  # noqa: ANN003
    return lambda spark, sf_dir: f(part(spark, sf_dir), reference(spark, sf_dir), PS, UP, "p_brand", **more).select("p_brand", r(name))


for _name, _f, _column, _sql, _more in (
    ("igd", distance.igd, "igd", over_ref("d", "igd"), {}),
    ("igd_plus", distance.igd_plus, "igd_plus", over_ref("dp", "igd_plus"), {}),
    ("gd", distance.gd, "gd", over_ref("d", "gd", key="id"), {}),
    ("igd_p2", distance.igd, "igd", f"WITH {SETS} SELECT p_brand, round(sqrt(avg(x * x)), 6) AS igd FROM (SELECT p_brand, rid, min(d) AS x FROM c GROUP BY p_brand, rid) GROUP BY p_brand", {"p": 2}),
    ("epsilon_additive", distance.epsilon_additive, "epsilon_additive", over_ref("e", "epsilon_additive", "max"), {}),
    ("epsilon_mult", distance.epsilon_mult, "epsilon_mult", over_ref("m", "epsilon_mult", "max"), {}),
    *((f"avg_hausdorff_p{k}", distance.avg_hausdorff_dist, "avg_hausdorff", f"WITH {SETS}, a AS (SELECT p_brand, pow(avg(pow(x, {k})), 1.0 / {k}) AS v FROM (SELECT p_brand, rid, min(d) AS x FROM c GROUP BY p_brand, rid) GROUP BY p_brand), b AS (SELECT p_brand, pow(avg(pow(x, {k})), 1.0 / {k}) AS v FROM (SELECT p_brand, id, min(d) AS x FROM c GROUP BY p_brand, id) GROUP BY p_brand) SELECT p_brand, round(greatest(a.v, b.v), 6) AS avg_hausdorff FROM a JOIN b USING (p_brand)", {"p": k}) for k in (1, 2)),
):
    QUERIES[_name], SQL[_name] = _measure(_f, _column, **_more), _sql


@query(f"""WITH p AS (SELECT p_type, p_retailprice - 800 AS f1, 60 - CAST(p_size AS DOUBLE) AS f2 FROM part), f AS (SELECT DISTINCT p_type, f1, f2 FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_type = p.p_type AND {beats(2)})),
n AS (SELECT *, lag(f2) OVER w AS up, lead(f1) OVER w AS rt FROM f WINDOW w AS (PARTITION BY p_type ORDER BY f1))
SELECT p_type, round(0.5 * sum(f1 * (coalesce(pow(up / (f1 + up), 2), 1) - pow(f2 / (f1 + f2), 2)) + f2 * (coalesce(pow(rt / (f2 + rt), 2), 1) - pow(f1 / (f1 + f2), 2))), 6) AS r2 FROM n GROUP BY p_type""")
def r2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r2.r2_exact(part(spark, sf_dir), PS, [800.0, 60.0], UP, "p_type").select("p_type", r("r2"))


# --- attainment


def surfaces(source: str, by: str = "") -> str:
    """SQL: corner points t, x, m of all levels of ``source`` (s, f1, f2, by), and the grid's column for ties."""
    b, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""x AS (SELECT DISTINCT {b}f1 AS x FROM {source}), l AS (SELECT DISTINCT {b}s FROM {source}),
c AS (SELECT DISTINCT {b}s, x, min(f2) OVER (PARTITION BY {b}s ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM x JOIN l {using} LEFT JOIN (SELECT {b}s, f1 AS x, f2 FROM {source}) USING ({b}s, x)),
t AS (SELECT *, row_number() OVER (PARTITION BY {b}x ORDER BY m NULLS LAST) AS t FROM c),
e AS (SELECT * FROM (SELECT *, min(m) OVER (PARTITION BY {b}t ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM t WHERE m IS NOT NULL) WHERE low IS NULL OR m < low),
n AS (SELECT {b}count(*) AS n FROM l {'GROUP BY ' + by if by else ''})"""


BRANDS = f"p AS (SELECT p_brand AS s, p_type, {COSTS} FROM part)"


@query(f"WITH {BRANDS}, {surfaces('p')} SELECT x AS p_retailprice, -m AS p_size, round(t * 100.0 / n, 6) AS percentile FROM e, n")
def eaf_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eaf(part(spark, sf_dir), PS, "p_brand", maximise=UP).select(*PS, r("percentile"))


@query(f"WITH {BRANDS}, {surfaces('p')} SELECT x AS p_retailprice, -m AS p_size, q AS percentile FROM e, n, (VALUES (0.0::DOUBLE), (33.0), (50.0), (100.0)) v(q) WHERE t = greatest(1, ceil(n * q / 100 - 1.4901161193847656e-8))")
def eaf_2d_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eaf(part(spark, sf_dir), PS, "p_brand", [50, 0, 33, 100], UP)


@query(f"WITH {BRANDS}, {surfaces('p', 'p_type')} SELECT p_type, x AS p_retailprice, -m AS p_size, round(t * 100.0 / n, 6) AS percentile FROM e JOIN n USING (p_type)")
def eaf_2d_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eaf(part(spark, sf_dir), PS, "p_brand", maximise=UP, groups="p_type").select("p_type", *PS, r("percentile"))


@query(f"WITH {BRANDS}, {surfaces('p')} SELECT x AS p_retailprice, -m AS p_size, round(t * 100.0 / n, 6) AS percentile, level FROM e, n, (VALUES ('best'), ('median'), ('worst')) v(level) WHERE t = CASE level WHEN 'best' THEN 1 WHEN 'median' THEN ceil(n / 2) ELSE n END")
def eaf_levels_best_median_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eaf_named_levels(part(spark, sf_dir), PS, "p_brand", UP).select(*PS, r("percentile"), "level")


@query(f"WITH {BRANDS}, {surfaces('p')} SELECT x AS p_retailprice, -m AS p_size, max(round(t * 100.0 / n, 6)) AS percentile FROM e, n WHERE t IN (1, 13, 25) GROUP BY x, m")
def attsurf2df(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = attainment.eaf(part(spark, sf_dir), PS, "p_brand", maximise=UP, levels=[1, 13, 25])
    return attainment.attsurf2df(attainment.eaf_as_dict(e, [4.0, 52.0, 100.0]), PS).select(*PS, r("percentile"))


@query(f"WITH {BRANDS}, {surfaces('p')} SELECT x AS p_retailprice, -m AS p_size, round(t * 100.0 / n, 6) AS percentile, (SELECT string_agg(CASE WHEN c.m <= e.m THEN '1' ELSE '0' END, '' ORDER BY s) FROM c WHERE c.x = e.x) AS attained FROM e, n")
def eaf_attained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = attainment.eaf_attained(part(spark, sf_dir), PS, "p_brand", UP)
    return e.select(*PS, r("percentile"), F.concat_ws("", F.transform("attained", lambda x: x.cast("int").cast("string"))).alias("attained"))


EAF3 = f"""WITH p AS (SELECT p_type AS s, {COSTS}, CAST(p_partkey % 37 AS DOUBLE) AS f3 FROM part), l AS (SELECT DISTINCT s FROM p),
g AS (SELECT s, f1 AS x, f2 AS y, min(f3) AS z FROM p GROUP BY s, f1, f2),
f AS (SELECT s, x, y, g.z FROM (SELECT s, x, y FROM l, (SELECT DISTINCT f1 AS x FROM p), (SELECT DISTINCT f2 AS y FROM p)) LEFT JOIN g USING (s, x, y)),
a AS (SELECT s, x, y, min(z) OVER (PARTITION BY s, y ORDER BY x) AS z FROM f), m AS (SELECT s, x, y, min(z) OVER (PARTITION BY s, x ORDER BY y) AS z FROM a),
t AS (SELECT x, y, z, row_number() OVER (PARTITION BY x, y ORDER BY z NULLS LAST) AS t FROM m),
e AS (SELECT *, lag(z) OVER (PARTITION BY t, y ORDER BY x) AS west, lag(z) OVER (PARTITION BY t, x ORDER BY y) AS south FROM t)"""


THIRD_SIDES = "CASE WHEN p_brand < 'Brand#3' THEN 'l' ELSE 'r' END || p_type AS s"


@query(f"{EAF3} SELECT x AS p_retailprice, -y AS p_size, z AS third, CAST(t AS DOUBLE) * 100 / (SELECT count(*) FROM l) AS percentile FROM e WHERE z IS NOT NULL AND (west IS NULL OR z < west) AND (south IS NULL OR z < south)")
def eaf_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eaf(three(spark, sf_dir), [*PS, "third"], "p_type", maximise=[*UP, False])


EVENTS = "p AS (SELECT event_type || user_id AS s, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 0 ELSE 1 END AS side, round(value, 2) AS f1, CAST(user_id % 13 + event_id % 29 AS DOUBLE) AS f2 FROM events WHERE event_type IN (SELECT min(event_type) FROM events UNION ALL SELECT max(event_type) FROM events))"
DIFF = f"""WITH {EVENTS}, {surfaces('p')}, sides AS (SELECT DISTINCT s, side FROM p), k AS (SELECT count(*) FILTER (side = 0) AS nl, count(*) FILTER (side = 1) AS nr FROM sides),
a AS (SELECT e.t, e.x, e.m, count(*) FILTER (side = 0) AS l, count(*) FILTER (side = 1) AS r FROM e JOIN c ON c.x = e.x AND c.m <= e.m JOIN sides ON sides.s = c.s GROUP BY e.t, e.x, e.m),
d AS (SELECT t, x, m, floor((nl + nr) / 2) * (CAST(l AS DOUBLE) / nl - CAST(r AS DOUBLE) / nr) AS diff FROM a, k)"""


def two_types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events").select("event_type", "user_id", F.round("value", 2).alias("f1"), (F.col("user_id") % 13 + F.col("event_id") % 29).cast("double").alias("f2"))
    ends = read(spark, sf_dir, "events").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    return events.where(F.col("event_type") == ends["a"]), events.where(F.col("event_type") == ends["b"])


@query(f"{DIFF} SELECT DISTINCT x AS f1, m AS f2, round(diff, 6) AS diff FROM d")
def eafdiff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.eafdiff(*two_types(spark, sf_dir), ["f1", "f2"], "user_id").select("f1", "f2", r("diff")).distinct()


RECTANGLES = f"""{DIFF}, y AS (SELECT DISTINCT t, y FROM (SELECT t, m AS y FROM d UNION ALL SELECT t - 1, m FROM d) WHERE t BETWEEN 1 AND (SELECT max(t) - 1 FROM d)),
s AS (SELECT t, y, lead(y) OVER (PARTITION BY t ORDER BY y) AS top FROM y),
q AS (SELECT s.t, s.y, s.top, (SELECT min(x) FROM d WHERE d.t = s.t AND d.m <= s.y) AS xa, (SELECT min_by(diff, x) FROM d WHERE d.t = s.t AND d.m <= s.y) AS diff, (SELECT min(x) FROM d WHERE d.t = s.t + 1 AND d.m <= s.y) AS xb FROM s)"""


@query(f"{RECTANGLES} SELECT DISTINCT xa AS xmin, y AS ymin, least(coalesce(xb, 1e6), 1e6) AS xmax, least(coalesce(top, 1e6), 1e6) AS ymax, round(diff, 6) AS diff FROM q WHERE xa IS NOT NULL AND (xb IS NULL OR xa < xb)")
def eafdiff_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = attainment.eafdiff_rectangles(*two_types(spark, sf_dir), ["f1", "f2"], "user_id")
    return d.select("xmin", "ymin", F.least("xmax", F.lit(1e6)).alias("xmax"), F.least("ymax", F.lit(1e6)).alias("ymax"), r("diff")).distinct()


@query(f"{DIFF} SELECT DISTINCT x AS f1, m AS f2, round(-diff, 6) AS diff FROM d WHERE diff < 0")
def choose_eafdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.choose_eafdiff(attainment.eafdiff(*two_types(spark, sf_dir), ["f1", "f2"], "user_id"), left=False).select("f1", "f2", r("diff")).distinct()


POLYGONS = f"""{RECTANGLES}, b AS (SELECT *, trunc(diff) AS colour, coalesce(xb, 'inf'::DOUBLE) AS ux, coalesce(top, 'inf'::DOUBLE) AS uy FROM q WHERE xa IS NOT NULL AND (xb IS NULL OR xa < xb)),
f AS (SELECT *, CASE WHEN lag(colour) OVER w = colour AND lag(y) OVER w = uy AND lag(xa) OVER w < ux AND lag(ux) OVER w > xa THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY t ORDER BY uy DESC)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY t ORDER BY uy DESC) AS run FROM f)"""


@query(f"{POLYGONS} SELECT CAST(t AS INT) AS level, CAST(colour AS INT) AS colour, CASE WHEN colour > 0 THEN 'left' ELSE 'right' END AS side, CAST(4 * count(*) + 1 AS INT) AS n_vertices FROM runs WHERE colour <> 0 GROUP BY t, colour, run")
def eafdiff_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attainment.eafdiff_polygons(*two_types(spark, sf_dir), ["f1", "f2"], "user_id")
    return p.select("level", "colour", "side", F.size("vertices").alias("n_vertices"))


LARGEST = f"""WITH o AS (SELECT p_type, p_brand, {COSTS} FROM part), types AS (SELECT DISTINCT p_type FROM o), pairs AS (SELECT u.p_type AS a, v.p_type AS b FROM types u JOIN types v ON u.p_type < v.p_type),
p AS (SELECT a, b, 'l' || p_brand AS s, f1, f2 FROM o JOIN pairs ON p_type = a UNION ALL SELECT a, b, 'r' || p_brand, f1, f2 FROM o JOIN pairs ON p_type = b), {surfaces('p', 'a, b')},
k AS (SELECT a, b, count(*) FILTER (s LIKE 'l%') AS nl, count(*) FILTER (s LIKE 'r%') AS nr FROM l GROUP BY a, b),
w AS (SELECT a, b, e.t, e.x, e.m, count(*) FILTER (c.s LIKE 'l%') AS left_n, count(*) FILTER (c.s LIKE 'r%') AS right_n FROM e JOIN c USING (a, b, x) WHERE c.m <= e.m GROUP BY a, b, e.t, e.x, e.m),
d AS (SELECT a, b, t, x, m, nl + nr AS last, least(5, floor((nl + nr) / 2)) * (CAST(left_n AS DOUBLE) / nl - CAST(right_n AS DOUBLE) / nr) AS diff FROM w JOIN k USING (a, b)),
y AS (SELECT DISTINCT a, b, t, y FROM (SELECT a, b, t, m AS y, last FROM d UNION ALL SELECT a, b, t - 1, m, last FROM d) WHERE t BETWEEN 1 AND last - 1),
h AS (SELECT *, lead(y) OVER (PARTITION BY a, b, t ORDER BY y) AS top FROM y),
q AS (SELECT h.a, h.b, h.t, h.y, any_value(top) AS top, min(x) FILTER (d.t = h.t) AS xa, min_by(diff, x) FILTER (d.t = h.t) AS diff, min(x) FILTER (d.t = h.t + 1) AS xb
      FROM h JOIN d ON d.a = h.a AND d.b = h.b AND d.t BETWEEN h.t AND h.t + 1 AND d.m <= h.y GROUP BY h.a, h.b, h.t, h.y),
v AS (SELECT a, b, diff, greatest(least(coalesce(xb, {R1}), {R1}) - xa, 0) * greatest(least(coalesce(top, {R2}), {R2}) - y, 0) AS area FROM q WHERE xa IS NOT NULL),
z AS (SELECT a, b, coalesce(sum(area) FILTER (diff >= 1), 0) AS one, coalesce(sum(area) FILTER (diff <= -1), 0) AS other FROM v GROUP BY a, b)"""


@query(f"{LARGEST} SELECT a AS left_dataset, b AS right_dataset, round(least(coalesce(one, 0), coalesce(other, 0)), 4) AS value FROM pairs LEFT JOIN z USING (a, b)")
def largest_eafdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.largest_eafdiff_table(part(spark, sf_dir), PS, "p_type", "p_brand", REF, UP).withColumn("value", F.round("value", 4))


RECTS = "(VALUES (900.0::DOUBLE, -50.0::DOUBLE, 1100.0::DOUBLE, -20.0::DOUBLE, 1.0::DOUBLE), (1000.0, -45.0, 1400.0, 1e9, 2.5), (950.0, -30.0, 1e9, -5.0, -1.0)) g(xmin, ymin, xmax, ymax, diff)"
WHV = f"""{POINTS}, g AS (SELECT row_number() OVER () AS id, xmin, ymin, least(xmax, {R1}) AS xmax, least(ymax, {R2}) AS ymax, diff FROM {RECTS}), j AS (SELECT p_type, id, xmax, ymax, diff, greatest(f1, xmin) AS x, greatest(f2, ymin) AS y FROM p, g WHERE f1 < xmax AND f2 < ymax),
a AS (SELECT p_type, diff * (xmax - x) * greatest(coalesce(min(y) OVER (PARTITION BY p_type, id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ymax) - y, 0) AS v FROM j), w AS (SELECT p_type, sum(v) AS whv FROM a GROUP BY p_type)"""


def rectangles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(900.0, -50.0, 1100.0, -20.0, 1.0), (1000.0, -45.0, 1400.0, 1e9, 2.5), (950.0, -30.0, 1e9, -5.0, -1.0)], "xmin double, ymin double, xmax double, ymax double, diff double")


def minimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.transform_maximise(part(spark, sf_dir), PS, UP)


@query(f"WITH {WHV} SELECT p_type, round(whv, 4) AS whv FROM w")
def whv_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.whv_rect(minimised(spark, sf_dir), rectangles(spark), PS, [R1, R2], "p_type").select("p_type", r("whv", 4))


@query(f"WITH {WHV}, v AS ({staircase('p', 'p_type')}), i AS (SELECT abs(({R1} - min(f1)) * ({R2} - min(f2))) AS box FROM p) SELECT p_type, round(hypervolume + 0.1 * box * whv, 4) AS total_whv FROM v JOIN w USING (p_type), i")
def total_whv_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.total_whv_rect(minimised(spark, sf_dir), rectangles(spark), PS, [R1, R2], by="p_type").select("p_type", r("total_whv", 4))


@query(f"WITH {BRANDS}, {surfaces('p')}, f AS (SELECT t, x AS f1, m AS f2 FROM e), v AS ({staircase('f', 't')}) SELECT CAST(t AS INTEGER) AS level, round(hypervolume, 4) AS hypervolume FROM v")
def vorob_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.level_volumes(part(spark, sf_dir), PS, "p_brand", REF, UP).select("level", r("hypervolume", 4))


VOROB = f"""WITH RECURSIVE {BRANDS}, {surfaces('p')}, f AS (SELECT t, x AS f1, m AS f2 FROM e), v AS ({staircase('f', 't')}), s AS ({staircase('p', 's')}), g AS (SELECT avg(coalesce(hypervolume, 0)) AS average FROM l LEFT JOIN s USING (s)),
k AS (SELECT unnest(range(1, (SELECT n + 1 FROM n))) AS t), h AS (SELECT t, coalesce(hypervolume, 0) AS hv FROM k LEFT JOIN v USING (t)),
r AS (SELECT 0.0::DOUBLE AS a, 100.0::DOUBLE AS b, 50.0::DOUBLE AS c, NULL::DOUBLE AS before, hv AS now FROM h, n WHERE t = greatest(1, ceil(n * 50.0 / 100 - 1.4901161193847656e-8))
  UNION ALL SELECT q.a, q.b, (q.a + q.b) / 2, q.now, hv FROM (SELECT CASE WHEN now > average THEN c ELSE a END AS a, CASE WHEN now > average THEN b ELSE c END AS b, now FROM r, g WHERE before IS NULL OR before <> now) q, h, n
  WHERE h.t = greatest(1, ceil(n * ((q.a + q.b) / 2) / 100 - 1.4901161193847656e-8)))"""
EXPECTED = "(SELECT greatest(1, ceil(n.n * c / 100 - 1.4901161193847656e-8)) FROM r, n ORDER BY b - a LIMIT 1)"


@query(f"{VOROB} SELECT x AS p_retailprice, -m AS p_size FROM e WHERE t = {EXPECTED}")
def vorob_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attainment.vorob_t(part(spark, sf_dir), PS, "p_brand", REF, UP).expectation


@query(f"{VOROB}, ve AS (SELECT x AS f1, m AS f2, 0 AS one FROM e WHERE t = {EXPECTED}), both_ AS (SELECT s, f1, f2 FROM p UNION ALL SELECT s, f1, f2 FROM l, ve), j AS ({staircase('both_', 's')}), w AS ({staircase('ve', 'one')}) SELECT round(2 * (SELECT avg(hypervolume) FROM j) - (SELECT average FROM g) - (SELECT hypervolume FROM w), 4) AS deviation")
def vorob_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(attainment.vorob_dev(part(spark, sf_dir), PS, "p_brand", REF, UP), 4),)], "deviation double")


# --- approximations and sources


@query(f"""WITH {POINTS}, f AS (SELECT {R1} - f1 AS z1, {R2} - f2 AS z2 FROM p WHERE f1 < {R1} AND f2 < {R2}),
a AS (SELECT ((0.5 + (i + 1) * ((sqrt(5.0::DOUBLE) - 1) / 2)) % 1.0) * pi() / 2 AS a FROM range(4096) g(i)), b AS (SELECT a, max(least(z1 / sin(a), z2 / cos(a))) AS m FROM a, f GROUP BY a)
SELECT round(avg(m * m) * pi() / 4, 5) AS hypervolume FROM b""")
def hv_approx_rphi_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approx.rphi_2d(part(spark, sf_dir), PS, REF, UP).select(r("hypervolume", 5))


def _approx(method: str) -> Query:
    return lambda spark, sf_dir: approx.hv_approx(three(spark, sf_dir), [*PS, "third"], [*REF, 30.0], [*UP, False], seed=42, method=method, by="p_type").select("p_type", r("hypervolume", 3))


for _name, _method in (("hv_approx_rphi", "Rphi-FWE+"), ("hv_approx_hw", "DZ2019-HW"), ("hv_approx_mc", "DZ2019-MC")):
    QUERIES[_name] = _approx(_method)

#: Directions of the additive sequence in three objectives: the first coordinate is uniform, the others turn around it.
SQL["hv_approx_rphi"] = f"""WITH p AS (SELECT p_type, p_retailprice AS f1, -CAST(p_size AS DOUBLE) AS f2, CAST(p_partkey % 37 AS DOUBLE) AS f3 FROM part WHERE p_retailprice < {R1} AND p_size > {-R2} AND p_partkey % 37 < 30),
f AS (SELECT DISTINCT p_type, {R1} - f1 AS z1, {R2} - f2 AS z2, 30 - f3 AS z3 FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_type = p.p_type AND {beats(3)})),
u AS (SELECT i, (0.5 + (i + 1) * ((1 / 1.324717957244746::DOUBLE) % 1.0)) % 1.0 AS a, pi() / 2 * ((0.5 + (i + 1) * ((1 / (1.324717957244746::DOUBLE * 1.324717957244746::DOUBLE)) % 1.0)) % 1.0) AS t FROM range(262144) g(i)),
w AS (SELECT i, a, sqrt(1 - a * a) * sin(t) AS b, sqrt(1 - a * a) * cos(t) AS c FROM u), m AS (SELECT p_type, i, max(least(z1 / a, z2 / b, z3 / c)) AS m FROM f, w GROUP BY p_type, i),
v AS (SELECT p_type, sum(m * m * m) / 262144 * pi() / 6 AS v FROM m GROUP BY p_type) SELECT p_type, round(coalesce(v, 0), 3) AS hypervolume FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN v USING (p_type)"""


def _hype(dist: str, mu: object) -> Query:
    return lambda spark, sf_dir: approx.whv_hype(minimised(spark, sf_dir), PS, [R1, R2], [900.0, -50.0], seed=42, dist=dist, mu=mu, by="p_type")


for _name, _dist, _mu in (("whv_hype_uniform", "uniform", None), ("whv_hype_exponential", "exponential", 0.2), ("whv_hype_point", "point", [1000.0, -45.0])):
    QUERIES[_name] = _hype(_dist, _mu)


@query()
def generate_ndset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate_ndset(spark, 100, 3, "convex-sphere", seed=42)


@query("SELECT p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def read_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = shared_folder(spark)
    path = f"{shared}/skyfront-sets-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    text_sets.write_datasets(transform.numbered_sets(part(spark, sf_dir), "p_brand"), path, PS)
    return text_sets.read_datasets(spark, f"{path}/*.txt", PS).select(*PS)


@query("SELECT p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def split_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets written with padded numbers and read in the pieces that Spark cuts files into."""
    path = f"{shared_folder(spark)}/skyfront-padded-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    text_sets.write_datasets(part(spark, sf_dir), path, PS, "p_brand", number=text_sets.PADDED)
    return text_sets.read_split_sets(spark, path, PS).select(*PS)


# --- batch jobs and three objectives


@query(f"WITH {POINTS}, v AS ({staircase('p', '')}) SELECT round(hypervolume, 4) AS hypervolume FROM v")
def hv_job_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.hv_job(part(spark, sf_dir), PS, "p_brand", REF, UP, union=True).select(r("hypervolume", 4))


@query(f"""WITH {SETS}, i AS (SELECT p_brand, avg(dp) AS igd_plus, max(e) AS epsilon_additive, avg(d) AS igd FROM (SELECT p_brand, rid, min(d) AS d, min(dp) AS dp, min(e) AS e FROM c GROUP BY p_brand, rid) GROUP BY p_brand),
g AS (SELECT p_brand, avg(d) AS gd FROM (SELECT p_brand, id, min(d) AS d FROM c GROUP BY p_brand, id) GROUP BY p_brand)
SELECT p_brand, round(gd, 6) AS gd, round(igd, 6) AS igd, round(igd_plus, 6) AS igd_plus, round(greatest(gd, igd), 6) AS avg_hausdorff, round(epsilon_additive, 6) AS epsilon_additive FROM i JOIN g USING (p_brand)""")
def indicators_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    names = ["gd", "igd", "igd_plus", "avg_hausdorff", "epsilon_additive"]
    return jobs.indicators(p, p.where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")), PS, "p_brand", UP, filter_ref=True).select("p_brand", *map(r, names))


@query(f"""WITH p AS (SELECT p_type, p_size < 25 AS small, p_retailprice AS f1, CAST(p_partkey % 37 AS DOUBLE) AS f2 FROM part),
e AS (SELECT small, max(x) AS x FROM (SELECT p.small, q.f1, q.f2, min(greatest(p.f1 - q.f1, p.f2 - q.f2)) AS x FROM p JOIN p q ON p.small <> q.small GROUP BY p.small, q.f1, q.f2) GROUP BY small)
SELECT CASE WHEN a.x <= 0 AND b.x > 0 THEN -1 WHEN b.x <= 0 AND a.x > 0 THEN 1 ELSE 0 END AS better FROM e a JOIN e b ON a.small AND NOT b.small""")
def epsilon_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = three(spark, sf_dir)
    better = distance.epsilon_compare(p.where("p_size < 25"), p.where("p_size >= 25"), ["p_retailprice", "third"])
    return spark.createDataFrame([(better,)], "better int")


@query(f"{EAF3.replace('p_type AS s', THIRD_SIDES)}, c AS (SELECT DISTINCT x, y, z FROM e WHERE z IS NOT NULL AND (west IS NULL OR z < west) AND (south IS NULL OR z < south)), k AS (SELECT count(*) FILTER (s LIKE 'l%') AS nl, count(*) FILTER (s LIKE 'r%') AS nr FROM l), w AS (SELECT x, y, c.z, count(*) FILTER (s LIKE 'l%') AS a, count(*) FILTER (s LIKE 'r%') AS b FROM c JOIN m USING (x, y) WHERE m.z <= c.z GROUP BY x, y, c.z) SELECT x AS p_retailprice, -y AS p_size, z AS third, round(floor((nl + nr) / 2) * (CAST(a AS DOUBLE) / nl - CAST(b AS DOUBLE) / nr), 6) AS diff FROM w, k")
def eafdiff_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, left = three(spark, sf_dir), F.col("p_brand") < "Brand#3"
    return attainment.eafdiff(p.where(left), p.where(~left), [*PS, "third"], "p_type", maximise=[*UP, False]).select(*PS, "third", r("diff"))


@query("WITH p AS (SELECT s_suppkey, s_acctbal AS f1, -CAST(s_nationkey AS DOUBLE) AS f2 FROM supplier) SELECT s_suppkey FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2 AND (q.f1 < p.f1 OR q.f2 < p.f2))")
def skyline_by_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, up = parse_objectives("-i+", ["s_acctbal", "third", "s_nationkey"])
    return dominance.filter_dominated(supplier(spark, sf_dir), names, up, keep_weakly=True).select("s_suppkey")


@query("SELECT p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part")
def catalog_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.as_points(Catalog(spark, sf_dir).load("part.parquet"), PS).select("p_partkey", *PS)


FOUR = "SELECT s_suppkey AS id, -s_acctbal AS f1, CAST(s_nationkey AS DOUBLE) AS f2, CAST(s_suppkey % 7 AS DOUBLE) AS f3, CAST(s_suppkey % 5 AS DOUBLE) AS f4 FROM supplier"


@query(f"""WITH p AS ({FOUR}), z AS (SELECT f3 AS c, coalesce(lead(f3) OVER (ORDER BY f3), 7) - f3 AS h FROM (SELECT DISTINCT f3 FROM p)), y AS (SELECT f4 AS d, coalesce(lead(f4) OVER (ORDER BY f4), 5) - f4 AS g FROM (SELECT DISTINCT f4 FROM p)),
s AS (SELECT c, h, d, g, f1, f2 FROM p JOIN z ON f3 <= c JOIN y ON f4 <= d), v AS ({staircase('s', 'c, h, d, g', '10000', '26')}) SELECT round(sum(hypervolume * h * g), 2) AS hypervolume FROM v""")
def hv_4d_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = supplier(spark, sf_dir).withColumn("fourth", F.col("s_suppkey") % 5)
    return hypervolume.hypervolume_tree(four, ["s_acctbal", "s_nationkey", "third", "fourth"], [-10000.0, 26.0, 7.0, 5.0], [True, False, False, False]).select(r("hypervolume", 2))


@query(f"""WITH p AS ({SUPPLIER}), n AS (SELECT *, count(*) OVER (PARTITION BY f1, f2, f3) AS times FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE {beats(3)})), z AS (SELECT f3 AS c, coalesce(lead(f3) OVER (ORDER BY f3), 7) - f3 AS h FROM (SELECT DISTINCT f3 FROM p)),
o AS (SELECT id FROM n UNION ALL SELECT -1), x AS (SELECT o.id AS out, f1, f2, c, h FROM n JOIN z ON f3 <= c JOIN o ON o.id <> n.id), v AS ({staircase('x', 'out, c, h', '10000', '26')}), w AS (SELECT out, sum(hypervolume * h) AS v FROM v GROUP BY out)
SELECT p.id AS s_suppkey, round(CASE WHEN n.id IS NULL OR times > 1 THEN 0 ELSE (SELECT v FROM w WHERE out = -1) - coalesce(w.v, 0) END, 3) AS hv_contribution FROM p LEFT JOIN n USING (id) LEFT JOIN w ON w.out = p.id""")
def hv_contributions_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hypervolume.hv_contributions(supplier(spark, sf_dir), ["s_acctbal", "s_nationkey", "third"], [-10000.0, 26.0, 7.0], [True, False, False])
    return c.select("s_suppkey", r("hv_contribution", 3))


@query(f"WITH {POINTS} SELECT f1 AS p_retailprice, -f2 AS p_size, dense_rank() OVER (ORDER BY p_brand) AS set_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_brand = p.p_brand AND {beats(2)})")
def write_filtered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/skyfront-fronts-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    rows = dominance.is_nondominated_within_sets(transform.numbered_sets(part(spark, sf_dir), "p_brand"), PS, "set_id", UP, keep_weakly=True)
    text_sets.write_datasets(rows, path, PS, keep="nondominated")
    back = text_sets.read_datasets(spark, f"{path}/*.txt", PS, per_file=True)
    return back.select(*PS, F.dense_rank().over(Window.orderBy("file", "set_id")).cast("long").alias("set_id"))


# --- SQL text and streams


@query(f"WITH {POINTS}, v AS ({staircase('p', 'p_type')}) SELECT p_type, round(hypervolume, 4) AS hypervolume FROM v")
def hv_in_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sql import register

    register(spark)
    minimised(spark, sf_dir).createOrReplaceTempView("skyfront_part")
    return spark.sql(f"SELECT p_type, round(hv(array(p_retailprice, p_size), array({R1}D, {R2}D)), 4) AS hypervolume FROM skyfront_part GROUP BY p_type")


SQL["hv_two_phases_in_sql"] = SQL["hv_in_sql_text"]


def hv_two_phases_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts where the rows are, then a volume a group, in SQL text."""
    from ..functions.sql import register

    register(spark)
    minimised(spark, sf_dir).createOrReplaceTempView("skyfront_part")
    fronts = "SELECT * FROM set_front(TABLE(SELECT p_type, array(p_retailprice, p_size) FROM skyfront_part))"
    return spark.sql(f"SELECT label AS p_type, round(hypervolume, 4) AS hypervolume FROM set_hv(TABLE({fronts}) PARTITION BY (label), array({R1}D, {R2}D))")


QUERIES["hv_two_phases_in_sql"] = hv_two_phases_in_sql


@query(f"WITH {BRANDS}, {surfaces('p', 'p_type')} SELECT p_type AS label, x, m AS y, CAST(t AS INTEGER) AS level FROM e")
def eaf_in_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sql import register

    register(spark)
    minimised(spark, sf_dir).createOrReplaceTempView("skyfront_part")
    return spark.sql("SELECT * FROM set_eaf(TABLE(SELECT p_type, p_brand, array(p_retailprice, p_size) AS point FROM skyfront_part) PARTITION BY (p_type) ORDER BY (point[0]))")


@query(f"WITH p AS (SELECT p_partkey, p_brand, p_retailprice, p_size, {COSTS} FROM part) SELECT DISTINCT p_brand, p_retailprice, p_size FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_brand = p.p_brand AND {beats(2)})")
def streaming_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from ..streaming.archive import skyline_archive

    shared = shared_folder(spark)
    place = f"{shared}/skyfront-stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "part").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir).select("p_brand", *PS)
    q = skyline_archive(stream, f"{place}/archive", f"{place}/checkpoint", PS, UP, "p_brand")
    q.processAllAvailable()
    last = q.lastProgress
    q.stop()
    return spark.read.parquet(f"{place}/archive/batch={last.batchId if last.numInputRows else last.batchId - 1}").select("p_brand", *PS)
