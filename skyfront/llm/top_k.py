"""Exact top-k inner products by ball-tree branch and bound.

Space is cut into at most ``CELLS`` cells by halving a bounded sample along its longest extent; every row is dealt
into its cell, a cell's rows into shards of bounded size, and each shard's ball tree is built once and kept.  For a
query q a ball with centre c and radius r holds no inner product above q.c + |q| r.  Nodes are taken in the order of
that bound, and a node is left out once its bound is below the k-th score known so far.  That score is shared: a
first round searches for each query its own shard and one of the cell with the highest bound; its k-th scores then
leave out whole cells for the queries of the second round, before any vector is moved.  The sample shapes cells only;
results don't depend on it.  Each shard returns at most k rows a query; they are ranked in a window by query.

Queries are a stated set, dealt into blocks of neighbouring cells; (shard, block) pairs are searched as tasks of
bounded size, never row pairs.  To the driver come the sample (``SAMPLE`` components, or 1024 vectors) and one row a cell, of
which there are ``CELLS`` and one for each vector length that the sample doesn't hold.

Defined results: components and scores beyond 64 bits stand at the end of that range (a shard's ranks are by whole scores); vectors that are null, or hold null or non-finite components, take no part; vectors of
different length are not compared; ties go to the smaller id; rows that repeat an id are candidates of their own,
but none of a query's own id, and an id asks once for each vector it has; fewer than k candidates give fewer rows; empty tables give an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard; a block of queries has four times as many.  Vectors of over 64 components: as many as hold the same number of components.
BLOCK = 16_384
LEAF = 256
CELLS, SAMPLE = 1024, 1 << 20
EXACT = float(1 << 52)


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def pack(x: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and their vectors as bytes, in the narrowest of 2, 4 and 8 bytes a component that holds the row."""
    lo, hi = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x), np.int64),) * 2
    width = np.where((lo >= -(1 << 15)) & (hi < 1 << 15), 2, np.where((lo >= -(1 << 31)) & (hi < 1 << 31), 4, 8))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(w * x.shape[1])
        yield rows, pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[rows].astype(f"<i{w}")))])


def unpack(packed: pd.Series, dim: int) -> np.ndarray:
    """The vectors of :func:`pack` as rows of integers."""
    out = np.zeros((len(packed), dim), np.int64)
    if dim:
        width = packed.map(len).to_numpy(np.int64) // dim
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            out[rows] = np.frombuffer(b"".join(packed.iloc[rows]), f"<i{w}").reshape(len(rows), dim)
    return out


class Layout:
    """Cells of the space of one vector length, in an order in which neighbours are close."""

    def __init__(self, dim: int, sample: np.ndarray | None = None, cells: int = 1) -> None:
        self.planes: list[tuple[np.ndarray, float, int, int]] = []  # direction, threshold, children; ~c is cell c
        centres: list[np.ndarray] = []

        def cut(x: np.ndarray, cells: int) -> int:
            centre = x.mean(0)
            far = x[((x - centre) ** 2).sum(1).argmax()]
            along = x[((x - far) ** 2).sum(1).argmax()] - far
            place = x @ along
            below = place[place < place.max()]
            if cells < 2 or not len(below):
                centres.append(centre)
                return ~(len(centres) - 1)
            threshold = min(np.median(place), below.max())
            at = len(self.planes)
            self.planes.append((along, threshold, 0, 0))
            left, right = cut(x[place <= threshold], cells // 2), cut(x[place > threshold], cells - cells // 2)
            self.planes[at] = (along, threshold, left, right)
            return at

        if sample is not None and len(sample):
            cut(sample.astype(np.float64), cells)
        self.centres = np.array(centres).reshape(-1, dim) if centres else np.zeros((1, dim))

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.planes else []
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                along, threshold, left, right = self.planes[node]
                over = x[rows] @ along > threshold
                todo += [(left, rows[~over]), (right, rows[over])]
        return out


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query and ball a number that no inner product in the ball exceeds, rounding included."""
    norms = np.sqrt((queries**2).sum(1))[:, None]
    reach = np.sqrt((centres**2).sum(1)) + radii
    return queries @ centres.T + norms * (radii + 1e-9 * reach)[None] + 1e-6


class BallTree:
    """Balls over the rows of a matrix of integers; leaves hold at most ``leaf`` rows, which stand together in ``x`` and ``ids``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        exact, x = x, x.astype(np.float64)
        order = np.arange(len(x))
        nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right
        centres, radii = [], []
        stack = [(0, len(x), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            rows = x[order[lo:hi]]
            centre = rows.mean(0)
            distance = np.sqrt(((rows - centre) ** 2).sum(1))
            at = len(nodes)
            nodes.append((lo, hi, -1, -1))
            centres.append(centre)
            radii.append(distance.max() * (1 + 1e-12) + 1e-9)
            if parent >= 0:
                a, b, left, right = nodes[parent]
                nodes[parent] = (a, b, at, right) if side == 0 else (a, b, left, at)
            if hi - lo > leaf and radii[-1] > 1e-6:
                far = rows[distance.argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                mid = (lo + hi) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows @ (other - far), mid - lo)]
                stack += [(lo, mid, at, 0), (mid, hi, at, 1)]
        self.x, self.ids = exact[order], ids[order]
        self.nodes, self.centres, self.radii = np.array(nodes), np.array(centres), np.array(radii)

    def dump(self) -> bytes:
        to = io.BytesIO()
        top = max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))
        np.savez(to, x=self.x.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"), ids=self.ids, nodes=self.nodes, centres=self.centres, radii=self.radii)
        return to.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw), allow_pickle=False) as f:
            for name in ("x", "ids", "nodes", "centres", "radii"):
                setattr(tree, name, f[name])
        return tree


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, tree: BallTree, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each query in one shard, without those below its ``floor``; ``x``: the tree's rows as doubles.

    All queries go down the tree together: a node is left out for the queries whose bound is below their k-th
    score, and the leaves that remain for a query are scored in the order of its bounds.
    """
    bounds = upper_bounds(queries, tree.centres, tree.radii)
    ids, n, m = tree.ids, len(queries), len(tree.nodes)
    open_, leaves = np.zeros((n, m), bool), []
    open_[:, 0] = True
    for i, (_, _, left, right) in enumerate(tree.nodes):
        open_[:, i] &= bounds[:, i] >= floor
        if left >= 0:
            open_[:, left] = open_[:, right] = open_[:, i]
        else:
            leaves.append(i)
    leaves = np.array(leaves)
    limit = np.where(open_[:, leaves], bounds[:, leaves], -np.inf)
    turn = np.argsort(-limit, axis=1, kind="stable")
    best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.astype(np.float64).copy()
    live = np.arange(n)
    for step in range(len(leaves)):
        nxt = turn[live, step]
        live = live[(limit[live, nxt] >= kth[live]) & (limit[live, nxt] > -np.inf)]
        if not len(live):
            break
        nxt = turn[live, step]
        for j in np.unique(nxt):
            q = live[nxt == j]
            lo, hi, _, _ = tree.nodes[leaves[j]]
            for part in range(lo, hi, 4096):
                own = slice(part, min(part + 4096, hi))
                s = queries[q] @ x[own].T
                s[query_ids[q][:, None] == ids[own][None]] = -np.inf
                if s.shape[1] > 4 * k:  # rows that tie with the k-th stay for the choice by id
                    cut = np.partition(s, -k, axis=1)[:, -k]
                    s_ids = np.where(s >= cut[:, None], ids[own][None], np.iinfo(np.int64).max)
                else:
                    s_ids = np.broadcast_to(ids[own][None], s.shape)
                both_s = np.hstack([best_s[q], s])
                both_i = np.hstack([best_i[q], s_ids])
                pick = np.lexsort((both_i, -both_s), axis=1)[:, :k]
                best_s[q], best_i[q] = np.take_along_axis(both_s, pick, 1), np.take_along_axis(both_i, pick, 1)
            kth[q] = np.maximum(kth[q], best_s[q][:, -1])
    row, col = np.nonzero((best_s > -np.inf) & (best_s >= floor[:, None]))
    return row, best_i[row, col], best_s[row, col]


def _parts(rows: pa.RecordBatch | pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    pdf = rows.to_pandas() if isinstance(rows, pa.RecordBatch) else rows
    for _, same in pdf.groupby("dim", sort=False):
        for at in range(0, len(same), size):
            yield same.iloc[at : at + size]


def _deal(rows: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """The rows with their cell, their distance from its centre, packed vectors and a number that is dealt out evenly."""
    shared = rows.sparkSession.sparkContext.broadcast(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                x = same.column("v").flatten().to_numpy().reshape(len(same), dim)
                layout = shared.value.get(int(dim)) or Layout(int(dim))
                cells = layout.cells(x.astype(np.float64))
                far = np.sqrt(((x - layout.centres[cells]) ** 2).sum(1))
                turns = np.arange(turn, turn + len(same))
                turn += len(same)
                for at, packed in pack(x):
                    columns = [same.column("id").take(pa.array(at)), same.column("asks").take(pa.array(at)), *map(pa.array, (np.full(len(at), dim, np.int32), cells[at].astype(np.int32), turns[at], far[at])), packed]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "asks", "dim", "cell", "turn", "far", "w"])

    return rows.mapInArrow(run, "id long, asks boolean, dim int, cell int, turn long, far double, w binary")


@dataclass
class Cells:
    """The cells of one vector length that hold rows: balls, and the shards that their rows are dealt into."""

    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    shards: np.ndarray


def _aim(queries: DataFrame, cells: dict[int, Cells], again: bool) -> DataFrame:
    """The queries with ``shards``, those to search: one of the cell with the highest bound and their own, or ``again`` all that the floor allows and that are not ``done``."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, 256):
                c = shared.value[int(part["dim"].iloc[0])]
                bounds = upper_bounds(unpack(part["w"], c.centres.shape[1]).astype(np.float64), c.centres, c.radii)
                if again:
                    every = [np.concatenate([np.arange(a, a + n) for a, n in zip(c.first[near], c.shards[near], strict=True)] or [np.empty(0, np.int64)]) for near in bounds >= part["floor"].to_numpy()[:, None]]
                    aims = [np.setdiff1d(a, done) for a, done in zip(every, part["done"], strict=True)]
                else:
                    best = bounds.argmax(1)
                    aims = [np.unique([own, c.first[b] + t % c.shards[b]]) for own, b, t in zip(part["own"], best, part["turn"], strict=True)]
                yield pd.DataFrame({"id": part["id"], "w": part["w"], "dim": part["dim"], "block": part["block"], "shards": [a.astype(np.int32) for a in aims], "floor": part["floor"]})

    return queries.mapInPandas(run, "id long, w binary, dim int, block int, shards array<int>, floor double")


def _find(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches the shards that the queries aim at; a shard goes only to blocks with a query for it."""

    def run(q: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(tree):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        t = BallTree.load(tree["tree"].iloc[0])
        a, x, qi, floor = unpack(q["w"], t.x.shape[1]), t.x, q["id"].to_numpy(np.int64), q["floor"].to_numpy(np.float64)
        largest = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
        if largest(a) * largest(x) * max(1, a.shape[1]) < EXACT:
            rows, parts = x.astype(np.float64), range(0, len(a), 2048)
            parts = [(i, *search(a[i : i + 2048].astype(np.float64), qi[i : i + 2048], floor[i : i + 2048], t, rows, k)) for i in parts]
            row, found, score = np.concatenate([i + r for i, r, _, _ in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        else:  # beyond exact doubles: integers of any size, all rows
            row, found, score = [], [], []
            for i in range(len(a)):
                s = [(-sum(int(u) * int(v) for u, v in zip(a[i], w, strict=True)), int(j)) for w, j in zip(x, t.ids, strict=True) if j != qi[i]]
                for total, j in sorted(s)[:k]:
                    row.append(i), found.append(j), score.append(min(max(-total, -(1 << 63)), (1 << 63) - 1))
            row = np.array(row, np.int64)
        return pd.DataFrame({"query_id": qi[row], "vec_id": np.asarray(found, np.int64), "score": np.asarray(score).astype(np.int64)})

    aimed = queries.select("id", "w", "block", "floor", F.explode("shards").alias("shard"))
    keys = ["shard", "block"]
    pairs = aimed.select(*keys).distinct().toDF(*keys)
    needed = shards.join(pairs, "shard").toDF("shard", "tree", "block")  # both sides come from one table
    return aimed.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, id, score: the k best rows of the table for each of its rows that ``queries`` picks."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), quantise(F.col(vector_col), scale).alias("v")).withColumn("dim", F.size("v"))
    n, longest = rows.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    size = lambda dim: max(1, min(block, BLOCK * 64 // max(dim, 1)))
    wanted, layouts = min(CELLS, -(-n // size(longest))), {}
    if wanted > 1:
        sample = rows.orderBy(F.xxhash64("id", "v")).limit(max(1024, SAMPLE // max(longest, 1))).select("dim", "v").toPandas()
        for dim, same in sample.groupby("dim"):
            layouts[int(dim)] = Layout(int(dim), np.array([*same["v"]], np.int64).reshape(len(same), -1), max(1, round(wanted * len(same) / len(sample))))
    dealt = materialize(_deal(rows, layouts))
    found = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max("far").alias("far")).toPandas().sort_values(["dim", "cell"])
    numbers, cells, shard, first_block = [], {}, 0, 0
    for dim, same in found.groupby("dim"):
        count = -(-same["n"].to_numpy() // size(dim))
        first = shard + np.cumsum(count) - count
        centres = (layouts.get(int(dim)) or Layout(int(dim))).centres[same["cell"]]
        cells[int(dim)] = Cells(centres, same["far"].to_numpy() * (1 + 1e-9) + 1e-9, first, count)
        before = same["asks"].cumsum() - same["asks"]
        numbers += [tuple(map(int, v)) for v in zip(np.full(len(same), dim), same["cell"], first, count, before, same["asks"], np.full(len(same), 4 * size(dim)), np.full(len(same), first_block), strict=True)]
        shard, first_block = shard + int(count.sum()), first_block + int(same["asks"].sum()) // (4 * size(dim)) + 1
    numbers = spark.createDataFrame(numbers, "dim int, cell int, first int, count int, before long, asking long, size long, first_block int")
    dealt = dealt.join(F.broadcast(numbers), ["dim", "cell"]).withColumn("own", (F.col("first") + F.pmod("turn", "count")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(unpack(pdf["w"], int(pdf["dim"].iloc[0])), pdf["id"].to_numpy(np.int64), leaf)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "tree": [tree.dump()]})

    trees = materialize(dealt.select("id", "w", "dim", F.col("own").alias("shard")).groupBy("shard").applyInPandas(plant, "shard int, tree binary"))
    in_order = F.floor((F.col("before") + F.pmod("turn", F.greatest("asking", F.lit(1)))) / F.col("size"))
    asking = dealt.where("asks").select("id", "w", "dim", "own", "turn", (F.col("first_block") + in_order).cast("int").alias("block"), F.lit(float("-inf")).alias("floor")).dropDuplicates(["id", "w"])
    asking = materialize(_aim(asking, cells, False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _find(trees, asking, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if shard > 1:
        found = materialize(found)
        # a score at the end of the range is no bound
        kth = found.where((F.col("rank") == k) & (F.col("score") > -(1 << 62))).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
        rest = asking.withColumnRenamed("shards", "done").join(kth, "id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        rest = materialize(_aim(rest, cells, True).where(F.size("shards") > 0))
        found = found.drop("rank").unionByName(_find(trees, rest, k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
