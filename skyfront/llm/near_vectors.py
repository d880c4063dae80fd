"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

On unit vectors cosine >= t means a distance of at most sqrt(2 - 2 t).  Equal vectors are one class, represented once and counted
by their copies.  Space is cut into at most ``CELLS`` cells from a bounded sample, a cell's classes dealt into blocks of
bounded size, and each block's cover tree is built once and kept: nested levels with halving radii, a node's members
within its radius of its centre; what no centre of a level groups goes on to the next level together, and what no level groups is
a leaf of its own.

**Pairs of blocks.**  Balls of cells, then of blocks, are too far apart (left out), so close that all their members link (counted as wholes,
no vector moves), or open.  Open pairs are the tasks of a dual traversal: pairs of nodes are left out or
taken whole by their centres' distance and covering radii, and a leaf's points by their distance from the other node's
ball; only what remains is compared.  So a group of near copies is counted by nodes, not by its pairs.

**Links.**  A task returns for each class how many vectors it links to and one edge towards the least member of its linked
group within the task, never a row a pair.  Components of the edges are found in rounds.  The sample shapes cells only; results don't
depend on it.  Pairs whose cosine is within 1e-12 of the threshold are decided from correctly rounded sums.

To the driver come the sample (``SAMPLE`` components, or 1024 vectors) and a row a cell.  Where vectors spread so evenly that no ball
is small against the distances between them, nearly all pairs of blocks are open and the work is that of comparing all vectors, in matrix products.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different length are not compared; 0.0 and -0.0 are equal; repeated rows each give a row and count as links of
each other; a null id takes part, is a component's id only if no member has an id, and is kept then; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release
from .top_k import CELLS, SAMPLE, Layout, finite

#: Classes of a block (of 64 components), points of a leaf, least members of a node below the root, candidate centres a level.
BLOCK, LEAF, GROUP, CENTRES = 16_384, 64, 64, 256
SLACK, DOUBT = 1e-9, 1e-12
WHOLE = 1 << 16  # comparisons up to which two nodes are compared without going further down


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, 4 a component where that is exact, else 8."""
    with np.errstate(over="ignore"):
        narrow = x.astype("<f4")
    short = (narrow == x).all(1)
    return [(narrow[i] if s else x[i].astype("<f8")).tobytes() for i, s in enumerate(short)]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in packed], np.float64).reshape(len(packed), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square leaves the range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """From correctly rounded sums."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    dot = lambda u, v: math.fsum((u * v).tolist())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


@dataclass
class CoverTree:
    """Nodes over points that stand in the tree's order; a node's children follow each other."""

    raw: np.ndarray
    cids: np.ndarray
    copies: np.ndarray
    nodes: np.ndarray  # from, to, first child, children
    centres: np.ndarray
    radii: np.ndarray

    def __post_init__(self) -> None:
        self.x = unit(self.raw)

    @classmethod
    def plant(cls, raw: np.ndarray, cids: np.ndarray, copies: np.ndarray, finest: float, leaf: int = LEAF, group: int = GROUP) -> CoverTree:
        """``finest``: radius below which points aren't grouped any more."""
        x, order = unit(raw), np.arange(len(raw))
        nodes, centres, radii = [], [], []
        todo: list[tuple[int, int, float, np.ndarray | None]] = [(0, len(x), 2.0, None)]
        for lo, hi, reach, centre in todo:  # grows as it goes
            rows = order[lo:hi]
            centre = x[rows].mean(0) if centre is None else centre
            centres.append(centre)
            radii.append(math.sqrt(((x[rows] - centre) ** 2).sum(1).max()) * (1 + 1e-12) + 1e-12)
            nodes.append([lo, hi, 0, 0])
            if hi - lo <= leaf:
                continue
            while reach >= finest:
                reach /= 2
                which, chosen = _net(x[rows], reach, group)
                if len(chosen) > 1 or len(chosen) == 1 and (which < 0).any():
                    break
            else:
                continue
            by = np.argsort(np.where(which < 0, len(chosen), which), kind="stable")
            order[lo:hi] = rows[by]
            sizes = np.bincount(np.where(which < 0, len(chosen), which), minlength=len(chosen) + 1)
            ends = lo + np.cumsum(sizes)
            nodes[-1][2:] = [len(todo), len(chosen) + int(sizes[-1] > 0)]
            todo += [(int(e - n), int(e), reach, x[rows[c]]) for e, n, c in zip(ends, sizes, chosen, strict=False)]
            if sizes[-1]:
                todo.append((int(ends[-1] - sizes[-1]), int(ends[-1]), reach, None))
        return cls(raw[order], cids[order], copies[order], np.array(nodes), np.array(centres), np.array(radii))

    def dump(self) -> bytes:
        to = io.BytesIO()
        with np.errstate(over="ignore"):
            narrow = self.raw.astype("<f4")
        raw = narrow if (narrow == self.raw).all() else self.raw
        np.savez(to, raw=raw, cids=self.cids, copies=self.copies, nodes=self.nodes, centres=self.centres, radii=self.radii)
        return to.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw), allow_pickle=False) as f:
            return cls(f["raw"].astype(np.float64), *(f[name] for name in ("cids", "copies", "nodes", "centres", "radii")))


def _net(x: np.ndarray, reach: float, group: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its group or -1, and the points at the groups' centres, further than ``reach`` apart."""
    picks = np.unique(np.linspace(0, len(x) - 1, CENTRES).astype(np.int64))
    far = 1 - reach**2 / 2  # cosine at that distance
    near = x[picks] @ x[picks].T >= far
    free, chosen = np.ones(len(picks), bool), []
    for i in range(len(picks)):
        if free[i]:
            chosen.append(i)
            free &= ~near[i]
    picks = picks[chosen]
    which = np.full(len(x), -1)
    for at in range(0, len(x), 4096):
        c = x[at : at + 4096] @ x[picks].T
        which[at : at + 4096] = np.where(c.max(1) >= far, c.argmax(1), -1)
    large = np.flatnonzero(np.bincount(which[which >= 0], minlength=len(picks)) >= group)
    names = np.full(len(picks) + 1, -1)
    names[large] = np.arange(len(large))
    return names[which], picks[large]


class Forest:
    """Linked groups of the points of a task."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        apart = a != b
        if not apart.any():
            return
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        over: dict[int, int] = {}

        def top(v: int) -> int:
            while v in over:
                v = over[v]
            return v

        for key in np.unique(a * len(self.root) + b).tolist():
            u, v = sorted((top(key // len(self.root)), top(key % len(self.root))))
            if u != v:
                over[v] = u
        for v in over:
            self.root[v] = top(v)
        self.root = self.root[self.root]


class Traversal:
    """Counts of links between two trees (or within one), and the groups that they make."""

    def __init__(self, a: CoverTree, b: CoverTree, threshold: float) -> None:
        self.a, self.b, self.same, self.threshold = a, b, a is b, threshold
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.shift = 0 if self.same else len(a.x)
        self.forest = Forest(len(a.x) + (0 if self.same else len(b.x)))
        self.add_a = np.zeros(len(a.x), np.int64)
        self.add_b = self.add_a if self.same else np.zeros(len(b.x), np.int64)
        todo = [(0, 0)]
        while todo:
            todo += self.visit(*todo.pop())

    def visit(self, i: int, j: int) -> list[tuple[int, int]]:
        a, b = self.a, self.b
        lo, hi, first, children = a.nodes[i].tolist()
        if self.same and i == j:
            if 2 * a.radii[i] <= self.reach - SLACK:
                self.add_a[lo:hi] += a.copies[lo:hi].sum() - a.copies[lo:hi]
                self.forest.join(np.arange(lo, hi), np.full(hi - lo, lo))
                return []
            if not children:
                self.compare(np.arange(lo, hi), np.arange(lo, hi), True)
            return [(first + k, first + m) for k in range(children) for m in range(k, children)]
        lo2, hi2, first2, children2 = b.nodes[j].tolist()
        between = math.sqrt(((a.centres[i] - b.centres[j]) ** 2).sum())
        if between - a.radii[i] - b.radii[j] > self.reach + SLACK:
            return []
        if between + a.radii[i] + b.radii[j] <= self.reach - SLACK:
            self.whole(np.arange(lo, hi), np.arange(lo2, hi2))
            return []
        if not children and not children2 or (hi - lo) * (hi2 - lo2) <= WHOLE:
            own, other = self.outside(a, lo, hi, b, j, False), self.outside(b, lo2, hi2, a, i, True)
            if len(own) and len(other):
                self.compare(own, other, False)
            return []
        if children and (not children2 or a.radii[i] >= b.radii[j]):
            return [(first + k, j) for k in range(children)]
        return [(i, first2 + k) for k in range(children2)]

    def outside(self, tree: CoverTree, lo: int, hi: int, ball: CoverTree, node: int, second: bool) -> np.ndarray:
        """Points that the ball may hold partners of; those near all of the first tree's ball are counted and left out."""
        away = np.sqrt(((tree.x[lo:hi] - ball.centres[node]) ** 2).sum(1))
        open_ = away - ball.radii[node] <= self.reach + SLACK
        if not second:
            all_ = away + ball.radii[node] <= self.reach - SLACK
            if all_.any():
                start, end = ball.nodes[node][:2]
                self.whole(lo + np.flatnonzero(all_), np.arange(start, end))
            open_ &= ~all_
        return lo + np.flatnonzero(open_)

    def whole(self, i: np.ndarray, j: np.ndarray) -> None:
        self.add_a[i] += self.b.copies[j].sum()
        self.add_b[j] += self.a.copies[i].sum()
        self.forest.join(i, np.full(len(i), j[0] + self.shift))
        self.forest.join(np.full(len(j), i[0]), j + self.shift)

    def compare(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        x, y = self.a.x[i], self.b.x[j]
        for at in range(0, len(i), 256):
            c = x[at : at + 256] @ y.T
            linked = c >= self.threshold
            for r, s in zip(*np.nonzero(np.abs(c - self.threshold) < DOUBT), strict=True):
                linked[r, s] = cosine(self.a.raw[i[at + r]], self.b.raw[j[s]]) >= self.threshold
            if own:
                linked[np.arange(len(c)), np.arange(at, at + len(c))] = False
            r, s = np.nonzero(linked)
            if len(r):
                self.add_a[i] += np.bincount(at + r, weights=self.b.copies[j[s]], minlength=len(i)).astype(np.int64)
                if not own:
                    self.add_b[j] += np.bincount(s, weights=self.a.copies[i[at + r]], minlength=len(j)).astype(np.int64)
                self.forest.join(i[at + r], j[s] + self.shift)

    def rows(self) -> pd.DataFrame:
        """cid, links, and another class of the same group (or the class itself), of the classes with links."""
        cids = self.a.cids if self.same else np.concatenate([self.a.cids, self.b.cids])
        add = self.add_a if self.same else np.concatenate([self.add_a, self.add_b])
        some = add > 0
        return pd.DataFrame({"cid": cids[some], "links": add[some], "near": cids[self.forest.root][some]})


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, ka, kb, w): packed vectors with a key by which equal ones are equal; null where the vector takes no part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = finite(F.col(vector_col)) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                packed, keys = [None] * len(same), np.zeros((len(same), 2), np.int64)
                if dim:
                    x = same.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(same), dim) + 0.0
                    packed = pack(x)
                    keys = np.frombuffer(b"".join(hashlib.md5(r.tobytes()).digest() for r in x), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([same.column("id"), same.column("dim"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(packed, pa.binary())], ["id", "dim", "ka", "kb", "w"])
        release()

    rows = vectors.select(F.col(id_col).alias("id"), F.when(ok, F.size(v)).otherwise(0).alias("dim"), F.when(ok, v).otherwise(F.array().cast("array<double>")).alias("v"))
    return rows.mapInArrow(run, f"id {kind}, dim int, ka long, kb long, w binary")


def _dealt(classes: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """The classes with their cell, distance from its centre, and a number that is dealt out evenly."""
    shared = classes.sparkSession.sparkContext.broadcast(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                x = unit(unpack(same.column("w").to_pylist(), int(dim)))
                layout = shared.value.get(int(dim)) or Layout(int(dim))
                cells = layout.cells(x)
                far = np.sqrt(((x - layout.centres[cells]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*(same.column(c) for c in ("cid", "copies", "dim", "w")), pa.array(cells.astype(np.int32)), pa.array(far), pa.array(np.arange(turn, turn + len(same)))], ["cid", "copies", "dim", "w", "cell", "far", "turn"])
                turn += len(same)

    return classes.select("cid", "copies", "dim", "w").mapInArrow(run, "cid long, copies long, dim int, w binary, cell int, far double, turn long")


def _block_pairs(roots: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """(a, b, whole): pairs of blocks that may link, a block with itself included; ``whole`` if all their members do."""
    side = lambda s: roots.select("dim", F.col("cell").alias(f"cell_{s}"), F.col("block").alias(s), F.col("centre").alias(f"centre_{s}"), F.col("radius").alias(f"radius_{s}"))
    pairs = F.broadcast(cells).join(side("a"), ["dim", "cell_a"]).join(side("b"), ["dim", "cell_b"]).where((F.col("cell_a") < F.col("cell_b")) | (F.col("a") <= F.col("b")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, p in batch.groupby("dim", sort=False):
                away = np.array([np.frombuffer(c) for c in p["centre_a"]]) - np.array([np.frombuffer(c) for c in p["centre_b"]])
                between = np.sqrt((away**2).sum(1))
                both = (p["radius_a"] + p["radius_b"]).to_numpy()
                same = (p["a"] == p["b"]).to_numpy()
                whole = ~same & (between + both <= reach - SLACK)
                stay = same | (between - both <= reach + SLACK)
                yield pd.DataFrame({"a": p["a"], "b": p["b"], "whole": whole})[stay]

    return pairs.select("dim", "a", "b", "centre_a", "centre_b", "radius_a", "radius_b").mapInPandas(run, "a int, b int, whole boolean")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked with it), component_id (least id that links reach), kept (whether that is its own)."""
    spark, reach = vectors.sparkSession, math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = materialize(_rows(vectors, id_col, vector_col))
    key = ["dim", "ka", "kb"]
    classes = rows.where("dim > 0").groupBy(*key).agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.any_value("w").alias("w"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    size = lambda dim: max(1, min(block, BLOCK * 64 // dim))
    wanted, layouts = min(CELLS, -(-n // size(longest))), {}
    if wanted > 1:
        sample = classes.orderBy("ka", "kb").limit(max(1024, SAMPLE // longest)).select("dim", "w").toPandas()
        for dim, same in sample.groupby("dim"):
            layouts[int(dim)] = Layout(int(dim), unit(unpack([*same["w"]], int(dim))), max(1, round(wanted * len(same) / len(sample))))
    dealt = materialize(_dealt(classes, layouts))
    found = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas().sort_values(["dim", "cell"])
    numbers, near, first = [], [], 0
    for dim, same in found.groupby("dim"):
        centres, far = (layouts.get(int(dim)) or Layout(int(dim))).centres[same["cell"]], same["far"].to_numpy()
        for c, count in zip(same["cell"].tolist(), (-(-same["n"] // size(dim))).tolist(), strict=True):
            numbers.append((int(dim), c, first, count))
            first += count
        for i, c in enumerate(same["cell"].tolist()):
            between = np.sqrt(((centres[i:] - centres[i]) ** 2).sum(1))
            near += [(int(dim), c, int(d)) for d in same["cell"].to_numpy()[i:][between - far[i:] - far[i] <= reach + SLACK]]
    numbers = spark.createDataFrame(numbers, "dim int, cell int, first int, count int")
    near = spark.createDataFrame(near, "dim int, cell_a int, cell_b int")
    dealt = dealt.join(F.broadcast(numbers), ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod("turn", "count")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = unpack([*pdf["w"]], int(pdf["dim"].iloc[0]))
        tree = CoverTree.plant(raw, pdf["cid"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64), reach / 8, leaf, group)
        own = {c: [int(pdf[c].iloc[0])] for c in ("block", "dim", "cell")}
        return pd.DataFrame(own | {"centre": [tree.centres[0].tobytes()], "radius": [tree.radii[0]], "members": [int(tree.copies.sum())], "lead": [int(tree.cids[0])], "tree": [tree.dump()]})

    trees = materialize(dealt.select("cid", "copies", "dim", "cell", "w", "block").groupBy("block").applyInPandas(plant, "block int, dim int, cell int, centre binary, radius double, members long, lead long, tree binary"))
    roots = materialize(trees.drop("tree"))
    pairs = materialize(_block_pairs(roots, near, reach))

    def meet(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a = CoverTree.load(own["tree"].iloc[0])
        b = a if own["a"].iloc[0] == own["b"].iloc[0] else CoverTree.load(other["tree"].iloc[0])
        out = Traversal(a, b, threshold).rows()
        release()
        return out

    open_ = pairs.where("not whole").select("a", "b")
    # toDF gives new columns, as both sides come from the same tables
    own = open_.join(trees.select(F.col("block").alias("a"), "tree"), "a").select("a", "b", "tree").toDF("a", "b", "tree").groupBy("a", "b")
    other = open_.join(trees.select(F.col("block").alias("b"), "tree"), "b").select("a", "b", "tree").toDF("a", "b", "tree").groupBy("a", "b")
    links = materialize(own.cogroup(other).applyInPandas(meet, "cid long, links long, near long"))
    edges = links.where("cid <> near").select(F.col("cid").alias("a"), F.col("near").alias("b"))
    whole = pairs.where("whole").select("a", "b")
    if whole.limit(1).count():
        # each block with every block that it links to as a whole
        both = whole.union(whole.select("b", "a")).join(roots.select(F.col("block").alias("b"), "members", F.col("lead").alias("far")), "b")
        told = materialize(both.groupBy(F.col("a").alias("block")).agg(F.sum("members").alias("links"), F.min("far").alias("near")))
        each = materialize(dealt.select("cid", "block").join(told, "block").select("cid", "links", "near"))
        leads = both.join(roots.select(F.col("block").alias("a"), F.col("lead").alias("own")), "a").where("own < far").select(F.col("own").alias("a"), F.col("far").alias("b"))
        links = links.unionByName(each)
        edges = edges.unionByName(each.select(F.col("cid").alias("a"), F.col("near").alias("b"))).unionByName(leads)
    labels = connected_components(edges)
    named = classes.select(*key, "cid", "copies", "least").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = materialize(named.join(labels.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")))
    told = materialize(named.join(least, "label").select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.select("id", *key).join(told, key, "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
