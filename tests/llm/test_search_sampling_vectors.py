"""Lexical search, importance resampling and near vectors against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfront.llm import importance, lexical_search, near_vectors
from skyfront.llm import queries as llm

BIG = (1 << 60) + 1
DOCS = "doc_id long, text string, term string, rid long, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \t\n", "word", "Ünïcödé ß 漢字 🙂 É", "x" * 3000, "same text here twice", "same text here twice", "x\x00y\x0bz", "A.b-c_d'e 1st"]


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{min(int(rng.expovariate(1 / 12)), vocabulary)}" for _ in range(n))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def documents(spark, rows):
    """Ids and texts, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "a", 7, "b") for i, t in rows], DOCS).repartition(3)


def corpus(rng):
    rows = [(BIG + k, t) for k, t in enumerate(ODD)] + [(None, "w1 w2 w3"), (None, prose(rng, 25)), (5, "w1 w5 w7"), (5, "w1 w5 w7"), (6, "w1 w5 w7")]
    return rows + [(100 + k, prose(rng, rng.randint(1, 60))) for k in range(120)] + [(900, prose(rng, 30_000))]


# --- 11 lexical search


def brute_search(docs, items, k):
    terms = [Counter(words(t)) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), t in zip(docs, terms, strict=True):
            n, score = sum(t.values()), 0
            for w, c in Counter(words(text)).items():
                if t[w]:
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * t[w]) // (1000 * t[w] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"TERMS_BROADCAST": 3, "ROWS_BROADCAST": 0, "PIECE": 50}])
def test_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(11)
    docs = corpus(rng)
    items = [(1, "w1 w5 w5 w40"), (1, "w1 w5 w5 w40"), (2, None), (3, "nowhere"), (None, "Same TEXT"), (BIG, "é x y ü"), (4, prose(rng, 40)), (5, "")]
    got = lexical_search.search(documents(spark, docs), spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, term int"), k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 7)


def test_search_on_nothing(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == lexical_search.search(documents(spark, [(1, None)]), items).count() == 0


def test_terms_by_pieces():
    text = "Ab, é🙂 " * 300 + "y" * 5000 + " END"
    assert lexical_search.term_counts(text, 37) == lexical_search.term_counts(text, 1 << 20) == Counter(w.encode() for w in words(text))


def test_search_sums_without_another_shuffle(spark):
    """Impacts are dealt by document once; the sums by item and document take place there."""
    index = spark.createDataFrame([(-1, 0, 1, 2, None, 0), (0, 0, 1, 2, "a", 2)], "bucket int, rid long, id long, n long, term string, tf long")
    asked = spark.createDataFrame([(0, "a", 1)], "item long, term string, c long")
    plan = lexical_search.top_documents(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


# --- 12 importance resampling


def brute_resample(docs, target, order, buckets, percent, least):
    def feats(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, x in docs for f in feats(x)), Counter(at(f) for x in target for f in feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for doc, x in docs:
        f = feats(x)
        weight = sum(gain[at(v)] for v in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(ranked[: percent * len(ranked) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize(("order", "buckets"), [(1, 10_000), (1, 7), (3, 101)])
def test_resample(spark, order, buckets):
    rng = random.Random(12)
    docs, target = corpus(rng), [None, "", "w1 w2 W3 w2", prose(rng, 80)]
    items = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = importance.resample(documents(spark, docs), items, order, buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, target, order, buckets, 30, 20)


def test_resample_on_nothing(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([("a",)], "text string")
    assert importance.resample(docs.limit(0), items).count() == 0
    got = importance.resample(docs, items.limit(0), least_words=1, percent=100).collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(1, 1)]


# --- 13 near vectors


def brute_vectors(rows, threshold):
    ok = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    root[top(i)] = top(j)
    ids = {}
    for i, (v, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(v)
    least = {k: min((v for v in m if v is not None), default=None) for k, m in ids.items()}
    return sorted(((v, links[i], least[top(i)] if links[i] else v, v == (least[top(i)] if links[i] else v)) for i, (v, _) in enumerate(rows)), key=str)


def vectors():
    rng = np.random.default_rng(13)
    c, d = rng.normal(size=8), rng.normal(size=8)
    rows = [(BIG + i, (c + rng.normal(size=8) * 0.05).tolist()) for i in range(60)] + [(100 + i, (d + rng.normal(size=8) * 0.3).tolist()) for i in range(80)]
    rows += [(300 + i, rng.normal(size=8).tolist()) for i in range(50)] + [(500 + i, c.tolist()) for i in range(20)]
    rows += [(500, c.tolist()), (None, c.tolist()), (None, [1e200] * 8), (700, [1e-200] * 8), (701, None), (702, []), (703, [0.0] * 8), (704, [1.0] * 7 + [None]), (705, [math.nan] * 8), (None, None)]
    return rows + [(706, [1.0, 2.0]), (707, [2.0, 4.0]), (708, [-0.0, 1.0]), (709, [0.0, 1.0]), (710, [math.inf, 1.0])]


@pytest.mark.parametrize("sizes", [{}, {"block": 32, "leaf": 4, "group": 4}, {"block": 8, "leaf": 2, "group": 2}])
@pytest.mark.parametrize("threshold", [0.95, 0.7])
def test_near_vectors(spark, monkeypatch, sizes, threshold):
    monkeypatch.setattr(near_vectors, "WHOLE", 64 if sizes else near_vectors.WHOLE)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cid int, block string").repartition(3)
    got = near_vectors.near_vectors(df, threshold, **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_vectors(rows, threshold)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_traversal_counts_groups_by_nodes(monkeypatch):
    """Two thousand near copies are counted without comparing their pairs."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(1, 16))
    raw = np.vstack([centre + rng.normal(size=(2000, 16)) * 0.002, rng.normal(size=(500, 16))])
    compared = []
    old = near_vectors.Traversal.compare
    monkeypatch.setattr(near_vectors.Traversal, "compare", lambda self, i, j, own: (compared.append(len(i) * len(j)), old(self, i, j, own)))
    tree = near_vectors.CoverTree.plant(raw, np.arange(2500), np.ones(2500, np.int64), 0.04)
    got = near_vectors.Traversal(tree, tree, 0.95).rows().set_index("cid")["links"]
    x = raw / np.linalg.norm(raw, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert all(got.get(i, 0) == want[i] for i in range(2500)) and sum(compared) < 1_000_000
    again = near_vectors.CoverTree.load(tree.dump())
    assert (again.x == tree.x).all() and (again.nodes == tree.nodes).all()


def test_threshold_is_decided_exactly():
    """A pair that rounding could put on either side goes by correctly rounded sums."""
    a, b = np.array([[3.0, 4.0]]), np.array([[4.0, 3.0]])
    for threshold, links in ((0.96, 1), (np.nextafter(0.96, 1), 0)):
        t = near_vectors.CoverTree.plant(np.vstack([a, b]), np.arange(2), np.ones(2, np.int64), 0.01)
        assert near_vectors.Traversal(t, t, threshold).rows()["links"].sum() == 2 * links


# --- queries


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_importance", "op13_near_vectors"])
def test_query(spark, name):
    db, small = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = llm.queries()[name](spark, small)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)
    assert got.select(F.count("*")).first()[0] > 0
