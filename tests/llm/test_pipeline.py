"""The pipeline's stages, each against a plain version or labels, and the registered queries."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyfront.llm.queries import oracle_sql, queries

from .test_operators import brute_components, brute_hits

SMALL = "/root/testdata/sf0.001"


def plain_repeats(texts, n=200):
    """What is left of the texts without the bytes under strings of ``n`` bytes that start anywhere else too."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(t[i : i + n], digest_size=12).digest() for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[hashlib.blake2b(t[i : i + n], digest_size=12).digest()] > 1:
                gone[i : i + n] = b"\x01" * n
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def agreement(labels, ids, kept):
    told = [(labels[i] == 1) == (i in kept) for i in ids if labels.get(i) is not None]
    return sum(told) / len(told)


def test_quality_stage_keeps_what_is_labelled_good(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.filter_quality(spark, docs, folder).collect()}
    assert agreement(labels, [r["doc_id"] for r in docs.select("doc_id").collect()], kept) > 0.95


def test_stages(spark):
    """Each stage on all that its predecessor kept: the classifier against labels, the others against plain versions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("_key", F.lit(1)), SMALL)
        before, rows = {r["doc_id"]: r for r in docs.collect()}, out.collect()
        got, texts = {r["doc_id"]: r for r in rows}, [r["text"] for r in before.values()]
        assert out.columns == corpus_pipeline.COLUMNS and len(rows) == len(got)
        if name == "quality classifier":
            assert agreement(labels, before, got) > 0.75  # of 87 labelled documents, the training rows
        elif name == "n-gram Jaccard join":
            ids, label = [*before], [v for _, v in brute_components(texts, 5, 80)]
            least = {}
            for i, v in zip(ids, label, strict=True):
                least[v] = min(least.get(v, i), i)
            assert set(got) == set(least.values()) and all(got[i] == before[i] for i in got)
        elif name == "suffix-array dedup":
            assert {i: r["text"] for i, r in got.items()} == dict(zip(before, plain_repeats(texts), strict=True)) and all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            clean = [i for i, hit in zip(before, brute_hits(texts, items), strict=True) if not hit[4]]
            assert set(got) == set(clean) and all(got[i] == before[i] for i in got)
        docs = spark.createDataFrame(rows, docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert mixed and all(0 < r["taken"] <= 3 * r["size"] for r in mixed)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for r in mixed for t in [next(d["text"] for d in rows if d["doc_id"] == r["doc_id"])])
    for source in {r["source"] for r in mixed}:
        own = [r for r in mixed if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 0.5)


def test_run_writes_stages(spark, monkeypatch):
    plain = [(n, lambda spark, docs, sf_dir, k=k: docs.where(F.col("doc_id") % 7 != k)) for k, (n, _) in enumerate(corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", plain)
    out = corpus_pipeline.run(spark, SMALL)
    assert out.inputFiles() and all("/skyfront-pipeline-" in f and "/3/" in f for f in out.inputFiles())
    assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 7 > 4").count()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want, key=str)


def test_odd_input(spark):
    """Nulls in any column, empty and white texts, repeated rows, and no rows at all pass every stage."""
    rows = [(1, None, None, None, None), (None, "some words " * 30, "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \t", None, "s", 1), (None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in corpus_pipeline.STAGES:
        for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
            # columns that stages use names of
            out = stage(spark, docs.withColumns({c: F.lit("x") for c in ("key", "row", "tag", "name", "score", "which", "id", "z", "_key")}), SMALL)
            got = out.collect()
            assert len(got) <= docs.count() and (docs.isEmpty() is False or not got)
            if name == "quality classifier":
                assert all(r["text"] for r in got)
            elif name == "mixing sources to target weights":
                assert all(r["taken"] > 0 for r in got)
            else:
                assert out.columns == corpus_pipeline.COLUMNS
                if got:  # only the repeated row goes
                    assert len(got) == (5 if name == "n-gram Jaccard join" else 6)


def test_names():
    names = set(queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"} and set(oracle_sql()) <= names
