"""Corpus pipeline: quality filter, near duplicates, repeated strings, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the
last, returns the columns of ``documents``.  A stage's result is written as Parquet in the shared folder and read again.

Defined results: null and empty texts score 0 for quality and go in the first stage (given to later stages, they pass
the n-gram join, the suffix dedup and the decontamination, and the mix takes nothing of them); of repeated rows with equal id and
text one stays in the n-gram join, of documents of one component that of least id; null ids are ids like others, and go before none;
a null source is a source of its own; an empty table passes every stage empty; columns other than those of ``documents``, whatever
their names, are dropped by the first stage that meets them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfront.llm import decontamination, mixing, ngram_join, quality, suffix_dedup
from skyfront.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word n-grams, similarity 0.8) stays, that of least id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), n=5, percent=80)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 200 bytes that occur elsewhere go; a character that loses a byte goes with it."""
    cleaned = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=[c for c in COLUMNS if c != "text"])
    kept = F.expr("string(kept)")
    text = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")))
    return cleaned.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_strings),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can't express the classifier; tests hold it against labels and each other stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    place = f"{shared_folder(spark)}/skyfront-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{place}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
