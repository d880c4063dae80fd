"""Target-distribution importance resampling over hashed n-grams from a position table.

**Features.**  A text's words are posexploded into a table of positions; for each order above one, ``lead`` over a
document's positions puts the words that follow next to each word, so that every run of 1 to ``order`` words is a row.
A feature's bucket is the CRC-32 of its words, joined by one space, modulo ``buckets``.

**Gains.**  Features are counted by bucket over all documents and over all target texts, combined before the shuffle;
a bucket's gain is floor(1000 * ln) of the smoothed share in the target by that in the documents.  Gains are at most
``buckets`` rows, a parameter, and are sent to every task.

**Draw.**  Features join the gains and are summed by document; a document's weight is the floored mean, its score adds
Gumbel noise from a hash of ``seed`` and id, so that the highest scores are a sample without replacement by weight.  One
range sort by score numbers the rows; what is beyond ``percent`` of the documents of at least ``least_words`` words is not drawn.

The documents are read twice (once for the counts, once for the sums) and nothing of the size of their words is stored
or, for order 1, shuffled.

Defined results: null and empty texts, and texts without words, have no feature, weight 0 and are never drawn; null ids
hash as the empty string and come after others among equal scores; repeated rows each give a row and count each;
rows equal in score and id are numbered in any order; an empty target or document table has no counts, which smoothing
covers; a very long text is one array of words in the JVM and one row a word from then on; other columns, whatever their
names, are ignored.  A row is known by its place in the input, which is the same in a task that runs again if ``docs`` is read from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from .common import materialize
from .decontamination import words_of

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The position table: (rid, id, n_words, pos, word); a document without words has one row, of null position."""
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    return words.select("rid", "id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))


def features(table: DataFrame, order: int = 1) -> DataFrame:
    """(rid, id, n_words, feature): the runs of 1 to ``order`` words of a position table; one null where there are none."""
    if order == 1:
        return table.select("rid", "id", "n_words", F.col("word").alias("feature"))
    next_words = Window.partitionBy("rid").orderBy("pos")
    table = table.select("*", *(F.lead("word", k).over(next_words).alias(f"word{k}") for k in range(1, order)))
    runs = [F.col("word")]
    for n in range(2, order + 1):
        last = F.col(f"word{n - 1}")
        runs.append(F.when(last.isNotNull(), F.concat_ws(" ", "word", *(f"word{k}" for k in range(1, n)))))
    runs = F.filter(F.array(*runs), lambda f: f.isNotNull())
    return table.select("rid", "id", "n_words", F.explode_outer(runs).alias("feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def bucket_counts(texts: DataFrame, order: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket."""
    table = positions(texts.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id")
    return features(table, order).where(F.col("feature").isNotNull()).groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that ``raw`` holds, from both sides' counts."""
    total = lambda df: F.lit(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    s_all, t_all = total(raw), total(target)
    both = raw.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    t = F.coalesce("t", F.lit(0))
    share = ((t + 1) * (s_all + buckets)).cast("double") / ((F.col("s") + 1) * (t_all + buckets)).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, order: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, n_words, n_features, weight): the floored mean gain of each document's features."""
    found = features(positions(docs, id_col, text_col), order).withColumn("bucket", bucket(F.col("feature"), buckets))
    summed = found.join(F.broadcast(gain), "bucket", "left").groupBy("rid", "id", "n_words").agg(F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return summed.select("rid", "id", "n_words", "n_features", mean.cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u in (0, 1) from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row per document: id, n_features, weight, score, and for those drawn ``rank`` from 1, the highest score first."""
    gain = materialize(gains(materialize(bucket_counts(docs, order, buckets, text_col)), materialize(bucket_counts(target, order, buckets, target_text)), buckets))
    rows = weights(docs, gain, order, buckets, id_col, text_col)
    rows = materialize(rows.select("rid", "id", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("long")))
    drawn = percent * rows.where("long").count() // 100
    placed = numbered(rows, [F.desc("long"), F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")], name="place")
    rank = F.when(F.col("long") & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))
