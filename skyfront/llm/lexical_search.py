"""Ranked lexical search: the documents that score highest for each item, over a term-bucketed table of postings.

**Index.**  A posting is a term of a document: (bucket, term, document, its number of terms, tf).  Postings are written as
Parquet in the shared folder, one folder a bucket of terms, sorted by term; the write rebalances by size, so a term that most
documents hold makes several files.  If the items' terms are few enough to be sent to every task (``TERMS_BROADCAST``), only their
postings are kept; otherwise all are.  Each document with a term also has a row of its own (bucket -1), from which the number
of documents and their terms are summed.

**Scores.**  Document frequencies give integer weights.  Each posting's impact is computed once, where it stands; impacts
are dealt out by document (a posting moves once, however many items ask for its term), join the items' terms there, and
are summed by item and document without another shuffle.  A window by item ranks them; Spark keeps at most k
rows a task and item before that window's shuffle.

All numbers but the weights are 64-bit integers, so sums don't depend on order.

Defined results: null and empty texts, and texts without terms, have no posting and count nowhere; items without terms, or whose
terms no document holds, give no row; every row of the items is an item (repeated rows each give their list), and every row of the
documents a document; null document ids come after others of equal score, equal ids in any order; a null item id is given
back as it is; empty tables give an empty result; a very long text is read by pieces and held as counts of its distinct terms;
other columns, whatever their names, are ignored.  A row is known by its place in the input until the index is written,
which is the same in a task that runs again if the table is read from files.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, shared_folder, text_slices

#: Bytes of terms, with capitals as small letters; all others as blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BUCKETS, TERMS_BROADCAST, ROWS_BROADCAST, PIECE = 16, 500_000, 1_000_000, 1 << 20


def term_counts(text: str, piece: int = PIECE) -> Counter[bytes]:
    """Terms of a text and how often they occur; the text is cut into pieces of bounded size, between terms."""
    if len(text) <= piece:
        return Counter(text.encode("utf-8", "replace").translate(TERM_BYTES).split())
    counts: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(text), piece):
        part = rest + text[at : at + piece].encode("utf-8", "replace").translate(TERM_BYTES)
        cut = len(part) if at + piece >= len(text) else part.rfind(b" ") + 1
        counts.update(part[:cut].split())
        rest = part[cut:]
    return counts


def _terms(df: DataFrame, schema: str, wanted: frozenset[bytes] | None) -> DataFrame:
    """(rid, id, n, term, tf) of each text's terms (those ``wanted``), and a row of null term for each text that has any."""
    shared = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for batch in batches:
            for part, texts in text_slices(batch):
                terms: list[str | None] = []
                tf, sizes, totals = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for i, text in enumerate(texts):
                    counts = term_counts(text) if text else {}
                    if not counts:
                        continue
                    kept = [*counts] if known is None else [t for t in counts if t in known]
                    terms.append(None), tf.append(0)
                    terms += [t.decode("utf-8", "replace") for t in kept]
                    tf += [counts[t] for t in kept]
                    sizes[i], totals[i] = len(kept) + 1, sum(counts.values())
                at = pa.array(np.repeat(np.arange(len(texts)), sizes))
                yield pa.RecordBatch.from_arrays([part.column("rid").take(at), part.column("id").take(at), pa.array(totals).take(at), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], ["rid", "id", "n", "term", "tf"])
        release()

    return df.mapInArrow(run, schema)


def postings(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rid, id, n, term, tf): the postings of all terms, or of the distinct ``terms``, and a row of null term (bucket -1) for each document with a term."""
    wanted = None
    if terms is not None and terms.limit(TERMS_BROADCAST + 1).count() <= TERMS_BROADCAST:
        wanted = frozenset(r[0].encode("utf-8", "replace") for r in terms.select("term").toLocalIterator())
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _terms(rows, f"rid long, id {docs.schema[id_col].dataType.simpleString()}, n long, term string, tf long", wanted)
    return found.select(F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int").alias("bucket"), "*")


def write_index(found: DataFrame, path: str) -> DataFrame:
    """Postings as Parquet by bucket, sorted by term, in files of even size."""
    found.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "rid").write.partitionBy("bucket").parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def term_weights(index: DataFrame, n_docs: int) -> DataFrame:
    """(term, w): floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    df = index.where("bucket >= 0").groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"))


def impact(n_docs: int, n_terms: int, percent: int, k1: int) -> Column:
    """What a posting adds a unit of weight: (10^9 tf) div (1000 tf + k1 m), with m the length's share in percent."""
    return F.expr(f"(1000000000 * tf) div (1000 * tf + {k1} * ({100 - percent} + (({percent} * n * {n_docs}) div {max(n_terms, 1)})))")


def top_documents(index: DataFrame, asked: DataFrame, k: int = 20, percent: int = 25, k1: int = 12) -> DataFrame:
    """(item, rank, id, score): the k best documents for each item; ``asked``: (item, term, c), a term's occurrences in the item."""
    size = index.where("bucket = -1").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weighted = materialize(asked.join(term_weights(index, size["docs"]), "term").where("w > 0").select("item", "term", (F.col("c") * F.col("w")).alias("w")))
    added = index.where("bucket >= 0").select("rid", "id", "term", impact(size["docs"], size["terms"], percent, k1).alias("x")).repartition("rid")
    # where the items' terms fit into every task, rows stay dealt by document and the sums need no exchange
    met = added.join(_small(weighted, ROWS_BROADCAST), "term")
    scores = met.groupBy("item", "rid", "id").agg(F.sum(F.col("w") * F.col("x")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, percent: int = 25, k1: int = 12, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """item id, rank, document id, score: the k highest-scoring documents of every row of ``items``; the index goes when the rows are found."""
    spark = docs.sparkSession
    rows = materialize(items.select(F.monotonically_increasing_id().alias("rid"), F.col(item_id).alias("id"), F.col(item_text).alias("text")))
    kind = items.schema[item_id].dataType.simpleString()
    asked = materialize(_terms(rows, f"rid long, id {kind}, n long, term string, tf long", None).where("term IS NOT NULL").select(F.col("rid").alias("item"), "term", F.col("tf").alias("c")))
    path = f"{shared_folder(spark)}/skyfront-postings-{uuid.uuid4().hex}"
    index = write_index(postings(docs, asked.select("term").distinct(), id_col, text_col, buckets), path)
    found = materialize(top_documents(index, asked, k, percent, k1))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    named = found.join(rows.select(F.col("rid").alias("item"), F.col("id").alias("of")), "item")
    return named.select(F.col("of").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
