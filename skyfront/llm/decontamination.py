"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

**Phrases.**  An item's *windows* are its runs of ``window`` words (the whole item, if it has fewer).  A window is looked for
by its rarest terms, by counts over all training texts.  The index stores a posting per occurrence of these terms:
text, position and, for a window's very rarest term, the words around it.  The lists of a window's ``LISTS`` rarest terms, each shifted
by the term's offset, are intersected: an aggregate by a hash of (window, text, start) collects which lists meet there.  Of the
places where all do, the words around are compared with the whole window.

**Proximity.**  The lists of the two rarest terms of an item are paired where they stand at most ``slop`` words out of place in one text.

The benchmark is the small side.  Its terms go into the plan as a set, at most ``terms_per_pass`` of them
at a time: a larger benchmark is indexed in as many passes over the training texts, and its windows are joined
by shuffle.  Documents of equal text share their postings, and everything is keyed by a 128-bit text key.  Texts with
hits are broadcast up to ``BROADCAST_TEXTS`` of them, and joined by shuffle beyond.

Defined results: null texts have no words, items without words no window; items of equal text are all
hit; an item of null id hits words but is neither counted nor listed; repeated documents and null ids each give a row; empty tables give
empty results or no hits; very long texts are one array of words in the JVM; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, text_key

#: Anything but digits, lower-case letters and characters beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERMS_PER_PASS, WINDOWS_BROADCAST, BROADCAST_TEXTS, PLACES_BROADCAST = 50_000, 200_000, 100_000, 1_000_000
#: Posting lists of a window that are intersected.
LISTS = 3


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Distinct windows: ``words`` array and ``items``, the ids of the items that hold it."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))))
    return w.select("item", F.slice("all", F.col("at"), window).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text", terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """(term, n): occurrences in all training texts of the given distinct terms, 0 included; too many to send to every task are counted by shuffle."""
    seen = docs.select(F.explode(words_of(F.col(text_col))).alias("term"))
    if terms.count() <= terms_per_pass:
        seen = seen.join(F.broadcast(terms), "term", "left_semi")
    return terms.join(seen.groupBy("term").count(), "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, text_col: str = "text", context: int = 12, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """The positional index of some terms: (term, key, n_words, pos, first, around).

    ``terms``: distinct ``term`` and ``led``, whether words around are wanted.  ``key`` is the text's key, ``pos`` the 0-based
    word position, ``around`` the words from position ``first`` up to ``context`` words after the term, or null.
    """
    terms = materialize(terms)
    passes = max(1, -(-terms.count() // terms_per_pass))
    d = docs.select(text_key(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("w"))

    def some(p: int) -> DataFrame:
        own = [*terms.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == p).orderBy("term").toLocalIterator()]
        plain, led = ([F.lit(r["term"]) for r in own if r["led"] == k] for k in (False, True))
        kind = lambda w, i: F.struct(i.alias("i"), (w.isin(*led) if led else F.lit(False)).alias("led"))
        at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(*plain, *led) if own else F.lit(False), kind(w, i))), lambda s: s.isNotNull())

        def posting(s: Column) -> Column:
            i = s["i"]
            near = F.slice("w", F.greatest(F.lit(1), i - context + 1), F.least(i, F.lit(context)) + context + 1)
            return F.struct(F.element_at("w", i + 1).alias("term"), i.alias("pos"), F.greatest(F.lit(0), i - context).alias("first"), F.when(s["led"], near).alias("around"))

        out = d.select("key", F.size("w").alias("n_words"), F.explode(F.transform(at, posting)).alias("p"))
        return out.select("p.term", "key", "n_words", "p.pos", "p.first", "p.around")

    return reduce(DataFrame.unionByName, map(some, range(passes)))


def window_lists(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows that may occur, with ``lists``: place, term and offset of their rarest terms, the rarest first."""
    t = windows.select("words", "items", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    by_rarity = t.groupBy("words", "items").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("all"))
    few = F.slice("all", 1, LISTS)
    lists = F.transform(few, lambda x, j: F.struct(j.alias("j"), x["term"].alias("term"), x["offset"].alias("offset")))
    return by_rarity.where(F.col("all")[0]["n"] > 0).select(F.xxhash64("words").alias("window"), "words", "items", lists.alias("lists"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, n_words, start, length, items): every occurrence of a window in an indexed text; ``windows`` as of :func:`window_lists`."""
    each = materialize(windows.select("window", F.size("lists").alias("size"), F.explode("lists").alias("l")).select("window", "size", "l.j", "l.term", "l.offset"))
    met = index.join(_small(each, LISTS * WINDOWS_BROADCAST), "term").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    met = met.withColumn("place", F.xxhash64("window", "key", "start"))  # two places of one hash would only be compared in vain
    full = met.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("lists"), F.max("size").alias("size"))
    full = materialize(full.where(F.col("lists") == F.expr("shiftleft(1, size) - 1")).select("place"))
    led = met.where("j = 0").join(_small(full, PLACES_BROADCAST), "place", "left_semi")
    led = led.groupBy("window", "key", "n_words", "start").agg(F.min("first").alias("first"), F.first("around").alias("around"))
    held = led.join(_small(windows.select("window", "words", "items"), WINDOWS_BROADCAST), "window")
    there = F.slice("around", F.greatest(F.lit(1), F.col("start") - F.col("first") + 1), F.size("words"))
    return held.where((F.col("start") >= F.col("first")) & (there == F.col("words"))).select("key", "n_words", "start", F.size("words").alias("length"), "items")


def rarest_pairs(items: DataFrame, counts: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, a, b): term and first offset of the two rarest terms of each item with an id; of a single distinct term, twice that."""
    whole = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.col("item").isNotNull())
    terms = whole.select("item", F.posexplode("words").alias("offset", "term")).groupBy("item", "term").agg(F.min("offset").alias("offset"))
    ranked = terms.join(counts, "term").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("n", "term")))
    return ranked.where("r <= 2").groupBy("item").agg(F.min_by(F.struct("term", "offset"), "r").alias("a"), F.max_by(F.struct("term", "offset"), "r").alias("b"))


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int = 5) -> DataFrame:
    """(item, key, pos, shift): places where an item's two rarest terms stand at most ``slop`` words out of place.

    An item with a single distinct term matches wherever that term stands, with shift 0.
    """
    pairs = _small(materialize(pairs), WINDOWS_BROADCAST)
    bucket = lambda pos, offset: F.floor((pos - offset) / F.lit(slop + 1))

    def side(name: str) -> DataFrame:
        met = index.select("term", "key", "pos").join(pairs, F.col(f"{name}.term") == F.col("term"))
        return met.select("item", "key", "pos", (F.col("pos") - F.col(f"{name}.offset")).alias("at"))

    a = side("a").withColumn("bucket", F.explode(F.array(*(bucket(F.col("at"), F.lit(0)) + d for d in (-1, 0, 1)))))
    b = side("b").withColumn("bucket", bucket(F.col("at"), F.lit(0)))
    place = F.xxhash64("item", "key", "bucket")  # narrow rows first: places where both terms are; hashes that fall together only cost a comparison
    both = a.select(place.alias("place"), F.lit(1).alias("side")).unionByName(b.select(place.alias("place"), F.lit(2).alias("side")))
    full = materialize(both.groupBy("place").agg(F.bit_or("side").alias("sides")).where("sides = 3").select("place"))
    a, b = (x.withColumn("place", place).join(full, "place", "left_semi").distinct() for x in (a, b))
    met = a.join(b.select("item", "key", "bucket", F.col("at").alias("other")), ["item", "key", "bucket"]).withColumn("shift", F.col("other") - F.col("at"))
    return met.where(F.abs("shift") <= slop).select("item", "key", "pos", "shift")


def text_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, terms_per_pass: int = TERMS_PER_PASS, slop: int = 5) -> DataFrame:
    """One row per distinct text with a hit: key, n_hit, hit_items, near_items, contaminated."""
    windows = materialize(benchmark_windows(items, item_id, item_text, window))
    vocabulary = materialize(windows.select(F.explode("words").alias("term")).distinct())
    counts = materialize(term_counts(docs, vocabulary, text_col, terms_per_pass))
    windows = materialize(window_lists(windows, counts))
    pairs = materialize(rarest_pairs(items, counts, item_id, item_text))
    used = windows.select(F.explode("lists").alias("l")).select("l.term", (F.col("l.j") == 0).alias("led"))
    used = used.unionByName(pairs.select(F.explode(F.array("a.term", "b.term")).alias("term"), F.lit(False).alias("led")))
    index = materialize(postings(docs, used.groupBy("term").agg(F.max("led").alias("led")), text_col, window - 1, terms_per_pass))
    # words under a text's matches: each start covers up to the next one; a text's starts are at most its words
    spans = phrase_matches(index, windows).groupBy("key", "n_words", "start").agg(F.max("length").alias("length"), F.flatten(F.collect_set("items")).alias("items"))
    by_text = spans.groupBy("key", "n_words").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("items"))))).alias("hit_items"))
    cover = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    near = proximity_matches(index, pairs, slop).groupBy("key").agg(F.countDistinct("item").alias("near_items"))
    by_text = by_text.select("key", cover.cast("long").alias("n_hit"), "hit_items", (cover * share >= F.col("n_words")).alias("contaminated"))
    return by_text.join(near, "key", "full_outer").select("key", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), F.coalesce("near_items", F.lit(0).cast("long")).alias("near_items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items whose two rarest terms are met in proximity)."""
    hits = _small(materialize(text_hits(docs, items, text_col, item_id, item_text, window, share, terms_per_pass)), BROADCAST_TEXTS)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words")).join(hits, "key", "left")
    zero, listed = F.lit(0).cast("long"), F.coalesce("hit_items", F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.coalesce("near_items", zero).alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs`` whose texts are not contaminated, with all their columns; no row is shuffled while the contaminated texts are few."""
    hits = materialize(text_hits(docs, items, text_col, item_id, item_text, window, share).where("contaminated").select("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col(text_col)).alias("key"))
    return rows.join(_small(hits, BROADCAST_TEXTS), "key", "left_anti").select("row.*")
