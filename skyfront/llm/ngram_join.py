"""Similarity join on word n-grams by vertical partitioning.

Two documents link when the Jaccard similarity of their n-gram sets is at least ``percent`` / 100.

**Order.**  All n-grams have one global order, that of their 64-bit hashes, cut into fragments.

**Candidates.**  Documents of equal sets are one class, represented once.  In a first round each class is
paired with one likely partner, the class that leads a group of equal min-hash; the links found make
components.  Then all classes are searched: sets that differ in few places have runs of the order in
common, so they share two n-grams that follow each other in both.  Of a set's adjacent pairs as many
are taken from the order's front as linked sets can't all miss (:func:`prefix_length`).  Classes that share a pair meet
under its leader, the least of their keys: near copies share hundreds of pairs and have few leaders, so they meet a few times and
bring their parity bits along.  A passage that many documents hold makes no group of them, as its n-grams lie scattered between
each document's own.  A candidate is made only if its sides are not of one component already (its link would change none), if their
sizes differ little, and if parity bits (1024, for larger sets as many as the set's size asks for) don't show that the
sets differ in more places than linked ones can.

**Verification.**  For each pair the overlaps in the fragments are counted separately and summed.

So no group of copies or of near copies is expanded into all its pairs, and yet no link between
components is missed: the result is exact but for collisions of 64-bit hashes inside one pair of sets; a word's hash
is a sum of independent random values, one for each place and byte, so no family of words collides.

Defined results: texts without words, and nulls, have an empty set and link with nothing; texts of fewer
words than n have one n-gram, the whole; repeated rows each give a row; a null id takes part, and
is a component's id only if no member has an id; empty tables give an empty result; very long texts are hashed by pieces
of bounded size (what is kept is 8 bytes a word); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_map, connected_components, materialize, may_hold, release, slices, utf8

#: Fragments of the order, min-hashes of the first round, words of the parity maps: the first round's, and a finer one.
FRAGMENTS, SIGNATURES, PARITY, FINE = 8, 6, 4, 16
#: Words of the largest parity map that goes with a set to each of its leaders (sets of up to 8191 n-grams); larger sets' maps meet once a pair.
CARRIED = 256
_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random value for each place in a word (beyond the table, mixed with the round) and byte.
PLACES = 64
_VALUES = _RNG.integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
_SALT = _RNG.integers(1, 1 << 63, SIGNATURES, dtype=np.uint64) * _U(2) + _U(1)
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
KEYS = "ka long, kb long"


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = a * _U(0xFF51AFD7ED558CCD) ^ (b + _U(0x2545F4914F6CDD1D)) * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(31)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(30)
    return x


def _word_sums(raw: np.ndarray, begin: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, length, place) of the words of a buffer in which texts begin at ``begin``; ``done`` bytes of the first word came before."""
    in_word = _WORD[raw]
    at = np.flatnonzero(in_word)
    if not len(at):
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.empty(len(raw), bool)
    new[0], new[1:] = True, ~in_word[:-1]
    new[begin[begin < len(raw)]] = True
    first = np.flatnonzero(new[at])
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    if done:
        place[: length[0]] += done
    value = _VALUES[(place % PLACES) * 256 + _LOWER[raw[at]]]
    if len(far := np.flatnonzero(place >= PLACES)):
        value[far] = _mix(value[far], (place[far] // PLACES).astype(_U))
    return np.add.reduceat(value, first), length, at[first]


def _words(raw: np.ndarray, offsets: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and for each text where its words begin (one more at the end)."""
    sums, lengths, places = [], [], []
    open_ = 0  # bytes of the word that the last piece ended in
    for lo in range(0, max(len(raw), 1), piece):
        part = raw[lo : lo + piece]
        begin = offsets[(offsets >= lo) & (offsets < lo + piece)] - lo
        goes_on = bool(open_ and len(part) and _WORD[part[0]] and not (len(begin) and begin[0] == 0))
        s, n, at = _word_sums(part, begin, open_ if goes_on else 0)
        if goes_on:
            sums[-1][-1] += s[0]
            lengths[-1][-1] += n[0]
            s, n, at = s[1:], n[1:], at[1:]
        if len(s):
            sums.append(s), lengths.append(n), places.append(at + lo)
        open_ = int(lengths[-1][-1]) if lengths and len(part) and _WORD[part[-1]] else 0
    if not sums:
        return np.empty(0, _U), np.zeros(len(offsets), np.int64)
    return _mix(np.concatenate(sums), np.concatenate(lengths).astype(_U)), np.searchsorted(np.concatenate(places), offsets)


def word_hashes(raw: np.ndarray, piece: int = 1 << 19) -> np.ndarray:
    """Hashes of the words of one text, ASCII letters without case."""
    with np.errstate(over="ignore"):
        return _words(raw, np.array([0, len(raw)]), piece)[0]


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int, piece: int = 1 << 19) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of the texts between ``offsets`` of a buffer."""
    with np.errstate(over="ignore"):
        words, bounds = _words(raw, offsets, piece)
        grams = words
        if len(words) >= n:
            grams = words[: len(words) - n + 1]
            for k in range(1, n):
                grams = _mix(grams, words[k : len(words) - n + 1 + k])
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= n:
                out.append(np.unique(grams[lo : hi - n + 1]))
            elif hi > lo:
                whole = words[lo : lo + 1]
                for k in range(lo + 1, hi):
                    whole = _mix(whole, words[k : k + 1])
                out.append(_mix(whole, _U(hi - lo)))
            else:
                out.append(np.empty(0, _U))
    return out


def _class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs a set; equal sets, and only they, have the same."""
    digests = b"".join(hashlib.md5(s.tobytes()).digest() if len(s) else bytes(16) for s in sets)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


#: Classes that a task remembers having sent; beyond that it begins anew, which costs rows and changes nothing.
KNOWN_CLASSES = 1 << 20


def _new_ones(key: np.ndarray, done: set[tuple[int, int]]) -> np.ndarray:
    """The places of keys that are not in ``done``, each key once; they are put into it."""
    if len(done) > KNOWN_CLASSES:
        done.clear()
    out = []
    for i, k in enumerate(zip(*key.T.tolist(), strict=True)):
        if k not in done:
            done.add(k)
            out.append(i)
    return np.array(out, np.int64)


def _needed(total: Column, percent: int) -> Column:
    """Least overlap of linked sets of this total size: 100 i >= percent (total - i)."""
    return F.ceil(percent * total / F.lit(100 + percent)).cast("int")


def size_band(size: Column, percent: int) -> Column:
    """Bands of sizes; the larger of two linked sets lies in the smaller one's band or in the next."""
    return F.floor(F.ln(size) / ((1 + 1e-9) * max(math.log(100 / percent), 1e-6)))


def run_length(percent: int) -> int:
    """N-grams in a row that a candidate's sides must share: two, if links of different sets leave any pair at all."""
    return 2 if percent >= 70 else 1


def prefix_length(size: int, percent: int) -> int:
    """How many of a set's runs (of the order) have to be looked at, so that no link to a different set is missed.

    Sets of total size t that link share i >= percent t / (100 + percent) and differ in t - 2 i places, which leave at
    least i - (r - 1)(t - 2 i + 1) runs of r shared n-grams whole; the least t is that of the smallest partner.
    """
    r = run_length(percent)
    t = size + -(-percent * size // 100)
    whole = -(-(2 * r - 1) * percent * t // (100 + percent)) - (r - 1) * (t + 1)
    return max(0, min(size - r + 1, size - r + 2 - whole))


def _parity(s: np.ndarray, owner: np.ndarray, n: int, words: int) -> np.ndarray:
    """Bit maps of 64 * words bits in which each member flips one; a map of a power of two folds to smaller ones."""
    at = ((s >> _U(17)) % _U(64 * words)).astype(np.int64) + owner * (64 * words)
    odd = (np.bincount(at, minlength=n * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, words)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _rows(docs: DataFrame, text_col: str, id_col: str, n: int) -> DataFrame:
    """A row per document: id, name (hash of the text), class key, size, parity bits, finer ones, for large sets ones that grow with the set, min-hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("name"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in slices(*utf8(batch.column("text"))):
                sets = ngram_sets(raw, offsets, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                fine = _parity(every, owner, len(sets), FINE)
                bits = np.bitwise_xor.reduce(fine.reshape(len(sets), -1, PARITY), 1)
                low = np.zeros((len(sets), SIGNATURES), np.int64)
                if len(full):
                    begin = (np.cumsum(sizes) - sizes)[full]
                    with np.errstate(over="ignore"):
                        for k, x in enumerate(_SALT):
                            low[full, k] = np.minimum.reduceat(_mix(every, x), begin).view(np.int64)
                wide = [_parity(s, np.zeros(len(s), np.int64), 1, 1 << (2 * len(s) // 64).bit_length())[0] if len(s) > 24 * FINE else None for s in sets]
                key = _class_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("name").slice(lo, hi - lo), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sizes), _lists(bits), _lists(fine), pa.array(wide, pa.list_(pa.int64())), _lists(low)],
                    ["id", "name", "ka", "kb", "n", "bits", "fine", "wide", "low"],
                )
        release()

    return rows.mapInArrow(run, f"id {kind}, name long, {KEYS}, n long, bits array<long>, fine array<long>, wide array<long>, low array<long>")


def _apart(x: str, y: str, words: int) -> Column:
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(words)), F.lit(0))


def _alike(x: str, y: str, percent: int, bits: str = "bits", words: int = PARITY) -> Column:
    """What sizes and parity bits leave possible; both sides have n and bits."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    needed = _needed(total, percent)
    return (needed <= F.least(F.col(f"{x}.n"), F.col(f"{y}.n"))) & (_apart(f"{x}.{bits}", f"{y}.{bits}", words) <= total - 2 * needed)


def _alike_wide(x: str, y: str, percent: int) -> Column:
    """What the maps that grow with the set leave possible; true if a side has none or one is over twice as long as the other."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    words = F.least(F.size(f"{x}.wide"), F.size(f"{y}.wide"))

    def folded(c: str) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(c) == 2 * words, halves).otherwise(F.col(c))

    apart = F.aggregate(F.zip_with(folded(f"{x}.wide"), folded(f"{y}.wide"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return F.coalesce(apart <= total - 2 * _needed(total, percent), F.lit(True))


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the finer parity bits leave possible: 1024, then for large sets as many as the set's size asks for."""
    own = classes.select("key", "n", "fine", "wide")
    both = pairs.join(own.toDF("a", "na", "x", "wx"), "a").join(own.toDF("b", "nb", "y", "wy"), "b")
    most = F.col("na") + F.col("nb") - 2 * _needed(F.col("na") + F.col("nb"), percent)
    left = both.where(_apart("x", "y", FINE) <= most).select("a", "b", most.cast("long").alias("most"), "wx", "wy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y, most in zip(batch.column("wx"), batch.column("wy"), batch.column("most").to_pylist(), strict=True):
                if not (x.is_valid and y.is_valid):
                    stay.append(True)
                    continue
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                w = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, w)) for v in (x, y))
                stay.append(int(np.bitwise_count(x ^ y).sum()) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(stay, pa.bool_()))
        release()

    return left.mapInArrow(run, left.select("a", "b").schema)


def _likely_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Each class with at most one other: of the leaders of its min-hash groups, the one whose bits differ least."""
    each = classes.select("key", "copies", F.posexplode("low").alias("i", "low"))
    lead = each.groupBy("i", "low").agg(F.max(F.struct("copies", F.xxhash64("key", "i").alias("turn"), "key")).alias("best"), F.count("*").alias("c")).where("c > 1")
    pairs = each.select("i", "low", F.col("key").alias("b")).join(lead.select("i", "low", F.col("best.key").alias("a")), ["i", "low"]).where("a <> b").select("a", "b").distinct()
    own = classes.select("key", F.struct("n", "bits").alias("of"))
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").where(_alike("x", "y", percent))
    best = both.groupBy("b").agg(F.min(F.struct(_apart("x.bits", "y.bits", PARITY).alias("apart"), "a")).alias("m"))
    return best.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()


def _fragments(docs: DataFrame, text_col: str, names: Broadcast, n: int) -> DataFrame:
    """(key, fragment, grams): the sets of the classes whose texts' names the bit map may hold, cut at the fragments' bounds.

    The map spares most others the shuffle; those it lets through have no pair and drop out when pairs are joined.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(names.value, batch.column("name").to_numpy())))
            for lo, hi, raw, offsets in slices(*utf8(batch.column("text"))):
                sets = ngram_sets(raw, offsets, n)
                key = _class_keys(sets)
                once = _new_ones(key, done)
                once = once[[len(sets[i]) > 0 for i in once]] if len(once) else once
                cuts = np.arange(1, FRAGMENTS, dtype=_U) << _U(64 - FRAGMENTS.bit_length() + 1)
                bounds = np.array([[0, *np.searchsorted(sets[i], cuts), len(sets[i])] for i in once], np.int64).reshape(-1, FRAGMENTS + 1)
                count = np.diff(bounds, axis=1)
                i, f = np.nonzero(count)
                grams = np.concatenate([sets[k] for k in once]) if len(once) else np.empty(0, _U)
                offs = np.concatenate([[0], np.cumsum(count[i, f])]).astype(np.int32)
                key = key[once[i]]
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(f.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(grams.view(np.int64)))], ["ka", "kb", "fragment", "grams"])
        release()

    parts = rows.mapInArrow(run, f"{KEYS}, fragment int, grams array<long>")
    return parts.groupBy(F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("key"), "fragment").agg(F.first("grams").alias("grams"))


def _verified(docs: DataFrame, text_col: str, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link: overlaps counted by fragment and summed."""
    pairs = materialize(_close(pairs, classes, percent))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.join(classes.select("key", "n", "name"), "key"))
    names = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select("name")))
    parts = _fragments(docs, text_col, names, n)
    left = parts.select(F.col("key").alias("a"), "fragment", F.col("grams").alias("own"))
    right = parts.select(F.col("key").alias("b"), "fragment", F.col("grams").alias("other"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("own", "other")).alias("overlap"))
    summed = counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    sizes = wanted.select("key", "n")
    summed = summed.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    found = materialize(summed.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"))
    names.unpersist()
    return found


def _prefixes(docs: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """(run, ka): hashes of the first runs of each set in the global order, with the first half of its class key."""
    r = run_length(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for _, _, raw, offsets in slices(*utf8(batch.column("text"))):
                sets = ngram_sets(raw, offsets, n)
                key = _class_keys(sets)
                once = _new_ones(key, done)
                fronts = [sets[i][: prefix_length(len(sets[i]), percent) + r - 1] for i in once]
                fronts = [s if len(s) >= r else s[:0] for s in fronts]
                with np.errstate(over="ignore"):
                    runs = [_mix(s[:-1], s[1:]) if r == 2 else s for s in fronts]
                sizes = [len(s) for s in runs]
                if not sum(sizes):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.repeat(key[once, 0], sizes))], ["run", "ka"])
        release()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "run long, ka long")


def _open_pairs(prefixes: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a run of their prefixes and may link."""
    by_run = Window.partitionBy("run")

    def mixed(rows: DataFrame, c: str) -> DataFrame:
        """Rows of runs that different values of ``c`` share."""
        return rows.withColumn("lo", F.min(c).over(by_run)).withColumn("hi", F.max(c).over(by_run)).where("lo <> hi").drop("lo", "hi")

    named = classes.select("key", F.col("key.a").alias("ka")).join(labels.toDF("key", "label"), "key", "left")
    named = materialize(named.select("key", "ka", F.xxhash64(F.coalesce("label", "key")).alias("label")))
    shared = mixed(prefixes.repartition("run"), "ka").distinct()
    many = mixed(shared.join(named.select("ka", "label"), "ka").repartition("run"), "label")
    many = many.select(F.min("ka").over(by_run).alias("leader"), "ka").distinct()
    own = classes.select("key", "n", "fine", F.when(F.size("wide") <= CARRIED, F.col("wide")).alias("wide"))
    # linked sizes lie in one band or in neighbouring ones, so a row waits in its own for smaller partners and seeks larger ones there and in the next
    band = size_band(F.col("n"), percent)
    many = many.join(named, "ka").drop("ka").join(own, "key").select("*", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("in"))
    many = many.select("leader", "key", "label", "n", "fine", "wide", "in.band", "in.own").repartition("leader", "band")
    x, y = many.alias("x"), many.where("own").alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key"))
    alike = ordered & (F.col("x.label") != F.col("y.label")) & _alike("x", "y", percent, "fine", FINE) & _alike_wide("x", "y", percent)
    pairs = x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.band") == F.col("y.band")) & alike)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles long, component_id (least id that links reach), text_name (64-bit hash of the text)."""
    rows = materialize(_rows(docs, text_col, id_col, n))
    key = F.struct(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = [F.any_value(c).alias(c) for c in ("n", "bits", "fine", "wide", "low", "name")]  # of one set, so any row's will do
    classes = materialize(rows.where("n > 0").groupBy(key.alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("copies"), *same))
    links = _verified(docs, text_col, classes, _likely_pairs(classes, percent), n, percent)
    labels = connected_components(links)
    more = _verified(docs, text_col, classes, _open_pairs(_prefixes(docs, text_col, n, percent), classes, labels, percent), n, percent)
    labels = connected_components(links.unionByName(more))
    named = classes.select("key", "id", "copies").join(labels.toDF("key", "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    # only documents of a component of several need be told its id; written first, so that joins on a large component's label can be split
    least = materialize(named.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("copies").alias("members")).where("members > 1"))
    told = materialize(named.join(least, "label").select("key", "component_id"))
    out = rows.select("id", "n", "name", key.alias("key")).join(told, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("name").alias("text_name"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of least id of their components, each row once; documents that link with nothing stay."""
    found = near_duplicates(docs, n, percent, id_col, text_col)
    which = lambda name: F.struct(F.col(id_col).alias("id"), name.alias("name")).alias("which")  # noqa: E731  a struct, as null ids are equal in it
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(which(F.col("text_name"))).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), which(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    return rows.join(stay, "which", "left_semi").dropDuplicates(["which"]).select("row.*")
