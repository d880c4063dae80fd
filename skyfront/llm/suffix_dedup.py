"""Removal of byte strings that occur twice, by distributed prefix doubling over sampled positions.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed.

**Ranks.**  The rank of the 2h bytes at a position is made of the ranks of the h bytes there and
h further on (64-bit names instead of ordinals, so equal strings get equal ranks in every task).  Any
longer string is named by the ranks of two overlapping powers of two.

**Sampled positions.**  Each string of ``length`` bytes is led by the position of its least 64-byte rank (the
leftmost of equals; 64 bytes of short period come last).  Equal strings are led at the same offset, so only leading
positions, about one in 60, need be sorted.  Spark sorts them by the rank pair (64 bytes at the position; all bytes of the
strings that it leads, up to 336) and reranks: a position whose 64 bytes are unique is done; one whose longer
rank is shared is past the threshold, every string that it leads is repeated; for the others Spark sorts the ranks of
the single strings, 200 bytes long, and those that are shared are repeated.

Sorting plain pairs for all positions instead would shuffle some 20 bytes a byte and round; see README.

A position that a text holds several times in the same surroundings (periodic text) goes as one row with its spans; of copies
of a text a task ranks two.

**Hot strings.**  A sample of at most ``HOT_TEXTS`` texts tells which first 64 bytes many texts share: those are dealt by the longer rank as
well.  A string that the sample itself shows to be repeated needs no partner and is dealt by its place.  The sample decides where rows
meet, never what is repeated.

Defined results: null counts as empty; matches do not cross documents; equal texts are matches of each other;
repeated rows each give a row; empty tables give an empty result; very long texts are ranked by overlapping pieces of bounded
size; other columns are ignored, and those in ``keep`` come back under their names (which should not be those of results).  A text
is known by 88 bits of its hashes, a string by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_map, materialize, may_hold, release, slices, utf8

LENGTH, CORE = 200, 64
#: Bytes ranked at once in a task.
CHUNK = 1 << 19
#: Low bits of an order key that hold the place in a chunk.
PLACE_BITS = 22
#: Bounds of the sample of texts that tells hot strings (texts, bytes of a text), and how many of its texts make a string hot.
HOT_TEXTS, HOT_BYTES, HOT = 16_000, 1 << 16, 16
#: Texts whose copies a task tells apart; beyond that it begins anew, which costs rows and changes nothing.
KNOWN_TEXTS = 1 << 20
_U = np.uint64
_SPAN = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15) ^ (b + _U(0x7F4A7C15F39CC060)) * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    return x


class Ranks:
    """Ranks of all substrings of a buffer, by doubling."""

    def __init__(self, buffer: np.ndarray, longest: int) -> None:
        with np.errstate(over="ignore"):
            self.levels = [_mix(buffer.astype(_U), _U(0))]
            w = 1
            while 2 * w <= longest and len(self.levels[-1]) > w:
                self.levels.append(_mix(self.levels[-1][:-w], self.levels[-1][w:]))
                w *= 2

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Ranks of the strings of these sizes at these positions."""
        size = np.broadcast_to(np.asarray(size, np.int64), at.shape)
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(at), _U)
        with np.errstate(over="ignore"):
            for m in np.unique(level):
                k = level == m
                h, n = self.levels[m], size[k]
                out[k] = _mix(_mix(h[at[k]], h[at[k] + n - (1 << int(m))]), n.astype(_U))
        return out


def leading_positions(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, core: int = CORE) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position, first and last start led, core rank, whole rank) of the texts between ``offsets``, by pieces of bounded size."""
    if len(raw) <= 2 * CHUNK:
        yield from _chunk(raw, offsets, [(i, 0, a, b) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))], length, core)
        return
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b - length + 1, CHUNK):  # starts of this piece, with all that they lead to
            end = min(at + CHUNK + length - 1, b)
            yield from _chunk(raw[at:end], np.array([0, end - at]), [(i, at - a, 0, end - at)], length, core)


def _chunk(buffer: np.ndarray, offsets: np.ndarray, parts: list[tuple[int, int, int, int]], length: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``parts``: text, place of the part in it, and where the part begins and ends in the buffer."""
    reach = length - core
    parts = [p for p in parts if p[3] - p[2] >= length]
    if not parts:
        return
    starts = np.concatenate([np.arange(a, b - length + 1) for _, _, a, b in parts])
    owner = np.repeat(np.arange(len(parts)), [b - a - length + 1 for _, _, a, b in parts])
    ranks = Ranks(buffer, 256)
    g = ranks.of(np.arange(len(buffer) - core + 1), core)
    half = ranks.levels[(core // 2).bit_length() - 1]
    periodic = np.zeros(len(g), bool)
    for step in range(1, core // 2 + 1):
        periodic |= half[: len(g)] == half[step : step + len(g)]
    place = np.arange(len(g)).astype(_U)
    v = (g >> _U(1) | periodic.astype(_U) << _U(63)) >> _U(PLACE_BITS) << _U(PLACE_BITS) | place
    w = 1
    while 2 * w <= reach + 1:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    if rest := reach + 1 - w:
        v = np.minimum(v[:-rest], v[rest:])
    lead = (v[starts] & ((_U(1) << _U(PLACE_BITS)) - _U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])]))
    p, lo, hi, own = lead[new], starts[new], starts[np.append(new[1:], len(starts)) - 1], owner[new]
    with np.errstate(over="ignore"):
        whole = _mix(ranks.of(lo, hi - lo + length), (p - lo).astype(_U))
    text, shift = np.array([q[0] for q in parts])[own], np.array([q[1] - q[2] for q in parts])[own]
    yield text, p + shift, lo + shift, hi + shift, g[p].view(np.int64), whole.view(np.int64)


def _named(docs: DataFrame, text_col: str) -> tuple:
    """Columns text (null: empty), key and tag: 64 and 24 bits that name the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return text.alias("text"), F.xxhash64(text).alias("key"), F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 40).alias("tag")


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(lo) else hi
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return (lo[np.append(0, cut)], hi[np.append(cut - 1, len(lo) - 1)]) if len(lo) else (lo, hi)


_NONE = np.empty(0, np.int64)


@dataclass
class Hot:
    """Cores that many texts share; strings known to be repeated: (core, whole rank, key and at of one of them) and (core, rank), by second column."""

    cores: np.ndarray = field(default_factory=lambda: _NONE)
    wholes: tuple[np.ndarray, ...] = (_NONE,) * 4
    strings: tuple[np.ndarray, ...] = (_NONE,) * 2


def _hits(table: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each (a, b) in a table ordered by its second column, or -1."""
    if not len(table[1]):
        return np.full(len(a), -1)
    i = np.minimum(np.searchsorted(table[1], b), len(table[1]) - 1)
    return np.where((table[1][i] == b) & (table[0][i] == a), i, -1)


def _apart(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values other than 0 that deal rows one by one."""
    with np.errstate(over="ignore"):
        return _mix(key.view(_U), at.view(_U)).view(np.int64) | 1


def _positions(docs: DataFrame, text_col: str, length: int, core: int, hot: Hot) -> DataFrame:
    """All leading positions: (core, part, whole, key, at, state, spans).

    ``part``: 0, or for hot cores what deals their rows; ``at`` packs the text's tag, bytes led and first start; ``state``: 1 for a whole known
    to be repeated, 2 for the one that stands for it; ``spans`` if a text has several of the same core and whole.
    """
    rows = docs.select(*_named(docs, text_col)).where(F.octet_length("text") >= length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "part", "whole", "key", "at", "state", "spans"]
        times: dict[tuple[int, int], int] = {}
        for batch in batches:
            stay = []
            for text in zip(batch.column("key").to_pylist(), batch.column("tag").to_pylist(), strict=True):
                times[text] = n = times.get(text, 0) + 1
                stay.append(n <= 2)  # two rows tell that a text is repeated, more copies tell no more
            if len(times) > KNOWN_TEXTS:
                times.clear()
            if not all(stay):
                batch = batch.filter(pa.array(stay))
            keys, tags = (batch.column(c).to_numpy() for c in ("key", "tag"))
            for first, last, raw, offsets in slices(*utf8(batch.column("text")), CHUNK):
                own_keys, own_tags = keys[first:last], tags[first:last]
                for text, _, lo, hi, c, w in leading_positions(raw, offsets, length, core):
                    order = np.lexsort((lo, w, c, text))
                    text, lo, hi, c, w = (x[order] for x in (text, lo, hi, c, w))
                    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
                    count = np.diff(np.append(new, len(lo)))
                    at, key = own_tags[text] << 40 | (hi - lo + length) << 31 | lo, own_keys[text]
                    hit = _hits(hot.wholes, c, w)
                    state, part = (hit >= 0).astype(np.int8), np.where(np.isin(c, hot.cores), w | 1, 0) if len(hot.cores) else np.zeros(len(c), np.int64)
                    if state.any():
                        part = np.where(state > 0, _apart(key, at), part)
                        state[(state > 0) & (hot.wholes[2][hit] == key) & (hot.wholes[3][hit] == at)] = 2
                    for k, many in ((new[count == 1], False), (new[count > 1], True)):
                        if not len(k):
                            continue
                        spans = pa.nulls(len(k), _SPANS)
                        if many:
                            runs = [_merge(lo[i : i + n], hi[i : i + n] + length) for i, n in zip(k, count[count > 1], strict=True)]
                            spans = pa.array([[{"lo": a, "hi": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in runs], _SPANS)
                        yield pa.RecordBatch.from_arrays([*(pa.array(x[k]) for x in (c, part, w, key, at, state)), spans], names)
        release()

    return rows.mapInArrow(run, "core long, part long, whole long, key long, at long, state byte, spans array<struct<lo:int,hi:int>>")


def _strings(docs: DataFrame, text_col: str, open_rows: DataFrame, length: int, hot: Hot) -> DataFrame:
    """(core, rank, key, at, part) of the strings that the positions in ``open`` lead.

    ``at`` packs the text's tag, whether they are known to be repeated, and the start; ``part`` is 0 but for strings that are known to be hot.
    """
    names = docs.sparkSession.sparkContext.broadcast(bit_map(open_rows.select(F.col("key").alias("name"))))
    rows = docs.select(*_named(docs, text_col)).where(F.octet_length("text") >= length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            once = np.zeros(len(keys), bool)
            once[np.unique(keys, return_index=True)[1]] = True  # copies in a batch: one will do
            part = batch.filter(pa.array(once & may_hold(names.value, keys)))
            raw, offsets = utf8(part.column("text"))
            texts = [z.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tag"), pa.array(texts, pa.binary())], ["key", "tag", "z"])
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for key, tag, packed, row in zip(batch.column("key").to_pylist(), batch.column("tag").to_pylist(), batch.column("z"), batch.column("open"), strict=True):
                raw, fields = np.frombuffer(z.decompress(packed.as_buffer()), np.uint8), row.values.flatten()
                core, lo, size, twice = (x.to_numpy(zero_copy_only=False) for x in fields)
                for k in range(0, len(lo), 2000):  # positions at once
                    here = slice(k, k + 2000)
                    a, n = lo[here].astype(np.int64), size[here].astype(np.int64)
                    buffer = np.concatenate([raw[i : i + m] for i, m in zip(a, n, strict=True)])
                    count = n - length + 1
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    ranks = Ranks(buffer, 128).of(np.repeat(np.cumsum(n) - n, count) + step, length)
                    at = np.int64(tag) << np.int64(40) | np.repeat(twice[here].astype(np.int64), count) << 32 | np.repeat(a, count) + step
                    cores, ranks, keys = np.repeat(core[here], count), ranks.view(np.int64), np.full(len(at), key)
                    part = np.where(_hits(hot.strings, cores, ranks) >= 0, _apart(keys, at), 0) if len(hot.strings[0]) else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (cores, ranks, keys, at, part))], ["core", "rank", "key", "at", "part"])
        release()

    texts = rows.mapInArrow(pack, "key long, tag long, z binary").groupBy("key", "tag").agg(F.first("z").alias("z"))
    return texts.join(open_rows, ["key", "tag"]).select("key", "tag", "z", "open").mapInArrow(run, "core long, rank long, key long, at long, part long")


def _lo_size() -> tuple[Column, Column]:
    return F.col("at").bitwiseAND(0x7FFFFFFF).cast("int"), F.shiftright("at", 31).bitwiseAND(0x1FF).cast("int")


def _columns(rows: DataFrame, *names: str, by: str) -> tuple[np.ndarray, ...]:
    got = rows.select(*names).toPandas().sort_values(by)
    return tuple(got[c].to_numpy(np.int64) for c in names)


def hot_strings(docs: DataFrame, text_col: str, length: int = LENGTH, core: int = CORE) -> Hot:
    """Cores, wholes and single strings that at least ``HOT`` texts of a sample share; as the sample is bounded, so are they."""
    share = min(1.0, HOT_TEXTS / max(docs.count(), 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sample = docs.select(text.alias("text")).where((F.octet_length("text") <= HOT_BYTES) & (F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(1 << 40)) < int(share * (1 << 40))))
    p = materialize(_positions(sample, "text", length, core, Hot()).select("core", "whole", "key", "at").distinct())
    texts = F.count_distinct("key").alias("texts")
    cores = p.groupBy("core").agg(texts).where(F.col("texts") >= HOT)
    found = Hot(_columns(cores, "core", by="core")[0])
    if not len(found.cores):
        return found
    p = p.join(F.broadcast(cores.select("core")), "core")
    wholes = p.groupBy("core", "whole").agg(texts, F.min(F.struct("key", "at")).alias("one")).where(F.col("texts") >= HOT).select("core", "whole", "one.key", "one.at")
    found.wholes = _columns(wholes, "core", "whole", "key", "at", by="whole")
    lo, size = _lo_size()
    single = p.join(F.broadcast(wholes.select("core", "whole")), ["core", "whole"], "left_anti")
    single = single.groupBy("key", F.shiftrightunsigned("at", 40).alias("tag")).agg(F.collect_set(F.struct("core", lo.alias("lo"), size.alias("size"), F.lit(False).alias("twice"))).alias("open"))
    strings = _strings(sample, "text", materialize(single), length, Hot()).groupBy("core", "rank").agg(texts).where(F.col("texts") >= HOT)
    found.strings = _columns(strings, "core", "rank", by="rank")
    return found


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, core: int = CORE) -> tuple[DataFrame, DataFrame]:
    """(key, tag, settled) and (key, tag, starts): for each text the spans under repeated positions, and the starts of single repeated strings."""
    hot = hot_strings(docs, text_col, length, core)
    p = _positions(docs, text_col, length, core, hot).repartition("core", "part")
    by_core = Window.partitionBy("core", "part")
    ordered = by_core.orderBy("whole", "key", "at")
    p = p.withColumn("previous", F.lag("whole").over(ordered)).withColumn("next", F.lead("whole").over(ordered))
    first = F.when(F.col("state") > 0, F.col("state") == 2).otherwise(F.col("previous").isNull() | (F.col("previous") != F.col("whole")))
    p = p.withColumn("first", first).withColumn("twice", (F.col("state") > 0) | ~first | F.coalesce(F.col("next") == F.col("whole"), F.lit(False)) | F.col("spans").isNotNull())
    several = (F.col("kinds") > 1) | (F.col("part") != 0)  # of a hot core not all rows are here
    p = p.withColumn("kinds", F.count_if("first").over(by_core)).where(F.col("twice") | several)
    lo, size = _lo_size()
    span = F.array(F.struct(lo.alias("lo"), (lo + size).alias("hi")))
    p = p.withColumn("settled", F.when(F.col("twice"), F.coalesce("spans", span)))
    p = p.withColumn("open", F.when(F.col("first") & several, F.struct("core", lo.alias("lo"), size.alias("size"), "twice")))
    tag = F.shiftrightunsigned("at", 40)
    known = materialize(p.groupBy("key", tag.alias("tag")).agg(F.flatten(F.collect_set("settled")).alias("settled"), F.collect_set("open").alias("open")))
    strings = _strings(docs, text_col, known.where(F.size("open") > 0).select("key", "tag", "open"), length, hot).repartition("rank", "part")
    known_twice = F.shiftright("at", 32).bitwiseAND(1)
    times = F.sum(1 + known_twice).over(Window.partitionBy("rank", "core", "part"))
    again = strings.withColumn("times", times).where(((F.col("times") > 1) | (F.col("part") != 0)) & (known_twice == 0))
    return known.where(F.size("settled") > 0).select("key", "tag", "settled"), again.groupBy("key", tag.alias("tag")).agg(F.collect_set(lo).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` (default: the id), kept binary, n_bytes, n_removed, n_spans.

    Only texts that a bit map of the keys of texts with repeats may hold are shuffled to be joined with their spans; the others are whole.
    """
    settled, again = repeated_spans(docs, text_col, length, core)
    known = materialize(settled.join(again, ["key", "tag"], "full_outer"))
    names = docs.sparkSession.sparkContext.broadcast(bit_map(known.select(F.col("key").alias("name"))))
    rows = docs.select(F.struct(*(keep or [id_col])).alias("row"), *_named(docs, text_col))
    row = rows.schema["row"]
    binary, long = T.BinaryType(), T.LongType()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(names.value, batch.column("key").to_numpy())))
            for lo, hi, raw, offsets in slices(*utf8(batch.column("text")), 8 * CHUNK):
                texts = [z.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("row", "key", "tag")), pa.array(texts, pa.binary())], ["row", "key", "tag", "z"])
        release()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~may_hold(names.value, batch.column("key").to_numpy())))
            size, none = np.diff(utf8(batch.column("text"))[1]), pa.array(np.zeros(len(batch), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text").cast(pa.binary()), pa.array(size), none, none], ["row", "kept", "n_bytes", "n_removed", "n_spans"])
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, out, size = batch.column("row"), [], 0

            def done(end: int) -> pa.RecordBatch:
                kept, *numbers = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([rows.slice(end - len(out), len(out)), pa.array(kept, pa.binary()), *(pa.array(n, pa.int64()) for n in numbers)], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

            for i, (packed, spans, single) in enumerate(zip(batch.column("z"), batch.column("settled"), batch.column("starts"), strict=True)):
                raw = z.decompress(packed.as_buffer())
                a, b = (x.to_numpy().astype(np.int64) for x in spans.values.flatten()) if spans.is_valid else (np.empty(0, np.int64),) * 2
                starts = single.values.to_numpy().astype(np.int64) if single.is_valid else np.empty(0, np.int64)
                lo, hi = _merge(np.append(a, starts), np.append(b, starts + length))
                kept = b"".join(raw[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                out.append((kept, len(raw), int((hi - lo).sum()), len(lo)))
                size += len(raw)
                if size > 8 * CHUNK:
                    yield done(i + 1)
                    out, size = [], 0
            if out:
                yield done(len(batch))
        release()

    packed = rows.mapInArrow(pack, T.StructType([row, T.StructField("key", long), T.StructField("tag", long), T.StructField("z", binary)]))
    found = packed.join(known, ["key", "tag"], "left").select("row", "z", "settled", "starts")
    results = [T.StructField(c, long) for c in ("n_bytes", "n_removed", "n_spans")]
    kind = T.StructType([row, T.StructField("kept", binary), *results])
    return found.mapInArrow(run, kind).unionByName(rows.mapInArrow(whole, kind)).select("row.*", "kept", "n_bytes", "n_removed", "n_spans")


def digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return cleaned.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What :func:`digest` returns, by a dictionary of all strings; for tests."""
    raw = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out
