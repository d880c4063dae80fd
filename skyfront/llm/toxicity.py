"""Toxicity: obfuscated words are restored by a noisy channel, then the restored text is scored.

**Language model.**  Character trigrams of all documents (64 letter classes, so a table of fixed size).

**Channel.**  A token that may be obfuscated (letters mixed with look-alike digits and signs, a letter
three times or more, single letters set apart) is read as a lattice: a sign may stand for a letter or for itself, a
repeated letter may be one or two, a mark between single letters may be dropped or end a word, each at a cost.  Viterbi
decoding under the language model picks the cheapest word.  Other tokens stand as they are.

**Score.**  On the fitting sample every word and word prefix gets a shrunk log-odds of toxic against
clean documents; a document is described by its strongest words, their number against the number to be
expected in clean text of its length, and scored by logistic regression.  A fitting row is described
with its own counts taken out.

The sample is bounded (``n_docs`` labelled rows of lowest id hash); the language model counts all texts.

Defined results: null and empty texts have no words and get the model's score for that; repeated rows
each give a row; ids, null ones too, are handed on as they are; a very long text is restored in the task that holds it, beside no
more than 1 MB of others; labels that are null count as absent; without labels of both kinds the score is the
share of toxic labels; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_sample, text_slices

#: Bound of the fitting sample (a documented parameter); it bounds the terms that the model can hold as well.
N_DOCS = 16_000
#: Letters that look-alike characters may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "*": "aeiou", "(": "c", "<": "c", "#": "h"}
MARKS = " .-_*~'`,/\\"
_LOOK = re.escape("".join(LOOKALIKES))
SPACED = re.compile(rf"(?<![^\W_])[^\W_](?:[{re.escape(MARKS)}]{{1,2}}[^\W_]){{3,}}(?![^\W_])")
GAP = re.compile(rf"([{re.escape(MARKS)}]{{1,2}})")
MIXED = re.compile(rf"(?:[^\W\d_]|[{_LOOK}]|(?<=[^\W\d_])[.\-_](?=[^\W\d_]))*[^\W\d_](?:[^\W\d_]|[{_LOOK}]|(?<=[^\W\d_])[.\-_](?=[^\W\d_]))*")
ODD = re.compile(rf"[{_LOOK}._\-]|(.)\1\1", re.IGNORECASE)
_ANY = r"[^\W\d_]"
#: Signs that are punctuation at the end of a word, and look-alikes that are not.
_EDGE, _HARD = "!|*#(<.,_-~'`", "0-9@$€£¢+"
#: What any match of MIXED has that ODD is to find in without its _EDGE: a sign between letters, a look-alike that is no punctuation on either side of a letter
#: (both told from the sign, as letters are too many to begin at), a letter three times.
CANDIDATE = re.compile(rf"[{_LOOK}._\-](?:(?<={_ANY}.)[{_LOOK}._\-]*{_ANY}|(?<=[{_HARD}])[{_LOOK}]*{_ANY}|(?<={_ANY}[{_LOOK}])(?:(?<=[{_HARD}])|[{_LOOK}]*[{_HARD}]))", re.DOTALL)
THRICE = re.compile(rf"({_ANY})\1\1", re.IGNORECASE)
LETTER, TOKEN = re.compile(_ANY), re.compile(r"\S+")
WORD = re.compile(r"[^\W\d_]+")
CACHED = 48  # longer tokens are decoded each time
#: Costs of reading a gap in a spaced run as a word's end: a gap like the others, and one longer than the shortest.
WORD_END, LONG_GAP = 3.0, 0.0
#: Costs of reading a look-alike as the sign that it is: a digit at a token's edge (``1st``, ``covid19``), another sign there, any inside (``h2o``).
DIGIT_AT_EDGE, SIGN_AT_EDGE, KEPT = 1.0, 5.0, 4.0

CLASSES = 64
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
_CODE = {c: i for i, c in enumerate(_LETTERS, 1)}
_LUT = np.zeros(256, np.int64)
for _c, _i in _CODE.items():
    _LUT[ord(_c)] = _i
_OTHER = CLASSES - 1


def _codes(text: str) -> np.ndarray:
    """Letter classes of a text; 0 for anything that isn't a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 256
    return np.where(low, _LUT[np.where(low, points, 0)], np.where(points < 0x2000, _OTHER, 0))


def _thrice(text: str) -> bool:
    """Has the text a letter three times in a row?"""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    same = c[1:] == c[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    return any(chr(c[i]).isalpha() for i in at)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter-class trigrams of all documents, words being framed by class 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for _, texts in (x for batch in batches for x in text_slices(batch)):
            for text in texts:
                if text:
                    c = np.concatenate([[0, 0], _codes(text), [0, 0]])
                    grams = c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:]
                    np.add.at(total, grams, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES**3, np.int64)
    out[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


class Restorer:
    """Viterbi decoder of obfuscated words."""

    def __init__(self, counts: np.ndarray, max_words: int = 100_000) -> None:
        c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1 + 0.5).sum()
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        self.cost = -np.log((c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10))
        self.max_words, self.cache = max_words, {}

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of a character, its readings and their channel costs."""
        out, at, t = [], 0, token.lower()
        while at < len(t):
            end = at
            while end < len(t) and t[end] == t[at]:
                end += 1
            c, n = t[at], end - at
            readings = []
            if c in _CODE or c.isalpha():
                readings = [(c * n, 0.0)] if n <= 2 else [(c * 2, 1.0)]
                readings += [(c, 0.5 if n > 2 else 3.0)] if n > 1 else []
            else:
                for x in LOOKALIKES.get(c, ""):
                    readings.append((x * min(n, 2), 1.5 + 1.5 * (c == "*")))
                    if n > 1:
                        readings.append((x, 2.0))
                if c in MARKS or c in "!|+":
                    readings.append(("", 1.0 if c in MARKS else 6.0))
                if c in LOOKALIKES:
                    at_edge = not at or end == len(t)
                    readings.append((c * n, (DIGIT_AT_EDGE if c.isdigit() else SIGN_AT_EDGE) if at_edge else KEPT))
                readings = readings or [("", 8.0)]
            out.append(readings)
            at = end
        return out

    def spaced_lattice(self, run: str) -> list[list[tuple[str, float]]]:
        """The lattice of single letters set apart, where each gap may also end a word."""
        parts = GAP.split(run)
        shortest = min(map(len, parts[1::2]))
        out = []
        for k, part in enumerate(parts):
            readings = self.lattice(part)
            if k % 2:
                if len(readings) == 2:  # two different marks
                    readings = [[(a + b, x + y) for a, x in readings[0] for b, y in readings[1]]]
                longer = len(part) > shortest
                readings = [[*((a, x + 3.0 * longer) for a, x in readings[0]), (" ", LONG_GAP if longer else WORD_END)]]
            out += readings
        return out

    def decode(self, token: str, spaced: bool = False) -> str:
        if (known := self.cache.get(token)) is not None:
            return known
        states, settled = {(0, 0): (0.0, "")}, ""
        for k, readings in enumerate(self.spaced_lattice(token) if spaced else self.lattice(token), 1):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for letters, extra in readings:
                    x, y, total = a, b, cost + extra
                    for ch in letters:
                        z = _CODE.get(ch) or (_OTHER if ch.isalpha() else 0)
                        total += self.cost[x, y, z]
                        x, y = y, z
                    if (old := new.get((x, y))) is None or (total, text + letters) < old:
                        new[x, y] = (total, text + letters)
            states = new
            if k % 64 == 0:  # what all readings begin with is put aside, so that time is linear in the length
                n = len(common := commonprefix([text for _, text in states.values()]))
                settled, states = settled + common, {s: (cost, text[n:]) for s, (cost, text) in states.items()}
        best = settled + min((cost + self.cost[a, b, 0], text) for (a, b), (cost, text) in states.items())[1]
        if len(token) <= CACHED:
            if len(self.cache) > self.max_words:
                self.cache.clear()
            self.cache[token] = best
        return best

    def restore(self, text: str) -> str:
        """The text with obfuscated tokens replaced by what they most likely stand for."""

        def token(m: re.Match) -> str:
            t = m[0]
            core = t.strip(_EDGE)
            if not core or not ODD.search(core):
                return t
            return t.replace(core, self.decode(core), 1)

        if SPACED.search(text):
            text = SPACED.sub(lambda m: self.decode(m[0], True) if LETTER.search(m[0]) else m[0], text)
        odd, thrice = CANDIDATE.search(text), _thrice(text)
        if not odd and not thrice:
            return text
        return TOKEN.sub(lambda m: MIXED.sub(token, m[0]) if odd and CANDIDATE.search(m[0]) or thrice and THRICE.search(m[0]) else m[0], text)


def terms(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in range(4, min(len(word), 9) + 1))]


@dataclass
class Model:
    counts: np.ndarray
    table: dict[str, tuple[int, int]]  # toxic and clean documents of the sample that hold a term
    n_toxic: int
    n_clean: int
    rates: tuple[float, float] = (1e-3, 1e-2)  # strong words a word, in clean and in toxic text
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    @property
    def base(self) -> float:
        return (self.n_toxic + 0.5) / (self.n_toxic + self.n_clean + 1)

    def value(self, word: str, less: tuple[int, int] = (0, 0)) -> float:
        """Largest shrunk log-odds of a word's terms; ``less``: the counts of the document itself, taken out."""
        best, p = 0.0, self.base
        for t in terms(word):
            if (n := self.table.get(t)) is not None:
                odds = (n[0] - less[0] + 6 * p) / (n[1] - less[1] + 6 * (1 - p))
                best = max(best, math.log(odds * (1 - p) / p))
        return best

    def describe(self, words: list[str], values: dict[str, float]) -> list[float]:
        own = sorted((v for w in set(words) if (v := values[w]) > 1.0), reverse=True)
        top = [*own[:4], 0.0, 0.0, 0.0, 0.0][:4]
        hits, n = sum(values[w] > 1.0 for w in words), len(words)
        lo, hi = self.rates
        poisson = hits * math.log(hi / lo) - n * (hi - lo)
        return [*top, math.log1p(hits), math.log1p(n), max(-20.0, min(20.0, poisson)), hits / (n + 5), sum(own) / math.sqrt(n + 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(_expand((x - self.mean) / self.scale) @ self.weights, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -5, 5)
    i, j = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 3.0) -> np.ndarray:
    """Penalised logistic regression by Newton's method; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _words(restorer: Restorer, text: str | None) -> list[str]:
    return WORD.findall(restorer.restore(text).lower()) if text else []


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_docs: int = N_DOCS) -> Model:
    """Language model from all texts, term counts and weights from a bounded sample of labelled rows of the training folds."""
    spark = docs.sparkSession
    counts = trigram_counts(docs, text_col)
    marked = labels.where((fold(F.col(id_col), held_mod) != held) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ids = hash_sample(marked.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")), "id", n_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    lm = spark.sparkContext.broadcast(counts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, found, n = Restorer(lm.value), (Counter(), Counter()), [0, 0]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                n[y] += 1
                found[y].update({t for w in set(_words(restorer, text)) for t in terms(w)})
        own = sorted(found[1])
        clean = Counter({t: found[0][t] for t in found[0]})
        every = [*own, *(t for t in sorted(clean) if t not in found[1])]
        yield pd.DataFrame({"term": ["", *every], "toxic": [n[1], *(found[1][t] for t in every)], "clean": [n[0], *(clean[t] for t in every)]})

    sums = rows.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.where((F.col("term") == "") | (F.col("toxic") >= 3) & (F.col("toxic") * 3 >= F.col("clean")))
    got = sums.toPandas()
    totals = got[got["term"] == ""].sum()
    table = {t: (a, b) for t, a, b in zip(got["term"], got["toxic"].astype(int), got["clean"].astype(int), strict=True) if t}
    model = Model(counts, table, int(totals["toxic"] or 0), int(totals["clean"] or 0))
    if not model.n_toxic or not model.n_clean:
        return model
    first = spark.sparkContext.broadcast(model)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, restorer = first.value, Restorer(lm.value)
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                words = _words(restorer, text)
                values = {w: model.value(w, (y, 1 - y)) for w in set(words)}
                out.append((sum(values[w] > 1.0 for w in words), len(words), [[v, float(n)] for w, n in Counter(words).items() if (v := values[w]) > 1.0]))
            yield pd.DataFrame(out, columns=["hits", "n", "strong"]).assign(id=pdf["id"].astype(str).to_numpy(), y=pdf["y"].to_numpy())

    seen = rows.mapInPandas(own, "hits long, n long, strong array<array<double>>, id string, y int")
    seen = seen.orderBy(F.xxhash64("id"), "id", "n").limit(2 * n_docs).toPandas()
    y = seen["y"].to_numpy(float)
    rate = [(seen["hits"][y == k].sum() + 0.1) / (seen["n"][y == k].sum() + 100) for k in (0, 1)]
    model.rates = (rate[0], max(rate[1], rate[0] * 1.5))
    x = []
    for n, strong in zip(seen["n"], seen["strong"], strict=True):
        values = {f"{i}": float(v) for i, (v, _) in enumerate(strong)}
        listed = [f"{i}" for i, (_, k) in enumerate(strong) for _ in range(int(k))]
        values[""] = 0.0
        x.append(model.describe([*listed, *[""] * (int(n) - len(listed))], values))
    x = np.array(x)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic(_expand((x - model.mean) / model.scale), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: toxic likelier); one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer, values = Restorer(model.counts), {}
        for part, texts in (x for batch in batches for x in text_slices(batch)):
            x = []
            for text in texts:
                words = _words(restorer, text)
                if len(values) > 200_000:
                    values.clear()
                for w in set(words):
                    if w not in values:
                        values[w] = model.value(w)
                x.append(model.describe(words, values))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.probability(np.array(x).reshape(-1, 9)))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def restore_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.counts)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for part, texts in (x for batch in batches for x in text_slices(batch)):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([restorer.restore(t) if t else t for t in texts], pa.string())], ["id", "restored"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, restored string").withColumnRenamed("id", id_col)
