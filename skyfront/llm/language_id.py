"""Language identification by a linear-chain conditional random field over words.

Every word of a text (a run of letters) gets emission scores from hashed features: the word, its
prefixes and suffixes, its character trigrams, its shape, and whether it stands in a language's lexicon
(words frequent in, and typical of, that language in the fitting sample).  Emissions and transitions are
learned together by maximum likelihood; the training chains are lines of texts, some of them joined
across languages, so that the transitions know of code-switching.  Forward-backward gives each word a
distribution over languages; a document's score for a language is the mean over its words.

The model is fitted on a bounded sample (``n_docs`` documents of lowest id hash, of at most ``max_chars``
characters) and shipped to the tasks; then every text is labelled whole, in one pass without a shuffle.

Texts are taken in runs of about 1 MB and words scored 4096 at a time, so a task's memory does not depend on how many rows
come in a batch; of a very long text it keeps 4 bytes a word and the forward scores of one segment.

Defined results: a null text, or one without letters, is ``und`` with score 0; a tie goes to the
language that sorts first; repeated rows each give a row; without any training row all is ``und``;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hash_sample, release, text_slices

#: Bounds of the fitting sample (documented parameters).
N_DOCS, MAX_CHARS = 800, 40_000
DIMENSIONS = 1 << 16
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


_U = np.uint64


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = a.astype(_U) * _U(0x9E3779B97F4A7C15) ^ (np.asarray(b).astype(_U) + _U(0x632BE59BD9B4E019)) * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(29)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many words at once: (feature numbers, where each word's begin).

    Per word: a constant, the word, its length (to 12), its case, prefixes and suffixes of 1 to 4
    characters, the trigrams of the framed word, and the language of a lexicon word.
    """
    lower = [w.lower() for w in words]
    framed = "".join(f"\x02{w}\x03" for w in lower)
    codes = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in lower], np.int64)
    begin = np.cumsum(sizes) - sizes
    n, every = len(words), np.arange(len(words))
    owner = np.repeat(every, sizes)
    place = np.arange(len(codes)) - begin[owner]
    rest = sizes[owner] - 1 - place
    feature, of = [], []

    def add(which: np.ndarray, value: np.ndarray, kind: int) -> None:
        feature.append(_mix(value, kind))
        of.append(which)

    with np.errstate(over="ignore"):
        add(every, np.zeros(n, np.int64), 0)
        named = _mix(codes, place)
        add(every, np.add.reduceat(named, begin), 1)
        add(every, np.minimum(sizes, 14), 2)
        add(every, np.array([2 * w.istitle() + w.isupper() for w in words]), 3)
        # affixes: running sums of the characters, named by their distance from the word's start or end
        from_start, from_end = np.cumsum(named), np.cumsum(_mix(codes, rest)[::-1])[::-1]
        for k in range(1, 5):
            longer = np.flatnonzero(sizes - 2 >= k)
            first, last = begin[longer], begin[longer] + sizes[longer] - 1
            add(longer, from_start[first + k] - from_start[first], 10 + k)
            add(longer, from_end[last - k] - from_end[last], 20 + k)
        mid = np.flatnonzero(rest >= 2)
        add(owner[mid], _mix(_mix(codes[mid], codes[mid + 1]), codes[mid + 2].astype(_U)), 4)
        listed = [(i, k) for i, w in enumerate(lower) if (k := lexicon.get(w)) is not None]
        if listed:
            add(np.array([i for i, _ in listed]), np.array([k for _, k in listed]), 5)
    of, feature = np.concatenate(of), np.concatenate(feature)
    order = np.argsort(of, kind="stable")
    return (feature[order] % _U(DIMENSIONS)).astype(np.int64), np.searchsorted(of[order], every)


@dataclass
class CRF:
    languages: list[str]
    weights: np.ndarray  # dimensions x languages
    transitions: np.ndarray  # log scores, from x to
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Exponentiated emission scores of words, the largest of each scaled to 1."""
        flat, starts = word_features(words, self.lexicon)
        s = np.add.reduceat(self.weights[flat], starts)
        return np.exp(np.maximum(s - s.max(1, keepdims=True), -30))


def forward_backward(chains: list[np.ndarray], emission: np.ndarray, transitions: np.ndarray, words: bool = False, pairs: np.ndarray | None = None, segment: int = 1 << 15) -> tuple[np.ndarray, list[np.ndarray]]:
    """Summed marginals of each chain and, if ``words``, each word's.

    Chains are arrays of rows of ``emission``; they are swept together, longest first, so that step t works on
    those that reach it.  Forward scores are kept for ``segment`` steps: of longer chains those at the segments' starts stay,
    and the others are made again when the backward sweep comes there.  ``pairs``, if given, gets the expected transition counts added.
    """
    k = emission.shape[1]
    sizes = np.array([len(c) for c in chains])
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    ids = np.zeros((steps, len(chains)), np.int32)
    for j, i in enumerate(order):
        ids[: sizes[i], j] = chains[i]
    active = len(chains) - np.searchsorted(np.sort(sizes), np.arange(steps), "right")
    a = np.exp(transitions)

    def forward(lo: int, before: np.ndarray | None) -> np.ndarray:
        alpha = np.empty((min(segment, steps - lo), len(chains), k))
        for t in range(lo, lo + len(alpha)):
            n = active[t]
            now = emission[ids[t, :n]] * (before[:n] @ a if t else 1.0)
            alpha[t - lo, :n] = before = now / now.sum(1, keepdims=True)
        return alpha

    starts, alpha, carried = range(0, steps, segment), None, {0: None}
    for lo in starts:
        alpha = forward(lo, carried[lo])
        carried[lo + segment] = alpha[-1].copy()
    beta, total = np.ones((len(chains), k)), np.zeros((len(chains), k))
    gammas = np.zeros((steps, len(chains), k)) if words else None
    for lo in reversed(starts):
        if lo != starts[-1]:
            alpha = forward(lo, carried[lo])
        for t in range(lo + len(alpha) - 1, lo - 1, -1):
            n = active[t]
            g = alpha[t - lo, :n] * beta[:n]
            g /= g.sum(1, keepdims=True)
            total[:n] += g
            if words:
                gammas[t, :n] = g
            eb = emission[ids[t, :n]] * beta[:n]
            if pairs is not None and t:
                x = (alpha[t - lo - 1] if t > lo else carried[lo])[:n, :, None] * a[None] * eb[:, None, :]
                pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
            back = eb @ a.T
            beta[:n] = back / back.sum(1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total
    if not words:
        return out, []
    per_word: list[np.ndarray] = [np.empty((0, k))] * len(chains)
    for j, i in enumerate(order):
        per_word[i] = gammas[: sizes[i], j]
    return out, per_word


def build_lexicon(texts: list[str], tags: list[int], n_languages: int, top: int = 300) -> dict[str, int]:
    """Words by language: frequent there, and at least three times as frequent as elsewhere."""
    counts = [Counter() for _ in range(n_languages)]
    for text, tag in zip(texts, tags, strict=True):
        counts[tag].update(w.lower() for w in words_of(text))
    sums = [max(1, sum(c.values())) for c in counts]
    lexicon = {}
    for k, c in enumerate(counts):
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]:
            if n >= 3 and all(n / sums[k] >= 3 * counts[j][w] / sums[j] for j in range(n_languages) if j != k):
                lexicon[w] = k
    return lexicon


def fit(texts: list[str], tags: list[str], rounds: int = 20, rate: float = 0.4, seed: int = 0) -> CRF:
    """Maximum likelihood by AdaGrad over chains of lines."""
    languages = sorted(set(tags))
    numbers = [languages.index(t) for t in tags]
    k = len(languages)
    model = CRF(languages, np.zeros((DIMENSIONS, k)), np.zeros((k, k)), build_lexicon(texts, numbers, k))
    seen: dict[str, int] = {}
    lines = []
    for text, tag in zip(texts, numbers, strict=True):
        for line in text.split("\n"):
            if ids := [seen.setdefault(w, len(seen)) for w in words_of(line)]:
                lines.append((np.array(ids), tag))
    if not lines:
        return model
    rng = np.random.default_rng(seed)
    rng.shuffle(lines)
    chains, truths, at = [], [], 0
    while at < len(lines):
        part = lines[at : at + rng.integers(1, 4)]
        at += len(part)
        chains.append(np.concatenate([x for x, _ in part]))
        truths.append(np.concatenate([np.full(len(x), y) for x, y in part]))
    rows = [*seen]
    flat, starts = word_features(rows, model.lexicon)
    owner = np.repeat(np.arange(len(rows)), np.diff([*starts, len(flat)]))
    truth_words = np.zeros((len(rows), k))
    observed = np.zeros((k, k))
    for c, y in zip(chains, truths, strict=True):
        np.add.at(truth_words, (c, y), 1)
        np.add.at(observed, (y[:-1], y[1:]), 1)
    all_words = np.concatenate(chains)
    bounds = np.cumsum([0, *map(len, chains)])
    gw, gt = np.full(model.weights.shape, 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds):
        s = np.add.reduceat(model.weights[flat], starts)
        e = np.exp(np.maximum(s - s.max(1, keepdims=True), -30))
        pairs, gamma = np.zeros((k, k)), np.zeros((len(all_words), k))
        for lo in range(0, len(chains), 512):
            _, per = forward_backward(chains[lo : lo + 512], e, model.transitions, True, pairs)
            gamma[bounds[lo] : bounds[min(lo + 512, len(chains))]] = np.concatenate(per)
        expected = np.stack([np.bincount(all_words, gamma[:, j], len(rows)) for j in range(k)], 1)
        diff = truth_words - expected
        g = np.stack([np.bincount(flat, diff[owner, j], DIMENSIONS) for j in range(k)], 1) - 0.01 * model.weights
        gw += g * g
        model.weights += rate * g / np.sqrt(gw)
        t = observed - pairs - 0.01 * model.transitions
        gt += t * t
        model.transitions += rate * t / np.sqrt(gt)
    return model


def train(docs: DataFrame, held_mod: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_docs: int = N_DOCS, max_chars: int = MAX_CHARS) -> CRF | None:
    """Fit on a bounded sample of the training folds; None if they hold no labelled text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((fold(F.col("id"), held_mod) != held) & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    ids = hash_sample(rows.select("id"), "id", n_docs).distinct()
    got = rows.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(n_docs).toPandas()
    return fit([*got["text"]], [*got["lang"]]) if len(got) else None


class Tagger:
    """Labels texts in a task; distinct words are scored once while the table has room, ``block`` at a time."""

    def __init__(self, model: CRF, max_words: int = 100_000, block: int = 4096) -> None:
        self.model, self.max_words, self.block = model, max_words, block
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)))

    def learn(self, new: list[str]) -> None:
        """Scores words that the table lacks; words without a letter stay out."""
        new = [w for w in new if any(map(str.isalpha, w))]
        at = len(self.ids)
        self.ids.update(zip(new, range(at, at + len(new)), strict=True))
        self.table = np.concatenate([self.table, *(self.model.emissions(new[i : i + self.block]) for i in range(0, len(new), self.block))])

    def chains(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [words_of(t) for t in texts]
        new = {w for own in words for w in own if w not in self.ids}
        if self.ids and len(self.ids) + len(new) > self.max_words:  # what one call asks for has to be there at once
            self.clear()
            new = {w for own in words for w in own}
        self.learn(sorted(new))
        get = self.ids.get
        return [np.array([i for i in map(get, own) if i is not None], np.int32) for own in words]

    def marginals(self, texts: list[str | None], words: bool = False, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Mean distribution of each text, in order (empty without letters), and of its words if asked for."""
        chains = self.chains(texts)
        results: list[tuple[np.ndarray, np.ndarray | None]] = [(np.empty(0), None)] * len(texts)
        order = sorted((i for i, c in enumerate(chains) if len(c)), key=lambda i: -len(chains[i]))
        at = 0
        while at < len(order):
            part = order[at : at + max(1, block // len(chains[order[at]]))]
            at += len(part)
            total, per = forward_backward([chains[i] for i in part], self.table, self.model.transitions, words)
            for j, i in enumerate(part):
                results[i] = (total[j] / len(chains[i]), per[j] if words else None)
        return iter(results)


def predict(docs: DataFrame, model: CRF | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred string, score double; one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tagger = Tagger(model) if model else None
        for batch in batches:
            for part, texts in text_slices(batch):
                langs, scores = [], []
                for mean, _ in tagger.marginals(texts) if tagger else ((np.empty(0), None) for _ in texts):
                    best = int(mean.argmax()) if len(mean) else -1
                    langs.append(model.languages[best] if best >= 0 else "und")
                    scores.append(float(min(1.0, mean[best])) if best >= 0 else 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: CRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and words array<struct<word, lang, p>>: the language of each word of code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, languages = Tagger(shared.value), shared.value.languages
        kinds = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
        for batch in batches:
            for part, texts in text_slices(batch):
                rows = []
                for text, (_, per) in zip(texts, tagger.marginals(texts, True), strict=True):
                    own = [w for w in words_of(text) if any(map(str.isalpha, w))]
                    rows.append([{"word": w, "lang": languages[int(g.argmax())], "p": float(g.max())} for w, g in zip(own, per if per is not None else [], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kinds)], ["id", "words"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, words array<struct<word:string,lang:string,p:double>>").withColumnRenamed("id", id_col)
