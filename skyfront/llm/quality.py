"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are described by structural features (shares of
character classes, repetition, word and line shape) and by the shares of their words and of their bytes' trigrams in
``HASHED`` hash buckets each.  The class prior is estimated first: for any
region A of feature space, P_U(A) >= prior * P_P(A), so the smallest ratio over the regions "score of a
positive-against-unlabelled model >= t" bounds the prior, tightly where a region holds few negatives.
Then a one-layer network minimises the non-negative unbiased risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` with logistic loss.

The model is fitted on a bounded sample (``n_positive`` labelled and ``n_unlabelled`` other rows of lowest id hash; the
rows and not what they say decide) and shipped to the tasks; every text is then scored whole, in one pass without a shuffle.  Texts are
taken in runs of about 1 MB; a very long one is counted by pieces.

Defined results: a text that is null, empty or white space scores 0; repeated rows each give a row;
labels that are null count as absent; without any positive the score is 0.5; an empty table gives an empty result; other columns are
ignored, and those in ``keep`` come back under their names (``score`` should not be one).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, hash_sample, release, text_slices
from .ngram_join import word_hashes

#: Bounds of the fitting sample (documented parameters).
N_POSITIVE, N_UNLABELLED = 12_000, 12_000
SYMBOLS = frozenset(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) - set(".,;:?'\"()-")
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b" ", b"\n", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?'\"()-", b"!", b"|", b"*%$&#@^~_=+<>[]{}\\/`"), 1):
    _CLASS[list(_chars)] = _k
#: Hash buckets for words, and for trigrams of bytes.
HASHED = 128
N_FEATURES = 20 + 2 * HASHED
#: Hashed shares are many and each says little: they count for less than a structural feature, and the less the smaller the sample is.
DAMPED = 15.0
_PIECE = 1 << 20


def hashed_shares(raw: bytes) -> np.ndarray:
    """Square roots of the shares of a text's words and byte trigrams in hash buckets (ASCII letters without case)."""
    b = np.frombuffer(raw, np.uint8)
    word = np.bincount((word_hashes(b) >> np.uint64(40)).astype(np.int64) % HASHED, minlength=HASHED).astype(np.float64)
    gram = np.zeros(HASHED)
    for lo in range(0, max(0, len(b) - 2), _PIECE):
        x = (b[lo : lo + _PIECE + 2] | 0x20).astype(np.uint32)
        gram += np.bincount((((x[:-2] * 31 + x[1:-1]) * 31 + x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 7), minlength=HASHED)[:HASHED]
    return np.sqrt(np.concatenate([word / max(word.sum(), 1), gram / max(gram.sum(), 1)]))


def features(text: str) -> np.ndarray:
    """What a whole text is described by."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / max(n, 1)
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    lower = [w.lower() for w in words]
    return np.array([
        *share[1:9],
        sum(map(str.isupper, words)) / k,
        sum(w[-1] in SYMBOLS for w in words) / k,
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / k,
        np.log(len(set(lower)) + 1) / np.log(k + 1),
        n / k,
        max(map(len, words), default=0) ** 0.5,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(k),
        len(zlib.compress(raw, 1)) / max(n, 1),
        np.log1p(n / len(lines)),
        len(text) / max(n, 1),
        *hashed_shares(raw),
    ])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class PUModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2)


#: Rows that are standardised or multiplied (in doubles) at a time: the driver holds the sample once, and while the prior is estimated half of it again.
_ROWS = 1024


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return [x[lo : lo + _ROWS] for lo in range(0, len(x), _ROWS)]


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([part @ w for part in _parts(x)]) if len(x) else x @ w


def _train(x: np.ndarray, n: int, prior: float | None, hidden: int, steps: int, seed: int) -> tuple[np.ndarray, ...]:
    """Weights by Adam for ``n`` positives and the unlabelled rows after them. ``prior=None``: plain logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    theta = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    theta = [t.astype(np.float32) for t in theta]
    k = len(x) - n
    for step in range(1, steps + 1):
        h = np.tanh(_times(x, theta[0]) + theta[1])
        f = h @ theta[2] + theta[3]
        s = _sigmoid(f)
        if prior is None:
            g = np.concatenate([(s[:n] - 1) / n, s[n:] / k])
        else:
            # derivative of log(1 + e^-f) is s - 1, of log(1 + e^f) it is s
            negative = np.log1p(np.exp(np.clip(f[n:], -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(f[:n], -30, 30))).mean()
            if negative >= 0:
                g = np.concatenate([prior * (s[:n] - 1) / n - prior * s[:n] / n, s[n:] / k])
            else:  # the part that must not fall below zero is pushed back
                g = np.concatenate([prior * s[:n] / n, -s[n:] / k])
        back = np.outer(g, theta[2]) * (1 - h * h)
        grads = [sum(a.T @ b for a, b in zip(_parts(x), _parts(back), strict=True)) + 1e-4 * theta[0], back.sum(0), h.T @ g + 1e-4 * theta[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            theta[i] = theta[i] - 0.03 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(theta)


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in ``u`` by the scores of held-out positives and unlabelled rows: the least ratio over regions that hold much of both.

    Less one standard error: a prior that is too large lets the risk's bound bite early, a slightly small one does no harm.
    """
    cuts = np.quantile(p, np.linspace(0.02, 0.5, 25))
    return float(np.clip(min((u >= t).mean() / max((p >= t).mean(), 1e-9) for t in cuts) - len(u) ** -0.5, 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray, hidden: int = 12, steps: int = 250, seed: int = 0) -> PUModel:
    """A model from features of trusted positives and of unlabelled texts."""
    return _fit(np.vstack([p, u]).astype(np.float32, copy=False), len(p), hidden, steps, seed)


def _fit(x: np.ndarray, n: int, hidden: int = 12, steps: int = 250, seed: int = 0) -> PUModel:
    """A model from ``n`` positives and the unlabelled rows after them, which are standardised in place."""
    parts = _parts(x)
    mean = sum(part.sum(0, np.float64) for part in parts) / len(x)
    scale = np.sqrt(np.maximum(sum(np.einsum("ij,ij->j", part, part, dtype=np.float64) for part in parts) / len(x) - mean**2, 0)) + 1e-6
    scale[-2 * HASHED :] *= DAMPED * max(1.0, (20_000 / len(x)) ** 0.5)
    for part in parts:
        part -= mean.astype(np.float32)
        part /= scale.astype(np.float32)
        np.clip(part, -8, 8, out=part)
    half_p, half_u = n // 2 or 1, (len(x) - n) // 2 or 1
    w1, b1, w2, b2 = _train(np.vstack([x[:half_p], x[n : n + half_u]]), half_p, None, hidden, steps // 2, seed)
    held = [np.tanh(_times(a, w1) + b1) @ w2 + b2 for a in (x[half_p:n], x[n + half_u :])]
    prior = estimate_prior(*held) if all(map(len, held)) else 0.5
    w1, b1, w2, b2 = _train(x, n, prior, hidden, steps, seed)
    return PUModel(mean, scale, w1, b1, w2, float(b2[0]), prior)


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, p, x): features of each row's text, as the bytes of 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                x = np.array([features(t or "") for t in texts], np.float32).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("p"), pa.array([row.tobytes() for row in x], pa.binary())], ["id", "p", "x"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), "p", F.col(text_col).alias("text"))
    kind = [rows.schema["id"], rows.schema["p"], T.StructField("x", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(kind))


def sample(rows: pa.Table) -> tuple[np.ndarray, int]:
    """The features of a table (p, x), positives first and each in the table's order, and the number of positives."""
    p = rows.column("p").to_numpy()
    n, x = int((p == 1).sum()), np.empty((len(p), N_FEATURES), np.float32)
    place, lo = np.where(p == 1, np.cumsum(p == 1) - 1, n + np.cumsum(p != 1) - 1), 0
    for part in rows.column("x").chunks:
        for i, v in enumerate(part, lo):
            x[place[i]] = np.frombuffer(v.as_buffer(), np.float32)
        lo += len(part)
    return x, n


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n_positive: int = N_POSITIVE, n_unlabelled: int = N_UNLABELLED) -> PUModel | None:
    """Fit on positives of the training folds and on unlabelled texts, each a bounded sample; None without both."""
    ids = F.col(id_col).alias("id")
    positive = labels.where((F.col(label_col) == 1) & (fold(F.col(id_col), held_mod) != held) & F.col(id_col).isNotNull()).select(ids).distinct()
    chosen = hash_sample(positive, "id", n_positive).select("id", F.lit(1).alias("p"))
    web = hash_sample(docs.where(F.col(id_col).isNotNull()).select(ids), "id", n_unlabelled).distinct().select("id", F.lit(0).alias("p"))
    rows = docs.select(ids, F.col(text_col).alias("text")).join(F.broadcast(chosen.unionByName(web)), "id")
    got = feature_table(rows, "id", "text")
    got = got.orderBy(F.xxhash64("id"), "id", "p").limit(2 * (n_positive + n_unlabelled)).select("p", "x").toArrow()
    x, n = sample(got)
    del got
    release()
    model = _fit(x, n) if 0 < n < len(x) else None
    del x
    release()
    return model


def score(docs: DataFrame, model: PUModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the id) and ``score``, for every row of ``docs``."""
    rows = docs.select(F.struct(*(keep or [id_col])).alias("row"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                x = np.array([features(t or "") for t in texts]).reshape(-1, N_FEATURES)
                y = model.score(x) if model else np.full(len(x), 0.5)
                blank = [not (t or "").strip() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.where(blank, 0.0, y).astype(np.float64))], ["row", "score"])
        release()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])).select("row.*", "score")
