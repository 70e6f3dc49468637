"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else is unlabelled web text, and no negative label is read. The
share of good text among the unlabelled (the class prior) is estimated from how far a positive-against-unlabelled
scorer's top can be explained by positives alone. Then a small network minimises the non-negative unbiased risk: the
unlabelled risk less the prior's share of the positives' negative risk stands for the risk of the unseen negatives,
and where that estimate falls below zero, the step is taken back instead of followed.

Features describe the shape of a text (byte classes, words, repeats, lines), never its id, source or language. The fit
reads a bounded sample (``SAMPLE`` positives and as many unlabelled rows, those with the smallest hash of the id); every
document is scored.

Defined cases: null and empty texts have the features of a text without words; rows with a null id are scored, never
learned from; an empty training set scores the prior's default for all.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.common import crc_mod, renamed, slices, texts_of, utf8

SAMPLE = 8_000          # rows of each kind that are learned from, at most
THRESHOLD = 0.7

#: fixed values: byte classes whose shares are features
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" ",
            "line": b"\n", "comma": b",;:", "stop": b".", "mark": b"!?", "bar": b"|", "quote": b"\"'`", "bracket": b"()[]{}<>",
            "sign": b"#$%&*@^~", "path": b"/\\_=+-"}
_BYTE = np.zeros((256, len(_CLASSES) + 1))
for _k, _bytes in enumerate(_CLASSES.values()):
    _BYTE[list(_bytes), _k] = 1
_BYTE[128:, -1] = 1
NAMES = (*_CLASSES, "high", "log_bytes", "log_words", "word_bytes", "distinct", "same_as_last", "most_common", "caps", "bare", "odd_end",
         "line_words", "line_repeats")
_BARE = frozenset("|*#-=~_.")


def features(text: bytes) -> list[float]:
    n = len(text)
    counts = np.zeros(256, np.int64)
    for at in range(0, n, 1 << 20):
        counts += np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, n - at), at), minlength=256)
    shares = (counts @ _BYTE) / max(1, n)
    words = text.split()
    w = len(words)
    if not w:
        return [*shares.tolist(), np.log1p(n), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    same = sum(map(bytes.__eq__, words, words[1:]))
    distinct = set(words)
    # the upper-cased form differs from the lower-cased one: letters; equal to the word itself: capitals
    caps = sum(map(bytes.isupper, words))
    bare = w - sum(map(_has_letter, words))
    odd = sum(map(_odd_end, words))
    lines = text.split(b"\n")
    first = words[0] if len(distinct) == 1 else None
    most = 1.0 if first is not None else _most_common(words) / w
    return [*shares.tolist(), np.log1p(n), np.log1p(w), (n - counts[32]) / w, len(distinct) / w, same / max(1, w - 1), most, caps / w,
            bare / w, odd / w, np.log1p(w / len(lines)), 1 - len(set(lines)) / len(lines)]


_LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))


def _has_letter(word: bytes) -> bool:
    return word[0] in _LETTERS or word[-1] in _LETTERS or not _LETTERS.isdisjoint(word)


_PLAIN_ENDS = _LETTERS | frozenset(b".,;:?0123456789")


def _odd_end(word: bytes) -> bool:
    return word[-1] not in _PLAIN_ENDS


def _most_common(words: list[bytes]) -> int:
    from collections import Counter
    return max(Counter(words).values())


# ---------------------------------------------------------------- model

@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    @property
    def learned(self) -> bool:
        return bool(np.any(self.w2))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, rounds: int = 300) -> float:
    """Share of positives among the unlabelled: the smallest ratio of what the unlabelled and the positives have above a
    score, over scores that enough held-out positives pass, with a margin for counting errors."""
    half_p, half_u = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    x = np.vstack([pos[half_p], unl[half_u]])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.r_[np.ones(half_p.sum()), np.zeros(half_u.sum())]
    weight = np.where(y > 0, 0.5 / max(1, half_p.sum()), 0.5 / max(1, half_u.sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= 2.0 * (x.T @ (weight * (_sigmoid(x @ w) - y)) + 1e-4 * w)
    apply = lambda a: np.hstack([a, np.ones((len(a), 1))]) @ w
    p, u = apply(pos[~half_p]), apply(unl[~half_u])
    if not len(p) or not len(u):
        return 0.5
    best = 1.0
    for t in np.quantile(p, np.linspace(0.02, 0.9, 60)):
        a, b = (p >= t).mean(), (u >= t).mean()
        best = min(best, (b + np.sqrt(b * (1 - b) / len(u))) / max(1e-9, a - np.sqrt(a * (1 - a) / len(p))))
    return float(np.clip(best, 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, hidden: int = 16, steps: int = 1_500, rate: float = 0.01,
        seed: int = 7) -> Model:
    """Minimise the non-negative PU risk with the logistic loss (Adam, mini-batches from both sides)."""
    dims = len(NAMES)
    if not len(pos) or not len(unl):
        return Model(np.zeros(dims), np.ones(dims), np.zeros((dims, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 0.5)
    both = np.vstack([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    prior = estimate_prior(p, u) if prior is None else prior
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(dims), (dims, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
        x = np.vstack([a, b])
        h = np.maximum(x @ params[0] + params[1], 0)
        out = h @ params[2] + params[3][0]
        s, is_p = _sigmoid(out), np.r_[np.ones(len(a), bool), np.zeros(len(b), bool)]
        neg_loss = np.log1p(np.exp(np.clip(out, -30, 30)))
        unseen = neg_loss[~is_p].mean() - prior * neg_loss[is_p].mean()      # risk of the unseen negatives
        on_unseen = np.where(is_p, -prior / len(a), 1 / len(b)) * s
        # below zero: take the step back on that part alone
        grad = np.where(is_p, prior / len(a) * (s - 1), 0) + on_unseen if unseen >= 0 else -on_unseen
        back = np.outer(grad, params[2]) * (h > 0)
        grads = [x.T @ back + 1e-4 * params[0], back.sum(0), h.T @ grad + 1e-4 * params[2], np.array([grad.sum()])]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * (1 - step / steps) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior)


# ---------------------------------------------------------------- on Spark

def _feature_rows(texts: DataFrame) -> np.ndarray:
    """Features of a bounded sample, at the driver: a few hundred bytes a row."""
    def run(batches):
        for b in slices(batches, 200):
            x = [features(t) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], names=["x"])
    got = texts.select("text").mapInArrow(run, "x array<double>").toArrow().column("x")
    return np.array(got.to_pylist(), float).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id",
          label_col: str = "quality", text_col: str = "text", prior: float | None = None) -> Model:
    """A model from rows labelled 1 and from unlabelled rows; ``held_out``: rows of docs that are never read."""
    own = docs if held_out is None else docs.filter(~held_out)
    texts = texts_of(own.filter(own[id_col].isNotNull()), id_col, text_col)
    good = labels.filter(labels[label_col] == 1).select(labels[id_col].cast("long").alias("doc_id")).distinct()
    known = labels.filter(labels[label_col].isNotNull()).select(labels[id_col].cast("long").alias("doc_id")).distinct()
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id"]
    ids = texts.select("doc_id").distinct()
    trusted = ids.join(good, "doc_id", "left_semi").orderBy(*order).limit(sample)
    web = ids.join(known, "doc_id", "left_anti").orderBy(*order).limit(sample)
    if web.isEmpty():                                             # all rows are labelled: those not trusted, whatever their label
        web = ids.join(trusted, "doc_id", "left_anti").orderBy(*order).limit(sample)
    chosen = trusted.withColumn("good", F.lit(1)).unionByName(web.withColumn("good", F.lit(0)))
    rows = texts.join(F.broadcast(chosen), "doc_id")              # at most 2 * sample ids
    return fit(_feature_rows(rows.filter("good = 1")), _feature_rows(rows.filter("good = 0")), prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
           carry: bool = False) -> DataFrame:
    """doc_id, score, predicted of every row; with ``carry`` the rows of docs that are predicted good, unchanged."""
    if carry and not model.learned:                               # nothing is known against any row
        return docs
    names = None
    if carry:
        docs, names = renamed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs if carry else texts_of(docs, id_col, text_col)
    text_at = src.columns.index(text_col if carry else "text")

    def scores(column) -> np.ndarray:
        x = np.array([features(t or b"") for t in utf8(column)]).reshape(-1, len(NAMES))
        return shared.value.score(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            s = scores(b.column(text_at))
            if carry:
                yield b.filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])
    out = src.mapInArrow(run, docs.schema if carry else "doc_id long, score double, predicted int")
    return names(out) if carry else out


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from rows whose crc32(doc_id) mod 4 is not 2."""
    model = train(docs, labels, crc_mod(docs["doc_id"], 4) == 2)
    out = scored(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
