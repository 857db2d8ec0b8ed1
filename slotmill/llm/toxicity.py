"""Toxicity (operator 2): non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic documents and from unlabelled text (a sample of
all learnable documents, whatever their labels). A linear model g is fitted in numpy to the
non-negative risk  p R+(g) + max(0, U-(g) - p P-(g)),  where p is the class prior, R+ the loss
of positives as positive, P- and U- the losses of positives and unlabelled as negative. The
prior is the share of toxic rows among the learnable labels.

Features of a document are its distinct lower-cased words and the leading letters of them,
hashed; each counts how many distinct words carry it, damped by the number of words. Only
features whose document frequency differs clearly between positives and unlabelled text take
part, the clearer the more freely. As the model is linear in words, a worker scores a word
once and remembers the sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CACHE, crc_fold, sample, slices

#: Documents of the training sample at most.
POSITIVES, UNLABELLED = 2_000, 5_000
#: Standard errors of a frequency difference for a feature to take part, and to do so freely.
LEAST_Z, FULL_Z = 3.0, 6.0
#: Leading letters that make features, hash space, rounds and step of the fit, weight decay.
PREFIXES, SPACE, EPOCHS, STEP, DECAY = (4, 5, 6, 7), 2**22, 300, 0.05, 1e-5
FOLDS = 5

_LETTERS = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> list[int]:
    """Hashed features of one word: itself and its leading letters."""
    return [xxhash.xxh3_64_intdigest(f"{len(word)}={word}".encode()) % SPACE] + [
        xxhash.xxh3_64_intdigest(f"{k}<{word[:k]}".encode()) % SPACE for k in PREFIXES if len(word) > k
    ]


class Features(dict):
    def __missing__(self, word: str) -> np.ndarray:
        value = self[word] = np.array(features_of(word), np.int32)
        return value


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Features()
    for part in slices(batches):
        ids, counts, size = [], [], []
        for text in part.column("text").to_pylist():
            words = set(_LETTERS((text or "").lower()))
            if len(cache) > WORD_CACHE:
                cache.clear()
            f, n = np.unique(np.concatenate([cache[w] for w in words]) if words else np.empty(0, np.int32), return_counts=True)
            ids.append(f.astype("<i4").tobytes()), counts.append(n.astype("<i4").tobytes()), size.append(len(words))
        yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(size, pa.int64())], ["positive", "ids", "counts", "size"])


def damping(n_words) -> np.ndarray:
    return 2 / np.sqrt(1 + np.asarray(n_words, float))


class Model:
    """Weights by feature, a bias; `word(w)` is the undamped sum of a word."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.ids, self.weights, self.bias = ids, weights, bias

    def table(self) -> dict[int, float]:
        return dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))


def fit_nnpu(rows: list[tuple[bool, np.ndarray, np.ndarray, int]], prior: float) -> Model:
    """Fit to rows (positive, feature ids, counts, words); positives and unlabelled."""
    positive = np.array([r[0] for r in rows], bool)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not 0 < prior < 1:
        return Model(np.empty(0, np.int32), np.empty(0), -4.0)
    known = np.unique(np.concatenate([r[1] for r in rows]))
    in_p, in_u = (np.bincount(np.searchsorted(known, np.concatenate([r[1] for r in rows if r[0] == p])), minlength=len(known)) for p in (True, False))
    pool = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(pool * (1 - pool) * (1 / n_p + 1 / n_u))
    keep = (z >= LEAST_Z) & (in_p + in_u >= 3)
    if not keep.any():
        return Model(np.empty(0, np.int32), np.empty(0), float(np.log(prior / (1 - prior))))
    known, free = known[keep], np.minimum(z[keep] / FULL_Z, 1)
    doc, col, val = [], [], []
    for i, (_, ids, counts, size) in enumerate(rows):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        ok = known[at] == ids
        col.append(at[ok]), val.append(counts[ok] * damping(size) * free[at[ok]]), doc.append(np.full(int(ok.sum()), i))
    doc, col, val = np.concatenate(doc), np.concatenate(col), np.concatenate(val)
    w, b = np.zeros(len(known)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        g = np.bincount(doc, val * w[col], len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # the gradient of -log(1 - s), and 1 + that of -log s
        loss_neg = np.log1p(np.exp(np.clip(g, -30, 30)))
        negative = loss_neg[~positive].sum() / n_u - prior * loss_neg[positive].sum() / n_p
        d = np.where(positive, prior * (s - 1) / n_p, 0.0)
        if negative >= 0:
            d += np.where(positive, -prior * s / n_p, s / n_u)
        grad = np.bincount(col, val * d[doc], len(w)) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        w -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= STEP * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return Model(known, w * free, b)


class WordScores(dict):
    def __init__(self, model: Model) -> None:
        self.weights, self.bias = model.table(), model.bias

    def __missing__(self, word: str) -> float:
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value

    def score(self, text: str | None) -> float:
        words = set(_LETTERS((text or "").lower()))
        if len(self) > WORD_CACHE:
            self.clear()
        g = self.bias + sum(map(self.__getitem__, words)) * float(damping(len(words)))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    scorer = WordScores(sent.value)
    for part in slices(batches):
        score = [scorer.score(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
        )


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the rows whose crc32 fold isn't 0: at most `positives` confirmed toxic documents
    and `unlabelled` others, each taken by a hash of id and text. Null ids are never learnt from."""
    known = labels.where((crc_fold(F.col("doc_id"), FOLDS) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    plain = docs.select("doc_id", "text").where(crc_fold(F.col("doc_id"), FOLDS) != 0)
    ids = sample(known.where(F.col("toxic") == 1).select("doc_id").distinct(), positives, toxic, 11, "doc_id")
    confirmed = plain.join(F.broadcast(ids), "doc_id", "left_semi")  # at most `positives` ids; an id may have many rows
    confirmed = sample(confirmed, positives, confirmed.count(), 12, "doc_id", "text").withColumn("positive", F.lit(True))
    rest = sample(plain, unlabelled, plain.count(), 11, "doc_id", "text").withColumn("positive", F.lit(False))
    rows = confirmed.union(rest).select("positive", "text").mapInArrow(_vectors, "positive boolean, ids binary, counts binary, size long").collect()
    return fit_nnpu([(r[0], np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<i4"), r[3]) for r in rows], toxic / max(1, n))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text, any others).

    `labels` has doc_id and toxic (1, 0 or null). Null and empty texts score by the bias alone.
    Without toxic labels, without any that isn't, or without learnable documents nothing can be
    learnt: every text gets one score below 1/2. Repeated rows score alike; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"))
    return rows.mapInArrow(partial(_scored, sent=sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
