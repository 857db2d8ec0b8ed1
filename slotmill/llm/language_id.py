"""Language ID (operator 3): nearest centroid over TF-IDF vectors of character n-grams.

A text is lower-cased, its ASCII non-letters become single blanks, and its byte runs of one to
three bytes are hashed into DIMS counts. Log counts times inverse document frequency, scaled
to length 1, make its vector. Every language has up to CLUSTERS spherical k-means centroids;
a text gets the language of the centroid with the largest cosine. A text whose cosine is below
what nearly all training texts of that language reach is marked as rejected: it resembles no
learned language well, though the nearest one is still named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, slices

FOLDS, HELD_OUT = 3, 1
#: Training texts a language and altogether at most, hash space, centroids a language, k-means rounds.
#: There are as many languages as texts at most: of more, the most frequent ones.
PER_LANGUAGE, TOTAL, DIMS, CLUSTERS, ROUNDS = 600, 4_000, 4096, 4, 15
#: Share of training texts that lie farther than the rejection distance; sharpness of the score.
REJECT, SHARPNESS = 0.002, 25.0

_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of the general category L occurs, as in Java's \\p{L}."""
    return any(map(str.isalpha, text))


def counts_of(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    code = np.concatenate([b, two + np.uint32(0x10000), three + np.uint32(0x4000000)])
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out = [counts_of(t).astype("<f4").tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(out, pa.binary())], ["lang", "counts"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        """`langs` of the training rows, their counts (rows x DIMS)."""
        self.idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self.vectors(counts)
        self.langs, centres, self.owner, self.least = sorted(set(langs)), [], [], []
        lang = np.array(langs)
        for k, name in enumerate(self.langs):
            c = self._cluster(x[lang == name])
            centres.append(c)
            self.owner += [k] * len(c)
        self.centres, self.owner = np.concatenate(centres), np.array(self.owner)
        near = self.cosines(x)
        for k, name in enumerate(self.langs):
            self.least.append(float(np.quantile(near[lang == name, k], REJECT)))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    @staticmethod
    def _cluster(x: np.ndarray) -> np.ndarray:
        centres = x[:1]
        while len(centres) < min(CLUSTERS, len(x)):  # the farthest next
            centres = np.concatenate([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
        for _ in range(ROUNDS):
            at = (x @ centres.T).argmax(axis=1)
            centres = _unit(np.stack([x[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))]))
        return centres

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Rows x languages: the cosine with the nearest centroid of each."""
        c = x @ self.centres.T
        return np.stack([c[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, far = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if at:
            c = self.cosines(self.vectors(np.stack([counts_of(texts[i]) for i in at])))
            e = np.exp(SHARPNESS * (c - c.max(axis=1, keepdims=True)))
            best = c.argmax(axis=1)
            for i, k, row, p in zip(at, best, c, e.max(axis=1) / e.sum(axis=1), strict=True):
                lang[i], score[i], far[i] = self.langs[k], float(p), bool(row[k] < self.least[k])
        return lang, score, far


def _predicted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for part in slices(batches):
        lang, score, far = model.predict(part.column("text").to_pylist()) if model else (["und"] * part.num_rows, [0.0] * part.num_rows, [True] * part.num_rows)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"]
        )


def train(docs: DataFrame, each: int = PER_LANGUAGE, total: int = TOTAL) -> Centroids | None:
    """Learn from the documents outside the held-out fold: at most `each` texts a language and
    `total` altogether, taken by a hash of id and text."""
    plain = docs.select("doc_id", "text", "lang").where((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in plain.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(total).collect()}
    if not sizes:
        return None
    n = min(each, max(1, total // len(sizes)))
    # By 63 bits, so that no language is too large; a fifth more than needed goes on to be ranked.
    top = 2**63 - 1
    share = docs.sparkSession.createDataFrame([(k, min(top, int((1.2 * n + 50) / x * top))) for k, x in sizes.items()], "lang string, below long")
    at = F.xxhash64("doc_id", "text", F.lit(7)).bitwiseAND(F.lit(top))
    some = plain.withColumn("at", at).join(F.broadcast(share), "lang").where("at <= below")  # a row a language, `total` at most
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id", "text"))
    rows = some.withColumn("place", place).where(F.col("place") <= n).select("lang", "text").mapInArrow(_vectors, "lang string, counts binary").collect()
    rows.sort()
    return Centroids([r[0] for r in rows], np.stack([np.frombuffer(r[1], "<f4") for r in rows])) if rows else None


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of `docs` (doc_id, text, lang, any others).

    Null, empty and letterless texts are `und` with score 0. Without any learnable row every
    text is `und`. Repeated rows get the same answer; an empty table gives no rows. Ties go to
    the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select("doc_id", "text", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(partial(_predicted, sent=sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")
