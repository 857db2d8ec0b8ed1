"""Quality classifier (operator 6): hierarchical empirical Bayes over sites.

Evidence: a logistic regression on text statistics, fitted to labelled documents, gives each
document a log-odds of good quality. Sites: documents share a host, and within it a path.
The mean evidence of a host is shrunk toward the global share of good documents, that of a
path toward its host; how strongly follows from the spread between hosts (and between paths)
by the method of moments, so that sparse sites lean on the level above. The posterior of a
document multiplies its own likelihood ratio with the posterior of its path as the prior.

Both levels are grouped sums, combined before the shuffle; no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIds, crc_fold, cut, give_back, sample, slices

FOLDS = 5
#: Labelled documents to fit on at most, ridge, Newton rounds.
LABELLED, RIDGE, ROUNDS = 6_000, 1.0, 25
#: Least and largest weight of the level above, in documents.
WEIGHT = (5.0, 1000.0)
#: Sites up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 100_000
KEEP = 0.5
LEAST_ODDS = float(np.log(KEEP / (1 - KEEP)))


def statistics(text: str | None, cache: WordIds) -> list[float]:
    """Numbers that describe the form of a text, each of order one."""
    text = text or ""
    b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    ids = cache.of(words)
    upper, lower = b[65:91].sum(), b[97:123].sum() + b[128:].sum() / 2
    visible = max(1, b.sum() - b[[9, 10, 13, 32]].sum())
    symbols = b[[35, 42, 36, 37, 38, 60, 62]].sum() / n
    twice = (ids[1:] == ids[:-1]).sum() / n if len(ids) > 1 else 0.0
    distinct = len(np.unique(ids)) / n
    length = np.log1p(len(words))
    expected = min(1.0, 3.0 / (1.0 + length / 3.0))
    return [
        length / 7, max(0.0, 3 - length), max(0.0, 4 - length), upper / max(1.0, upper + lower), min(1.0, 3 * upper / max(1.0, upper + lower)),
        symbols, min(1.0, 4 * symbols), b[124] / n, min(1.0, 4 * b[124] / n), b[33] / n, min(1.0, 4 * b[33] / n),
        twice, min(1.0, 4 * twice), distinct, expected - distinct, b[48:58].sum() / visible, min(2.0, visible / n / 10), b[[44, 46]].sum() / n, (len(words) == 0) * 1.0,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, pen = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], RIDGE), 1e-3]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def log_odds(model, texts: list[str | None], cache: WordIds) -> np.ndarray:
    if not texts:
        return np.empty(0)
    x = np.array([statistics(t, cache) for t in texts])
    if model is None:
        return np.zeros(len(x))
    mean, scale, w = model
    return np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -12, 12)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordIds()
    for part in slices(batches):
        x = [statistics(t, cache) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])


def _evidence(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    cache, model = WordIds(), sent.value
    for part in slices(batches):
        odds = log_odds(model, part.column("text").to_pylist(), cache)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "path")), pa.array(odds, pa.float64())], ["doc_id", "host", "path", "odds"])


def _odds(sent):
    """The log-odds of a text as a column: only the text leaves the JVM, and one number a row returns."""

    @F.arrow_udf("double")
    def odds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, model = WordIds(), sent.value
        for text in texts:
            got = [log_odds(model, part.column(0).to_pylist(), cache) for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]))]
            yield pa.array(np.concatenate([np.empty(0), *got]), pa.float64())
        give_back()

    return odds


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED):
    """The document classifier, from at most `labelled` labelled rows outside fold 0, taken by a
    hash of id and text; None if there is but one class. Labels that contradict each other
    count as the lower quality; null ids are never learnt from."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = sample(known, labelled, known.count(), 5, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `labelled` ids; an id may have many rows
    rows = sample(rows, labelled, rows.count(), 6, "doc_id", "text").select("quality", "text").mapInArrow(_features, "quality int, x array<double>").collect()
    y = np.array([r[0] for r in rows], float)
    return fit_logistic(np.array([r[1] for r in rows]), y) if len(set(y.tolist())) == 2 else None


def _moments(sites: DataFrame, mean: float) -> float:
    """The weight of the level above: from the spread of the site means beyond chance."""
    m = F.col("good") / F.col("n")
    got = sites.where("n >= 2").agg(F.sum("n"), F.sum(F.col("n") * (m - mean) * (m - mean)), F.count("*")).first()
    if not got[0] or got[2] < 2:
        return WEIGHT[1]
    noise = mean * (1 - mean)
    between = (got[1] - noise * got[2]) / got[0]
    return float(np.clip(noise / between - 1, *WEIGHT)) if between > 0 else WEIGHT[1]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """From (host, path, odds): (host, path, prior) with the prior as log-odds, and the global log-odds."""
    p = 1 / (1 + F.exp(-F.col("odds")))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    mean = (good + 0.5) / (n + 1)
    top, low = _moments(hosts, mean), _moments(paths, mean)
    h = hosts.select(F.col("host").alias("h"), ((F.lit(top * mean) + F.col("good")) / (F.lit(top) + F.col("n"))).alias("of_host"))
    both = paths.join(h, paths.host.eqNullSafe(h.h))
    theta = (F.lit(low) * F.col("of_host") + F.col("good")) / (F.lit(low) + F.col("n"))
    return both.select("host", "path", F.log(theta / (1 - theta)).alias("prior")), float(np.log(mean / (1 - mean)))


def _sized(sites: DataFrame) -> DataFrame:
    """Broadcast where that is small; else the join shuffles and splits its hot hosts."""
    sites = cut(sites, "sites")
    return F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites


def _rows(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    return docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, evidence, prior, score, kept) for every row of `docs` (doc_id, text, site columns, any others).

    `evidence` is the text's own probability of good quality, `prior` that of its path,
    `score` both combined; `kept` is score >= KEEP. Null and empty texts are scored as texts
    without words. Null hosts and paths are sites of their own. `labels` has doc_id and
    quality (0, 1 or null); with fewer than two classes all evidence is 1/2. Repeated rows are
    judged alike, very long texts whole; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    of = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, path string, odds double"
    scored = cut(_rows(docs, F.col(host), F.col(path)).mapInArrow(partial(_evidence, sent=sent), of), "evidence")
    sites, shift = site_posteriors(scored)
    s = _sized(sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "prior"))
    total = F.col("odds") + F.col("prior") - F.lit(shift)
    full = scored.join(s, scored.host.eqNullSafe(F.col("h")) & scored.path.eqNullSafe(F.col("q")))

    def probability(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    return full.select("doc_id", probability(F.col("odds")).alias("evidence"), probability(F.col("prior")).alias("prior"), probability(total).alias("score"), (probability(total) >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of `docs` that `quality` keeps, all columns as they are.

    Texts are scored once, into a table of the rows with their evidence; the rest is a filter on
    it, which shuffles nothing unless there are more than BROADCAST_SITES sites. Null and empty
    texts are texts without words; null hosts and paths are sites of their own; repeated rows
    are judged alike, each; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = cut(docs.withColumn("_slotmill_odds", _odds(sent)(F.col("text"))), "scored")
    sites, shift = site_posteriors(scored.select(scored[host].cast("string").alias("host"), scored[path].cast("string").alias("path"), F.col("_slotmill_odds").alias("odds")))
    s = _sized(sites.select(F.col("host").alias("_slotmill_h"), F.col("path").alias("_slotmill_q"), F.col("prior").alias("_slotmill_prior")))
    full = scored.join(s, scored[host].cast("string").eqNullSafe(F.col("_slotmill_h")) & scored[path].cast("string").eqNullSafe(F.col("_slotmill_q")))
    return full.where(F.col("_slotmill_odds") + F.col("_slotmill_prior") - F.lit(shift) >= LEAST_ODDS).select(*(F.col(f"`{c}`") for c in docs.columns))
