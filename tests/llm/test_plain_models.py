"""Trained operators, and the pipeline, against plain Python: the same fitted model, each row by itself."""

from __future__ import annotations

import collections
import math
import re
import zlib

import model
import xxhash
from conftest import SMALL
from test_brute import bags_of, jaccard, model_spans
from test_shapes import check_packing

import corpus_pipeline
from slotmill.llm import language_id, near_dedup, packing, quality, secrets, toxicity
from slotmill.llm.common import WordIds


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_toxicity_scores_row_by_row(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    fitted = toxicity.train(docs, labels)
    weights, hashed = fitted.table(), lambda s: xxhash.xxh3_64_intdigest(s.encode()) % toxicity.SPACE
    assert len(weights) > 10
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        words = {w for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())}
        total = 0.0
        for w in words:
            names = [f"{len(w)}={w}", *(f"{k}<{w[:k]}" for k in (4, 5, 6, 7) if len(w) > k)]
            total += sum(weights.get(hashed(n), 0.0) for n in names)
        score = 1 / (1 + math.exp(-(fitted.bias + total * 2 / math.sqrt(1 + len(words)))))
        x = got[r.doc_id]
        assert math.isclose(x.score, score, rel_tol=1e-9) and x.predicted == (x.score >= 0.5) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_languages_row_by_row(spark):
    docs = table(spark, "documents")
    fitted = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        kept = "".join(chr(b) if chr(b).islower() and b < 128 or b >= 128 else " " for b in r.text.lower().encode())
        b = f" {' '.join(kept.split(' ')).strip()} ".encode("latin-1")
        b = re.sub(b" +", b" ", b)
        counts = collections.Counter()
        for i in range(len(b)):
            one = b[i]
            counts[one * 2654435761 % 2**32 >> 20] += 1
            if i + 1 < len(b):
                two = one * 257 + b[i + 1]
                counts[(two + 0x10000) * 2654435761 % 2**32 >> 20] += 1
                if i + 2 < len(b):
                    counts[(two * 263 + b[i + 2] + 0x4000000) * 2654435761 % 2**32 >> 20] += 1
        vector = {k: math.log1p(n) * float(fitted.idf[k]) for k, n in counts.items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        near = collections.defaultdict(lambda: -1.0)
        for c, owner in zip(fitted.centres, fitted.owner.tolist(), strict=True):
            near[fitted.langs[owner]] = max(near[fitted.langs[owner]], sum(v * float(c[k]) for k, v in vector.items()) / length)
        best = max(near.values())
        shares = {k: math.exp(25 * (v - best)) for k, v in near.items()}
        assert near[x.lang_pred] >= best - 1e-5 and math.isclose(x.score, max(shares.values()) / sum(shares.values()), rel_tol=1e-3)


def quality_of(rows, fitted):
    """doc_id -> probability of good quality, from a fitted document classifier and rows (doc_id, text, host, path)."""
    mean, scale, w = fitted
    odds = {}
    for i, text, *_ in rows:
        x = quality.statistics(text, WordIds())
        odds[i] = max(-12.0, min(12.0, sum((v - m) / s * k for v, m, s, k in zip(x, mean, scale, w, strict=False)) + w[-1]))
    p = {i: 1 / (1 + math.exp(-o)) for i, o in odds.items()}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, host, path in rows:
        paths[host, path].append(p[i])
        hosts[host].append(p[i])
    n, good = len(p), sum(p.values())
    mean_all = (good + 0.5) / (n + 1)

    def weight(groups):
        """How many documents the level above counts for: chance over the spread of the means beyond chance."""
        some = [g for g in groups.values() if len(g) >= 2]
        size = sum(map(len, some))
        if not size or len(some) < 2:
            return 1000.0
        noise = mean_all * (1 - mean_all)
        between = (sum(len(g) * (sum(g) / len(g) - mean_all) ** 2 for g in some) - noise * len(some)) / size
        return max(5.0, min(1000.0, noise / between - 1)) if between > 0 else 1000.0

    top, low = weight(hosts), weight(paths)
    out = {}
    for i, _, host, path in rows:
        of_host = (top * mean_all + sum(hosts[host])) / (top + len(hosts[host]))
        theta = (low * of_host + sum(paths[host, path])) / (low + len(paths[host, path]))
        out[i] = 1 / (1 + math.exp(-(odds[i] + math.log(theta / (1 - theta)) - math.log(mean_all / (1 - mean_all)))))
    return out


def test_quality_row_by_row(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    want = quality_of([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], quality.train(docs, labels))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(want) and all(math.isclose(got[i].score, p, rel_tol=1e-6) and got[i].kept == (got[i].score >= 0.5) for i, p in want.items())


def windows(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(10, len(words))
    return words, n


def redacted(text):
    """The text with each run of overlapping spans as one mark."""
    out, at = [], 0
    for start, _, end, _ in model_spans(text):
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, "documents")
    fitted = quality.train(docs, table(spark, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i, p in quality_of([(r.doc_id, r.text, r.source, r.lang) for r in rows.values()], fitted).items() if p >= 0.5]
    bags = dict(zip(good, bags_of([rows[i].text for i in good]), strict=True))
    holders = collections.defaultdict(list)
    for i in good:
        for h in set(bags[i].tolist()):
            holders[h].append(i)
    pairs = {(i, j) for s in holders.values() for i in s for j in s if i < j}
    label = model.components(good, [(i, j) for i, j in pairs if jaccard(bags[i], bags[j]) >= near_dedup.THRESHOLD])
    one = [i for i in good if label[i] == i]
    items = collections.defaultdict(set)
    for r in table(spark, "benchmark").collect():
        words, n = windows(r.text)
        items[n] |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    clean = []
    for i in one:
        words, _ = windows(rows[i].text)
        if not any(tuple(words[k : k + n]) in some for n, some in items.items() for k in range(len(words) - n + 1)):
            clean.append(i)
    assert len(rows) > len(good) > len(one) > len(clean) > 50
    texts = [(i, redacted(rows[i].text) if rows[i].text else rows[i].text) for i in clean]
    check_packing(texts, corpus_pipeline.run(spark, SMALL).collect(), packing.tokenizer_path())


def test_plain_redaction_is_that_of_the_operator(spark):
    texts = ["token=abcdefgh and password: token=abcdefgh", "https://a:b@c https://d:e@f", "x" * 30 + " 0123456789abcdef01234567"]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: redacted(t) for i, t in enumerate(texts)}
