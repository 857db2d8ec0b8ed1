"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns whose names clash with inner ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotmill.llm import decontaminate, language_id, licenses, near_dedup, packing, quality, quality_rules, secrets, toxicity, url_filter

CLASHES = ("digest", "n", "bands", "key", "spans", "row", "body", "host", "path", "grp", "label", "words", "size", "uid", "held_out", "score", "kept", "d2", "mask", "rank", "salt", "prior", "odds", "count", "at")
GOOD = "the rivers run down from the hills to the sea and the people walk along them in the evening light. " * 3


def rows():
    texts = [None, "", "   \n\t ", "...!?", "one", "two words", GOOD, GOOD, GOOD + "more", "é ñ ü ß " * 40, "word " * 60_000, "x" * 70_000, "a\nb\n\n" * 300, "Released under the MIT License.", "password = hunter2hunter2"]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s0", None)[i % 2], len(t) if t else None) for i, t in enumerate(texts)]
    return out + [out[6], out[0], (None, GOOD, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, (1, 0, None)[(i or 0) % 3], (0, 1, None)[(i or 0) % 3]) for i in (None, *range(15), 6, 6)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "the rivers run down from the hills to the sea and the people"), (1, None), (2, ""), (3, "two words"), (None, "one"), (3, "two words")], "item_id long, text string")


def applied(name, docs, labels, benchmark):
    return {
        "near": lambda: near_dedup.near_duplicates(docs),
        "toxic": lambda: toxicity.toxicity(docs, labels),
        "language": lambda: language_id.identify(docs),
        "license": lambda: licenses.license_scan(docs),
        "quality": lambda: quality.quality(docs, labels),
        "secrets": lambda: secrets.digest(secrets.find_secrets(docs)),
        "redact": lambda: secrets.redact(docs),
        "rules": lambda: quality_rules.quality_rules(docs),
        "contamination": lambda: decontaminate.digest(decontaminate.contamination(docs, benchmark)),
        "blocks": lambda: decontaminate.digest(decontaminate.contamination(docs, benchmark, block=1)),
    }[name]()


ROW_WISE = ("near", "toxic", "language", "license", "quality", "secrets", "redact", "rules", "contamination", "blocks")


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_a_row(docs, labels, benchmark, name):
    got = applied(name, docs, labels, benchmark).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows())
    # Repeated rows get one answer.
    for i in (0, 6):
        answers = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got if r.doc_id == i]
        assert len(answers) == 2 and answers[0] == answers[1]


@pytest.mark.parametrize("name", ROW_WISE)
def test_empty_tables(docs, labels, benchmark, name):
    none = docs.where("false")
    assert applied(name, none, labels, benchmark).count() == 0
    assert applied(name, none, labels.where("false"), benchmark.where("false")).count() == 0
    assert applied(name, docs, labels.where("false"), benchmark.where("false")).count() == len(rows())


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, labels, benchmark, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, docs, str(tmp_path))
    if name != "packing":
        assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
        assert 0 < got.count() <= len(rows())
    assert f(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_defined_results(docs, labels, benchmark):
    near = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).where("doc_id is not null").collect()}
    assert near[7] == near[6] == near[8] == 6 and all(near[i] == i for i in (0, 1, 2, 3, 4, 5, 9, 10))
    kept = near_dedup.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [i for i in range(15) if i not in (7, 8)]
    assert sum(r.doc_id is None for r in kept) == 2
    lang = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (0, 1, 2, 3))
    lic = {r.doc_id: r.families for r in licenses.license_scan(docs).collect()}
    assert lic[13] == "mit" and lic[0] == lic[6] == ""
    hit = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(docs, benchmark)).collect()}
    assert (hit[5].n_hit, hit[5].n_items, hit[4].n_hit, hit[4].n_items) == (2, 1, 1, 0) and hit[6].contaminated and not hit[0].contaminated
    redacted = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert redacted[14].text == "[SECRET]" and redacted[14].n_chars == 8 and redacted[0].text is None and redacted[6].text == GOOD


def test_packing_covers_every_id_once(docs):
    path = packing.tokenizer_path()
    got = packing.pack(docs, path).collect()
    check_packing([(r[0], r[1]) for r in rows()], got, path)
    assert packing.pack(docs.where("false"), path).count() == 0


def check_packing(texts, pieces, path):
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids)] += 1
        cuts = packing.piece_starts(len(ids))
        for a, b in zip(cuts, cuts[1:], strict=False):
            want[i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.start, p.length, p.ids_crc32] += 1
        if p.start == 0:
            got[p.doc_id, p.doc_tokens] += 1
    assert got == want
    lanes = defaultdict(list)
    for p in pieces:
        lanes[p.sequence_id].append((p.offset, p.length))
    for lane in lanes.values():
        end = 0
        for offset, length in sorted(lane):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    return sum(packing.CAPACITY - sum(n for _, n in lane) for lane in lanes.values()) / (packing.CAPACITY * len(lanes))


def test_urls(spark):
    urls = [None, "", "no mark", "HTTP://A.Example.NET/en/x?y#z", "http://net/", "http://example.com/de/1", "http://x.org/fr/", "http://evil-casino-x.com", "http://ok.com/casino-x", "http://ok.com/a/ads/b", "http://" + "a" * 50_000 + ".net/x", "http://ü.net/é"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "/", "net/", "block") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert [got[i][3] for i in (7, 8, 9)] == ["block", "allow", "block"] and got[10][2:] == got[11][2:] == ("net/", "block")
    assert url_filter.judge_urls(pages.where("false")).count() == 0
