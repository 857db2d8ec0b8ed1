"""Stored catalogs and indexes: what snapshots hold, which files they touch, which they read."""

from __future__ import annotations

import re
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotmill.operators import catalog, lsh, stored


def entries(spark, ids, tag="a"):
    rows = [(i, f"/bin/{i}\"\\\n é{tag}", 3, 24, -5 if tag == "a" else 7, [1, -1, 2**62], [] if i == "p3" else [4, -4]) for i in ids]
    return spark.createDataFrame(rows, catalog.SCHEMA)


def listed(df):
    return sorted(tuple(str(x) for x in r) for r in df.select("program_id", "source_path", "ngram_count", "normalized_len", "simhash", "minhash", "ngram_sample").collect())


def test_merges_rewrite_only_what_they_touch(spark, tmp_path):
    root = str(tmp_path / "db")
    first = stored.StoredCatalog.create(entries(spark, [f"p{i}" for i in range(300)]), root, version=7, buckets=16)
    new = entries(spark, ["p5", "p9", "new"], "b")
    second = first.merge(new)
    touched = second.entries.touched(new)
    assert {b for b, d in second.entries.parts.items() if first.entries.parts.get(b) != d} == {str(b) for b in touched} and len(touched) <= 3
    assert all((tmp_path / "db" / d / f"bucket={b}").is_dir() for b, d in second.entries.parts.items())
    want = catalog.merge(entries(spark, [f"p{i}" for i in range(300)]), new)
    back = stored.StoredCatalog.open(spark, root)
    assert listed(back.rows()) == listed(want) and back.version == 7 and back.size() == 301
    # Older snapshots stay; ids that go leave the rest of their bucket.
    assert listed(stored.StoredCatalog.open(spark, root, 1).rows()) == listed(entries(spark, [f"p{i}" for i in range(300)]))
    third = back.delete(spark.createDataFrame([("p5",), ("none",)], "program_id string"))
    assert third.size() == 300 and third.find("p5").isEmpty() and third.find("p9").first().source_path.endswith("b") and third.find("none").isEmpty()
    third.store.forget()
    assert third.size() == 300 and stored.StoredCatalog.open(spark, root).store.number == 3
    with pytest.raises(FileNotFoundError):
        stored.StoredCatalog.open(spark, root, 1)


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    made = stored.StoredCatalog.create(entries(spark, [f"p{i}" for i in range(200)]), str(tmp_path / "db"), buckets=8)
    files = made.find("p17").inputFiles()
    assert made.find("p17").first().program_id == "p17" and files and all(f"bucket={made.entries.touched(spark.createDataFrame([('p17',)], 'program_id string')).pop()}/" in f for f in files)


def test_repeated_ids_and_other_writers_fail(spark, tmp_path):
    root = str(tmp_path / "db")
    twice = entries(spark, ["x", "y"]).union(entries(spark, ["x"]))
    with pytest.raises(Exception, match="a catalog repeats x"):
        stored.StoredCatalog.create(twice, root)
    made = stored.StoredCatalog.create(entries(spark, []), root)
    assert made.size() == 0 and made.find("x").isEmpty()
    with pytest.raises(Exception, match="a catalog repeats x"):
        made.merge(twice)
    with pytest.raises(Exception, match="a catalog repeats x"):
        catalog.merge(entries(spark, ["a"]), twice).collect()
    later = made.merge(twice.withColumn("at", F.monotonically_increasing_id()), order="at")
    assert later.size() == 2
    with pytest.raises(stored.Conflict):
        made.merge(entries(spark, ["z"]))
    assert stored.StoredCatalog.open(spark, root).size() == 2


def test_an_index_after_inserts_and_deletes(spark, tmp_path):
    rng = np.random.default_rng(1)
    sig = rng.integers(-9, 9, (80, 16))
    frame = lambda ids, s: spark.createDataFrame([(f"p{i}", [int(v) for v in s[i]]) for i in ids], "program_id string, minhash array<long>")
    config = lsh.LshConfig.of(16, 8)
    index = stored.StoredIndex.create(spark, str(tmp_path / "ix"), config, buckets=4)
    plain = lsh.LshIndex(config, frame([], sig))
    moved = np.roll(sig, 1, axis=0)
    for ids, s in ((range(50), sig), (range(40, 80), sig), (range(0, 30), moved)):
        index, plain = index.insert(frame(ids, s)), plain.insert(frame(ids, s))
    gone = spark.createDataFrame([(f"p{i}",) for i in range(0, 80, 7)] + [("none",)], "program_id string")
    index = index.delete(gone)
    plain = lsh.LshIndex(config, plain.signatures.join(gone, "program_id", "left_anti"))
    again = frame([7, 14], sig)
    index, plain = stored.StoredIndex.open(spark, str(tmp_path / "ix")).insert(again), plain.insert(again)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for made in (index, index.compact()):
        assert rows(made.entries()) == rows(plain.buckets().select("program_id", "band", "bucket_key")) and made.size() == plain.size()
        asked = frame(range(3, 6), sig)
        assert rows(made.search(asked, 0.1)) == rows(lsh.search(plain.signatures, asked, config, 0.1))
    # An entry of an earlier snapshot is still found there.
    assert stored.StoredIndex.open(spark, str(tmp_path / "ix"), 2).size() == 50


def test_lookups_read_matching_parts_of_bands(spark, tmp_path):
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2**62, (400, 8))
    prints = spark.createDataFrame([(f"p{i}", [int(v) for v in s]) for i, s in enumerate(sig)], "program_id string, minhash array<long>")
    index = stored.StoredIndex.create(spark, str(tmp_path / "ix"), lsh.LshConfig.of(8, 2)).insert(prints)
    keys = lsh.buckets(prints.where("program_id = 'p1'"), index.config)
    parts = [tuple(r) for r in keys.select("band", stored._prefix(F.col("bucket_key"))).collect()]
    found = index.entries(parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*band#\d+ = \d[^\]]*prefix#", plan) and found.count() < index.entries().count() / 4
    assert {r.program_id for r in found.join(keys, ["band", "bucket_key"]).select(found.program_id).collect()} == {"p1"}


def test_json_in_splits_and_parts(spark, tmp_path):
    rows = entries(spark, [f"p{i}" for i in range(40)])
    one, parts = str(tmp_path / "db.json"), str(tmp_path / "parts")
    assert catalog.save_json(rows, one, 5) == 40
    catalog.save_parts(rows.repartition(5), parts, 5)
    joined = subprocess.run(f"cat {parts}/part-*", shell=True, capture_output=True, check=True).stdout
    assert joined == open(one, "rb").read()
    for path in (one, parts):
        back = catalog.Catalog.load(spark, path)
        assert back.version == 5 and listed(back.rows) == listed(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.minPartitionNum", 8)
    try:
        split = catalog.load_json(spark, one)
        assert split.rdd.getNumPartitions() > 4 and listed(split) == listed(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    none = str(tmp_path / "none.json")
    assert catalog.save_json(rows.where("false"), none) == 0 and catalog.Catalog.load(spark, none).is_empty()
    catalog.save_parts(rows.where("false"), str(tmp_path / "no"), 1)
    assert catalog.Catalog.load(spark, str(tmp_path / "no")).is_empty()
    # The same object in another layout.
    import json

    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps(json.loads(joined)))
    assert listed(catalog.Catalog.load(spark, str(flat)).rows) == listed(rows)


def test_equal_streams_are_hashed_once(spark, tmp_path, monkeypatch):
    from slotmill.operators.fingerprint import fingerprints

    texts = [bytes(range(i, i + 80)) for i in range(12)]
    rows = [(f"p{i}", texts[i % 12]) for i in range(30)] + [("tiny", b"x"), ("null", None)]
    programs = spark.createDataFrame(rows, "program_id string, text binary")
    hashed = []
    monkeypatch.setattr(stored, "fingerprints", lambda some, *rest: hashed.append(some.count()) or fingerprints(some, *rest))
    store = stored.StoredPrints.create(spark, str(tmp_path / "prints"), k=16, buckets=4)
    plain = lambda df: sorted((r.program_id, r.ngram_count, r.normalized_len, r.minhash, r.simhash, r.ngrams) for r in df.collect())
    first, store = store.of(programs)
    assert plain(first) == plain(fingerprints(programs, k=16)) and hashed[0] <= 13
    second, again = stored.StoredPrints.open(spark, str(tmp_path / "prints")).of(programs.where("program_id <> 'p3'"))
    assert len(hashed) == 1 and again.store.number == store.store.number and second.count() == 29
    more = programs.union(spark.createDataFrame([("other", bytes(range(100, 180)))], "program_id string, text binary"))
    third, _ = store.of(more)
    assert hashed[1:] == [1] and plain(third) == plain(fingerprints(more, k=16))


def test_catalog_texts_are_neither_sorted_nor_searched(spark, tmp_path, monkeypatch):
    """Entries are sorted before they are printed, and each text is looked at once, without a search through it."""
    rows = entries(spark, [f"p{i}" for i in range(40)])
    path, plans = str(tmp_path / "parts"), []
    write = type(rows).write
    monkeypatch.setattr(type(rows), "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write.fget(df)))
    catalog.save_parts(rows, path, 5)
    monkeypatch.undo()
    lines = plans[0].split("\n")
    assert [i for i, x in enumerate(lines) if "array_join" in x] < [i for i, x in enumerate(lines) if "Sort " in x]
    back = catalog.load_json(spark, path)
    assert back.where("ngram_count >= 0").count() == 40 and listed(back) == listed(rows)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and "Filter" not in plan
