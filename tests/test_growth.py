"""What keeps the work of queries in proportion to their tables."""

from __future__ import annotations

import os

import model
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotmill.operators import fingerprint as fp
from slotmill.operators import kernels as k
from slotmill.plans import durable


def test_shared_features_are_hashed_once(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 900, n, dtype=np.uint64)) for n in (0, 700, 1, 500, 0, 800)]
    expected = [model.minhash(s.tolist(), 7) for s in sets]
    hashed = []
    real = k._sha256
    monkeypatch.setattr(k, "_sha256", lambda m: hashed.append(m) or real(m))
    assert k.minhashes(sets, 7).tolist() == expected
    assert len(hashed) == len(set(hashed)) == 7 * len(set().union(*(s.tolist() for s in sets)))


@pytest.mark.skipif(not k._compress, reason="hashlib isn't linked to a library that gives its compression")
def test_many_hashes_make_no_hash_object(monkeypatch):
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 300, 1, 170)]
    sets += [np.concatenate([sets[1][:200], sets[2]])]
    expected = [model.minhash(s.tolist(), 300) for s in sets]  # seeds of more than a byte
    assert k._hashes(sets[1].tobytes(), 300).shape == (300, 300)
    real, blocks = k._compress, []

    def no(_):
        raise AssertionError("a hash object a hash")

    with monkeypatch.context() as m:
        m.setattr(k, "_sha256", no)
        m.setattr(k, "_compress", lambda *a: blocks.append(1) or real(*a))
        assert k.minhashes(sets, 300).tolist() == expected
        assert len(blocks) == 300 * 471
        led = k.leaders(sets[1], 300)
    assert [model.minhash([f], 300)[i] for i, f in enumerate(led.tolist())] == expected[1]
    monkeypatch.setattr(k, "_compress", None)
    assert k.minhashes(sets, 300).tolist() == expected


def test_streams_that_begin_alike_meet_and_tasks_follow_the_bytes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    made = [(f"{i}-{j}", bytearray(base + bytes([j]) * 24)) for i, base in enumerate(rng.bytes(400) for _ in range(40)) for j in (1, 2, 3)]
    programs = spark.createDataFrame([(p, t) for p, t in made] + [("none", None)], "program_id string, text binary")
    seen = []
    monkeypatch.setattr(fp, "TASK_BYTES", 4_000)
    monkeypatch.setattr(fp, "tasks_for", lambda df, size: seen.append((durable._size(df), durable.tasks_for(df, size))) or seen[-1][1])
    got = {r.program_id: r for r in fp.fingerprints_once(programs, config=None, empty="keep").collect()}
    assert seen[0][1] >= seen[0][0] / 4_000 > 4
    plain = {r.program_id: r for r in fp.fingerprints(programs, config=None, empty="keep").collect()}
    assert got == plain and len(got) == 121


def test_votes_hash_shared_features_once(monkeypatch):
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 90, n, dtype=np.uint64)) for n in (0, 70, 1, 2, 50, 0)]
    hashed = []
    real = k._sha256
    monkeypatch.setattr(k, "_sha256", lambda m: hashed.append(bytes(m)) or real(m))
    programs = pa.RecordBatch.from_pydict({"program_id": [str(i) for i in range(6)], "text": [b""] * 6})
    monkeypatch.setattr(fp, "_features", lambda *_, rest=iter(sets): (next(rest), 0))
    got = list(fp._sketched(iter([programs]), 3, 0, None))[0].column("simhash").to_pylist()
    assert [x % 2**64 for x in got] == [model.simhash(s.tolist()) for s in sets] == [k.simhash(s) for s in sets]
    assert sorted(hashed[: len(set(hashed))]) == sorted(set(hashed))


def _driver_bound(monkeypatch):
    """Makes whatever passes rows through the driver one by one, or gathers more than a few, fail."""
    from pyspark.sql.classic.dataframe import DataFrame

    def no(*_):
        raise AssertionError("rows pass the driver")

    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "toLocalIterator", no)
    monkeypatch.setattr(DataFrame, "collect", lambda df: r if len(r := real(df)) <= 3 else no())


def test_catalogs_as_json_and_their_summaries_pass_no_driver(spark, tmp_path, monkeypatch):
    from slotmill import cli
    from slotmill.operators import catalog
    from slotmill.plans.durable import numbered

    rows = [(f"p{i:03}", f"/x/{(i * 37) % 100:03}", i, 8 * i, i - 50, [i, -1], [i]) for i in range(100)]
    entries = spark.createDataFrame(rows, catalog.SCHEMA)
    said = cli.format_catalog(entries, 3).split("\n")
    monkeypatch.setattr(catalog, "scan", lambda *a, **k: entries)
    from slotmill.plans import files

    with monkeypatch.context() as m:
        _driver_bound(m)
        path = files._saved_catalog(spark, str(tmp_path / "files"), 3)
        back = catalog.Catalog.load(spark, path)
        head, lines = cli.catalog_lines(back.rows, back.version)
        placed = numbered(lines, "source_path")
    got = {r.place: r.line for r in placed.collect()}
    assert [head, *(got[i] for i in range(100))] == said
    assert sorted(back.rows.collect()) == sorted(entries.collect())


def test_entries_of_files_broadcast_no_signature(spark):
    from slotmill.operators import catalog

    programs = spark.createDataFrame([("a", "/a", bytearray(range(80)), None), ("b", "/b", None, "no")], "program_id string, path string, text binary, load_error string")
    plan = catalog.file_entries(programs)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_signatures_alike_by_chance_are_no_candidates(spark, monkeypatch):
    """Signatures that share a position here and there, as unrelated streams of a large table do."""
    from slotmill.operators import similarity

    rng = np.random.default_rng(7)
    rows = rng.integers(-(2**63), 2**63 - 1, (60, 128))
    common = rng.integers(-(2**63), 2**63 - 1, 128)
    for r in rows:
        some = rng.permutation(128)[:40]
        r[some] = common[some]
    rows[1, :70] = rows[0, :70]
    rows[3, :64] = rows[2, :64]
    rows[3, 64:] = rng.integers(-(2**63), 2**63 - 1, 64)
    equal = {(f"p{i:02}", f"p{j:02}"): int((rows[i] == rows[j]).sum()) for i in range(60) for j in range(i + 1, 60)}
    expected = {p: n / 128 for p, n in equal.items() if n >= 64}
    assert ("p02", "p03") in expected and len(expected) < 4
    listed = []
    real = similarity.near_in
    monkeypatch.setattr(similarity, "near_in", lambda *a: listed.append(real(*a)) or listed[0])
    classes = spark.createDataFrame([(f"p{i:02}", r.tolist(), 1) for i, r in enumerate(rows)], "class_id string, minhash array<long>, size long")
    got = {(r.a, r.b): r.jaccard_estimate for r in similarity.estimate_pairs(classes, 0.5, 128).collect()}
    assert got == expected
    assert listed[0].count() <= len(expected) + 5


def test_bits_of_a_set_are_made_once_not_for_each_item(spark):
    from slotmill.operators.similarity import exact_index

    classes = spark.createDataFrame([("a", [1, 2, 3], 1), ("b", [2, 3], 1)], "class_id string, items array<long>, size long")
    index = exact_index(classes, 0.5)
    lines = index._jdf.queryExecution().optimizedPlan().toString().split("\n")
    listed = [i for i, x in enumerate(lines) if "Generate explode" in x]
    made = [i for i, x in enumerate(lines) if " aggregate(" in x]
    assert listed and made and all(any(i < m for i in listed) for m in made)
    assert {(r.id, r.key, r.n) for r in index.collect()} == {("a", 2, 3), ("b", 2, 2), ("b", 3, 2)}


def test_native_signatures_are_made_in_their_rows(spark):
    from slotmill.operators import hashing, native

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 40, 600)]
    rows = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)] + [(4, [])], "i int, f array<long>")
    got = {r.i: r.m for r in rows.select("i", hashing.minhash_array(F.col("f"), 6).alias("m")).collect()}
    assert [[x % 2**64 for x in got[i]] for i in range(4)] == [k.minhash(s, 6).tolist() for s in sets] and got[4] is None
    programs = spark.createDataFrame([("a", bytearray(range(80)))], "program_id string, text binary")
    plan = native.fingerprints(programs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the votes


@pytest.mark.parametrize("name", ["tier_counts", "stored_index", "stored_search"])
def test_where_signatures_count_nothing_else_is_written(spark, monkeypatch, name):
    from slotmill.plans import queries, registry

    seen, real = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df, *a, **o: seen.append(df.columns) or real(df, *a, **o))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [["program_id", "minhash"]]


def test_tiers_from_signatures_are_those_of_reports(spark):
    from slotmill.operators.similarity import compared, tiers

    rng = np.random.default_rng(13)
    base = rng.bytes(800)
    programs = spark.createDataFrame([(str(n), bytearray(base[:n] + rng.bytes(800 - n))) for n in (0, 400, 600, 780, 792, 800)] + [("short", bytearray(b"abc"))], "program_id string, text binary")
    prints = fp.fingerprints(programs, empty="keep").cache()
    pairs = prints.select(F.col("program_id").alias("a")).crossJoin(prints.select(F.col("program_id").alias("b"))).union(spark.createDataFrame([("0", "none")], "a string, b string"))
    got = sorted(tuple(r) for r in tiers(pairs, prints.select("program_id", "minhash")).collect())
    assert got == sorted(tuple(r) for r in compared(pairs, prints).select("a", "b", "tier").collect()) and len({t for *_, t in got}) > 2


def test_saved_files_are_removed_by_tasks_not_by_the_driver(spark, monkeypatch):
    from slotmill.plans import durable, files

    left, drop = [], durable.Scratch.drop

    def seen(self):
        for _, path in self.paths:
            for _, _, names in os.walk(path.removeprefix("file:")):
                left.extend(n for n in names if n.endswith(".so"))
        drop(self)

    made = []
    monkeypatch.setattr(durable.Scratch, "drop", seen)
    monkeypatch.setattr(files, "save_images", lambda images, folder, real=files.save_images: made.append(real(images, folder)))
    assert files.QUERIES["scan_programs"](spark, "/root/testdata/sf0.001").count() > 0
    assert made[0] > 0 and not left


@pytest.mark.parametrize("name", ["cluster_summary", "cluster_documents", "cluster_document_summary"])
def test_clusters_are_made_of_signatures_alone(spark, monkeypatch, name):
    from slotmill.plans import queries, registry

    seen, real = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df, *a, **o: seen.append(df.columns) or real(df, *a, **o))
    monkeypatch.setattr(queries, "cluster_table", lambda prints, *a: prints)
    monkeypatch.setattr(queries, "cluster_members", lambda prints, *a: prints)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [["program_id", "minhash"]]


@pytest.mark.parametrize("threshold", [0.5, 0.0])
def test_equal_signatures_count_by_their_number(spark, threshold):
    from slotmill.operators.cluster import cluster_table

    signatures = [[1, 2, 3, 4]] * 3 + [[1, 2, 3, 9]] * 2 + [[7, 8, 5, 6], [0, 0, 0, 0], [0, 0, 0, 0]]
    rows = [(f"p{i}", s) for i, s in enumerate(signatures)]
    prints = spark.createDataFrame(rows, "program_id string, minhash array<long>")
    got = {r.program_id: r for r in cluster_table(prints, threshold, 4).collect()}
    groups = [range(5), [5], [6, 7]] if threshold else [range(8)]
    for g in groups:
        equal = [sum(x == y for x, y in zip(signatures[i], signatures[j], strict=True)) / 4 for i in g for j in g if i < j]
        for i in g:
            assert got[f"p{i}"].size == len(g) and abs(got[f"p{i}"].avg_similarity - (sum(equal) / len(equal) if equal else 1.0)) < 1e-12
