from __future__ import annotations

import json
import os
import random
import shutil
import struct
import subprocess
import sys

import model
import pyarrow as pa
import pytest
from conftest import ROOT, SMALL, duck, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slotmill import cli
from slotmill.functions.u64 import fnv_words, from_decimal, from_hex16, hex16, ordered, signed, to_decimal
from slotmill.operators import catalog, lsh
from slotmill.operators.cluster import cluster_members, clusters
from slotmill.operators.components import components, extended
from slotmill.operators.fingerprint import features, fingerprints, ngram_total
from slotmill.operators.hashing import feature_hash, minhash_long, permuted_hash, simhash_long
from slotmill.operators.similarity import compared, estimate_pairs, exact_pairs, search, set_classes, signature_classes
from slotmill.plans import durable, registry
from slotmill.plans.durable import Scratch, cut
from slotmill.sources.elf import FileBytes, LoadError, text_section
from slotmill.sources.files import load_paths, read_store, scan_directory, with_ids


def test_unsigned_columns(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 0xDEADBEEFCAFEBABE]
    df = spark.createDataFrame([(signed(v), f"{v:016x}") for v in values], "v long, h string")
    out = df.select("v", "h", hex16(F.col("v")).alias("x"), from_hex16(F.col("h")).alias("back"), from_decimal(to_decimal(F.col("v"))).alias("d")).collect()
    assert all(r.h == r.x and r.v == r.back == r.d for r in out)
    assert [r.v % 2**64 for r in df.orderBy(ordered(F.col("v"))).collect()] == sorted(values)


def test_band_hash(spark):
    words = [[], [0], [2**64 - 1], [0, 2**64 - 1], [0x125BA56A463BCC37, 3, 2**63]]
    df = spark.createDataFrame([([signed(x) for x in w],) for w in words], "w array<long>")
    assert [r[0] % 2**64 for r in df.select(fnv_words("w")).collect()] == [model.fnv(w) for w in words]
    assert model.fnv([2**64 - 1]) == 0x509C41B379FE466E


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck(SMALL).execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.fixture(scope="module")
def turns(spark):
    """Model n-grams of the turns that have any, by conversation and turn."""
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "text").collect()
    sets = {(r.conv_id, r.turn): model.ngrams(model.normalize((r.text or "").encode())[0]) for r in rows}
    assert max(t for _, t in sets) > 1
    return {k: s for k, s in sets.items() if s}


def test_stored_turns_are_compared(spark, turns):
    got = {r.a: r for r in entry.queries()["compare_stored"](spark, SMALL).collect()}
    nexts = {f"{c}-{t}": (turns[c, t], turns[c, t + 1]) for c, t in turns if t % 4 == 3 and (c, t + 1) in turns}
    copies = {f"{c}-{t}": (turns[c, t], turns[c, t]) for c, t in turns if t % 4 == 0}
    assert copies and {a for a in got if int(a.split("-")[1]) % 4 in (0, 3)} == set(nexts) | set(copies) and all(r.b == f"db/{a}" and r.notes == "" for a, r in got.items())
    for a, (x, y) in (nexts | copies).items():
        r = got[a]
        assert r.jaccard_estimate == model.estimate(model.minhash(x, 128), model.minhash(y, 128))
        assert r.jaccard_exact == pytest.approx(len(x & y) / len(x | y)) and (r.ngram_count_a, r.ngram_count_b) == (len(x), len(y))
        assert r.hamming_distance == (model.simhash(x) ^ model.simhash(y)).bit_count()


def test_merge_takes_the_last_of_repeated_ids(spark):
    of = catalog.SCHEMA + ", place long"
    row = lambda i, path, place: (i, path, 1, 8, 0, [0], [0], place)
    one = spark.createDataFrame([row("a", "1", 0), row("b", "2", 1), row("c", "3", 2)], of)
    two = spark.createDataFrame([row("q", "4", 0), row("b", "5", 1), row("q", "6", 2), row("b", "7", 3), row("d", "8", 4)], of)
    got = [(r.program_id, r.source_path) for r in catalog.merge(one, two, "place").orderBy("place").collect()]
    assert got == [("a", "1"), ("b", "7"), ("c", "3"), ("q", "6"), ("d", "8")]
    assert catalog.merge(one.where("false"), two, "place").count() == 3 and catalog.merge(one, two.where("false"), "place").count() == 3
    with pytest.raises(Exception, match="repeats q"):
        catalog.merge(two, one, "place").collect()


def test_stores_know_their_size_and_version(spark, tmp_path):
    new = catalog.Catalog.new(spark)
    assert (new.size(), new.is_empty(), new.version) == (0, True, 1)
    rows = spark.createDataFrame([("a", "p", 1, 8, -1, [1, -1], [5])], catalog.SCHEMA)
    path = str(tmp_path / "db.json")
    catalog.Catalog(rows, 4).save(path)
    back = catalog.Catalog.load(spark, path)
    assert (back.size(), back.version, back.merged(new).version, new.merged(back).size()) == (1, 4, 4, 1)
    (tmp_path / "none.json").write_text('{"entries": []}')
    with pytest.raises(ValueError, match="version"):
        catalog.Catalog.load(spark, str(tmp_path / "none.json"))
    index = lsh.LshIndex.new(spark, 8)
    assert index.is_empty() and index.config.rows_per_band == 16 and lsh.LshIndex.of(new.rows).config.bands == lsh.DEFAULT_BANDS
    some = spark.createDataFrame([("a", [1, 2]), ("b", [3, 4])], "program_id string, minhash array<long>")
    index = lsh.LshIndex.of(some, 2).insert(spark.createDataFrame([("a", [9, 2])], some.schema))
    assert index.size() == 2 and index.buckets().count() == 4


def test_names_that_are_not_utf8(spark, tmp_path):
    for name in (b"caf\xe9.so", "caf\u00e9.so".encode()):
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as f:
            f.write(model.elf(model.sample(3)))
    rows = with_ids(scan_directory(spark, str(tmp_path))).collect()
    assert sorted(r.program_id for r in rows) == ["caf\u00e9", "unknown"] and all(bytes(r.text) == model.sample(3) for r in rows)


def test_works_without_the_corpus_operators(tmp_path):
    """The rest of the tree imports and lists its queries where the corpus operators are deleted."""
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; from slotmill.plans import registry; assert set(e.queries()) == set(registry.QUERIES); assert set(e.oracle_sql()) == set(registry.ORACLE_SQL); print(len(e.queries()))"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tree / name).unlink()
        said = subprocess.run([sys.executable, "-c", code], cwd=tree, env=os.environ | {"PYTHONPATH": str(tree)}, capture_output=True, text=True)
        assert said.returncode == 0 and int(said.stdout) == len(registry.QUERIES), said.stderr


def test_an_import_that_fails_leaves_the_rest(tmp_path):
    """A corpus module that is there but can't be imported takes no other query with it."""
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    (tree / "slotmill/llm").mkdir()
    (tree / "slotmill/llm/__init__.py").write_text("")
    (tree / "slotmill/llm/queries.py").write_text("import no_such_library\n")
    code = "import __spark_entry__ as e; from slotmill.plans import registry; assert set(e.queries()) == set(registry.QUERIES); print(len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tree, env=os.environ | {"PYTHONPATH": str(tree)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) == len(registry.ORACLE_SQL), said.stderr


def test_files_need_a_mounted_folder(spark, monkeypatch):
    """A shared folder that only Spark reaches isn't taken for a local one."""
    monkeypatch.setattr(durable, "checkpoint_dir", lambda _: "hdfs://host/shared")
    with pytest.raises(ValueError, match="hdfs:"):
        durable.scratch_folder(spark, "files")
    monkeypatch.setattr(durable, "checkpoint_dir", lambda _: "file:///mnt/shared")
    assert durable.scratch_folder(spark, "files").startswith("/mnt/shared/slotmill-files-")


def test_streams_are_unpacked_by_bytes():
    from slotmill.operators import fingerprint

    texts = [b"x" * 3_000_000, b"y" * 3_000_000, None, *[b"z"] * 200, b"w" * 9_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts, pa.binary())], ["program_id", "text"])
    got = [(part.column("program_id").to_pylist(), some) for part, some in fingerprint._texts(iter([batch]))]
    assert [i for ids, _ in got for i in ids] == [str(i) for i in range(len(texts))] and [t for _, some in got for t in some] == [t or b"" for t in texts]
    assert all(len(some) <= fingerprint.ROWS and (len(some) == 1 or sum(map(len, some)) <= fingerprint.BYTES) for _, some in got)


def test_tables_of_a_scope_go_with_it(spark):
    made = []
    with pytest.raises(RuntimeError), Scratch():
        with Scratch():
            made.append(cut(spark.range(3), "t", result=True))
            made.append(cut(spark.range(3), "t"))
        assert made[0].count() == 3
        paths = [f.removeprefix("file:").removeprefix("//") for df in made for f in df.inputFiles()]
        raise RuntimeError
    assert paths and not any(os.path.exists(p) for p in paths)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.fixture(scope="module")
def documents(spark):
    """Prints and model features of the smallest documents, with near copies that differ in a slot."""
    texts = [(str(r.doc_id), (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()][:60]
    texts += [(f"{i}x", t[:80] + b"!" * 8 + t[88:]) for i, t in texts[:20]] + [("tiny", b"abc"), ("none", b"")]
    programs = spark.createDataFrame(texts, "program_id string, text binary")
    return programs, {i: model.ngrams(model.normalize(t)[0]) for i, t in texts}


def test_fingerprints_of_documents(spark, documents):
    programs, sets = documents
    kept = {r.program_id: r for r in fingerprints(programs, k=4, empty="keep").collect()}
    assert {i: r.ngram_count for i, r in kept.items()} == {i: len(s) for i, s in sets.items()}
    for i in ("0", "3", "5x"):
        assert [x % 2**64 for x in kept[i].minhash] == model.minhash(sets[i], 4)
        assert kept[i].simhash % 2**64 == model.simhash(sets[i])
    assert kept["none"].minhash == [-1] * 4
    assert fingerprints(programs, k=1).count() == sum(map(bool, sets.values()))
    with pytest.raises(Exception, match="no opcode n-grams"):
        fingerprints(programs, k=1, empty="error").collect()
    assert features(programs).count() == sum(map(len, sets.values()))
    assert {r.program_id: r.n_grams for r in ngram_total(programs).collect()}["tiny"] == 0


def test_column_sketches_equal_the_kernels(spark, documents):
    programs, sets = documents
    some = features(programs.where("program_id in ('0', '3x', '7')"))
    got: dict = {}
    for r in minhash_long(some, 6).collect():
        got.setdefault(r.program_id, {})[r.i] = r.v % 2**64
    assert {i: [v[j] for j in range(6)] for i, v in got.items()} == {i: model.minhash(sets[i], 6) for i in ("0", "3x", "7")}
    assert {r.program_id: r.simhash % 2**64 for r in simhash_long(some).collect()} == {i: model.simhash(sets[i]) for i in ("0", "3x", "7")}
    edge = spark.createDataFrame([(0, 0), (0, 1), (-1, 127)], "f long, i int")
    assert [hex(r[0] % 2**64) for r in edge.select(permuted_hash(F.col("f"), F.col("i"))).collect()] == ["0xb43207b5f07bec15", "0x1cf3dfff4522e4c3", "0xa977f34c5b02895"]
    assert [hex(r[0] % 2**64) for r in spark.createDataFrame([(0,), (1,)], "f long").select(feature_hash(F.col("f"))).collect()] == ["0x7a0b81a1f57055af", "0xa63f41d436a19f7c"]


def test_pairs_and_clusters_equal_brute_force(spark, documents):
    programs, _ = documents
    k = 32
    prints = fingerprints(programs, k=k)
    sig = {r.program_id: tuple(r.minhash) for r in prints.select("program_id", "minhash").collect()}
    least = {s: min(i for i in sig if sig[i] == s) for s in sig.values()}
    for t in (0.25, 0.5, 0.9, 1.0):
        want = {(a, b): model.estimate(sa, sb) for sa, a in least.items() for sb, b in least.items() if a < b and model.estimate(sa, sb) >= t}
        assert {(r.a, r.b): r.jaccard_estimate for r in estimate_pairs(signature_classes(prints), t, k).collect()} == want
    links = [(a, b) for a in sig for b in sig if a < b and model.estimate(sig[a], sig[b]) >= 0.5]
    label = model.components(sig, links)
    assert {r.program_id: r.label for r in cluster_members(prints, 0.5, k).collect()} == label
    for r in clusters(prints, 0.5, k).collect():
        pairs = [(a, b) for a in r.members for b in r.members if a < b]
        assert {label[m] for m in r.members} == {r.members[0]} and r.size == len(r.members)
        want = sum(model.estimate(sig[a], sig[b]) for a, b in pairs) / len(pairs) if pairs else 1.0
        assert r.avg_similarity == pytest.approx(want)
    assert clusters(prints, 0.0, k).count() == 1
    with pytest.raises(ValueError):
        estimate_pairs(signature_classes(prints), 0.0, k)


def test_exact_pairs_equal_brute_force(spark, documents):
    programs, sets = documents
    classes = set_classes(fingerprints(programs, k=0, empty="keep"), "program_id", "ngrams")
    least = {frozenset(s): min(i for i in sets if sets[i] == s) for s in map(frozenset, sets.values()) if s}
    for t in (0.1, 0.6, 0.95):
        want = {(a, b): len(x & y) / len(x | y) for x, a in least.items() for y, b in least.items() if a < b and len(x & y) / len(x | y) >= t}
        assert {(r.a, r.b): r.jaccard_exact for r in exact_pairs(classes, t).collect()} == pytest.approx(want)


def test_lsh_equals_brute_force(spark, documents):
    programs, _ = documents
    prints = fingerprints(programs, k=32)
    sig = {r.program_id: r.minhash for r in prints.collect()}
    config = lsh.LshConfig.of(32, 8)
    keys = {i: [model.fnv([x % 2**64 for x in s[4 * b : 4 * b + 4]]) for b in range(8)] for i, s in sig.items()}
    want = {}
    for q in ("1", "3x"):
        for i in sig:
            bands = [b for b in range(8) if keys[q][b] == keys[i][b]]
            if bands and model.estimate(sig[q], sig[i]) >= 0.3:
                want[q, i] = (model.estimate(sig[q], sig[i]), bands[0])
    got = lsh.search(prints, prints.where(F.col("program_id").isin("1", "3x")), config, 0.3).collect()
    assert {(r.query_id, r.program_id): (r.score, r.band) for r in got} == want
    for bad in (0, 5):
        with pytest.raises(ValueError, match="divisible"):
            lsh.LshConfig.of(32, bad)
    with pytest.raises(Exception, match="length"):
        lsh.buckets(prints, lsh.LshConfig.of(64, 8)).collect()


def test_exact_search_finds_what_bands_miss(spark):
    rng = random.Random(11)
    rows = [("0", [rng.randrange(2**40) for _ in range(128)])]
    for i in range(1, 200):  # at similarities from 0.5 to 1
        same = rng.randrange(64, 129)
        at = set(rng.sample(range(128), same))
        rows.append((str(i), [x if j in at else rng.randrange(2**40) for j, x in enumerate(rows[0][1])]))
    prints = spark.createDataFrame([*rows, ("twin", rows[0][1])], "program_id string, minhash array<long>")
    query = prints.where("program_id = '0'")
    want = {r.program_id: model.estimate(rows[0][1], r.minhash) for r in prints.collect() if model.estimate(rows[0][1], r.minhash) >= 0.6}
    got = search(prints, query, 0.6, 128).collect()
    assert {r.program_id: r.score for r in got} == want and len(got) == len(want)  # recall 1
    banded = lsh.search(prints, query, lsh.LshConfig.of(128, lsh.CLI_BANDS), 0.6).count()
    print("recall of 8 bands:", banded, "of", len(want))
    assert banded < 0.9 * len(want)
    with pytest.raises(ValueError):
        search(prints, query, 0.0, 128)


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    nodes = {n for a, b in links for n in (a, b)} - {5}
    assert got == {n: model.components(nodes, [p for p in links if 5 not in p])[n] for n in nodes}


def test_components_grow_by_new_edges(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    rng.shuffle(edges)
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    labels, upto = components(frame(edges[:100]), "grow"), 100
    for more in (60, 1, 159):
        labels, upto = extended(labels, frame(edges[upto : upto + more]), "grow"), upto + more
        some = [p for p in edges[:upto] if p[0] != p[1]]
        want = model.components({n for p in some for n in p}, some)
        assert {r.node: r.label for r in labels.collect()} == want
    assert {r.node: r.label for r in extended(labels, frame(edges).where("false"), "grow").collect()} == want


def test_only_headers_and_code_of_a_file_are_read(spark, tmp_path):
    """A file whose code lies behind 6 GB of other data, most of which is a hole."""
    code = model.sample(5)
    far = 6_000_000_000
    header = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 247, 1, 0, 0, 64, 0, 64, 0, 0, 64, 2, 0)
    sections = bytes(64) + struct.pack("<IIQQQQIIQQ", 0, 1, 6, 0, far, len(code), 0, 0, 0, 0)
    path = tmp_path / "tree/deep/er/large.so"
    path.parent.mkdir(parents=True)
    with open(path, "wb") as f:
        f.write(header + sections)
        f.seek(far)
        f.write(code)
    with open(path, "rb") as f:
        data = FileBytes(f.fileno())
        assert text_section(data) == code and data.read < 300_000
    (tmp_path / "tree/none").mkdir()
    (tmp_path / "tree/to").symlink_to(tmp_path / "tree/deep", target_is_directory=True)
    rows = scan_directory(spark, str(tmp_path / "tree")).collect()
    assert [(r.path, bytes(r.text), r.load_error) for r in rows] == [(str(path), code, None)]
    assert scan_directory(spark, str(tmp_path / "tree/none")).isEmpty() and scan_directory(spark, "/no/such/folder").isEmpty()


def test_elf_sections():
    text = model.sample(1)
    for wide in (True, False):
        for order in "<>":
            assert text_section(model.elf(text, wide=wide, order=order)) == text
    assert text_section(model.elf(b"", second=text)) == b""
    assert text_section(model.elf(text, flags=2, second=b"12345678")) == b"12345678"
    for data, said in ((b"", "not a valid elf"), (b"hello world, not elf", "not a valid elf"), (model.elf(text)[:-1], "exceeds file bounds"), (model.elf(text, flags=2), "no executable"), (model.elf(text, kind=3), "no executable"), (model.elf(text)[:70], "not a valid elf")):
        with pytest.raises(LoadError, match=said):
            text_section(data)


@pytest.fixture
def tree(tmp_path):
    """Programs in nested folders, some hidden, some that don't load."""
    for name, seed in (("prog_a.so", 20), ("prog_b.so", 20), ("sub/prog_c.so", 200), ("_x.so", 1), (".y.so", 7)):
        p = tmp_path / "bin" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(model.elf(model.sample(seed)))
    (tmp_path / "bin/readme.txt").write_bytes(b"no program")
    (tmp_path / "bin/empty").write_bytes(b"")
    return tmp_path


def test_scans(spark, tree):
    rows = {r.path.rsplit("/", 1)[1]: r for r in scan_directory(spark, str(tree / "bin")).collect()}
    assert set(rows) == {"prog_a.so", "prog_b.so", "prog_c.so", "_x.so", ".y.so", "readme.txt", "empty"}
    assert bytes(rows["_x.so"].text) == model.sample(1) and rows["empty"].load_error.startswith("not a valid elf")
    assert load_paths(spark, ["/no/such/file"]).first().load_error.startswith("io error")
    assert read_store(spark, str(tree / "bin")).where("load_error is null").count() == 3
    paths = spark.createDataFrame([(p,) for p in ("a/b.so", "a/.so", "b.tar.so", "c/noext", "b.")], "path string")
    assert [r.program_id for r in with_ids(paths).collect()] == ["b", ".so", "b.tar", "noext", "b"]


def test_catalog_round_trip(spark, tree):
    rows = catalog.scan(spark, str(tree / "bin")).cache()
    assert rows.count() == 5
    path = str(tree / "out/db.json")
    assert catalog.save_json(rows, path) == 5
    back = catalog.load_json(spark, path)
    one = catalog.entry_of_file(spark, str(tree / "bin/prog_a.so"), "other").first()
    assert (one.program_id, one.ngram_count) == ("other", 29)
    quick = cli.quick_compare(spark, str(tree / "bin/prog_a.so"), str(tree / "bin/sub/prog_c.so"))
    assert quick.tier == "distinct" and quick.ngram_count_a == 29
    (tree / "few").mkdir()
    (tree / "few/short.so").write_bytes(model.elf(model.sample(1)[:16]))
    with pytest.raises(Exception, match="no ngrams extracted from .*few/short.so"):
        catalog.entry_of_file(spark, str(tree / "few/short.so"), "other").collect()
    assert lsh.index_directory(spark, str(tree / "bin"), 8).count() == 5 * 8
    key = lambda r: (r.program_id, r.source_path, r.ngram_count, r.normalized_len, r.simhash, r.minhash, sorted(r.ngram_sample))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))
    assert json.loads(open(path).read())["version"] == 1
    (tree / "broken.json").write_text('{"version": 1, "entries": [{"program_id": "a"}]}')
    with pytest.raises(Exception, match="lacks a field"):
        catalog.load_json(spark, str(tree / "broken.json")).collect()
    (tree / "bin/short.so").write_bytes(model.elf(model.sample(1)[:16]))
    with pytest.raises(ValueError, match="no ngrams extracted from .*short.so"):
        catalog.scan(spark, str(tree / "bin"))
    assert catalog.scan(spark, str(tree / "bin"), strict=False).count() == 5
    assert catalog.empty(spark).isEmpty() and catalog.merge(catalog.empty(spark), rows).count() == 5
    (tree / "bin/sub/prog_a.so").write_bytes(model.elf(model.sample(42)))
    again = catalog.scan(spark, str(tree / "bin"), strict=False)
    assert catalog.find(again, "prog_a").first().source_path.endswith("sub/prog_a.so")


def test_reports(spark):
    programs = spark.createDataFrame([("a", model.sample(3)), ("b", model.sample(99)), ("c", model.sample(20)), ("d", model.sample(200))], "program_id string, text binary")
    prints = fingerprints(programs)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("a", "nobody")], "a string, b string")
    got = {(r.a, r.b): r for r in compared(pairs, prints).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("c", "d")}
    same = got["a", "b"]
    assert (same.tier, same.jaccard_exact, same.hamming_distance, len(same.notes)) == ("identical", 1.0, 0, 1)
    assert (got["c", "d"].hamming_distance, got["c", "d"].tier) == (33, "distinct")


def test_command_line(spark, tree, capsys):
    a, b, c = (str(tree / "bin" / n) for n in ("prog_a.so", "prog_b.so", "sub/prog_c.so"))

    def said(*args: str) -> list[str]:
        assert cli.main(list(args), spark) == 0
        return capsys.readouterr().out.splitlines()

    assert said("compare", a, b)[2:] == ["jaccard_estimate: 1.0000", "jaccard_exact:    1.0000", "simhash_similarity: 1.0000", "hamming_distance: 0"]
    lines = said("fingerprint", a)
    assert lines[1:4] == ["ngram_count: 29", "simhash: c649b6f6ff0c5bd8", "minhash_signature:"] and lines[4].startswith(" 07b58ce8b3dbcb5f ") and len(lines) == 36
    lines = said("cluster", str(tree / "bin"), "--threshold", "0.8")
    assert lines[1:3] == ["threshold: 0.80", "clusters: 4"] and lines[4] == "cluster 0 (2 members, avg_similarity 1.0000)" and lines[5:7] == [f"  {a}", f"  {b}"]
    db = str(tree / "db.json")
    assert said("index", str(tree / "bin"), "--output", db) == ["indexed 5 programs", f"catalog: {db}"]
    assert said("query", a, "--db", db, "--min_jaccard", "0.9")[1:] == ["catalog: 5 entries", "  prog_a jaccard=1.0000", "  prog_b jaccard=1.0000"]
    lines = said("report", a, c)
    assert lines[0] == "similarity report" and lines[3] == "  tier: distinct" and lines[8] == "  ngrams: 29 vs 29"
    assert cli.main(["compare", a, str(tree / "bin/readme.txt")], spark) == 1
    assert capsys.readouterr().err.startswith("error: ")
    reports = cli.batch_compare(spark, a, [b, c], 0.5)
    assert cli.format_batch(a, reports).splitlines()[1:] == ["matches: 1", f"  [0] {b} jaccard=1.0000 tier=Identical"]
    assert cli.format_catalog(catalog.load_json(spark, db)).startswith("fingerprint_db version=1 entries=5")


def test_streaming_ingest(spark, tmp_path):
    from slotmill.streaming.ingest import ingest

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", model.sample(1)), ("b", model.sample(7)), ("c", b"")], "program_id string, text binary").write.parquet(source)
    stream = spark.readStream.schema("program_id string, text binary").parquet(source)
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {r.program_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}
