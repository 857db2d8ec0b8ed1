"""Searches hash what they can find, and lose nothing by it."""

from __future__ import annotations

import model
import numpy as np
import pytest

from slotmill.operators import fingerprint as fp
from slotmill.operators import kernels as k
from slotmill.operators import reach
from slotmill.plans import queries as q

K = 16


def test_leaders_attain_the_minima():
    rng = np.random.default_rng(9)
    for n in (1, 2, 300, 700):
        some = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        led = k.leaders(some, K)
        assert set(led.tolist()) <= set(some.tolist())
        assert [model.minhash([f], K)[i] for i, f in enumerate(led.tolist())] == k.minhash(some, K).tolist()
    assert len(k.leaders(some[:0], K)) == 0


def _programs(spark):
    """Streams with common parts of all lengths, a part that all have, copies, and empty ones."""
    rng = np.random.default_rng(10)
    everywhere, rows = rng.bytes(80), []
    for i in range(12):
        base = rng.bytes(640)
        for share in (80, 320, 560, 640):
            rows.append((f"{i}-{share}", bytearray(everywhere + base[:share] + rng.bytes(640 - share))))
        rows.append((f"{i}-copy", rows[-1][1]))
    return spark.createDataFrame([*rows, ("0-none", None), ("1-short", bytearray(b"abc"))], "program_id string, text binary")


@pytest.mark.parametrize("need, bands, common", [(1, 1, 256), (2, 1, 256), (10, 1, 256), (4, 4, 256), (2, 8, 256), (4, 1, 2), (2, 8, 2), (1, 1, 1)])
def test_all_that_may_be_found_is_within_reach(spark, monkeypatch, need, bands, common):
    monkeypatch.setattr(reach, "COMMON", common)
    programs = _programs(spark).cache()
    asked = programs.where("program_id in ('0-640', '5-320', '0-none', '1-short')")
    got = {r.program_id for r in reach.within_reach(programs, asked, need, bands, k=K).collect()}
    prints = {r.program_id: np.array(r.minhash).reshape(bands, -1) for r in fp.fingerprints(programs, k=K).collect()}
    of = [prints[i] for i in ("0-640", "5-320")]
    expected = {i for i, m in prints.items() if any(((m == x).sum(axis=1) >= need).any() for x in of)}
    assert expected <= got and {"0-640", "0-copy", "5-320"} <= expected
    if common > 2 and need > 3:
        assert len(got - expected - {"0-none", "1-short"}) <= 4


@pytest.mark.parametrize("name", ["lsh_documents", "exact_query", "batch_compare", "one_against_every"])
def test_searches_hash_few_streams(spark, monkeypatch, name):
    """No query hashes all streams under all seeds: their number is that of the search's own."""
    sizes = []
    real = q.fingerprints_once
    monkeypatch.setattr(q, "fingerprints_once", lambda p, **o: sizes.append((p.select("text").distinct().count(), o.get("k", 128))) or real(p, **o))
    small = "/root/testdata/sf0.01"
    q.__dict__[name](spark, small)
    every = (q.documents if name == "lsh_documents" else q.turns)(spark, small).select("text").distinct().count()
    assert sizes and sum(n for n, seeds in sizes if seeds) < every / 5
