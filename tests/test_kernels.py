from __future__ import annotations

import model
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slotmill.operators import kernels as k

slot = st.builds(
    lambda op, reg, off, imm: bytes([op, reg]) + off + imm,
    st.sampled_from([0x18, 0x18, 0xB7, 0xB7, 0x07, 0x20]),
    st.sampled_from([0, 0, 1, 0x10, 0x21, 0x35, 0xFF]),
    st.sampled_from([bytes(2), b"\1\2"]),
    st.sampled_from([bytes(4), b"\1\0\0\0"]),
)
stream = st.builds(lambda s, tail: b"".join(s) + tail, st.lists(slot, max_size=40), st.binary(max_size=7))


@settings(max_examples=300, deadline=None)
@given(stream, st.booleans(), st.booleans(), st.booleans())
def test_normalize_equals_the_model(text, strip, collapse, remap):
    got = k.normalize(text, k.NormalizeConfig(strip, collapse, remap))
    assert (got.normalized, got.removed_instructions, got.register_remap) == model.normalize(text, strip, collapse, remap)
    assert got.original_len == len(text)


@settings(max_examples=100, deadline=None)
@given(stream, st.integers(1, 4))
def test_ngrams_and_sketches_equal_the_model(text, n):
    got = k.ngrams(text, n)
    assert set(got.tolist()) == model.ngrams(text, n) and len(set(got.tolist())) == len(got)
    assert k.minhash(got, 5).tolist() == model.minhash(got.tolist(), 5)
    assert k.simhash(got) == model.simhash(got.tolist())


GOLDEN = {  # seed: simhash raw, simhash normalized, first minhash normalized
    1: ("c896e175a52e2ee7", "98b6e1b5a52caee7", "055741f8fbd5dac9"),
    3: ("40018d50b113b938", "e10f8d52f313f978", "08600bb48c086313"),
    99: ("40018d50b113b938", "e10f8d52f313f978", "08600bb48c086313"),
    7: ("6c3d21309585c531", "663561b72525c511", "04b53dcccf4465d8"),
    20: ("071ab487a5654490", "c649b6f6ff0c5bd8", "07b58ce8b3dbcb5f"),
    42: ("30490dc8d4af2a4f", "30092d4ed4af2b4c", "09ceeb40883cc311"),
    200: ("a16a8677039804a7", "a166867612d810a3", "00697080b450d7e6"),
}


@pytest.mark.parametrize("seed", GOLDEN)
def test_golden_programs(seed):
    raw = k.ngrams(model.sample(seed))
    norm = k.normalize(model.sample(seed))
    grams = k.ngrams(norm.normalized)
    assert (len(raw), len(grams), len(norm.normalized), norm.removed_instructions) == (30, 29, 248, 0)
    assert tuple(f"{x:016x}" for x in (k.simhash(raw), k.simhash(grams), int(k.minhash(grams, 1)[0]))) == GOLDEN[seed]


def test_golden_sets():
    some = np.arange(50, dtype=np.uint64)
    assert [f"{x:016x}" for x in k.minhash(some, 64)[:4]] == ["125ba56a463bcc37", "013a540018ba9e86", "094fee3db191ebc7", "006e4ca6cc4d5438"]
    assert f"{k.simhash(some):016x}" == "002a6ab02fd3b96c"


def test_wide_loads_at_the_end_and_no_ops():
    s = lambda *b: bytes(b) + bytes(8 - len(b))
    text = s(0x18, 1) + s(0) + s(0x18, 2) * 3 + s(0xB7) * 2 + bytes([0x18, 3, 0, 0, 0, 0, 0, 1])
    got = k.normalize(text)
    assert got.normalized.hex() == "1800000000000000" + "1801000000000000" * 2 + "1802000000000001"
    assert got.removed_instructions == 1 and got.register_remap == ((1, 0), (2, 1), (3, 2))
    assert got.lookup(2) == 1 and got.lookup(9) == 9 and got.compression_ratio == 0.5


def test_limits():
    for n in (0, 5):
        with pytest.raises(ValueError):
            k.ngrams(b"", n)
    none = np.empty(0, np.uint64)
    assert k.minhash(none, 3).tolist() == [2**64 - 1] * 3 and k.simhash(none) == 0 and len(k.minhash(none, 0)) == 0
    assert k.normalize(b"").compression_ratio == 1.0
    assert len(k.ngrams(bytes(23))) == 0 and len(k.ngrams(bytes(24))) == 1
