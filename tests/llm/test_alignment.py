"""The cross-tokenizer alignment against a plain walk over every pair of tokens."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_tokens import ODD

from slotmill.llm import alignment as al
from slotmill.llm import queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The contract, from the libraries' own encodings of whole texts."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(self, text):
        """[(id, start, end)] of both sides; None without tokens."""
        if not text:
            return None
        a = [(i, bytes(self.letter[c] for c in t)) for i, t in ((i, self.a.id_to_token(i)) for i in self.a.encode(" " + text, add_special_tokens=False).ids)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        out = []
        for side in (a, b):
            if b"".join(x for _, x in side) != (" " + text).encode():
                return None
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            out.append([(i, e - len(x), e) for (i, x), e in zip(side, ends, strict=True)])
        return out

    def document(self, text):
        """(n_a, n_b, links, groups as text), from all pairs of tokens."""
        both = self.tokens(text)
        if both is None:
            return 0, 0, [], ""
        a, b = both
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 2000 else None
        if links is None:
            links, k = [], 0
            for i, s, e in a:
                while b[k][2] <= s:
                    k += 1
                m = k
                while m < len(b) and b[m][1] < e:
                    links.append((i, b[m][0]))
                    m += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, s, _ in side if lo <= s < hi) for side in (a, b)))
        return len(a), len(b), links, ";".join(groups)

    def corpus(self, texts):
        docs = [self.document(t) for t in texts]
        count = collections.Counter(p for d in docs for p in set(d[2]))
        top = collections.defaultdict(int)
        for (i, _), n in count.items():
            top[i] = max(top[i], n)
        return [
            (n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for n_a, n_b, links, g in docs
        ]


PLAIN = Plain()
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(ODD), max_size=25).map("".join))
def test_documents_equal_the_libraries(text):
    (found,) = al._aligner(BYTES, PIECES).of([text])
    n_a, n_b, links, groups = PLAIN.document(text)
    got = b"".join(f[1] for f in found)
    assert sorted((int(x) >> 40, int(x) >> 16 & 0xFFFFFF) for x in np.frombuffer(got, "<u8")) == sorted(links)
    assert b"".join(f[2] for f in found)[:-1].decode() == groups and sum(f[0] for f in found) & (1 << 40) - 1 == n_a


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " ", "one", "the river runs", "the river runs", "a▁b", "déjà vu, 12.5", "x\r\ny", "the " * 3000, "<|endoftext|> the <s>", "语言 river"]
    return [(i, t, "c") for i, t in enumerate(texts)] + [(4, "the river runs", "c"), (None, "the", "c")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, rows, monkeypatch, small):
    """Also with counts merged in two rounds and slices parted in several shares."""
    if small:
        monkeypatch.setattr(al, "FAN", 2)
        monkeypatch.setattr(al, "BUCKETS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string").withColumn("a", F.lit("clash")).withColumn("at", F.lit(1))
    got = al.alignment(docs.repartition(5, "doc_id"), BYTES, PIECES)
    assert got.columns == ["doc_id", *COLUMNS]
    want = [(str(i), *x) for (i, *_), x in zip(rows, PLAIN.corpus([t for _, t, _ in rows]), strict=True)]
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted(want)
    assert al.alignment(docs.where("false"), BYTES, PIECES).count() == 0


def test_query_on_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_cross_tokenizer(spark, SMALL).collect()}
    want = dict(zip([r.doc_id for r in docs], PLAIN.corpus([r.text for r in docs]), strict=True))
    assert got == want


@pytest.mark.parametrize("held", [1, 1000])
def test_streams_over_any_batches(monkeypatch, held):
    """Counts and postings that batches part anywhere give the same sums, also if they leave early."""
    monkeypatch.setattr(al, "HELD", held)
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 9, 80), rng.integers(0, 30, 80), rng.integers(1, 99, 80), strict=True)}
    rows, want = [], collections.defaultdict(lambda: [0, 0])
    for a in sorted({a for a, _ in pairs}):
        mine = sorted(b for x, b in pairs if x == a)
        top = max(pairs[a, b] for b in mine)
        rows.append((a, None, np.array(mine, "<u4").tobytes(), None, np.array([pairs[a, b] for b in mine], "<u8").tobytes(), None))
        for s in range(6):
            b, d, m = rng.choice(mine, 4), rng.integers(0, 5, 4), rng.integers(1, 9, 4)
            rows.append((a, s, b.astype("<u4").tobytes(), d.astype("<u2").tobytes(), None, m.astype("<u4").tobytes()))
            for x, y, z in zip(b.tolist(), d.tolist(), m.tolist(), strict=True):
                want[s, y][0] += z * (pairs[a, x] == top)
                want[s, y][1] += z * pairs[a, x]
    names = ["a", "slice", "bs", "ds", "ns", "ms"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    for size in (1, 2, 5, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + size]], t) for i, t in enumerate(kinds)], names) for k in range(0, len(rows), size)]
        got = collections.defaultdict(lambda: [0, 0])
        for out in al._rated(iter(batches)):
            for s, d, best, sums in zip(*(out.column(c).to_pylist() for c in ("slice", "ds", "best", "sums")), strict=True):
                for y, p, q in zip(np.frombuffer(d, "<u2").tolist(), np.frombuffer(best, "<i8").tolist(), np.frombuffer(sums, "<i8").tolist(), strict=True):
                    got[s, y][0] += p
                    got[s, y][1] += q
        assert got == want
