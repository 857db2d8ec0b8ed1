"""Token counts against the libraries themselves."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from slotmill.llm import queries, token_counts
from slotmill.llm.tokens import vocabulary

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "Zé", "ß", "don't", "'s", "12", "3,5", ".", "...", ",", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "▁", "<|endoftext|>", "<|endo", "text|>", "<s>", "語", "。", "😀", "é", "​", "²", "x" * 40, "\x00"]
TEXTS = st.lists(st.sampled_from(ODD), max_size=30).map("".join)


class Libraries:
    """The libraries' own counts, loaded once."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        tokenizer, model = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
        self.count = {BYTES: lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids), PIECES: lambda t: len(model.encode(t))}


LIBRARIES = Libraries().count


@pytest.mark.parametrize("path", [BYTES, PIECES])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_counts_equal_the_library(path, text):
    assert token_counts._counter(path).of([text]) == [LIBRARIES[path](text)]


@pytest.mark.parametrize("path", [BYTES, PIECES])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS, chunk=st.integers(2, 40), overlap=st.integers(1, 20))
def test_spliced_chunks_equal_the_whole(path, text, chunk, overlap):
    counter = token_counts._counter(path)
    if text and not (counter.lead and "▁" in text):
        assert token_counts.count_spliced(counter.lead + text, counter.ends, chunk, overlap) == LIBRARIES[path](text)


def test_long_texts_are_cut_and_whole_in_count(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["river", "Straße", "déjà", "x" * 300, "3.14", "<|endoftext|>", "don't", "\n\n", "語" * 50]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 60_000))
    seen = []
    counter = token_counts._counter(BYTES)
    ends = counter.ends
    monkeypatch.setattr(counter, "ends", lambda t: seen.append(len(t)) or ends(t))
    assert counter.of([text, "", text[:100]]) == [LIBRARIES[BYTES](t) for t in (text, "", text[:100])]
    assert len(seen) > 10 and max(seen) <= 2 * token_counts.CHUNK
    # One long word has no boundary: overlaps widen until the chunk is the text.
    for one in ("x" * 300_000, "語" * 100_000, " " * 200_000, "\r\n" * 80_000):
        assert counter.of([one]) == [LIBRARIES[BYTES](one)]


def test_units_hold_their_bytes():
    for path in (BYTES, PIECES):
        tokens = vocabulary(path, True)
        text = " The rivers, déjà vu... 12,5\nrun\tdown  fast <|endoftext|> ok."
        units = tokens.units(text)
        assert "".join(units) == text and len(units) > 10
        for u, ids in zip(units, tokens.encode(units), strict=True):
            assert b"".join(tokens.bytes_of[i] for i in ids) == u.encode()


def test_query_equals_the_library_on_every_document(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n = LIBRARIES[BYTES](r.text or "")
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 1024)


def test_shapes(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "two words", "c"), (3, "two words", "c"), (None, "x", "c"), (4, "word " * 40_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTES).collect())
    assert got == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 9, 2, False), ("3", 9, 2, False), ("4", 200_000, LIBRARIES[BYTES]("word " * 40_000), True), ("None", 1, 1, False)]
    assert token_counts.token_counts(docs.where("false"), BYTES).count() == 0
    assert {r.n_tokens for r in token_counts.token_counts(docs.where("doc_id = 3"), PIECES).collect()} == {LIBRARIES[PIECES]("two words")}
