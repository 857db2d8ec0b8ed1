"""Token counts (operator 11): exact counts of whole texts in bounded memory.

A text up to CHUNK characters is encoded as it is. A longer one is cut in chunks that overlap;
each chunk is encoded by itself, as the byte offsets at which its tokens end. Two chunks are
spliced at a boundary in their overlap that is common (both have a token ending there) and
proven stable: whatever stands before or after, the vocabulary's pre-tokens part there, so what
follows is encoded alike in either chunk and in the whole text. Tokens of the left chunk count
up to the splice, those of the right one from it on. An overlap without such a boundary is
widened, twofold each time, the left chunk growing with it; at worst, in a text that is one
long word, it grows to the whole text. Nothing is estimated, no text is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import Remembered, Tokens, vocabulary

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 65_536, 512
#: Tokens beyond which a document is over the limit.
LIMIT = 1024

#: A stable boundary: white space after a visible ASCII character, or one of these marks after a Latin
#: letter. The white space is such to every library, and no special token spans the place.
_STABLE = re.compile("(?<=[\x21-\x7e])(?=[ \t\n])|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[,.])").finditer

Encoder = Callable[[str], np.ndarray]


def count_spliced(text: str, ends_of: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of `text`; `ends_of` gives the byte offsets at which the tokens of a chunk end."""
    start, end, total = 0, min(len(text), chunk), 0
    ends, skip = ends_of(text[:end]), 0  # `skip`: bytes of the chunk that are counted already
    wide = overlap
    while end < len(text):
        at = max(start, end - wide)
        right = text[at : min(len(text), at + max(chunk, 2 * wide))]
        right_ends = ends_of(right)
        before = len(text[start:at].encode())  # bytes of the left chunk before the overlap
        both = np.intersect1d(ends - before, right_ends)
        splice = next((b for b in _boundaries(text[at:end]) if before + b > skip and _has(both, b)), None)
        if splice is None:
            wide *= 2
            end = min(len(text), end + wide)
            ends = ends_of(text[start:end])
            continue
        total += int(((ends > skip) & (ends <= before + splice)).sum())
        ends, skip = right_ends, splice
        start, end, wide = at, at + len(right), overlap
    return total + int((ends > skip).sum())


def _boundaries(overlap: str) -> Iterator[int]:
    """Byte offsets of the stable boundaries inside a text. The first and last character decide
    nothing: what stands beyond them is not seen."""
    at = size = 0
    for m in _STABLE(overlap, 1, max(1, len(overlap) - 1)):
        size += len(overlap[at : m.start()].encode())
        at = m.start()
        yield size


def _has(values: np.ndarray, x: int) -> bool:
    i = int(np.searchsorted(values, x))
    return i < len(values) and values[i] == x


class Counter:
    """Counts of many texts with one vocabulary."""

    def __init__(self, tokens: Tokens, lead: str) -> None:
        self.tokens, self.lead = tokens, lead
        self.lengths = Remembered(lambda some: [tokens.size[ids].astype("<u2").tobytes() for ids in tokens.encode(some)])

    def ends(self, text: str) -> np.ndarray:
        (found,) = self.lengths.of([self.tokens.units(text)])
        ends = np.cumsum(np.frombuffer(b"".join(found), "<u2").astype(np.int64))
        return ends - (ends[-1] - len(text.encode()))  # a chunk's first piece may hold a blank that isn't there

    def of(self, texts: list[str]) -> list[int]:
        if self.lead:  # the model reads its mark for a blank as a blank
            texts = [t.replace("▁", " ") for t in texts]
        out = [0] * len(texts)
        long = [bool(t) and len(t) > CHUNK and not self.tokens.whole for t in texts]
        short = [i for i, t in enumerate(texts) if t and not long[i]]
        found = self.lengths.of([self.tokens.units(self.lead + texts[i]) for i in short])
        for i, parts in zip(short, found, strict=True):
            out[i] = sum(map(len, parts)) // 2
        for i, t in enumerate(texts):
            if long[i]:
                out[i] = count_spliced(self.lead + t, self.ends)
        return out


@cache
def _counter(path: str) -> Counter:
    """A piece vocabulary puts a blank before a text; chunks must not get one of their own."""
    return Counter(vocabulary(path), " " if path.endswith(".model") else "")


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for part in slices(batches):
        texts = [t or "" for t in part.column("text").to_pylist()]
        columns = [[len(t.encode()) for t in texts], counter.of(texts)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text, any others).

    `tokenizer` names a byte-level vocabulary (.json) or a piece vocabulary (.model) that every
    executor sees. Tokens are those the vocabulary's library gives without begin, end or other
    added tokens; special strings inside texts count as the library's default has it. A null or
    empty text has no bytes and no tokens. Very long texts are counted whole, chunk by chunk.
    Repeated rows are counted each; an empty table gives no rows. Nothing shuffles.
    """
    of = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = docs.select("doc_id", "text").mapInArrow(partial(_counts, path=tokenizer), of)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
