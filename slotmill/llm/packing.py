"""Packing (operator 4): cutting-stock column generation over a length histogram.

Documents become token ids (their own ids, then id 1) and are cut at the multiples of the
sequence length and, in what remains, at its half, so that every piece is a whole sequence
or at most half of one. Pieces are counted by length class (lengths rounded up to a grid):
a histogram of at most `capacity / GRID` rows, whatever the size of the corpus. On it the
driver solves the cutting-stock linear program: columns are patterns (how many pieces of each
class share a sequence); a knapsack by dynamic programming prices new columns until the
Farley bound shows the program to be within GAP of its optimum. The rounded-down patterns and
a first-fit-decreasing packing of the few pieces left over make the plan.

Pieces are ranked within their class without gathering a class anywhere: salted row numbers
plus the prefix sums of the salts' counts. Rank and plan give each piece its sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

CAPACITY, END_ID, GRID, GAP = 2048, 1, 4, 0.002
#: Pricing rounds at most; stopping early only leaves a slightly worse plan, never a piece.
MAX_ROUNDS = 4000
#: Chunks a worker remembers, and the longest remembered chunk; only memory and speed depend on them.
CHUNK_CACHE, CHUNK_LENGTH = 900_000, 40

_END = np.array([END_ID], "<u4").tobytes()
#: A comma or full stop after anything but white space, a Latin letter or a digit.
_NO_LETTER = re.compile(r"[^a-zA-Z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\s][.,]").search


#: Words whose letters the tokenizer's normalizer leaves as they are.
_LETTERS = re.compile(r"[a-z\u00e0-\u00f6\u00f8-\u00ff]+").fullmatch


def _cut(chunks: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
    raw = ids.tobytes()
    return ((c, raw[a:b]) for c, a, b in zip(chunks, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, for which lower-casing goes character by character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkTokens:
    """Token ids (little-endian uint32) of texts, chunk by chunk.

    The tokenizer lower-cases, drops white space and never merges across it, nor from a letter
    to a comma or full stop; so the ids of a text are those of its chunks in order. Chunks not
    remembered are encoded together: words of lower-case Latin letters by the tokenizer's
    model behind a bare split at blanks (their last tokens are marked as word ends), others
    parted by a word that is one token and in none of them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        words = (w for w in self.tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha())
        self.mark = max(words, key=lambda w: (len(w), w))[:-4]
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.limit = CHUNK_CACHE
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {c: spell(chr(c))[0][0] for c in range(0xE0, 0x100)}
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    @staticmethod
    def chunks(text: str) -> list[str]:
        if "<|" not in text and _latin(text) and not _NO_LETTER(text):
            text = text.lower().replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Codes of `chunks`; the short ones are remembered."""
        words = [c for c in chunks if _LETTERS(c)]
        codes: dict[str, bytes] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            joined = " ".join(part)
            joined = joined if joined.isascii() else joined.translate(self.spelt)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.is_end[ids])[0] + 1
            if len(ends) == len(part):
                codes.update(_cut(part, ids, np.append(0, ends[:-1]), ends))
        odd = {c for c in chunks if self.mark in c.lower() and c not in codes}
        codes.update((c, np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()) for c in odd)
        plain = [c for c in chunks if c not in codes]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.nonzero(ids == self.mark_id)[0], len(ids))
            codes.update(_cut(part, ids, np.append(0, ends[:-1] + 1), ends))
        self.known.update((c, x) for c, x in codes.items() if len(c) <= CHUNK_LENGTH)
        return codes

    def trim(self) -> None:
        if len(self.known) > self.limit:
            self.known.clear()

    def of(self, texts: list[str]) -> list[bytes]:
        self.trim()
        split = [self.chunks(t) for t in texts]
        codes = [list(map(self.known.get, c)) for c in split]
        new: set[str] = set()
        for chunks, found in zip(split, codes, strict=True):
            if None in found:
                new.update(compress(chunks, [x is None for x in found]))
        learnt = self._learn(new)
        for chunks, found in zip(split, codes, strict=True):
            if None in found:
                found[:] = [learnt[c] if x is None else x for c, x in zip(chunks, found, strict=True)]
        return [b"".join(x) for x in codes]


def piece_starts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of `total` ids begin, and `total`."""
    starts = list(range(0, total, capacity))
    if total - starts[-1] < capacity and total - starts[-1] > capacity // 2:
        starts.append(starts[-1] + capacity // 2)
    return [*starts, total]


@cache
def _tokens(path: str) -> ChunkTokens:
    """One a worker process: later tasks find the vocabulary loaded and frequent chunks known."""
    return ChunkTokens(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, remembered: int) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    tokens.limit = remembered
    for part in slices(batches):
        at, start, length, crc, total, kept = [], [], [], [], [], []
        for i, ids in enumerate(tokens.of([t or "" for t in part.column("text").to_pylist()])):
            ids += _END
            cuts = piece_starts(len(ids) // 4)
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b])), total.append(cuts[-1])
                kept.append(ids[4 * a : 4 * b] if with_ids else None)
        long = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *long, pa.array(kept, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    tokens.trim()


def _price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern for these class values: an unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - sizes[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], took[c] = gain[j], j
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often to use each; together they hold at least `demand`.

    `sizes` ascending, none over `capacity`.
    """
    m = len(sizes)
    if not m:
        return []
    per = capacity // sizes
    columns = np.diag(per.astype(float))
    inverse = np.diag(1.0 / per)
    x = demand / per
    for _ in range(MAX_ROUNDS):
        dual = inverse.sum(axis=0)
        worth, pattern = _price(np.maximum(dual, 0), sizes, capacity)
        if worth <= 1 / (1 - gap):
            break
        step = inverse @ pattern
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        by = ratio[out]
        x = np.maximum(x - by * step, 0)
        x[out] = by
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
        columns[:, out] = pattern
    uses = np.floor(x + 1e-9).astype(np.int64)
    plan = [(columns[:, j].astype(np.int64), int(uses[j])) for j in range(m) if uses[j]]
    left = np.maximum(demand - sum((p * u for p, u in plan), np.zeros(m, np.int64)), 0).astype(np.int64)
    # First fit decreasing, a pattern at a time, used as long as the pieces last.
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False, remembered: int = CHUNK_CACHE) -> DataFrame:
    """One row a piece of `docs` (doc_id, text, any others): where it lies in which sequence.
    With `with_ids` the pieces carry their ids, too, as little-endian unsigned 32-bit numbers.
    Workers remember up to `remembered` chunks: more of them are faster and take more memory.

    A null or empty text is a document of the end id alone. Repeated rows are packed each.
    An empty table gives no rows. Columns: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.
    """
    spark = docs.sparkSession
    of = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    made = docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=tokenizer, with_ids=with_ids, remembered=remembered), of)
    made = made if with_ids else made.drop("ids")
    pieces = cut(made.withColumn("uid", F.monotonically_increasing_id()).withColumn("size", F.ceil(F.col("length") / GRID).cast("int")), "pieces")
    histogram = sorted((r["size"], r["count"]) for r in pieces.groupBy("size").count().collect())  # at most CAPACITY / GRID rows
    blocks = _blocks(histogram)
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    before = salted.groupBy("size", "salt").count().select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("uid")) - 1).join(before, ["size", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    # The plan has a few thousand rows at most: classes times patterns.
    slots = F.broadcast(spark.createDataFrame(blocks, "size int, first long, past long, uses long, base long"))
    placed = ranked.join(slots, "size").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    placed = placed.withColumn("sequence_id", F.col("base") + (F.col("rank") - F.col("first")) % F.col("uses"))
    row = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(row), F.lit(0)).alias("offset"))
    return placed.select(*out, *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids) from `pack(..., with_ids=True)`: a sequence's pieces in
    order, at most CAPACITY of them."""
    piece = F.struct("offset", "ids")
    ids = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), ids.alias("ids"))


def _blocks(histogram: list[tuple[int, int]], capacity: int = CAPACITY // GRID) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank past the last, uses, first sequence) for every class of every pattern."""
    whole = [(s, n) for s, n in histogram if 2 * s > capacity]
    parts = [(s, n) for s, n in histogram if 2 * s <= capacity]
    sizes, demand = np.array([s for s, _ in parts], np.int64), np.array([n for _, n in parts], np.int64)
    out, base, next_rank = [], 0, dict.fromkeys((s for s, _ in histogram), 0)
    for s, n in whole:  # fills more than half: alone
        out.append((s, 0, n, n, base))
        base += n
    for pattern, uses in cutting_stock(sizes, demand, capacity):
        for i in np.nonzero(pattern)[0]:
            s, n = int(sizes[i]), int(pattern[i]) * uses
            out.append((s, next_rank[s], next_rank[s] + n, uses, base))
            next_rank[s] += n
        base += uses
    return out


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


