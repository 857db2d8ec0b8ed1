"""Benchmark decontamination (operator 10): a prefix-filtered set join over item-sized windows.

A benchmark item is cut in windows of ten consecutive words (a shorter item is one window). A
window occurs in a document only if all its shingles (three words, fewer for tiny windows) do,
so by the prefix principle for containment 1 its rarest shingle alone has to join. Rarity is
counted over the whole corpus in a first pass; a window whose rarest shingle never occurs is
out. The second pass joins the remaining prefix shingles with the shingles of each document,
applies the positional and length bounds (the window must fit between the document's ends at
the place the shingle dictates) and verifies the words exactly.

The benchmark side is sent to the workers in blocks of at most BLOCK windows, whatever its
size. One pass over the corpus counts the shingles of many blocks; then a block at a time is
matched, into a table, and leaves the workers. Hits are united by row content.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordIds, cut, maybe_in, shingles, slices, small_batches

WINDOW, WIDTH, BLOCK = 10, 3, 200_000
#: Shingles that one pass over the corpus counts.
COUNTED = 4_000_000
#: Rows with hits up to this many are broadcast; more are joined by a shuffle.
BROADCAST_HITS = 100_000

#: Lower-cases A-Z and blanks every ASCII byte that is neither digit nor letter.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text after lower-casing A-Z."""
    return (text or b"").translate(_BYTES).split()


class ByteIds(WordIds):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    n = min(WINDOW, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        ids, out = [], []
        for item, text in zip(part.column("item_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for w in set(windows_of(words_of(text))):
                ids.append(None if item is None else str(item)), out.append(b" ".join(w))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "window"])


def _prefixes(windows: list[bytes]) -> dict[bytes, list[tuple[int, int]]]:
    """For each window the (shingle hash, offset) of its shingles."""
    ids = ByteIds()
    return {w: [(int(h), k) for k, h in enumerate(shingles(ids.of(w.split()), WIDTH))] for w in windows}


def _widths(windows: list[bytes]) -> list[int]:
    return sorted({min(WIDTH, w.count(b" ") + 1) for w in windows})


class Among:
    """Where hashes are in a sorted set: by a bitmap of their leading bits, then a search."""

    SHIFT = np.uint64(64 - 18)

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.leading = values, np.zeros(2**18, bool)
        self.leading[values >> self.SHIFT] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the hashes found, and where in the set they are."""
        some = np.nonzero(self.leading[hashes >> self.SHIFT])[0]
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.values, hashes[some]), len(self.values) - 1)
        found = self.values[at] == hashes[some]
        return some[found], at[found]


def _count(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """How often each shingle of the benchmark occurs in the documents of this task."""
    wanted, widths = sent.value
    total, cache, among = np.zeros(len(wanted), np.int64), ByteIds(), Among(wanted)
    for part in slices(batches):
        for text in part.column("text").cast(pa.binary()).to_pylist():
            ids = cache.of(words_of(text))
            for width in widths:
                if len(ids) >= width:
                    np.add.at(total, among.find(shingles(ids, width))[1], 1)
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])


class Matcher:
    """Finds the windows of one block in documents."""

    def __init__(self, sent: tuple) -> None:
        prefixes, self.places, self.items, self.widths = sent
        self.prefixes = Among(prefixes)
        self.cache = ByteIds()

    def find(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """(start, length) of every occurrence, and the items they belong to."""
        spans, items = set(), set()
        if not len(self.prefixes.values):
            return spans, items
        ids = self.cache.of(words)
        for width in self.widths:
            if len(ids) < width:
                continue
            h = shingles(ids, width)
            for pos in self.prefixes.find(h)[0].tolist():
                for offset, length in self.places[int(h[pos])]:
                    start = pos - offset
                    if start >= 0 and start + length <= len(words):
                        found = self.items.get(b" ".join(words[start : start + length]))
                        if found is not None:
                            spans.add((start, length))
                            items.update(found)
        return spans, items


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
FOUND = "n_words long, spans array<struct<start:long,length:long>>, items array<string>"


def _found(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(sent.value)
    for part in slices(batches):
        n_words, spans, items = [], [], []
        for text in part.column("text").cast(pa.binary()).to_pylist():
            words = words_of(text)
            s, found = matcher.find(words)
            n_words.append(len(words)), spans.append([{"start": a, "length": b} for a, b in sorted(s)]), items.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"]
        )


def _hits(batches: Iterator[pa.RecordBatch], sent, block: int) -> Iterator[pa.RecordBatch]:
    """For the rows with hits: row content key, block, spans and items."""
    matcher = Matcher(sent.value)
    for part in slices(batches):
        keep, spans, items = [], [], []
        for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
            s, found = matcher.find(words_of(text))
            if s:
                keep.append(i), spans.append([{"start": a, "length": b} for a, b in sorted(s)]), items.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [part.column("key").take(pa.array(keep, pa.int64())), pa.array([block] * len(keep), pa.int32()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], ["key", "block", "spans", "items"]
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        n = [len(words_of(t)) for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), part.column("key")], ["doc_id", "n_words", "key"])


def _tainted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Ids and text hashes of the rows with hits."""
    matcher = Matcher(sent.value)
    for part in slices(batches):
        hit = pa.array([bool(matcher.find(words_of(t))[0]) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column(c).filter(hit) for c in ("doc_id", "th")], ["doc_id", "th"])


class Blocks:
    """The windows of a benchmark in `count` blocks, as inputs of a Matcher."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, block: int) -> None:
        self.docs, self.block = docs, block
        self.windows = cut(benchmark.select("item_id", "text").mapInArrow(_item_windows, "item string, window binary").distinct(), "windows")
        self.count = -(-self.windows.count() // block) or 1

    def _items(self, i: int) -> dict[bytes, list[str]]:
        items: dict[bytes, list[str]] = defaultdict(list)
        for w, item in self.windows.where(F.pmod(F.xxhash64("window"), F.lit(self.count)) == i).select("window", "item").toLocalIterator():
            items[bytes(w)].extend([] if item is None else [item])
        return items

    def _rarity(self, wanted: np.ndarray, widths: list[int]) -> dict[int, int]:
        """How often each of these shingles occurs in the corpus; those that don't are left out."""
        if not len(wanted):
            return {}
        sent = self.docs.sparkSession.sparkContext.broadcast((wanted, widths))
        found = self.docs.select("text").mapInArrow(partial(_count, sent=sent), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        with small_batches(self.docs.sparkSession):
            counts = {r["shingle"] % 2**64: r["n"] for r in found.collect()}  # as many as were sent at most
        sent.unpersist()
        return counts

    def __iter__(self) -> Iterator:
        """Broadcast matcher inputs, one after the other; the user ends each."""
        at_once = max(1, COUNTED // (self.block * (WINDOW - WIDTH + 1)))
        for first in range(0, self.count, at_once):
            some = range(first, min(self.count, first + at_once))
            shingles_of, widths = [np.empty(0, np.uint64)], set()
            for i in some:
                windows = list(self._items(i))
                widths.update(_widths(windows))
                shingles_of.append(np.array([h for x in _prefixes(windows).values() for h, _ in x], np.uint64))
            counts = self._rarity(np.unique(np.concatenate(shingles_of)), sorted(widths))
            for i in some:
                yield self.docs.sparkSession.sparkContext.broadcast(_matcher_input(self._items(i), counts))


def _matcher_input(items: dict[bytes, list[str]], counts: dict[int, int]) -> tuple:
    places: dict[int, set] = defaultdict(set)
    live: dict[bytes, list[str]] = {}
    for w, choices in _prefixes(list(items)).items():
        rarest, offset = min(choices, key=lambda x: (counts.get(x[0], 0), x))
        if counts.get(rarest, 0):
            places[rarest].add((offset, w.count(b" ") + 1))
            live[w] = items[w]
    return np.sort(np.array(list(places), np.uint64)), dict(places), live, _widths(list(live))


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of `docs` (doc_id, text, any others):
    where windows of `benchmark` (item_id, text, any others) occur, in words, and whose.

    Null and empty texts have no words, hence no hits; null and word-less items have no
    windows. An item without an id makes hits but isn't listed; repeated items count once.
    Empty tables on either side give no hits or no rows.
    """
    blocks = Blocks(docs, benchmark, block)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if blocks.count == 1:
        (sent,) = blocks
        return docs.select("doc_id", "text").mapInArrow(partial(_found, sent=sent), f"doc_id {kind}, {FOUND}")
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    of = "key string, block int, spans array<struct<start:long,length:long>>, items array<string>"
    union = None
    for i, sent in enumerate(blocks):
        hits = cut(rows.select("key", "text").mapInArrow(partial(_hits, sent=sent, block=i), of), "hits")
        sent.unpersist()
        union = hits if union is None else union.unionByName(hits)
    # One row a block and text at most, so a text gathers as many rows as there are blocks.
    once = union.groupBy("key", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    merged = once.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    words = rows.mapInArrow(_counted, f"doc_id {kind}, n_words long, key string")
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    return words.join(merged, "key", "left").select("doc_id", "n_words", F.coalesce("s", none).alias("spans"), F.coalesce("i", F.expr("cast(array() as array<string>)")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of `contamination`: words inside any span, items, the SHA-256 of the items."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], F.least(end, s["start"]))).alias("n"))

    n_hit = F.aggregate("spans", start, step, lambda a: a["n"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` without any occurrence of a benchmark window, all columns as they are.

    Null and empty texts have no words and stay; null and word-less items have no windows;
    repeated rows share their fate; empty tables on either side drop no row. A row is known by
    its id and the hash of its text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    with Scratch():
        hits = None
        for sent in Blocks(docs, benchmark, block):
            found = cut(rows.mapInArrow(partial(_tainted, sent=sent), f"doc_id {kind}, th long").distinct(), "hits")
            sent.unpersist()
            hits = found if hits is None else hits.union(found)
        hits = cut(hits.distinct().select(F.col("doc_id").alias("_slotmill_id"), F.col("th").alias("_slotmill_th")), "tainted", result=True)
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def clean(some: DataFrame, bad: DataFrame) -> DataFrame:
        return some.join(bad, some["doc_id"].eqNullSafe(F.col("_slotmill_id")) & (F.xxhash64(some["text"]) == F.col("_slotmill_th")), "left_anti").select(*columns)

    if hits.count() <= BROADCAST_HITS:
        return clean(docs, F.broadcast(hits))
    maybe, surely = maybe_in(docs, F.xxhash64("doc_id", F.xxhash64("text")), hits.select(F.xxhash64("_slotmill_id", "_slotmill_th").alias("hash")))
    return surely.unionByName(clean(maybe, hits))
