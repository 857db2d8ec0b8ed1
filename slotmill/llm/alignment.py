"""Cross-tokenizer alignment (operator 13): which tokens of two vocabularies cover the same bytes.

Both vocabularies encode a text (with a blank before it); byte offsets where tokens of both end
cut it into groups, and tokens whose byte ranges overlap are linked. Texts are put together
from units at whose ends both vocabularies end a token, so groups and links lie within units.

Counts are taken by postings. A slice is a bounded run of documents; for each id of side A and
each slice a posting row holds the ids of B linked there, the documents and the multiplicities.

1. Each task adds up, for its own documents, how many hold a pair; the sums are merged by A id,
   in a tree, in streams sorted by id. A merged id has at most as many entries as B has ids.
2. Cogroup: postings and merged counts meet in partitions of (bucket of A ids, share of slices),
   sorted by A id with its counts before its postings. A stream holds the counts of one id,
   finds its maximum and rates postings as they pass. A frequent id is spread by the slices'
   shares; Spark's sort spills, and nothing gathers a group.
3. What a task finds for a document is added up before it leaves, in blocks by slice; the sums
   by slice are joined to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, cut, slices
from .tokens import Remembered, Tokens, vocabulary

#: Documents, and bytes of them, in a slice; a longer document is a slice of its own.
SLICE_DOCS, SLICE_SIZE = 1024, 2_000_000
#: Buckets of A ids; tasks whose counts are merged at a time.
BUCKETS, FAN = 64, 1000
#: Pair counts a task holds before it adds them up, and slices before their sums leave it.
PENDING, HELD = 1_000_000, 1_000

_A, _B = np.uint64(40), np.uint64(16)
_ID = np.uint64(0xFFFFFF)


def align(a: list[int], b: list[int], left: Tokens, right: Tokens, text: str) -> tuple[int, int, int, list[int], str] | None:
    """(tokens of A, of B, groups, links as a << 40 | b << 16, groups as text) of a unit; None
    unless both sides' bytes are the unit's."""
    raw = text.encode()
    size_a, size_b = left.bytes_of, right.bytes_of
    if b"".join([size_a[x] for x in a]) != raw or b"".join([size_b[x] for x in b]) != raw:
        return None
    links, groups = [], []
    i = j = first_a = first_b = 0
    end_a, end_b = len(size_a[a[0]]), len(size_b[b[0]])
    while True:
        links.append(a[i] << 40 | b[j] << 16)
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))};")
            if i == len(a):
                return len(a), len(b), len(groups), links, "".join(groups)
            first_a, first_b = i, j
            end_a, end_b = end_a + len(size_a[a[i]]), end_b + len(size_b[b[j]])
        elif end_a < end_b:
            i += 1
            end_a += len(size_a[a[i]])
        else:
            j += 1
            end_b += len(size_b[b[j]])


class Aligner:
    """Alignments of units: (counts of tokens and groups in one number, links, text of groups)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = vocabulary(path_a, True), vocabulary(path_b, True)
        self.units = Remembered(self._learn)

    def _learn(self, some: list[str]) -> list[tuple[int, bytes, bytes] | None]:
        out: list[tuple[int, bytes, bytes] | None] = []
        for u, x, y in zip(some, self.a.encode(some), self.b.encode(some), strict=True):
            got = align(x, y, self.a, self.b, u)
            out.append(got and (got[0] | got[1] << 40 | got[2] << 80, np.array(got[3], "<u8").tobytes(), got[4].encode()))
        return out

    def of(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """The units' alignments of each text, with a blank before it; none for a text that either
        side doesn't give back byte by byte."""
        whole = self.a.whole or self.b.whole
        split = [[] if not t else [" " + t] if whole else self.a.units(" " + t) for t in texts]
        return [[] if None in found else found for found in self.units.of(split)]


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _blocks(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array of the values from each start to the next."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = _runs(key)
    return key[starts[:-1]], np.add.reduceat(count, starts[:-1]) if len(key) else count


_MADE = ("slice", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "bs", "ds", "ns")


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Three kinds of rows: documents (at), postings of a slice (a, bs, ds, ns), and the task's counts of
    pairs (a, bs, ns; no ds)."""
    aligner = _aligner(path_a, path_b)
    kinds = dict(zip(_MADE, (pa.int64(), pa.int32(), id_type, *[pa.int64()] * 4, pa.string(), pa.int32(), *[pa.binary()] * 3), strict=True))

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(_MADE))

    def counts() -> pa.RecordBatch:
        key, count = _added(keys, times)
        a = (key >> np.uint64(24)).astype(np.int32)
        starts = _runs(a)
        return rows(len(starts) - 1, slice=pa.array(np.full(len(starts) - 1, base)), a=pa.array(a[starts[:-1]]), bs=_blocks((key & _ID).astype("<u4"), starts), ns=_blocks(count.astype("<u8"), starts))

    base, number = TaskContext.get().partitionId() << 32, 0
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for part in slices(batches, SLICE_DOCS, SLICE_SIZE):
        found = aligner.of([t or "" for t in part.column("text").to_pylist()])
        totals = [sum(map(itemgetter(0), f)) for f in found]
        links = [np.frombuffer(b"".join(map(itemgetter(1), f)), "<u8") for f in found]
        digests = [hashlib.sha256(b"".join(map(itemgetter(2), f))[:-1]).hexdigest() if f else "" for f in found]
        long = [pa.array([t >> s & (1 << 40) - 1 for t in totals], pa.int64()) for s in (0, 40, 80)]
        n, here = len(found), base | number
        number += 1
        yield rows(n, slice=pa.array(np.full(n, here)), at=pa.array(np.arange(n, dtype=np.int32)), doc_id=part.column("doc_id").cast(id_type), n_a=long[0], n_b=long[1], n_groups=long[2], n_links=pa.array(list(map(len, links)), pa.int64()), groups_sha256=pa.array(digests))
        key = np.sort(np.concatenate([x | np.uint64(i) for i, x in enumerate(links)]))
        if not len(key):
            continue
        starts = _runs(key)
        once, n_times = key[starts[:-1]], np.diff(starts)
        a = (once >> _A).astype(np.int32)
        by = _runs(a)
        yield rows(len(by) - 1, slice=pa.array(np.full(len(by) - 1, here)), a=pa.array(a[by[:-1]]), bs=_blocks((once >> _B & _ID).astype("<u4"), by), ds=_blocks((once & np.uint64(0xFFFF)).astype("<u2"), by), ns=_blocks(n_times.astype("<u4"), by))
        pair = once >> _B
        starts = _runs(pair)
        keys.append(pair[starts[:-1]]), times.append(np.diff(starts))
        if sum(map(len, keys)) > 2 * PENDING:
            key, count = _added(keys, times)
            keys, times = [key], [count]
            if len(key) > PENDING:
                yield counts()
                keys, times = [], []
    if keys:
        yield counts()


def _lists(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and how many each row has."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data else np.empty(0, kind)
    return values, np.diff(ends) // values.itemsize


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts (a, bs, ns) of equal ids. The stream ascends by id; the last one waits for the next batch."""
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def out(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        a = (key >> np.uint64(24)).astype(np.int32)
        starts = _runs(a)
        return pa.RecordBatch.from_arrays([pa.array(a[starts[:-1]]), _blocks((key & _ID).astype("<u4"), starts), _blocks(count.astype("<u8"), starts)], ["a", "bs", "ns"])

    for batch in batches:
        b, sizes = _lists(batch.column("bs"), "<u4")
        keys.append(np.repeat(batch.column("a").to_numpy().astype(np.uint64), sizes) << np.uint64(24) | b)
        times.append(_lists(batch.column("ns"), "<u8")[0].astype(np.int64))
        key, count = _added(keys, times)
        done = int(np.searchsorted(key, key[-1] >> np.uint64(24) << np.uint64(24))) if len(key) else 0
        if done:
            yield out(key[:done], count[:done])
        keys, times = [key[done:]], [count[done:]]
    if keys and len(keys[0]):
        yield out(keys[0], times[0])


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slice and document (slice, ds, best, sums) of a stream in which the counts of an id
    (no slice) come before its postings."""
    held: dict[int, np.ndarray] = {}
    last_a, last_b, last_n = np.empty(0, np.uint64), np.empty(0, "<u4"), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        names = list(held)
        at = [np.flatnonzero(held[s][1]) for s in names]
        starts = np.append(0, np.cumsum(list(map(len, at))))
        best, sums = (np.concatenate([held[s][k][x] for s, x in zip(names, at, strict=True)]) for k in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _blocks(np.concatenate(at).astype("<u2"), starts), _blocks(best.astype("<i8"), starts), _blocks(sums.astype("<i8"), starts)], ["slice", "ds", "best", "sums"])

    for batch in batches:
        a = batch.column("a").to_numpy().astype(np.uint64)
        posting = batch.column("slice").is_valid().to_numpy(zero_copy_only=False)
        b, sizes = _lists(batch.column("bs"), "<u4")
        row = np.repeat(np.arange(len(a)), sizes)
        is_post = posting[row]
        # The counts of this batch, after those of the last id before it.
        n, n_sizes = _lists(batch.column("ns"), "<u8")
        known_a, known_b, known_n = np.append(last_a, a[row[~is_post]]), np.append(last_b, b[~is_post]), np.append(last_n, n.astype(np.int64))
        starts = _runs(known_a)
        keys = known_a << np.uint64(32) | known_b
        most = np.repeat(np.maximum.reduceat(known_n, starts[:-1]), np.diff(starts)) if len(keys) else known_n
        tail = starts[-2] if len(keys) else 0
        last_a, last_b, last_n = known_a[tail:], known_b[tail:], known_n[tail:]
        if not is_post.any():
            continue
        post = row[is_post]
        at = np.searchsorted(keys, a[post] << np.uint64(32) | b[is_post])
        count, top = known_n[at], known_n[at] == most[at]
        d, times = _lists(batch.column("ds"), "<u2")[0], _lists(batch.column("ms"), "<u4")[0].astype(np.int64)
        name, local = np.unique(batch.column("slice").fill_null(-1).to_numpy()[post], return_inverse=True)
        cell = local * SLICE_DOCS + d
        order = np.argsort(cell, kind="stable")
        cell, starts = cell[order], _runs(cell[order])
        best, sums = (np.add.reduceat(x[order], starts[:-1]) for x in (times * top, times * count))
        cell = cell[starts[:-1]]
        for i, s in enumerate(name.tolist()):
            lo, hi = np.searchsorted(cell, (i * SLICE_DOCS, (i + 1) * SLICE_DOCS))
            mine = held.setdefault(s, np.zeros((2, SLICE_DOCS), np.int64))
            mine[0, cell[lo:hi] - i * SLICE_DOCS] += best[lo:hi]
            mine[1, cell[lo:hi] - i * SLICE_DOCS] += sums[lo:hi]
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, at, n_best, count_sum) from sums by slice; a slice's rows follow each other."""
    now, total = None, np.zeros((2, SLICE_DOCS), np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(total[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["slice", "at", "n_best", "count_sum"])

    for batch in batches:
        for s, d, best, sums in zip(*(batch.column(c).to_pylist() for c in ("slice", "ds", "best", "sums")), strict=True):
            if s != now:
                if now is not None:
                    yield out()
                now = s
                total[:] = 0
            at = np.frombuffer(d, "<u2")
            total[0, at] += np.frombuffer(best, "<i8")
            total[1, at] += np.frombuffer(sums, "<i8")
    if now is not None:
        yield out()


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of
    `docs` (doc_id, text, any others), between a byte-level vocabulary and a piece vocabulary.

    `n_links` counts the pairs of token occurrences whose bytes overlap; the count of an id pair is how
    many rows hold it; `n_best` counts the links whose pair has its A id's highest count, ties
    included; `count_sum` sums counts over links. Null and empty texts, and such as a vocabulary
    doesn't give back byte by byte, have zeros and no digest. Very long texts are aligned whole.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    with Scratch():
        return _alignment(docs, path_a, path_b)


def _merge(counts: DataFrame) -> DataFrame:
    return cut(counts.sortWithinPartitions("a").select("a", "bs", "ns").mapInArrow(_merged, "a int, bs binary, ns binary"), "pairs")


def _alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    of = f"slice long, at int, doc_id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, bs binary, ds binary, ns binary"
    made = cut(docs.select("doc_id", "text").mapInArrow(partial(_aligned, path_a=path_a, path_b=path_b, id_type=to_arrow_type(id_type)), of), "aligned")
    counts = made.where("a is not null and ds is null").select("a", "bs", "ns", F.shiftrightunsigned("slice", 32).alias("task"))
    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks > FAN:  # first FAN tasks' counts each, so that no stream merges those of all tasks
        counts = _merge(counts.repartition(partitions, "a", F.floor(F.col("task") / FAN)))
    counts = _merge(counts.repartition(partitions, "a"))

    shares = max(1, -(-partitions // BUCKETS))
    bucket = F.pmod(F.xxhash64("a"), F.lit(BUCKETS)).cast("int") * shares
    postings = made.where("ds is not null").select("a", "slice", "bs", "ds", F.lit(None).cast("binary").alias("ns"), F.col("ns").alias("ms"), (bucket + F.pmod(F.xxhash64("slice"), F.lit(shares)).cast("int")).alias("to"))
    none = F.lit(None).cast("binary")
    known = counts.select("a", F.lit(None).cast("long").alias("slice"), "bs", none.alias("ds"), "ns", none.alias("ms"), F.explode(F.sequence(bucket, bucket + shares - 1)).alias("to"))
    # Nulls sort first: the counts of an id come before its postings.
    both = known.unionByName(postings).repartitionById(BUCKETS * shares, F.col("to")).sortWithinPartitions("a", F.asc_nulls_first("slice")).drop("to")
    found = both.mapInArrow(_rated, "slice long, ds binary, best binary, sums binary")
    sums = found.repartition(partitions, "slice").sortWithinPartitions("slice").mapInArrow(_summed, "slice long, at int, n_best long, count_sum long")
    rows = made.where("at is not null").select("slice", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    full = rows.join(sums, ["slice", "at"], "left")
    out = full.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
    return cut(out, "alignment", result=True)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
