"""What the corpus operators share: tables, folds, word hashing, shingles."""

from __future__ import annotations

import ctypes
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components as components
from ..plans.durable import Scratch as Scratch
from ..plans.durable import cut as cut
from ..plans.durable import maybe_in as maybe_in
from ..plans.durable import small_batches as small_batches
from ..plans.durable import spread

#: Distinct words a worker remembers before it starts afresh; only memory depends on it.
WORD_CACHE = 200_000
#: Rows of an Arrow batch, and bytes of them, that are unpacked to Python objects at a time; a
#: longer row goes alone.
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000

WORDS = re.compile(r"\w+").findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(0))


def crc_fold_of(doc_id: int | None, folds: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


class WordIds(dict):
    """Maps a word to its 64-bit hash, computed once while it stays remembered."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words; a shorter, non-empty text is one run."""
    if not len(ids):
        return ids
    width = min(width, len(ids))
    n = len(ids) - width + 1
    out = ids[:n].copy()
    for k in range(1, width):
        out = mix(out * _MULT + ids[k : k + n])
    return mix(out + np.uint64(width))


def _bounds(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of the slices of a batch."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns if batch.num_rows else ():
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += np.diff(np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + batch.num_rows + 1])
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (i - start >= rows or held + n > most):
            yield start, i - start
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield start, batch.num_rows - start


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes. A worker gives
    freed memory back when its task's batches end: it may wait long for its next task."""
    for batch in batches:
        for start, n in _bounds(batch, rows, size):
            yield batch.slice(start, n)
    give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_TOP = 2**63 - 1


def sample(rows: DataFrame, n: int, total: int, seed: int, *columns: str) -> DataFrame:
    """At most `n` of the `total` rows of `rows`: those least by a hash of `columns`.

    All of them if there are no more. Only hashes are ranked, those of a share that is expected
    to be a fifth larger than `n` (by 63 bits, so that no table is too large); then rows are taken
    up to the n-th hash where they lie, so that texts of any length meet in no task. The bound
    holds whatever repeats: of rows alike in all columns as many are taken as it lets.
    """
    at = F.xxhash64(*columns, F.lit(seed)).bitwiseAND(F.lit(_TOP))
    if total <= n:
        return rows
    share = (1.2 * n + 50) / total
    some = rows.where(at < F.lit(int(share * _TOP))) if share < 1 else rows
    least = [r[0] for r in some.select(at.alias("at")).orderBy("at").limit(n + 1).collect()]
    if len(least) <= n:
        return some
    last, beyond = least[n - 1 :]
    if last < beyond:
        return some.where(at <= F.lit(last))
    return some.where(at < F.lit(last)).union(some.where(at == F.lit(last)).limit(least[:n].count(last)))
