"""From byte streams to slots, normalized streams, features and sketches.

Every operator takes `programs` (program_id STRING, text BINARY, any others). The work on one
stream is local to its row: no operator here shuffles. Null streams count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut, tasks_for
from .kernels import HASHES, NGRAM, NormalizeConfig, check_n, minhashes, ngrams, normalize, simhashes

DEFAULT = NormalizeConfig()
NO_NGRAMS = "no opcode n-grams extracted from bytecode"
#: Rows, and bytes of streams, unpacked at a time; a longer stream goes alone.
ROWS, BYTES = 64, 4_000_000


def slots(programs: DataFrame) -> DataFrame:
    """(program_id, i, opcode, dst, src, token): one row a whole slot, on the JVM alone."""
    some = programs.select("program_id", "text", F.floor(F.octet_length("text") / 8).cast("int").alias("n")).where("n > 0")
    # Only the two bytes that matter of each slot are listed, never the stream beside each.
    heads = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("text"), i * 8 + 1, 2))
    each = some.select("program_id", F.posexplode(heads).alias("i", "head")).select("program_id", "i", F.hex("head").alias("s"))

    def digit(at: int) -> Column:
        return F.instr(F.lit("0123456789ABCDEF"), F.substring("s", at, 1)) - 1

    out = each.select("program_id", "i", (digit(1) * 16 + digit(2)).alias("opcode"), digit(4).alias("dst"), digit(3).alias("src"))
    return out.withColumn("token", F.shiftleft("opcode", 16).bitwiseOR(F.shiftleft("dst", 8)).bitwiseOR(F.col("src")))


def ngram_total(programs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(program_id, n_grams): n-grams with repetitions."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return programs.select("program_id", F.greatest(F.lit(0), F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 8) - (n - 1)).cast("long").alias("n_grams"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts: list[bytes] = []
        start = held = 0
        for i, text in enumerate(batch.column("text")):
            raw = text.as_py() or b""
            if texts and (len(texts) == ROWS or held + len(raw) > BYTES):
                yield batch.slice(start, len(texts)), texts
                start, held, texts = i, 0, []
            texts.append(raw)
            held += len(raw)
        if texts:
            yield batch.slice(start), texts


_REMAP = pa.list_(pa.struct([("old", pa.int32()), ("new", pa.int32())]))


def _normalized(batches: Iterator[pa.RecordBatch], config: NormalizeConfig) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        done = [normalize(t, config) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("program_id"),
                pa.array([d.original_len for d in done], pa.int64()),
                pa.array([d.normalized for d in done], pa.binary()),
                pa.array([d.removed_instructions for d in done], pa.int64()),
                pa.array([[{"old": a, "new": b} for a, b in d.register_remap] for d in done], _REMAP),
                pa.array([d.compression_ratio for d in done], pa.float64()),
            ],
            ["program_id", "original_len", "normalized", "removed_instructions", "register_remap", "compression_ratio"],
        )


def normalized(programs: DataFrame, config: NormalizeConfig = DEFAULT) -> DataFrame:
    """Normalized streams with what was changed."""
    of = "program_id string, original_len long, normalized binary, removed_instructions long, register_remap array<struct<old:int,new:int>>, compression_ratio double"
    return programs.select("program_id", "text").mapInArrow(partial(_normalized, config=config), of)


def _features(text: bytes, n: int, config: NormalizeConfig | None) -> tuple[np.ndarray, int]:
    if config:
        text = normalize(text, config).normalized
    return ngrams(text, n), len(text)


def _grams(batches: Iterator[pa.RecordBatch], n: int, config: NormalizeConfig | None) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        sets = [_features(t, n, config)[0].view(np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("program_id"), pa.array(sets, pa.list_(pa.int64()))], ["program_id", "ngrams"])


def feature_sets(programs: DataFrame, n: int = NGRAM, config: NormalizeConfig | None = DEFAULT) -> DataFrame:
    """(program_id, ngrams): distinct n-grams as BIGINT bits; `config` None takes raw streams."""
    check_n(n)
    return programs.select("program_id", "text").mapInArrow(partial(_grams, n=n, config=config), "program_id string, ngrams array<long>")


def features(programs: DataFrame, n: int = NGRAM, config: NormalizeConfig | None = DEFAULT) -> DataFrame:
    """(program_id, feature) in long form; streams without n-grams have no row."""
    return feature_sets(programs, n, config).select("program_id", F.explode("ngrams").alias("feature"))


def _sketched(batches: Iterator[pa.RecordBatch], n: int, k: int, config: NormalizeConfig | None) -> Iterator[pa.RecordBatch]:
    for part, texts in _texts(batches):
        sets, sizes = zip(*(_features(t, n, config) for t in texts), strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("program_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(list(minhashes(list(sets), k).view(np.int64)), pa.list_(pa.int64())),
                pa.array(simhashes(list(sets)).view(np.int64)),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ],
            ["program_id", "ngram_count", "normalized_len", "minhash", "simhash", "ngrams"],
        )


def fingerprints(programs: DataFrame, n: int = NGRAM, k: int = HASHES, config: NormalizeConfig | None = DEFAULT, empty: str = "skip") -> DataFrame:
    """(program_id, ngram_count, normalized_len, minhash, simhash, ngrams).

    Streams without n-grams are skipped, kept (`empty="keep"`, a signature of all ones), or
    fail the query (`empty="error"`).
    """
    check_n(n)
    if k < 0:
        raise ValueError("a signature has 0 hashes at least")
    of = "program_id string, ngram_count long, normalized_len long, minhash array<long>, simhash long, ngrams array<long>"
    out = programs.select("program_id", "text").mapInArrow(partial(_sketched, n=n, k=k, config=config), of)
    if empty == "keep":
        return out
    if empty == "error":
        checked = F.when(F.col("ngram_count") > 0, F.col("ngram_count")).otherwise(F.raise_error(F.lit(NO_NGRAMS)).cast("long"))
        return out.withColumn("ngram_count", checked)
    return out.where("ngram_count > 0")


#: Bytes of streams (as stored, compressed) a task sketches: seconds of work, so that no task is long.
TASK_BYTES = 1_000_000
#: Bytes of a stream by which it is dealt out.
HEAD = 64


def fingerprints_once(programs: DataFrame, n: int = NGRAM, k: int = HASHES, config: NormalizeConfig | None = DEFAULT, empty: str = "skip") -> DataFrame:
    """As `fingerprints`, with equal streams hashed once, and features once that streams of like
    beginnings share: streams meet by their SHA-256 in a table, whose rows are sorted by content. Hashing
    takes far longer than moving a stream; `programs` is read twice."""
    named = programs.select("program_id", F.coalesce("text", F.lit(b"")).alias("text")).withColumn("content", F.sha2("text", 256))
    streams = cut(named.groupBy("content").agg(F.first("text").alias("text")), "streams")
    # Dealt out by the first bytes, then anyhow: streams that begin alike go together, but a beginning that
    # very many have is no single task. Tasks by the work: adaptive execution would count bytes, which are few.
    tasks = tasks_for(streams, TASK_BYTES)
    dealt = streams.repartitionByRange(tasks, F.substring("text", 1, HEAD), F.xxhash64("content")).sortWithinPartitions("text")
    rows = fingerprints(dealt.select(F.col("content").alias("program_id"), "text"), n, k, config, empty).withColumnRenamed("program_id", "content")
    # By a merge: sizes are guessed from the few bytes of the input, and signatures are no broadcast.
    return named.select("program_id", "content").join(rows.hint("merge"), "content").select("program_id", "ngram_count", "normalized_len", "minhash", "simhash", "ngrams")


def rejections(programs: DataFrame, n: int = NGRAM, config: NormalizeConfig | None = DEFAULT) -> DataFrame:
    """(program_id, error) of the streams that `fingerprints` fails on with `empty="error"`."""
    return feature_sets(programs, n, config).where(F.size("ngrams") == 0).select("program_id", F.lit(NO_NGRAMS).alias("error"))


def looked_up(remap: Column, register: Column) -> Column:
    """The new number of a register in `normalized`'s register_remap; itself if it has none."""
    return F.coalesce(F.get(F.filter(remap, lambda r: r["old"] == register), 0)["new"], register)
