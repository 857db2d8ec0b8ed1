"""Banded locality-sensitive hashing of signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import fnv_words
from .catalog import scan
from .kernels import HASHES, NGRAM
from .similarity import estimate

DEFAULT_BANDS, CLI_BANDS = 16, 8
#: Query buckets up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class LshConfig:
    bands: int
    rows_per_band: int

    @classmethod
    def of(cls, length: int, bands: int = DEFAULT_BANDS) -> LshConfig:
        if bands <= 0 or length % bands:
            raise ValueError(f"signature length {length} must be divisible by bands {bands}")
        return cls(bands, length // bands)


def band_keys(signature: Column, config: LshConfig) -> Column:
    """array<struct<band,bucket_key>> of a signature."""
    r = config.rows_per_band

    def one(b: Column) -> Column:
        return F.struct(b.alias("band"), fnv_words(F.slice(signature, b * r + 1, r)).alias("bucket_key"))

    return F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), one)


def buckets(prints: DataFrame, config: LshConfig) -> DataFrame:
    """(program_id, band, bucket_key); signatures of another length are an error."""
    length = config.bands * config.rows_per_band
    sized = F.when(F.size("minhash") == length, F.col("minhash")).otherwise(F.raise_error(F.lit(f"signature length isn't {length}")).cast("array<bigint>"))
    return prints.select("program_id", F.inline(band_keys(sized, config)))


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, program_id, band, bucket_key): for every query each program that shares a
    bucket, with the lowest such band. `queries` has the columns of `index`."""
    q = queries.select(F.col("program_id").alias("query_id"), "band", "bucket_key")
    if q.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        q = F.broadcast(q)
    hits = index.join(q, ["band", "bucket_key"])
    low = hits.groupBy("query_id", "program_id").agg(F.min(F.struct("band", "bucket_key")).alias("m"))
    return low.select("query_id", "program_id", "m.band", "m.bucket_key")


def search(prints: DataFrame, queries: DataFrame, config: LshConfig, least: float = 0.0) -> DataFrame:
    """(query_id, program_id, score, band): candidates whose estimated Jaccard is `least` or
    more, best first. A program that is itself a query is found, too."""
    found = candidates(buckets(prints, config), buckets(queries, config))
    q = queries.select(F.col("program_id").alias("query_id"), F.col("minhash").alias("q"))
    scored = found.join(prints.select("program_id", "minhash"), "program_id").join(q, "query_id")
    scored = scored.select("query_id", "program_id", estimate(F.col("minhash"), F.col("q")).alias("score"), "band")
    return scored.where(F.col("score") >= least).orderBy("query_id", F.desc("score"), "program_id")


@dataclass(frozen=True)
class LshIndex:
    """Signatures (program_id, minhash) and their buckets under one configuration."""

    config: LshConfig
    signatures: DataFrame

    @classmethod
    def new(cls, spark: SparkSession, bands: int = DEFAULT_BANDS, k: int = HASHES) -> LshIndex:
        return cls(LshConfig.of(k, bands), spark.createDataFrame([], "program_id string, minhash array<long>"))

    @classmethod
    def of(cls, catalog: DataFrame, bands: int = DEFAULT_BANDS) -> LshIndex:
        """Of a catalog with unique ids; the length of its signatures is that of any entry, HASHES if there is none."""
        length = (catalog.select(F.size("minhash")).first() or [HASHES])[0]
        return cls(LshConfig.of(length, bands), catalog.select("program_id", "minhash"))

    def buckets(self) -> DataFrame:
        return buckets(self.signatures, self.config)

    def insert(self, prints: DataFrame) -> LshIndex:
        """With the rows of `prints` (unique ids) in place of those of their ids; no old bucket stays."""
        kept = self.signatures.join(prints, "program_id", "left_anti")
        return LshIndex(self.config, kept.unionByName(prints.select("program_id", "minhash")))

    def size(self) -> int:
        return self.signatures.count()

    def is_empty(self) -> bool:
        return self.signatures.isEmpty()


def index_directory(spark: SparkSession, directory: str, bands: int = DEFAULT_BANDS, n: int = NGRAM, k: int = HASHES, strict: bool = True) -> DataFrame:
    """`buckets` of all programs below a folder; `strict` as in a catalog's scan."""
    return buckets(scan(spark, directory, n, k, strict), LshConfig.of(k, bands))
