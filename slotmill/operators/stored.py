"""Catalogs, fingerprints and LSH indexes as tables in a folder that grow by snapshots.

A snapshot is a manifest: which folders of Parquet files hold the data. Data are written first,
under names no manifest has yet; then the manifest appears by one rename, which fails if
another writer was first. So readers see whole snapshots, a failed writer leaves only files that
nobody reads, and old snapshots stay readable until `forget`. The store must rename atomically,
as HDFS and mounted file systems do; two writers of one folder are told apart by its listing.

Neither the driver nor a task sees all entries: the driver handles bucket numbers and folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import cut
from . import catalog, lsh
from .fingerprint import fingerprints, normalized
from .kernels import HASHES, NGRAM
from .similarity import estimate

#: Buckets of ids, and parts of a band by the leading bits of its keys, that a new store has.
BUCKETS, PREFIXES = 64, 16


class Conflict(RuntimeError):
    """Another writer committed the snapshot first."""


class Folder:
    """Files of a folder in any store that Hadoop's FileSystem reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        where = self.path(self.root)
        return [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Writes a file that mustn't exist yet, so that it appears whole."""
        hidden, whole = self.path(f"{self.root}/_{uuid.uuid4().hex}"), self.path(f"{self.root}/{name}")
        stream = self.files.create(hidden)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.files.exists(whole) or not self.files.rename(hidden, whole):
            self.files.delete(hidden, False)
            raise Conflict(f"{self.root}/{name} exists")

    def delete(self, name: str) -> None:
        self.files.delete(self.path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Store:
    """One snapshot of a folder: its number and its manifest."""

    folder: Folder
    number: int = 0
    manifest: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, root: str, number: int | None = None) -> Store:
        """The last snapshot, or the one of that number."""
        folder = Folder(spark, root)
        have = sorted(int(n[9:-5]) for n in folder.names() if n.startswith("manifest-"))
        if not have or number is not None and number not in have:
            raise FileNotFoundError(f"no snapshot {'' if number is None else f'{number} '}in {root}")
        number = have[-1] if number is None else number
        return cls(folder, number, json.loads(folder.read(f"manifest-{number:010d}.json")))

    def next(self, manifest: dict) -> Store:
        number = self.number + 1
        self.folder.commit(f"manifest-{number:010d}.json", json.dumps(manifest))
        return Store(self.folder, number, manifest)

    def forget(self) -> None:
        """Drops older snapshots and what only they refer to. Their readers must be done."""
        used = set(json.dumps(self.manifest).split('"'))
        for name in self.folder.names():
            if name.startswith("manifest-") and int(name[9:-5]) < self.number or name.startswith("data-") and name not in used:
                self.folder.delete(name)


def bucket_of(program_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(program_id), F.lit(buckets)).cast("int")


def _new_data() -> str:
    return f"data-{uuid.uuid4().hex}"


class Buckets:
    """Rows with unique program ids, a folder of files for each bucket of ids.

    `parts` says which data folder holds a bucket now; a bucket without rows has none.
    """

    def __init__(self, folder: Folder, schema: str, buckets: int, parts: dict[str, str]) -> None:
        self.folder, self.schema, self.buckets, self.parts = folder, schema, buckets, parts

    def rows(self, some: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other file is opened."""
        paths = [f"{self.folder.root}/{data}/bucket={b}" for b, data in sorted(self.parts.items()) if some is None or int(b) in some]
        spark = self.folder.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """The rows of `ids` (program_id), from their buckets' files alone."""
        return self.rows(self.touched(ids)).join(ids, "program_id", "left_semi")

    def touched(self, ids: DataFrame) -> set[int]:
        """The buckets of some ids: at most as many numbers as there are buckets."""
        return {r[0] for r in ids.select(bucket_of(F.col("program_id"), self.buckets)).distinct().collect()}

    def written(self, rows: DataFrame, touched: set[int]) -> Buckets:
        """With `rows` in place of all rows of the buckets `touched`; other buckets keep their files."""
        data = _new_data()
        rows.withColumn("bucket", bucket_of(F.col("program_id"), self.buckets)).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.folder.root}/{data}")
        made = {n[7:] for n in Folder(self.folder.spark, f"{self.folder.root}/{data}").names() if n.startswith("bucket=")}
        parts = {b: d for b, d in self.parts.items() if int(b) not in touched} | dict.fromkeys(made, data)
        return Buckets(self.folder, self.schema, self.buckets, parts)


@dataclass(frozen=True)
class StoredCatalog:
    """A catalog in a folder, bucketed by id."""

    store: Store

    @classmethod
    def create(cls, rows: DataFrame, root: str, version: int = catalog.VERSION, buckets: int = BUCKETS) -> StoredCatalog:
        """Of catalog rows with unique ids (repeated ones are an error)."""
        folder = Folder(rows.sparkSession, root)
        made = Buckets(folder, catalog.SCHEMA, buckets, {}).written(catalog.unique(rows), set())
        return cls(Store(folder).next({"version": version, "buckets": buckets, "parts": made.parts}))

    @classmethod
    def open(cls, spark: SparkSession, root: str, snapshot: int | None = None) -> StoredCatalog:
        return cls(Store.open(spark, root, snapshot))

    @property
    def version(self) -> int:
        return self.store.manifest["version"]

    @property
    def entries(self) -> Buckets:
        m = self.store.manifest
        return Buckets(self.store.folder, catalog.SCHEMA, m["buckets"], m["parts"])

    def rows(self) -> DataFrame:
        return self.entries.rows()

    def find(self, program_id: str) -> DataFrame:
        """The entry of an id, from its bucket's files alone."""
        spark = self.store.folder.spark
        one = spark.range(1).select(F.lit(program_id).alias("program_id"))
        return self.entries.rows(self.entries.touched(one)).where(F.col("program_id") == program_id).limit(1)

    def merge(self, rows: DataFrame, order: str | None = None) -> StoredCatalog:
        """The next snapshot: `rows` replace entries of their ids, others are new. Of rows that repeat
        an id the last by `order` counts; without an order repeated ids are an error. Only
        buckets that `rows` touch are read and written."""
        columns = [c.strip().split(" ")[0] for c in catalog.SCHEMA.split(", ")]
        new = cut((catalog.upsert(rows, order) if order else catalog.unique(rows)).select(*columns), "incoming")
        touched = self.entries.touched(new)
        return self._next(self.entries.written(catalog.merge(self.entries.rows(touched), new), touched))

    def delete(self, ids: DataFrame) -> StoredCatalog:
        """The next snapshot, without the entries of `ids` (program_id)."""
        touched = self.entries.touched(ids)
        return self._next(self.entries.written(self.entries.rows(touched).join(ids, "program_id", "left_anti"), touched))

    def _next(self, entries: Buckets) -> StoredCatalog:
        return StoredCatalog(self.store.next(self.store.manifest | {"parts": entries.parts}))

    def size(self) -> int:
        return self.rows().count()


_PRINTS = "program_id string, ngram_count long, normalized_len long, minhash array<long>, simhash long, ngrams array<long>"


@dataclass(frozen=True)
class StoredPrints:
    """Fingerprints by content: one row for each different normalized (or raw) stream, under its SHA-256.

    Equal streams are hashed once, and streams of earlier calls not again. A folder belongs to
    one n-gram size, signature length and normalization.
    """

    store: Store

    @classmethod
    def create(cls, spark: SparkSession, root: str, n: int = NGRAM, k: int = HASHES, raw: bool = False, buckets: int = BUCKETS) -> StoredPrints:
        return cls(Store(Folder(spark, root)).next({"n": n, "k": k, "raw": raw, "buckets": buckets, "parts": {}}))

    @classmethod
    def open(cls, spark: SparkSession, root: str, snapshot: int | None = None) -> StoredPrints:
        return cls(Store.open(spark, root, snapshot))

    @property
    def prints(self) -> Buckets:
        m = self.store.manifest
        return Buckets(self.store.folder, _PRINTS, m["buckets"], m["parts"])

    def of(self, programs: DataFrame) -> tuple[DataFrame, StoredPrints]:
        """`fingerprints(programs)` (program_id, text), bit for bit, and the snapshot that knows all of
        their streams: the same one if it knew them before, and then nothing is hashed or written."""
        m = self.store.manifest
        plain = programs.select("program_id", "text") if m["raw"] else normalized(programs).select("program_id", F.col("normalized").alias("text"))
        streams = cut(plain.select("program_id", F.coalesce("text", F.lit(b"")).alias("text")).withColumn("content", F.sha2("text", 256)), "streams")
        contents = cut(streams.select(F.col("content").alias("program_id")).distinct(), "contents")
        touched = self.prints.touched(contents)
        known = self.prints.rows(touched)
        new = contents.join(known.select("program_id"), "program_id", "left_anti")
        after = self
        if not new.isEmpty():
            fresh = streams.join(new, F.col("content") == new["program_id"], "left_semi").groupBy("content").agg(F.first("text").alias("text"))
            made = cut(fingerprints(fresh.select(F.col("content").alias("program_id"), "text"), m["n"], m["k"], None, "keep"), "fresh")
            parts = self.prints.touched(made)
            after = StoredPrints(self.store.next(m | {"parts": self.prints.written(self.prints.rows(parts).unionByName(made), parts).parts}))
        rows = after.prints.rows(touched).where("ngram_count > 0").withColumnRenamed("program_id", "content")
        return streams.select("program_id", "content").join(rows, "content").select("program_id", "ngram_count", "normalized_len", "minhash", "simhash", "ngrams"), after


_SIGNATURES = "program_id string, minhash array<long>"
_ENTRIES = "program_id string, bucket_key long, band int, prefix int"


@dataclass(frozen=True)
class StoredIndex:
    """An LSH index in a folder.

    Bucket entries lie by band and by leading bits of their key, one data folder an insert;
    `gone` names ids whose earlier entries don't count any more. Signatures lie in buckets of
    ids. A lookup reads the parts of bands that its keys fall in, and the signatures' buckets of
    its candidates.
    """

    store: Store

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: lsh.LshConfig, buckets: int = BUCKETS) -> StoredIndex:
        m = {"bands": config.bands, "rows": config.rows_per_band, "buckets": buckets, "parts": {}, "inserts": [], "gone": []}
        return cls(Store(Folder(spark, root)).next(m))

    @classmethod
    def open(cls, spark: SparkSession, root: str, snapshot: int | None = None) -> StoredIndex:
        return cls(Store.open(spark, root, snapshot))

    @property
    def config(self) -> lsh.LshConfig:
        return lsh.LshConfig(self.store.manifest["bands"], self.store.manifest["rows"])

    @property
    def signatures(self) -> Buckets:
        m = self.store.manifest
        return Buckets(self.store.folder, _SIGNATURES, m["buckets"], m["parts"])

    def insert(self, prints: DataFrame) -> StoredIndex:
        """The next snapshot: with the rows of `prints` (program_id, minhash; unique ids) in place of
        those of their ids. Writes their entries and the buckets of signatures they touch."""
        new = cut(catalog.unique(prints.select("program_id", "minhash")), "incoming")
        keys = lsh.buckets(new, self.config).withColumn("prefix", _prefix(F.col("bucket_key")))
        data = _new_data()
        keys.repartition("band", "prefix").write.partitionBy("band", "prefix").parquet(f"{self.store.folder.root}/{data}")
        touched = self.signatures.touched(new)
        old = self.signatures.rows(touched)
        again = old.join(new, "program_id", "left_semi").select("program_id")
        kept = self.signatures.written(old.join(new, "program_id", "left_anti").unionByName(new), touched)
        m = self.store.manifest
        inserts = [*m["inserts"], [self.store.number + 1, data]]
        return StoredIndex(self.store.next(m | {"parts": kept.parts, "inserts": inserts, "gone": self._gone(again)}))

    def delete(self, ids: DataFrame) -> StoredIndex:
        """The next snapshot, without the programs of `ids` (program_id)."""
        ids = cut(ids.select("program_id").distinct(), "deleted")
        touched = self.signatures.touched(ids)
        kept = self.signatures.written(self.signatures.rows(touched).join(ids, "program_id", "left_anti"), touched)
        return StoredIndex(self.store.next(self.store.manifest | {"parts": kept.parts, "gone": self._gone(ids)}))

    def _gone(self, ids: DataFrame) -> list:
        data = _new_data()
        ids.write.parquet(f"{self.store.folder.root}/{data}")
        return [*self.store.manifest["gone"], [self.store.number + 1, data]]

    def _written(self, kind: str, schema: str, some: Column) -> DataFrame:
        """The rows of inserts or tombstones, with the snapshot `at` which they were written."""
        spark = self.store.folder.spark
        out = spark.createDataFrame([], f"{schema}, at int")
        for number, data in self.store.manifest[kind]:
            path = f"{self.store.folder.root}/{data}"
            out = out.unionByName(spark.read.schema(schema).parquet(path).where(some).withColumn("at", F.lit(number)))
        return out

    def entries(self, parts: list[tuple[int, int]] | None = None) -> DataFrame:
        """(program_id, band, bucket_key) that count now, of all parts or of some (band, prefix)."""
        some = F.lit(True)
        if parts is not None:
            some = F.lit(False)
            for band in sorted({b for b, _ in parts}):
                some = some | ((F.col("band") == band) & F.col("prefix").isin([p for b, p in parts if b == band]))
        live = self._written("inserts", _ENTRIES, some)
        gone = self._written("gone", "program_id string", F.lit(True)).groupBy("program_id").agg(F.max("at").alias("until"))
        return live.join(gone, "program_id", "left").where(F.col("until").isNull() | (F.col("at") >= F.col("until"))).select("program_id", "band", "bucket_key")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, program_id, band, bucket_key) for `queries` (program_id, minhash), as `lsh.candidates`."""
        asked = cut(lsh.buckets(queries, self.config), "asked")
        parts = [tuple(r) for r in asked.select("band", _prefix(F.col("bucket_key"))).distinct().collect()]  # bands x PREFIXES at most
        return lsh.candidates(self.entries(parts), asked)

    def search(self, queries: DataFrame, least: float = 0.0) -> DataFrame:
        """(query_id, program_id, score, band): candidates whose estimate is `least` or more, best first."""
        found = cut(self.candidates(queries), "candidates")
        near = self.signatures.of_ids(found.select("program_id").distinct())
        q = queries.select(F.col("program_id").alias("query_id"), F.col("minhash").alias("q"))
        scored = found.join(near, "program_id").join(q, "query_id").select("query_id", "program_id", estimate(F.col("minhash"), F.col("q")).alias("score"), "band")
        return scored.where(F.col("score") >= least).orderBy("query_id", F.desc("score"), "program_id")

    def compact(self) -> StoredIndex:
        """The next snapshot: the same entries in one data folder, without tombstones."""
        data = _new_data()
        self.entries().withColumn("prefix", _prefix(F.col("bucket_key"))).repartition("band", "prefix").write.partitionBy("band", "prefix").parquet(f"{self.store.folder.root}/{data}")
        return StoredIndex(self.store.next(self.store.manifest | {"inserts": [[self.store.number + 1, data]], "gone": []}))

    def size(self) -> int:
        return self.signatures.rows().count()


def _prefix(bucket_key: Column) -> Column:
    """The part of a band that a key belongs to: its leading bits."""
    return F.shiftrightunsigned(bucket_key, 64 - (PREFIXES - 1).bit_length()).cast("int")
