"""The fingerprint catalog: rows of fingerprints, kept in a folder (`stored`) or exchanged as JSON.

Columns: program_id, source_path, ngram_count, normalized_len, simhash, minhash, ngram_sample
(the full n-gram set). Ids are unique after `upsert`.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import from_decimal, to_decimal
from ..plans.durable import Scratch, cut
from ..sources.files import load_paths, scan_directory, with_ids
from ..sources.files import strict as load_checked
from .fingerprint import fingerprints, fingerprints_once
from .kernels import HASHES, NGRAM, NormalizeConfig

VERSION = 1
SCHEMA = "program_id string, source_path string, ngram_count long, normalized_len long, simhash long, minhash array<long>, ngram_sample array<long>"
_JSON = (
    "version int, entries array<struct<program_id:string,source_path:string,ngram_count:bigint,simhash:decimal(20,0),"
    "minhash:array<decimal(20,0)>,ngram_sample:array<decimal(20,0)>,normalized_len:bigint>>"
)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def upsert(rows: DataFrame, order: str) -> DataFrame:
    """One row an id: the one with the largest `order`. Ids with many rows combine first."""
    rest = [c for c in rows.columns if c not in ("program_id", order)]
    last = rows.groupBy("program_id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.max(order).alias(order))
    return last.select("program_id", order, *(F.col(f"r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def unique(rows: DataFrame) -> DataFrame:
    """`rows`, whose ids must differ: one that repeats is an error."""
    rest = [c for c in rows.columns if c != "program_id"]
    one = rows.groupBy("program_id").agg(F.first(F.struct(*rest)).alias("r"), F.count("*").alias("n"))
    checked = F.when(F.col("n") == 1, F.col("program_id")).otherwise(F.raise_error(F.concat(F.lit("a catalog repeats "), "program_id")).cast("string"))
    return one.select(checked.alias("program_id"), *(F.col(f"r.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def merge(primary: DataFrame, secondary: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of both, one an id: the secondary's where both have it, of several the last.

    `order` is a number column of both; in catalogs without one, a repeated id is an error.
    In the result it keeps the primary's order, new ids after it by their first place in the
    secondary. A primary that repeats an id is an error.
    """
    if order is None:
        secondary = unique(secondary)
        return unique(primary).join(secondary, "program_id", "left_anti").unionByName(secondary)
    last = upsert(secondary, order)
    first = secondary.groupBy("program_id").agg(F.min(order).alias("_slotmill_first"))
    old = primary.groupBy("program_id").agg(F.max(order).alias("_slotmill_old"), F.count("*").alias("_slotmill_times"))
    checked = F.when(F.col("_slotmill_times") == 1, F.col("_slotmill_old")).otherwise(F.raise_error(F.concat(F.lit("the primary catalog repeats "), "program_id")).cast("long"))
    old = old.select("program_id", checked.alias("_slotmill_old"))
    end = primary.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_slotmill_end"))  # one row
    new = last.join(first, "program_id").join(old, "program_id", "left").join(F.broadcast(end), F.lit(True))
    place = F.coalesce("_slotmill_old", F.col("_slotmill_end") + 1 + F.col("_slotmill_first")).alias(order)
    kept = primary.join(secondary, "program_id", "left_anti").join(old, "program_id").withColumn(order, F.col("_slotmill_old"))
    return kept.select(*primary.columns).unionByName(new.select(*(place if c == order else c for c in primary.columns)))


def find(catalog: DataFrame, program_id: str) -> DataFrame:
    return catalog.where(F.col("program_id") == program_id).limit(1)


#: Fixed value: what is said of a program without any n-gram, before its path.
NO_ENTRY = "no ngrams extracted from "


def file_entries(programs: DataFrame, n: int = NGRAM, k: int = HASHES) -> DataFrame:
    """A row for each of `programs` (program_id, path, text, load_error; ids may repeat): its catalog
    entry, or null columns and the error that keeps it from having one."""
    rows = programs.select("program_id", "path", "text", "load_error", F.struct("program_id", "path").alias("at"))
    loads = rows.where("load_error is null").select(F.to_json("at").alias("program_id"), "text")
    prints = fingerprints_once(loads, n, k, NormalizeConfig(), "keep").withColumnRenamed("program_id", "name")
    # By a merge: the plan takes signatures for as small as the paths, and would send them all through the driver.
    both = rows.drop("text").withColumn("name", F.to_json("at")).join(prints.hint("merge"), "name", "left")
    error = F.coalesce("load_error", F.when(F.col("ngram_count") == 0, F.concat(F.lit(NO_ENTRY), "path")))
    columns = {"ngram_count": "ngram_count", "normalized_len": "normalized_len", "simhash": "simhash", "minhash": "minhash", "ngram_sample": "ngrams"}
    full = both.withColumn("error", error)
    return full.select("program_id", F.col("path").alias("source_path"), *(F.when(F.col("error").isNull(), F.col(c)).alias(x) for x, c in columns.items()), "error")


def of_programs(programs: DataFrame, n: int = NGRAM, k: int = HASHES, strict: bool = True) -> DataFrame:
    """Catalog rows of `programs` (path, text, load_error); later paths win an id.

    Programs that don't load are left out. One that loads without any n-gram fails the
    query if `strict`, else it is left out, too.
    """
    good = upsert(with_ids(programs.where("load_error is null")).select("program_id", "path", "text"), "path")
    prints = fingerprints_once(good, n, k, NormalizeConfig(), "keep" if strict else "skip")
    full = prints.hint("merge").join(good.select("program_id", F.col("path").alias("source_path")), "program_id")
    checked = F.when(F.col("ngram_count") > 0, F.col("ngram_count")).otherwise(F.raise_error(F.concat(F.lit(NO_ENTRY), "source_path")).cast("long"))
    return full.select("program_id", "source_path", checked.alias("ngram_count"), "normalized_len", "simhash", "minhash", F.col("ngrams").alias("ngram_sample"))


def scan(spark: SparkSession, directory: str, n: int = NGRAM, k: int = HASHES, strict: bool = True) -> DataFrame:
    """Catalog rows of all programs below a folder. If `strict`, programs without n-grams abort the
    scan; the error names the first of them by path."""
    programs = scan_directory(spark, directory)
    if strict:
        counts = fingerprints(with_ids(programs.where("load_error is null"), by_path=True), n, 0, empty="keep")
        bare = counts.where("ngram_count = 0").agg(F.min("program_id")).first()[0]
        if bare is not None:
            raise ValueError(NO_ENTRY + bare)
    return of_programs(programs, n, k, strict)


def entry_of_file(spark: SparkSession, path: str, program_id: str | None = None, n: int = NGRAM, k: int = HASHES) -> DataFrame:
    """The catalog row of one file, under its default id or the one given; failures are errors."""
    row = of_programs(load_checked(load_paths(spark, [path])), n, k)
    return row.withColumn("program_id", F.lit(program_id)) if program_id else row


#: What parts two entries of the pretty form.
_BETWEEN = "\n    },\n    {"


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries of one catalog object; missing fields are an error, the version isn't judged.

    An object in the pretty form that catalogs are saved in is read in splits, entry by entry: a
    file of any size, or a folder of parts of it by `save_parts`. Any other layout is read as a whole.
    """
    rows = _pretty(spark, path) if _head(spark, path) else _object(spark, path).select(F.inline("entries"))
    full = [F.col(c).isNotNull() for c in rows.columns]
    ok = full[0]
    for c in full[1:]:
        ok = ok & c
    checked = F.when(ok, F.col("program_id")).otherwise(F.raise_error(F.lit("a catalog entry lacks a field")).cast("string"))
    many = lambda c: F.transform(c, from_decimal)
    return rows.select(
        checked.alias("program_id"), "source_path", "ngram_count", "normalized_len", from_decimal(F.col("simhash")).alias("simhash"), many("minhash").alias("minhash"), many("ngram_sample").alias("ngram_sample")
    )


def _head(spark: SparkSession, path: str) -> str | None:
    """The version that a catalog in the pretty form begins with; None for any other file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.isDirectory(where):
        parts = sorted(s.getPath().toString() for s in files.listStatus(where) if s.getPath().getName().startswith("part-"))
        if not parts:
            return None
        path = parts[0]
    lines = [r[0] for r in spark.read.text(path).select(F.substring("value", 1, 80)).head(3)]
    version = re.fullmatch(r' *"version": (\d+),', lines[1]) if len(lines) == 3 else None
    return version[1] if version and lines[0] == "{" and lines[2].startswith('  "entries": [') else None


def _pretty(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the pretty form: the text between two of them has a raw line break, which no JSON
    string has, so a file can be read from any of them on."""
    # Step by step in an array of one: as columns, a filter's text would be worked out anew for each mention of it. Only the text
    # at a part's ends has an object's or the list's brackets: a search through every entry takes longer than its parse.
    steps = (
        lambda v: F.btrim(v, F.lit(" \t\r\n,")),
        lambda v: F.when(F.startswith(v, F.lit("{")), F.substring(v, F.lit(2), F.length(v))).otherwise(v),
        lambda v: F.when(F.endswith(v, F.lit("}")), F.regexp_replace(v, r"\}?(\s*\]\s*\})?$", "")).otherwise(v),
        lambda v: F.when(F.startswith(v, F.lit("]")), F.regexp_replace(v, r"^\]\s*$", "")).otherwise(v),
        lambda v: F.btrim(v, F.lit(" \t\r\n")),
    )
    texts = F.array(F.substring_index("value", '"entries": [', -1))
    for step in steps:
        texts = F.transform(texts, step)
    some = spark.read.text(path, lineSep=_BETWEEN).select(F.explode(F.filter(texts, lambda v: v != "")).alias("v"))
    entry = spark.read.schema(_JSON).json(spark.sparkContext.emptyRDD()).schema["entries"].dataType.elementType
    return some.select(F.from_json(F.concat(F.lit("{"), "v", F.lit("}")), entry, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def _object(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)


def save_parts(catalog: DataFrame, folder: str, version: int = VERSION) -> None:
    """Writes a folder of text parts that in order make up one pretty JSON object, byte for byte what
    `save_json` writes. Entries are sorted and written by Spark: none passes the driver. Ids must differ.
    `catalog` is read more than once: pass a table, or a cut of dear fingerprints."""
    # Decimals only where the sign bit is set: few values have it.
    number = lambda x: F.when(x >= 0, x.cast("string")).otherwise(to_decimal(x).cast("string"))
    wide = lambda c: F.concat(F.lit("[\n        "), F.array_join(F.transform(c, number), ",\n        "), F.lit("\n      ]"))
    many = lambda c: F.when(F.size(c) > 0, wide(c)).otherwise(F.lit("[]"))
    text = lambda c: F.substring(F.to_json(F.struct(F.col(c).alias("x"))), F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    plain = lambda c: F.col(c).cast("string")
    values = {
        "program_id": text("program_id"), "source_path": text("source_path"), "ngram_count": plain("ngram_count"), "simhash": number(F.col("simhash")),
        "minhash": many("minhash"), "ngram_sample": many("ngram_sample"), "normalized_len": plain("normalized_len"),
    }
    body = F.concat_ws(",\n", *(F.concat(F.lit(f'      "{k}": '), v) for k, v in values.items()))
    place = F.struct("source_path", "program_id")
    last = catalog.agg(F.max(place).alias("last"))  # one row
    rows = catalog.join(F.broadcast(last), F.lit(True)).select(F.lit(1).alias("kind"), (place == F.col("last")).alias("is_last"), *values)
    ends = catalog.sparkSession.createDataFrame([(0, "", ""), (2, "", "")], "kind int, source_path string, program_id string")
    # Rows are sorted as numbers, and printed where they stand: a sort samples what it is given, and texts are several times as large.
    placed = rows.unionByName(ends, allowMissingColumns=True).orderBy("kind", "source_path", "program_id")
    entry = F.concat(F.lit("    {\n"), body, F.when(F.col("is_last"), "\n    }").otherwise("\n    },"))
    head, tail = f'{{\n  "version": {version},\n  "entries": [', "  ]\n}"
    placed.select(F.when(F.col("kind") == 0, head).when(F.col("kind") == 2, tail).otherwise(entry).alias("value")).write.text(folder)


def save_json(catalog: DataFrame, path: str, version: int = VERSION) -> int:
    """Writes one pretty JSON object through the driver, row by row; returns the entries.

    For exchange of catalogs that fit in a local file; `save_parts` writes larger ones in parts.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with Scratch(), open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "version": {version},\n  "entries": [')
        # A sort samples its rows first: a table, else dear rows were made twice.
        for r in cut(catalog, "entries").orderBy("source_path").toLocalIterator():
            u = lambda x: x % 2**64
            entry = {"program_id": r.program_id, "source_path": r.source_path, "ngram_count": r.ngram_count, "simhash": u(r.simhash)}
            entry |= {"minhash": [u(x) for x in r.minhash], "ngram_sample": [u(x) for x in r.ngram_sample], "normalized_len": r.normalized_len}
            f.write(("," if n else "") + "\n    " + json.dumps(entry, indent=2, ensure_ascii=False).replace("\n", "\n    "))
            n += 1
        f.write("\n  ]\n}\n")
    return n


@dataclass(frozen=True)
class Catalog:
    """Entries and the version of their format, as they stand in one file."""

    rows: DataFrame
    version: int = VERSION

    @classmethod
    def new(cls, spark: SparkSession) -> Catalog:
        return cls(empty(spark))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        version = _head(spark, path)
        if version is None:
            found = _object(spark, path).select("version").first()
            if found is None or found[0] is None:
                raise ValueError("a catalog lacks its version")
            version = found[0]
        return cls(load_json(spark, path), int(version))

    def save(self, path: str) -> int:
        return save_json(self.rows, path, self.version)

    def merged(self, other: Catalog, order: str | None = None) -> Catalog:
        """With the entries of `other`, under the version of this one."""
        return Catalog(merge(self.rows, other.rows, order), self.version)

    def size(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()
