"""Programs from files: directory scans and single paths.

Spark's `binaryFile` source hides names that begin with a dot or an underscore and drops empty
files, so mounted trees are listed and read by the executors, from a path they all see: folders
level by level, of files only the headers and the executable section. Stores that only
Spark reads go through `read_store`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext, suppress
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import cut
from .elf import FileBytes, LoadError, entry_offset, text_section

SCHEMA = "path string, text binary, entry_offset long, load_error string"
#: Paths a task reads; names of a folder that are sent on at a time.
PATHS_A_TASK, NAMES = 256, 4096
#: Bytes of sections that are sent on at a time; a longer one goes alone.
BYTES = 4_000_000
#: Fixed value: the id of a program whose file name can't be read as text.
UNKNOWN = "unknown"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What folders hold: (raw, is_folder) of regular files, links to such, and folders."""
    for batch in batches:
        for folder in batch.column("raw").to_pylist():
            found: list[tuple[bytes, bool]] = []
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            found.append((e.path, True))
                        elif e.is_file():
                            found.append((e.path, False))
            except OSError:
                pass
            for at in range(0, len(found), NAMES):
                part = found[at : at + NAMES]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.binary()), pa.array([d for _, d in part], pa.bool_())], ["raw", "is_folder"])


def listed_files(spark: SparkSession, directory: str) -> DataFrame:
    """(raw): paths of the regular files below `directory`, as the system spells them.

    Executors list it level by level, a table each: the driver holds no path but the first.
    Unreadable folders are passed over, links to folders aren't followed.
    """
    files = spark.createDataFrame([], "raw binary")
    folders = spark.createDataFrame([(bytearray(os.fsencode(directory)),)], "raw binary")
    while not folders.isEmpty():
        level = cut(folders.mapInArrow(_listed, "raw binary, is_folder boolean"), "listed")
        files = files.union(level.where("not is_folder").select("raw"))
        # Dealt out by name: a folder's folders stand together.
        folders = level.where("is_folder").select("raw").repartition(spark.sparkContext.defaultParallelism, "raw")
    return files


def _program(path: str, read) -> tuple[str, bytes | None, int | None, str | None]:
    try:
        with read(path) as data:
            return path, text_section(data), entry_offset(data), None
    except OSError as e:
        return path, None, None, f"io error: {e}"
    except LoadError as e:
        return path, None, None, str(e)


@contextmanager
def _opened(path: bytes) -> Iterator[FileBytes]:
    with open(path, "rb") as f:
        yield FileBytes(f.fileno())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "text", "entry_offset", "load_error"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for raw in batch.column("raw").to_pylist():
            rows.append(_program(raw.decode("utf-8", "replace"), lambda _, raw=raw: _opened(raw)))
            held += len(rows[-1][1] or b"")
            if held > BYTES:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield _rows([_program(path, lambda _, data=data: nullcontext(data))])


def load_paths(spark: SparkSession, paths: Sequence[str | bytes]) -> DataFrame:
    """(path, text, entry_offset, load_error) of files; a failure is a value, not an error. In a
    path that isn't UTF-8 the odd bytes are shown as U+FFFD."""
    tasks = max(1, -(-len(paths) // PATHS_A_TASK))
    listed = spark.createDataFrame([(bytearray(os.fsencode(p)),) for p in paths], "raw binary").repartition(tasks)
    return listed.mapInArrow(_read, SCHEMA)


def parse_images(images: DataFrame) -> DataFrame:
    """As `load_paths`, from rows that hold whole files (path, content, any others); null content
    is an empty file."""
    return images.select("path", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(_parsed, SCHEMA)


def _saved(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            where = os.path.join(folder, path)
            os.makedirs(os.path.dirname(where), exist_ok=True)
            with open(f"{where}.{os.getpid()}", "wb") as f:
                f.write(content or b"")
            os.replace(f.name, where)  # a task that is tried again leaves one whole file
        yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])


def save_images(images: DataFrame, folder: str) -> int:
    """Writes each row of `images` (path, content) as a file below `folder`, which driver and
    executors must share under that path; returns how many. Paths are expected to differ."""
    return images.select("path", "content").mapInArrow(partial(_saved, folder=folder), "path string").count()


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """As `load_paths`, of all files below a mounted folder, as a table: each file is read once."""
    found = cut(listed_files(spark, directory), "files")
    tasks = max(1, -(-found.count() // PATHS_A_TASK))
    return cut(found.repartition(tasks, "raw").mapInArrow(_read, SCHEMA), "programs")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("raw").to_pylist():
            with suppress(FileNotFoundError):  # by a task that was tried again
                os.unlink(raw)
        yield batch


def remove_files(spark: SparkSession, directory: str) -> int:
    """Removes all regular files below a mounted folder, on executors; returns how many. Folders stay."""
    found = cut(listed_files(spark, directory), "files")
    return found.repartition(max(1, -(-found.count() // NAMES)), "raw").mapInArrow(_removed, "raw binary").count()


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """As `scan_directory`, from any store that Spark reads; hidden and empty files are left out."""
    return parse_images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def strict(programs: DataFrame) -> DataFrame:
    """`programs`, failing the query at the first load error."""
    ok = F.when(F.col("load_error").isNull(), F.col("text")).otherwise(F.raise_error(F.col("load_error")).cast("binary"))
    return programs.withColumn("text", ok)


def default_id(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension. `unknown` if
    there is none or it isn't UTF-8."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.when((stem == "") | F.contains(stem, F.lit("\ufffd")), UNKNOWN).otherwise(stem)


def with_ids(programs: DataFrame, by_path: bool = False) -> DataFrame:
    """Adds program_id: the path itself or the default id."""
    return programs.withColumn("program_id", F.col("path") if by_path else default_id(F.col("path")))


def text_programs(rows: DataFrame, program_id: Column, text: Column) -> DataFrame:
    """Programs whose stream is the UTF-8 text of a column."""
    return rows.select(program_id.cast("string").alias("program_id"), F.encode(text, "UTF-8").alias("text"))
