"""Durable cuts of a plan: tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`.

    Only where it is unset and driver and executors are one process, a new local folder that
    goes with the process; on a cluster an unset folder is an error, as others can't see a local one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="slotmill-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        conf = _local["dir"]
    return conf.rstrip("/")


#: Rows, and bytes of them, that go to a Python worker at a time while a cut is written: rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, an action sends `rows` rows and about BATCH_BYTES to Python at a time, or
    fewer if the session says so; afterwards the session's own settings hold again. Actions
    that run meanwhile in other threads of the session get small batches, too: slower, not wrong."""
    least = {_ROWS: rows, _BYTES: BATCH_BYTES}
    was = {k: spark.conf.get(k) for k in least}
    for k, n in least.items():
        number = int(was[k].lower().removesuffix("b")) if was[k].lower().removesuffix("b").lstrip("-").isdigit() else n
        spark.conf.set(k, str(min(n, number) if number > 0 else n))
    try:
        yield
    finally:
        for k, x in was.items():
            spark.conf.set(k, x)


_open = threading.local()


def _scopes() -> list[Scratch]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def cut(df: DataFrame, name: str, rows: int = BATCH_ROWS, result: bool = False) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    This ends the lineage in a table that every executor sees, so a lost executor costs
    only its running tasks, and later reads get column pruning. `rows` go to a Python worker at
    a time. Within a `Scratch` the table goes at its end; a `result` outlives the innermost
    one, and belongs to the one around it, if any.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/slotmill-{name}-{uuid.uuid4().hex}"
    around = _scopes()[: -1 if result else None]
    if around:
        around[-1].paths.append((df.sparkSession, path))
    with small_batches(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `place`, 0, 1, ... by `order`, which should leave no ties. Rows are sorted in ranges, each
    numbered by itself, and what lies before a range is a sum over the few ranges."""
    _part, _at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns({"_slotmill_part": _part, "_slotmill_at": _at}), "numbered")
    sizes = rows.groupBy("_slotmill_part").agg(F.count("*").alias("n"))
    before = sizes.select("_slotmill_part", (F.sum("n").over(Window.orderBy("_slotmill_part")) - F.col("n")).alias("_slotmill_before"))
    placed = rows.join(F.broadcast(before), "_slotmill_part").withColumn("place", F.col("_slotmill_before") + F.col("_slotmill_at"))
    return placed.select(*df.columns, "place")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for tables, below the shared one. Within a `Scratch` it goes at its end."""
    path = f"{checkpoint_dir(spark)}/slotmill-{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].paths.append((spark, path))
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that driver and executors open by path: below the shared folder, which
    must be mounted under one path everywhere; in a store that isn't, that is an error. Within a
    `Scratch` it goes at its end."""
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", checkpoint_dir(spark))
    if scheme and scheme[1] != "file":
        raise ValueError(f"files that are opened by path need a mounted spark.checkpoint.dir, not one in {scheme[1]}:")
    path = f"{checkpoint_dir(spark)}/slotmill-{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].paths += [(spark, path), (spark, f"{path}-out")]
    return re.sub(r"^file:/*", "/", path)


class Scratch:
    """`with Scratch():` cuts made within it go at its end, also if something fails."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        _scopes().append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes().remove(self)
        self.drop()

    def drop(self) -> None:
        while self.paths:
            spark, path = self.paths.pop()
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Words of 64 bits in a prefilter at most: a few megabytes to broadcast, whatever the table.
FILTER_WORDS = 2**17


def maybe_in(df: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` in two parts: rows whose 64-bit `key` may be among `hashes` (hash), and rows whose
    key surely isn't.

    A bitmap of at most FILTER_WORDS words is broadcast. It decides nothing by itself: it only
    spares rows that surely don't meet a shuffle; full, it spares none.
    """
    n = hashes.count()
    words = min(FILTER_WORDS, 2 ** max(4, (n // 4).bit_length()))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(hash, 32), 64L) as int))")
    bits = hashes.where("hash is not null").groupBy(F.pmod("hash", F.lit(words)).alias("_slotmill_word")).agg(F.bit_or(bit).alias("_slotmill_bits"))
    probe = df.withColumn("_slotmill_key", F.coalesce(key, F.lit(0)))
    both = probe.join(F.broadcast(bits), F.pmod("_slotmill_key", F.lit(words)) == F.col("_slotmill_word"), "left")
    hit = F.expr("(shiftright(coalesce(_slotmill_bits, 0L), cast(pmod(shiftrightunsigned(_slotmill_key, 32), 64L) as int)) & 1L) = 1L")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return both.where(hit).select(*columns), both.where(~hit).select(*columns)


#: Bytes of files a core below which a table is dealt out anew.
SPREAD_BYTES = 4_000_000


def spread(df: DataFrame) -> DataFrame:
    """`df` (a plain scan) over all cores if its files are tiny, else as it is.

    A small file is one task however dear the work on its rows; dealing it out moves a few
    megabytes a core at most. Larger tables keep their scan's partitions: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < SPREAD_BYTES * cores else df


def _size(scan: DataFrame) -> int:
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(scan: DataFrame, size: int) -> int:
    """Tasks for dear work on a plain scan, `size` bytes of its files each; a task a core at least."""
    spark = scan.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_size(scan) // size))
