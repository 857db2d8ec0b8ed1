"""Queries over program files: the driver's conversations, saved as ELF files in a scratch folder.

A turn becomes two files: its text as an executable section (every fifth conversation: the bare
text, which is no program), and the same with one slot overwritten. Names are hidden, spelled
with and without extensions, and repeat ids. Paths in results are relative to the folder.
"""

from __future__ import annotations

import contextlib
import io
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli
from ..functions.u64 import hex16
from ..operators import catalog, lsh, stored
from ..operators.cluster import cluster_directory
from ..operators.fingerprint import fingerprints_once
from ..operators.hashing import swapped
from ..operators.similarity import batch_against_all, compared, positions, signature_text
from ..sources.files import parse_images, remove_files, save_images, scan_directory, with_ids
from .durable import Scratch, cut, numbered, scratch_folder, scratch_path
from .queries import K, _near, _prints, _queried, _signatures, _table, overwritten, turn_entries, turns

#: An ELF header with two section headers after it: none, and one that holds the bytes after them.
_HEADER = "7f454c46020101" + "00" * 9 + "0200f70001000000" + "00" * 16 + "4000000000000000" + "00000000" + "4000000000004000" + "0200" + "0000"
_SECTION = "00" * 64 + "00000000" + "01000000" + "{flags}00000000000000" + "00" * 8 + "c000000000000000"


def image(text: Column, flags: str = "06") -> Column:
    """A minimal ELF file around a binary column."""
    size = F.unhex(swapped(hex16(F.octet_length(text).cast("long")), 16))
    return F.concat(F.unhex(F.lit(_HEADER + _SECTION.format(flags=flags))), size, F.unhex(F.lit("00" * 24)), text)


def elf_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, by id: two programs, a bare text, a file cut short, one that isn't executable."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    kind = F.col("doc_id") % 5
    whole = image(text)
    content = F.when(kind < 2, whole).when(kind == 2, text).when(kind == 3, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(image(text, "02"))
    rows = parse_images(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return rows.select(F.col("path").alias("program_id"), F.coalesce(F.octet_length("text").cast("long"), F.lit(-1)).alias("n_bytes"), F.sha2("text", 256).alias("sha256"), F.coalesce("entry_offset", F.lit(-1)).alias("entry_offset"), "load_error")


def _turn_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    plain, name = F.col("turn") % 4, F.concat_ws("_", "conv_id", "turn")
    hidden = F.when(plain == 0, F.concat(F.lit("p"), name, F.lit(".so"))).when(plain == 1, F.concat(F.lit("_p"), name, F.lit(".so"))).when(plain == 2, F.concat(F.lit(".p"), name, F.lit(".so")))
    path = F.concat(F.lit("d"), F.col("conv_id") % 10, F.lit("/"), F.coalesce(hidden, F.concat(F.lit("p"), "conv_id", F.lit("."), "turn")))
    both = c.select("conv_id", "turn", path.alias("path"), "text").union(c.select("conv_id", "turn", F.concat(F.lit("e/"), name, F.lit(".tar.so")), overwritten(F.col("text"))))
    return both.select("conv_id", "turn", "path", F.octet_length("text").alias("n"), F.when(F.col("conv_id") % 5 == 4, F.col("text")).otherwise(image(F.col("text"))).alias("content"))


def _from_files(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query on the saved files; the result is a table, the files go."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Scratch():
            folder = scratch_folder(spark, "files")
            try:
                save_images(_turn_images(spark, sf_dir), folder)
                return cut(make(spark, folder), "from-files", result=True)
            finally:
                # On executors: at the end of a `Scratch` the driver removes what is left, file after file.
                remove_files(spark, folder)

    return query


def _relative(path: Column, folder: str) -> Column:
    return F.substring(path, F.lit(len(folder) + 2), F.length(path))


def _by_path(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all programs, named by relative path."""
    programs = scan_directory(spark, folder).where("load_error is null")
    return cut(fingerprints_once(programs.select(_relative(F.col("path"), folder).alias("program_id"), "text")), "prints")


def _pairs(prints: DataFrame) -> DataFrame:
    """Every overwritten program against the one it was made of, under either spelling of that."""
    name = F.regexp_replace(F.regexp_replace("program_id", r"^.*/[._]*p?", ""), r"(\.tar)?\.so$", "")
    key = prints.select("program_id", F.translate(name, ".", "_").alias("key"))
    left, right = key.where("program_id like 'd%'"), key.where("program_id like 'e/%'")
    return left.select(F.col("program_id").alias("a"), "key").join(right.select(F.col("program_id").alias("b"), "key"), "key").select("a", "b")


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_ids(scan_directory(spark, folder))
    return rows.select(_relative(F.col("path"), folder).alias("path"), "program_id", F.sha2("text", 256).alias("sha256"), "load_error")


def _listed(rows: DataFrame, folder: str, *more: Column) -> DataFrame:
    head = ("program_id", _relative(F.col("source_path"), folder).alias("source_path"), "ngram_count", "normalized_len")
    return rows.select(*head, hex16(F.col("simhash")).alias("simhash"), signature_text(F.col("minhash")).alias("minhash"), *more)


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(catalog.scan(spark, folder, strict=False), folder)


def _saved_catalog(spark: SparkSession, folder: str, version: int = catalog.VERSION) -> str:
    """The catalog of a folder as JSON, in parts that Spark writes; where it is."""
    path = f"{folder}-out/db.json"
    catalog.save_parts(cut(catalog.scan(spark, folder, strict=False), "entries"), path, version)
    return path


def _catalog_json(spark: SparkSession, folder: str) -> DataFrame:
    path = _saved_catalog(spark, folder, 3)
    back = catalog.Catalog.load(spark, path)
    return _listed(back.rows, folder, F.size("ngram_sample").cast("long").alias("n_sample"), F.lit(back.version).alias("version"), F.lit(back.size()).cast("long").alias("entries"))


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return lsh.index_directory(spark, folder, strict=False).select("program_id", "band", hex16(F.col("bucket_key")).alias("bucket_key"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_directory(spark, folder, 0.5).select("cluster_id", _relative(F.col("program_id"), folder).alias("program_id"), "size", "avg_similarity")


def _fingerprint_texts(spark: SparkSession, folder: str) -> DataFrame:
    return cli.texts(_by_path(spark, folder), cli.format_fingerprint, "program_id")


def _report_texts(form) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, folder: str) -> DataFrame:
        prints = _by_path(spark, folder)
        return cli.texts(compared(_pairs(prints), prints), form, "a", "b")

    return make


def batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each query program's batch report."""
    prints = _near(turns(spark, sf_dir), positions(0.4, K))
    found = batch_against_all(prints, _queried(prints), 0.4, K)
    order = Window.partitionBy("a").orderBy(F.desc("jaccard_estimate"), "b")
    ranked = found.withColumn("i", F.row_number().over(order) - 1).withColumn("matches", F.count("*").over(Window.partitionBy("a")))
    return cli.texts(ranked, cli.format_match, "a", "b")


def _said(spark: SparkSession, *args: str) -> tuple[int, str]:
    """Exit code and all that a command prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(out):
        code = cli.main(list(args), spark)
    return code, out.getvalue()


def _lines(spark: SparkSession, text: str, folder: str) -> DataFrame:
    """A command's lines, without the folder."""
    lines = text.rstrip("\n").replace(folder + "/", "").replace(folder, "").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def _cluster_command(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, _said(spark, "cluster", folder, "--threshold", "0.5")[1], folder)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each file as an entry under an id of its own: the entry, or the error."""
    programs = scan_directory(spark, folder).withColumn("program_id", F.concat(F.lit("as "), _relative(F.col("path"), folder)))
    error = F.replace(F.coalesce("error", F.lit("")), F.lit(folder + "/"), F.lit(""))
    rows = _listed(catalog.file_entries(programs), folder, F.size("ngram_sample").cast("long").alias("n_sample"), error.alias("error"))
    return rows.withColumns({c: F.when(F.col("error") == "", F.col(c)).otherwise(-1) for c in ("ngram_count", "normalized_len", "n_sample")}).withColumns({c: F.coalesce(c, F.lit("")) for c in ("simhash", "minhash")})


def _quick(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all pairs of files, as columns."""
    prints = _by_path(spark, folder)
    return compared(_pairs(prints), prints).withColumn("notes", F.array_join("notes", "; "))


def _index_command(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, _said(spark, "index", folder, "--output", f"{folder}-out/db.json")[1].replace(f"{folder}-out/", "out/"), folder)


def _catalog_summary(spark: SparkSession, folder: str) -> DataFrame:
    db = catalog.Catalog.load(spark, _saved_catalog(spark, folder))
    head, entries = cli.catalog_lines(db.rows, db.version)
    line = F.replace(F.replace("line", F.lit(folder + "/"), F.lit("")), F.lit(folder), F.lit(""))
    # A table: numbering samples its rows, else the catalog was parsed once more.
    return _lines(spark, head, folder).union(numbered(cut(entries, "lines"), "source_path").select(F.col("place") + 1, line))


def _query_command(spark: SparkSession, folder: str) -> DataFrame:
    path = _saved_catalog(spark, folder)
    return _lines(spark, _said(spark, "query", f"{folder}/d0/p0_0.so", "--db", path, "--min-jaccard", "0.3")[1], folder)


def cli_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes and messages of commands that fail, and of one that doesn't."""
    with Scratch():
        folder = scratch_folder(spark, "files")
        rows = [("good.so", b"0123456789abcdefghijklmnopqrstuvwxyz" * 4), ("few/short.so", b"12345678"), ("text.txt", None)]
        programs = spark.createDataFrame([(p, bytearray(t or b"")) for p, t in rows], "path string, text binary")
        content = F.when(F.col("path") == "text.txt", F.encode(F.lit("no program at all"), "UTF-8")).otherwise(image(F.col("text")))
        save_images(programs.select("path", content.alias("content")), folder)
        good, text, short = (f"{folder}/{p}" for p in ("good.so", "text.txt", "few/short.so"))
        commands = {"compare": ("compare", good, text), "fingerprint": ("fingerprint", text), "report": ("report", good, short), "index": ("index", f"{folder}/few", "--output", f"{folder}/db.json"), "good": ("compare", good, good)}
        got = [(name, *_said(spark, *args)) for name, args in commands.items()]
        return spark.createDataFrame([(name, code, said.split("\n")[0].replace(folder + "/", "") if code else "") for name, code, said in got], "command string, code int, message string")


def lsh_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbers of bands the signature length allows, and what is said of others."""
    rows = []
    for bands in range(33):
        try:
            rows.append((bands, lsh.LshConfig.of(K, bands).rows_per_band, ""))
        except ValueError as e:
            rows.append((bands, 0, str(e)))
    return spark.createDataFrame(rows, "bands int, rows_per_band int, error string")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a new and of a filled index and catalog."""
    prints = _prints(turns(spark, sf_dir))
    entries = prints.select("program_id", F.col("program_id").alias("source_path"), "ngram_count", "normalized_len", "simhash", "minhash", F.col("ngrams").alias("ngram_sample"))
    kinds = {"new index": lsh.LshIndex.new(spark), "index": lsh.LshIndex.of(entries).insert(prints), "new catalog": catalog.Catalog.new(spark), "catalog": catalog.Catalog(entries)}
    return spark.createDataFrame([(k, x.size(), x.is_empty(), getattr(x, "version", 0)) for k, x in kinds.items()], "store string, size long, is_empty boolean, version int")


def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogs of `catalog_merge`, stored, merged in two snapshots and read again."""
    with Scratch():
        e = cut(turn_entries(spark, sf_dir).withColumn("place", F.col("program_id").cast("long") * 1000 + F.col("turn")).drop("turn"), "entries")
        first = (F.col("place") % 1000 == 0) & (F.col("program_id").cast("long") % 3 != 0)
        root = scratch_path(spark, "catalog")
        made = stored.StoredCatalog.create(e.where(first).drop("place"), root)
        for half in (0, 1):
            made = made.merge(e.where(~first & (F.col("program_id").cast("long") % 2 == half)), "place")
        rows = stored.StoredCatalog.open(spark, root).rows()
        head = ("program_id", "source_path", "ngram_count", "normalized_len", hex16(F.col("simhash")).alias("simhash"))
        return cut(rows.select(*head), "stored", result=True)


def _stored_turns(spark: SparkSession, sf_dir: str, root: str) -> tuple[stored.StoredIndex, DataFrame]:
    """An index of turns and grown turns, in which those of odd turns were replaced by overwritten ones and
    those of each seventh conversation deleted; and the query programs."""
    prints = _signatures(turns(spark, sf_dir))
    name, kind = F.substring_index("program_id", "~", 1), F.substring_index("program_id", "~", -1)
    plain = ~F.contains("program_id", F.lit("~"))
    odd = F.substring_index(name, "-", -1).cast("long") % 2 == 1
    index = stored.StoredIndex.create(spark, root, lsh.LshConfig.of(K, lsh.CLI_BANDS))
    index = index.insert(prints.where(plain)).insert(prints.where(~plain & (kind == "more")))
    index = index.insert(prints.where(~plain & (kind == "edit") & odd).withColumn("program_id", name))
    gone = prints.where((plain | (kind == "more")) & (F.substring_index(name, "-", 1).cast("long") % 7 == 3)).select("program_id")
    index.delete(gone)
    return stored.StoredIndex.open(spark, root), _queried(prints)


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket entries of a stored index after inserts, replacements and deletes."""
    with Scratch():
        index, _ = _stored_turns(spark, sf_dir, scratch_path(spark, "index"))
        return cut(index.entries().select("program_id", "band", hex16(F.col("bucket_key")).alias("bucket_key")), "stored", result=True)


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query programs, searched in the stored index at 0.3 or more."""
    with Scratch():
        index, asked = _stored_turns(spark, sf_dir, scratch_path(spark, "index"))
        return cut(index.search(asked, 0.3), "stored", result=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "elf_sections": elf_sections,
    "scan_programs": _from_files(_scan),
    "scan_catalog": _from_files(_catalog),
    "catalog_json": _from_files(_catalog_json),
    "index_programs": _from_files(_index),
    "scan_clusters": _from_files(_clusters),
    "file_fingerprints": _from_files(_fingerprint_texts),
    "file_comparisons": _from_files(_report_texts(cli.format_comparison)),
    "file_reports": _from_files(_report_texts(cli.format_report)),
    "batch_lines": batch_lines,
    "cli_cluster": _from_files(_cluster_command),
    "cli_index": _from_files(_index_command),
    "file_entries": _from_files(_entries),
    "quick_comparisons": _from_files(_quick),
    "cli_query": _from_files(_query_command),
    "catalog_summary": _from_files(_catalog_summary),
    "cli_errors": cli_errors,
    "lsh_configs": lsh_configs,
    "stores": stores,
    "stored_catalog": stored_catalog,
    "stored_index": stored_index,
    "stored_search": stored_search,
}
