"""Queries over the driver's tables.

The tables hold no binaries, so texts stand in for streams: the UTF-8 bytes of `documents` and
`conversations`. Each turn of a conversation comes with three programs made of it: a copy, one
with a slot overwritten, and one with half of it repeated out of step, so that there are near and
far relatives. `events` gives streams rich in wide loads and no-ops: a user's events in order,
each a slot spelled from its id. Unsigned values leave as 16 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.u64 import hex16
from ..operators import catalog, lsh, native
from ..operators.cluster import cluster_members, cluster_table
from ..operators.fingerprint import feature_sets, features, fingerprints, fingerprints_once, looked_up, ngram_total, normalized, rejections, slots
from ..operators.similarity import compare_stored as stored_against_live
from ..operators.reach import within_reach
from ..operators.similarity import batch_against_all, compared, estimate_pairs, exact_pairs, one_against_all, positions, search, set_classes, signature_classes, signature_text, tiers
from ..sources.files import text_programs
from .durable import cut, spread

K = 128


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_programs(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def overwritten(text: Column) -> Column:
    """A binary column with its middle slot overwritten."""
    at = F.floor(F.octet_length(text) / 16).cast("int") * 8
    return F.concat(F.substring(text, F.lit(1), at), F.encode(F.lit("X" * 8), "UTF-8"), F.substring(text, at + 9, F.octet_length(text)))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and their relatives, by conversation and turn."""
    c = _table(spark, sf_dir, "conversations")
    plain = text_programs(c, F.concat_ws("-", "conv_id", "turn"), F.coalesce("text", F.lit("")))
    text = F.col("text")
    half = F.floor(F.octet_length(text) / 16).cast("int") * 8
    made = (("", text), ("~copy", text), ("~edit", overwritten(text)), ("~more", F.concat(text, F.substring(text, F.lit(2), half))))
    each = F.array(*(F.struct(F.concat("program_id", F.lit(k)).alias("program_id"), t.alias("text")) for k, t in made))
    return plain.select(F.inline(each))


def user_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream a user: wide loads, moves (every third a no-op) and others, by event order."""
    e = _table(spark, sf_dir, "events")
    op = F.element_at(F.array(*(F.lit(x) for x in ("18", "B7", "18", "07", "B7"))), (F.col("event_id") * 7 % 5 + 1).cast("int"))
    registers = F.when(F.col("event_id") % 3 == 0, "00").otherwise(F.lpad(F.hex(F.col("event_id") * 37 % 256), 2, "0"))
    rest = F.when(F.col("event_id") % 2 == 0, "000000000000").otherwise(F.concat(F.lit("0000"), F.lpad(F.hex("event_id"), 8, "0")))
    slot = F.struct("event_id", F.concat(op, registers, rest).alias("s"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(slot)), lambda x: x["s"]))
    return e.groupBy("user_id").agg(F.unhex(text).alias("text")).select(F.col("user_id").cast("string").alias("program_id"), "text")


def _near(programs: DataFrame, need: int, bands: int = 1) -> DataFrame:
    """Fingerprints of the query programs and of what a search for them can find: hashing is dear."""
    return _prints(within_reach(programs, _queried(programs), need, bands, k=K))


def _prints(programs: DataFrame, **options) -> DataFrame:
    """Fingerprints as a table: hashing is dear, and the queries read them more than once."""
    return cut(fingerprints_once(programs, **options), "prints")


def _signatures(programs: DataFrame, **options) -> DataFrame:
    """Of the fingerprints the signatures alone, as a table: nothing else of them is moved or written."""
    return cut(fingerprints_once(programs, **options).select("program_id", "minhash"), "signatures")


def slots_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(documents(spark, sf_dir))


def ngram_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_total(documents(spark, sf_dir))


def _normal_report(programs: DataFrame, way=normalized) -> DataFrame:
    n = way(programs)
    remap = F.array_join(F.transform("register_remap", lambda r: F.concat_ws(">", r["old"], r["new"])), ",")
    return n.select("program_id", "original_len", F.octet_length("normalized").cast("long").alias("normalized_len"), "removed_instructions", "compression_ratio", remap.alias("remap"), F.hex("normalized").alias("normalized"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal_report(documents(spark, sf_dir)).drop("normalized")


def normalize_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal_report(user_streams(spark, sf_dir))


def normalize_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of users, normalized without Python."""
    return _normal_report(user_streams(spark, sf_dir), native.normalized)


def normalize_documents_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal_report(documents(spark, sf_dir), native.normalized).drop("normalized")


def fingerprint_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of turns, normalized, cut in n-grams and hashed without Python."""
    p = native.fingerprints(turns(spark, sf_dir))
    return p.select("program_id", "ngram_count", "normalized_len", signature_text(F.col("minhash")).alias("minhash"), hex16(F.col("simhash")).alias("simhash"))


def ngrams_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(documents(spark, sf_dir), config=None).select("program_id", hex16(F.col("feature")).alias("feature"))


def ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_sets(documents(spark, sf_dir), config=None).select("program_id", F.size("ngrams").cast("long").alias("n_grams"))


def normalized_ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_sets(user_streams(spark, sf_dir)).select("program_id", F.size("ngrams").cast("long").alias("n_grams"))


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_once(turns(spark, sf_dir)).select("program_id", signature_text(F.col("minhash")).alias("minhash"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir), k=0).select("program_id", hex16(F.col("simhash")).alias("simhash"))


def fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fingerprints_once(documents(spark, sf_dir))
    return p.select("program_id", "ngram_count", "normalized_len", signature_text(F.col("minhash")).alias("minhash"), hex16(F.col("simhash")).alias("simhash"))


def jaccard_exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_pairs(cut(set_classes(feature_sets(documents(spark, sf_dir)), "program_id", "ngrams"), "classes"), 0.5)


def jaccard_estimate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_pairs(cut(signature_classes(fingerprints_once(turns(spark, sf_dir))), "classes"), 0.5, K)


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_pairs(cut(signature_classes(fingerprints_once(documents(spark, sf_dir))), "classes"), 0.5, K)


def _next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one of its conversation and with its relatives."""
    c = _table(spark, sf_dir, "conversations")
    a = F.concat_ws("-", "conv_id", "turn")
    others = F.array(F.concat_ws("-", "conv_id", F.col("turn") + 1), *(F.concat(a, F.lit(k)) for k in ("~copy", "~edit", "~more")))
    return c.select(a.alias("a"), F.explode(others).alias("b"))


def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the next one and its relatives."""
    r = compared(_next_turns(spark, sf_dir), _prints(turns(spark, sf_dir)))
    return r.withColumn("notes", F.array_join("notes", "; "))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(_next_turns(spark, sf_dir), _signatures(turns(spark, sf_dir))).groupBy("tier").agg(F.count("*").alias("n"))


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lsh.buckets(fingerprints_once(turns(spark, sf_dir)), lsh.LshConfig.of(K, lsh.CLI_BANDS))
    return b.select("program_id", "band", hex16(F.col("bucket_key")).alias("bucket_key"))


def _queried(prints: DataFrame) -> DataFrame:
    """The query programs: those of conversations whose id is divisible by 50."""
    return prints.where(F.substring_index("program_id", "-", 1).cast("long") % 50 == 0)


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = lsh.LshConfig.of(K)
    prints = _near(turns(spark, sf_dir), config.rows_per_band, config.bands)
    found = lsh.candidates(lsh.buckets(prints, config), lsh.buckets(_queried(prints), config))
    return found.withColumn("bucket_key", hex16(F.col("bucket_key")))


def lsh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = lsh.LshConfig.of(K, lsh.CLI_BANDS)
    prints = _near(turns(spark, sf_dir), config.rows_per_band, config.bands)
    return lsh.search(prints, _queried(prints), config, 0.6)


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `lsh_query` looks for, without its loss: every turn at 0.6 or more."""
    prints = _near(turns(spark, sf_dir), positions(0.6, K))
    return search(prints, _queried(prints), 0.6, K)


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(_signatures(turns(spark, sf_dir), config=None), 0.5, K)


def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_members(_signatures(documents(spark, sf_dir), config=None), 0.5, K)


def cluster_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents by size, with the average over all pairs of their members."""
    return cluster_table(_signatures(documents(spark, sf_dir), config=None), 0.5, K)


def lsh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 50, searched among all documents at 0.3 or more."""
    config = lsh.LshConfig.of(K)
    prints = _near(documents(spark, sf_dir), config.rows_per_band, config.bands)
    return lsh.search(prints, _queried(prints), config, 0.3)


def batch_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query programs against all others, at 0.1 or more."""
    prints = _near(turns(spark, sf_dir), positions(0.1, K))
    return batch_against_all(prints, _queried(prints), 0.1, K).withColumn("notes", F.array_join("notes", "; "))


def one_against_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn with the least name against every other program. Only those that share a leader with it
    need a signature: without one, no position is equal."""
    programs = turns(spark, sf_dir)
    plain = cut(fingerprints_once(programs, k=0).drop("minhash"), "plain")
    least = plain.agg(F.min("program_id")).first()[0] or ""
    near = _prints(within_reach(programs, programs.where(F.col("program_id") == least), 1, k=K)).select("program_id", "minhash")
    prints = plain.join(near.hint("merge"), "program_id", "left").withColumn("minhash", F.coalesce("minhash", F.expr("cast(array() as array<bigint>)")))
    return one_against_all(prints, least, 0.0).withColumn("notes", F.array_join("notes", "; "))


def register_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the 16 registers became in each normalized stream."""
    n = normalized(user_streams(spark, sf_dir)).select("program_id", "register_remap", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("register"))
    return n.select("program_id", "register", looked_up(F.col("register_remap"), F.col("register")).alias("new"))


def empty_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejections(documents(spark, sf_dir))


def turn_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog row a turn, under the id of its conversation: ids repeat."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("program_id"))
    plain = turns(spark, sf_dir).where(~F.contains("program_id", F.lit("~")))
    p = _prints(plain).join(c, "program_id")
    return p.select(F.col("conv_id").cast("string").alias("program_id"), F.col("program_id").alias("source_path"), "ngram_count", "normalized_len", "simhash", "minhash", F.col("ngrams").alias("ngram_sample"), "turn")


def _listed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("program_id", "source_path", "ngram_count", "normalized_len", hex16(F.col("simhash")).alias("simhash"), *more)


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(catalog.upsert(turn_entries(spark, sf_dir), "turn"))


def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of two conversations of three as the primary catalog; all other turns as the
    secondary, whose ids repeat. Places follow conversations and turns."""
    e = turn_entries(spark, sf_dir).withColumn("place", F.col("program_id").cast("long") * 1000 + F.col("turn"))
    first = (F.col("turn") == 0) & (F.col("program_id").cast("long") % 3 != 0)
    return _listed(catalog.merge(e.where(first).drop("turn"), e.where(~first).drop("turn"), "place"), "place")


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(catalog.find(catalog.upsert(turn_entries(spark, sf_dir), "turn"), "7"))


def compare_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as stored against the program that it is now: itself, overwritten, grown, or the next turn."""
    prints = _prints(turns(spark, sf_dir))
    stored = prints.where(~F.contains("program_id", F.lit("~")))
    stored = stored.select("program_id", F.concat(F.lit("db/"), "program_id").alias("source_path"), "ngram_count", "minhash", "simhash", F.col("ngrams").alias("ngram_sample"))
    name, kind = F.substring_index("program_id", "~", 1), F.substring_index("program_id", "~", -1)
    conv, turn = F.substring_index(name, "-", 1), F.substring_index(name, "-", -1).cast("long")
    now = F.element_at(F.array(F.lit("copy"), F.lit("edit"), F.lit("more"), F.lit("next")), (turn % 4 + 1).cast("int"))
    same = prints.where(F.contains("program_id", F.lit("~")) & (kind == now)).withColumn("program_id", name)
    later = prints.where(~F.contains("program_id", F.lit("~")) & (turn % 4 == 0) & (turn > 0)).withColumn("program_id", F.concat_ws("-", conv, turn - 1))
    return stored_against_live(stored, same.unionByName(later)).withColumn("notes", F.array_join("notes", "; "))


def basket_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sets of parts."""
    sets = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("items"))
    return exact_pairs(cut(set_classes(sets, "l_orderkey", "items"), "classes"), 0.5)
