"""Similarity of two fingerprints, as columns and as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.u64 import hex16
from ..plans.durable import cut
from .meetings import common_items, equal_positions, near_between, near_in

#: Tier bounds, largest first, and the texts of a report's notes.
TIERS = (("identical", 0.98), ("near_duplicate", 0.80), ("related", 0.40))
NOTES = (
    "simhash hamming distance within clone detection threshold",
    "minhash estimate diverges from exact jaccard; increase hash count",
    "one program produced empty ngram set",
)


def estimate(a: Column, b: Column) -> Column:
    """Share of equal signature positions; 0 for empty signatures or different lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def exact(a: Column, b: Column) -> Column:
    """Jaccard of two sets in arrays without repetitions; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64.0


def tier(value: Column) -> Column:
    out = F.lit("distinct")
    for name, least in reversed(TIERS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def notes(distance: Column, exactly: Column, estimated: Column, count_a: Column, count_b: Column) -> Column:
    some = (distance <= 3, (exactly >= 0.9) & (estimated < 0.7), (count_a == 0) | (count_b == 0))
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in zip(some, NOTES, strict=True))), lambda x: x.isNotNull())


def compared(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Reports for `pairs` (a, b) of program ids; pairs with an unknown id are left out."""
    side = lambda s: prints.select(F.col("program_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ngram_count", "minhash", "simhash", "ngrams")))
    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return reported(full)


def reported(full: DataFrame) -> DataFrame:
    """Reports from rows with a, b and both fingerprints (suffixes _a, _b)."""
    got = full.select(
        "a",
        "b",
        estimate(F.col("minhash_a"), F.col("minhash_b")).alias("jaccard_estimate"),
        exact(F.col("ngrams_a"), F.col("ngrams_b")).alias("jaccard_exact"),
        simhash_similarity(F.col("simhash_a"), F.col("simhash_b")).alias("simhash_similarity"),
        hamming(F.col("simhash_a"), F.col("simhash_b")).cast("int").alias("hamming_distance"),
        "ngram_count_a",
        "ngram_count_b",
    )
    return got.select("*", tier(F.col("jaccard_estimate")).alias("tier"), notes(*(F.col(c) for c in ("hamming_distance", "jaccard_exact", "jaccard_estimate", "ngram_count_a", "ngram_count_b"))).alias("notes"))


def tiers(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b, tier) as `compared` tells them, from `signatures` (program_id, minhash) alone."""
    side = lambda s: signatures.select(F.col("program_id").alias(s), F.col("minhash").alias(f"minhash_{s}"))
    full = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return full.select("a", "b", tier(estimate(F.col("minhash_a"), F.col("minhash_b"))).alias("tier"))


def one_against_all(prints: DataFrame, query_id: str, least: float = 0.0) -> DataFrame:
    """Reports of one program against all others, best first; the query itself is skipped."""
    query = prints.where(F.col("program_id") == query_id).limit(1)  # one row
    cols = ("ngram_count", "minhash", "simhash", "ngrams")
    a = query.select(F.col("program_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in cols))
    b = prints.select(F.col("program_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in cols)).where(F.col("b") != query_id)
    full = b.join(F.broadcast(a), F.lit(True))
    return reported(full).where(F.col("jaccard_estimate") >= least).orderBy(F.desc("jaccard_estimate"), "b")


def batch_against_all(prints: DataFrame, queries: DataFrame, least: float, k: int) -> DataFrame:
    """Reports (query as `a`) of each of `queries` against all others of `prints` at `least` (> 0) or more.

    Lossless, by `search`: only pairs that reach `least` get a report.
    """
    found = search(prints, queries, least, k).where("query_id <> program_id")
    return compared(found.select(F.col("query_id").alias("a"), F.col("program_id").alias("b")), prints)


def compare_stored(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored catalog rows against live fingerprints of the same id.

    The report names the stored id and the stored source path, and never has notes.
    """
    cols = ("ngram_count", "minhash", "simhash")
    a = stored.select(F.col("program_id").alias("a"), F.col("source_path").alias("path"), F.col("ngram_sample").alias("ngrams_a"), *(F.col(c).alias(f"{c}_a") for c in cols))
    b = live.select(F.col("program_id").alias("id_b"), F.col("ngrams").alias("ngrams_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    full = a.join(b, F.col("a") == F.col("id_b")).withColumnRenamed("path", "b")
    return reported(full).withColumn("notes", F.expr("cast(array() as array<string>)"))


def signature_classes(prints: DataFrame) -> DataFrame:
    """(class_id, minhash, size): programs with one signature, named by the least id."""
    return prints.groupBy("minhash").agg(F.min("program_id").alias("class_id"), F.count("*").alias("size"))


def _blocks(need: int, k: int) -> Column:
    """Hashes of blocks of signature positions, about twice as many as two signatures with `need` equal
    positions of k may differ in."""
    n = min(k, 2 * (k - need + 1))
    ends = [i * k // n for i in range(n + 1)]
    return F.array(*(F.xxhash64(F.lit(i), F.slice("minhash", a + 1, b - a)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))))


def _rarest(rows: DataFrame, least: Column) -> DataFrame:
    """(key, id, at, n) of `rows` (id, key, n): the keys of each id that it must share one of with any
    other id that shares `least` of its n keys.

    Keys rank by rarity. All but least - 1 of them make the prefix; keys of one id alone come first
    and can't be shared, so they only shorten it. What many ids share comes last: it is
    hardly ever in a prefix. `at` is the place of the key in its id's order.
    """
    rarity = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("id").orderBy("df", "key")
    ranked = rows.join(rarity, "key").withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count("*").over(Window.partitionBy("id")))
    return ranked.withColumn("at", F.col("rank") + F.col("n") - F.col("shared")).where(F.col("at") <= F.col("n") - least + 1).drop("df", "rank", "shared")


def positions(threshold: float, k: int) -> int:
    """Equal positions of k that make a similarity of `threshold`."""
    return max(1, math.ceil(threshold * k - 1e-9))


def _block_rows(signatures: DataFrame, need: int, k: int) -> DataFrame:
    """(id, key, n) of `signatures` (id, minhash)."""
    return signatures.select("id", F.explode(_blocks(need, k)).alias("key")).withColumn("n", F.lit(min(k, 2 * (k - need + 1))))


def _planes(k: int) -> list[tuple[str, Column]]:
    """Two bits of each signature position, in columns of 64 positions: the low ones, and the next ones."""

    def plane(at: int, bit: int) -> Column:
        words = F.slice("minhash", at + 1, 64)
        powers = F.array(*(F.lit(1 << i if i < 63 else -(2**63)) for i in range(64)))
        here = F.zip_with(words, F.slice(powers, 1, F.size(words)), lambda v, p: F.when(F.shiftrightunsigned(v, bit).bitwiseAND(F.lit(1)) == 1, p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(here, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return [(f"w{at // 64}_{bit}", plane(at, bit)) for at in range(0, k, 64) for bit in (0, 1)]


def may_agree(need: int, k: int, a: str, b: str) -> Column:
    """Whether two signatures may have `need` equal positions of k, by their `_planes` (with suffixes a and b):
    where two bits differ, a position does. Signatures by chance alike in a few positions mostly don't pass."""
    n = F.lit(0)
    for at in range(0, k, 64):
        x, y = ([F.col(f"w{at // 64}_{bit}{s}") for bit in (0, 1)] for s in (a, b))
        n = n + F.bit_count(x[0].bitwiseXOR(y[0]).bitwiseOR(x[1].bitwiseXOR(y[1])))
    return n <= k - need


def estimate_pairs(classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, size_a, size_b, jaccard_estimate) of `signature_classes` at `threshold` (> 0) or more.

    Lossless: two signatures with m equal positions of k differ in k - m at most, so of n
    blocks of positions n - (k - m) are equal throughout, and one of them is among the
    k - m + 1 rarest of either. Only those are indexed. A block that very many signatures share
    is met chunk by chunk. `classes` is read more than once: pass a table.
    """
    if threshold <= 0:
        raise ValueError("pairs without any equal position aren't listed: the threshold must be above 0")
    need = positions(threshold, k)
    if need > k:
        return classes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(0.0).alias("jaccard_estimate")).where("false")
    # Numbers for names, which may be long paths, in an index of many rows a signature.
    named = cut(classes.withColumn("id", F.monotonically_increasing_id()), "signatures")
    rows = _block_rows(named, need, k)
    planes = cut(named.select("id", *(c.alias(name) for name, c in _planes(k))), "planes")
    index = _rarest(rows, F.col("n") - (k - need)).select("key", "id").join(planes, "id")
    pairs = near_in(index, named.select("id", F.col("minhash").alias("items")), equal_positions, threshold, lambda a, b: may_agree(need, k, a, b))
    side = lambda s: named.select(F.col("id").alias(s), F.col("class_id").alias(f"c_{s}"), F.col("minhash").alias(f"m_{s}"), F.col("size").alias(f"size_{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("e", estimate(F.col("m_a"), F.col("m_b"))).where(F.col("e") >= threshold)
    first = F.col("c_a") < F.col("c_b")
    pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    return full.select(pick("c", "a", "b").alias("a"), pick("c", "b", "a").alias("b"), pick("size", "a", "b").alias("size_a"), pick("size", "b", "a").alias("size_b"), F.col("e").alias("jaccard_estimate"))


def search(prints: DataFrame, queries: DataFrame, threshold: float, k: int) -> DataFrame:
    """(query_id, program_id, score) at `threshold` (> 0) or more: every match, a query itself included.

    Lossless by the rarest blocks of positions as in `estimate_pairs`; equal signatures are
    compared once. Both are read more than once: pass tables.
    """
    need = positions(threshold, k)
    if threshold <= 0 or need > k:
        raise ValueError("the threshold must be above 0 and at most 1")
    named = lambda df: df.select("minhash").distinct().select(F.xxhash64("minhash").alias("id"), "minhash")
    asked, every = cut(named(queries), "asked"), cut(named(queries).union(named(prints)).distinct(), "every")
    index = cut(_rarest(_block_rows(every, need, k), F.col("n") - (k - need)).select("key", "id"), "blocks")
    pairs = near_between(index.join(asked.select("id"), "id", "left_semi"), index, every.select("id", F.col("minhash").alias("items")), equal_positions, threshold)
    # Every query signature meets itself, whatever blocks it has. Ids of 64 bits that collide bring candidates, not matches.
    pairs = pairs.union(asked.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct()
    side = lambda s, m: every.select(F.col("id").alias(s), F.col("minhash").alias(m))
    near = pairs.join(side("a", "m_q"), "a").join(side("b", "m_p"), "b").select("m_q", "m_p", estimate(F.col("m_q"), F.col("m_p")).alias("score")).where(F.col("score") >= threshold)
    of = lambda df, s, m: df.select(F.col("program_id").alias(s), F.col("minhash").alias(m))
    return near.join(of(queries, "query_id", "m_q"), "m_q").join(of(prints, "program_id", "m_p"), "m_p").select("query_id", "program_id", "score")


def set_classes(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(class_id, items, size): equal sets, named by the least key; empty sets are left out."""
    ordered = sets.where(F.size(items) > 0).select(F.col(key).alias("k"), F.array_sort(items).alias("items"))
    return ordered.groupBy("items").agg(F.min("k").alias("class_id"), F.count("*").alias("size"))


def exact_index(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, id, n, at, bits) of `set_classes`: the rarest items that a set shares one of with any other at the
    threshold, with their place in its order and 64 bits that its items hash to."""
    powers = F.array(*(F.lit(1 << i if i < 63 else -(2**63)) for i in range(64)))
    bits = F.aggregate("items", F.lit(0).cast("long"), lambda b, x: b.bitwiseOR(F.get(powers, F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    # Before the items are listed: what stands beside an explode is worked out, from the whole set, for each of them.
    sets = classes.select(F.col("class_id").alias("id"), F.size("items").alias("n"), bits.alias("bits"), "items")
    rows = sets.select("id", "n", "bits", F.explode("items").alias("key"))
    return _rarest(rows, F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).select("key", "id", "n", "at", "bits")


def may_reach(threshold: float, a: str, b: str) -> Column:
    """Whether two entries of `exact_index` with a common key may belong to sets at the threshold.

    By length; by place: a common item leaves at most what follows it in either set, if it is
    their first; by bits: a bit that only one set has stands for an item that the other lacks. The
    first common item of two sets at the threshold passes all three.
    """
    x, y = (lambda c: F.col(f"{c}{a}")), (lambda c: F.col(f"{c}{b}"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (x("n") + y("n")) - 1e-9)
    lacks = lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))
    lengths = F.least(x("n"), y("n")) >= F.lit(threshold) * F.greatest(x("n"), y("n")) - 1e-9
    places = F.least(x("n") - x("at"), y("n") - y("at")) + 1 >= need
    return lengths & places & (F.least(x("n") - lacks(x("bits"), y("bits")), y("n") - lacks(y("bits"), x("bits"))) >= need)


def exact_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, size_a, size_b, jaccard_exact) of `set_classes` at `threshold` (> 0) or more.

    Prefix-filtered: with items ordered by rarity, sets at the threshold share an item among
    their rarest n - ceil(threshold * n) + 1. Pairs are bounded by length, place and bits
    before they are listed; an item that very many prefixes hold is met chunk by chunk. `classes` is
    read more than once: pass a table.
    """
    if threshold <= 0:
        raise ValueError("pairs without a common item aren't listed: the threshold must be above 0")
    items = classes.select(F.col("class_id").alias("id"), "items")
    pairs = near_in(exact_index(classes, threshold), items, common_items, threshold, lambda a, b: may_reach(threshold, a, b))
    side = lambda s: classes.select(F.col("class_id").alias(s), F.col("items").alias(f"i_{s}"), F.col("size").alias(f"size_{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return full.select("a", "b", "size_a", "size_b", exact(F.col("i_a"), F.col("i_b")).alias("jaccard_exact")).where(F.col("jaccard_exact") >= threshold)


def signature_text(minhash: Column) -> Column:
    return F.array_join(F.transform(minhash, hex16), ",")
