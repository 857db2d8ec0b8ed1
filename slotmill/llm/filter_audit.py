"""Filter interaction audit (operator 12): what five filters remove, in every order.

Native expressions give each row a mask of the filters it fails; whether a smaller doc_id has
the same text comes from a group-by of the texts' SHA-256. Rows are counted by part and mask:
32 cells a part, whatever the table's size. All 120 orders and their steps are sums over cells,
listed from a fixed array, so nothing but cells is ever enumerated.

Only ids, digests and masks move, never texts. Copies of a text combine before they move,
so a text that a third of all rows share is one row a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 2 ** len(FILTERS)


def text_mask(text: Column) -> Column:
    """The bits of A to D: the filters that look at one text alone."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    out = F.lit(0)
    for k, f in enumerate(fails):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of `docs` by part and failure mask. Not yet one a part
    and mask.

    Rows that share text, part and id combine first, then those that share text and part. The
    text's least id fails nothing by E, wherever it stands; nor does a row without an id.
    """
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.join(marked, "doc_id", "left").select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    ids = rows.withColumn("n", F.lit(1)).groupBy("doc_id", "part", "digest", "mask").agg(*counts)
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", "n", "good", "toxic"))).alias("first")
    free = [F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(f"free_{c}") for c in ("n", "good", "toxic")]
    texts = cut(ids.groupBy("part", "digest", "mask").agg(*counts, first, *free), "texts")
    # The id may stand in several parts: in each its rows stay.
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    both = texts.join(least, "digest")
    kept = {c: F.col(f"free_{c}") + F.when(F.col("first.doc_id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    sides = F.array(
        F.struct("mask", *(x.alias(c) for c, x in kept.items())),
        F.struct((F.col("mask") + CELLS // 2).alias("mask"), *((F.col(c) - x).alias(c) for c, x in kept.items())),
    )
    return both.select("part", F.inline(sides))


def orders(cells: DataFrame) -> DataFrame:
    """One row a part, order and step from `cells` (part, mask, n, good, toxic)."""
    columns = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for c in ("n", "good", "toxic") for m in range(CELLS)]
    parts = cells.groupBy("part").agg(*(F.array(*columns[i * CELLS : (i + 1) * CELLS]).alias(c) for i, c in enumerate(("n", "good", "toxic"))))
    each = parts.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: i < F.col("step"))
    full = each.withColumn("bit", _bit_at(F.col("step"))).withColumn("before", F.aggregate(earlier, F.lit(0), lambda b, i: b + _bit_at(i)))

    def total(values: str, wanted) -> Column:
        weighed = F.transform(values, lambda v, m: v * wanted(m))
        return F.aggregate(weighed, F.lit(0).cast("long"), lambda s, v: s + v)

    def fails(m: Column, bits: str) -> Column:
        return m.bitwiseAND(F.col(bits)) != 0

    def one(c: Column) -> Column:
        return c.cast("long")

    here = lambda m: one(fails(m, "bit") & ~fails(m, "before"))
    # Of the orders in which a row fails k filters, each of the k comes first in a k-th.
    share = lambda m: F.when(fails(m, "bit"), F.lit(len(ORDERS)) / F.bit_count(m)).otherwise(0).cast("long")
    return full.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("n", lambda m: one(~fails(m, "bit") & ~fails(m, "before"))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: one(fails(m, "bit") & fails(m, "before"))).alias("redundant"),
        F.element_at("n", F.col("bit") + 1).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", share).alias("shapley"),
    )


def _bit_at(step: Column) -> Column:
    """The bit of the filter at a step of `filter_order`."""
    return F.element_at(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), F.instr(F.lit(FILTERS), F.substring("filter_order", step, F.lit(1))))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): what filters A to E do to `docs` (doc_id, text, source, any others), part by part.

    A part is a value of `source`, null the empty string. 600 rows a part, zeros included. Null
    texts count as empty, and like empty ones fail A; very long texts are judged whole. Repeated
    rows count each; with equal ids none of them makes another a copy, nor does a row without
    an id. A repeated label counts if any of its rows has it. An empty table gives no rows.
    """
    return orders(masks(docs, labels))
