"""The filter audit against a plain walk through every order, row by row."""

from __future__ import annotations

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from slotmill.llm.filter_audit import filter_audit

LONG = " ".join(f"w{i}" for i in range(260))
TEXTS = [None, "", LONG, LONG, LONG + " #", "word " * 300, "WORD " * 300, LONG.upper(), LONG + " $", "short", "a b\x0bc\x0cd\re\tf\n", "#", LONG + "ä" * 300 + "A" * 30, "x " * 20_000]


def plain(rows, labels):
    """(part, order, step) -> counts, by applying each order to each row."""
    good, toxic = ({i for i, *q in labels if q[k] == 1 and i is not None} for k in (0, 1))  # no id, no label
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].append(i)

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        return out + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and min(ids[t]) < i)

    out = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(i, fails(i, t)) for i, t, s in rows if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                earlier = set(order[:step])
                failing = [(i, x) for i, x in mine if f in x]
                removed = [i for i, x in failing if not earlier & set(x)]
                kept = sum(not (earlier | {f}) & set(x) for _, x in mine)
                out[part, "".join(order), step + 1] = [kept, len(removed), len(failing) - len(removed), sum(x == f for _, x in failing), sum(i in good for i in removed), sum(i in toxic for i in removed)]
    shapley = collections.Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("s0", None, "")[i % 3]) for i, t in enumerate(TEXTS)]
    return out + [out[2], (2, LONG, "other"), (None, LONG, "s0"), (None, None, None), (40, "", "only"), (41, LONG + " #", "s0")]


def test_against_brute_force(spark, rows):
    labels = [(i, (1, 0, None)[i % 3], (0, 1, None)[i % 3]) for i in range(0, 42, 2)] + [(None, 1, 1), (2, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("part", "mask", "digest", "n", "good", "toxic", "step", "bit"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = filter_audit(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes][2:] == ["int"] + ["bigint"] * 7
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert got == plain(rows, labels)


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.where("false"), labels).count() == 0
    got = filter_audit(docs, labels)
    assert got.count() == 600 * 4 and got.where("good_lost + toxic_lost > 0").isEmpty()
