"""MinHash near-dedup (operator 1): BagMinHash over multisets of five-word shingles.

A document is the multiset of its five-word shingles (lower-cased words; a shorter text is
one shingle). The similarity of two documents is their weighted Jaccard: the sum of the
smaller multiplicities over the sum of the larger.

Signature. Each shingle owns a hierarchy of Poisson processes, one for every dyadic interval
[0,1), [1,2), [2,4), [4,8) ... of the discretised weight axis. A process emits points in
ascending order; each falls on one signature component and on one weight level, by hashes of
(shingle, interval, point number) alone, and counts only if its level lies below the
shingle's multiplicity. A component holds the identity of its least point, so two documents
agree there with probability exactly equal to their weighted Jaccard. Points beyond the
largest component minimum can't matter: processes stop at a bound that is doubled for the
few documents in which it left a component empty, hence no bias.

Search. Equal texts (same word sequence) collapse first. Signatures are cut in bands; texts
that share a band are candidates. Verification is the exact multiset overlap, in three rounds
that never list the pairs of a group: (1) each text against the leader it shares most bands
with, (2) in buckets that still mix components, all pairs between components if the bucket is
small, else each text that can reach the threshold there against the text with the smallest
share of shingles of its own, (3) what remains between different components of large mixed
buckets, in full, chunk against chunk. A text can reach the threshold only if enough of its
shingles occur in other texts of large mixed buckets at all. A bucket whose members are all
in one component needs no further pair, so no link between different classes is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Scratch, WordIds, components, cut, maybe_in, mix, shingles, slices

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: Components of a signature at most, where bands are chosen for another threshold.
MOST = 256
#: Members up to which a mixed bucket's pairs are listed.
SMALL = 8
#: Texts and shingles that a chunk of a mixed bucket has on average.
CHUNK_ROWS, CHUNK_MASS = 256, 100_000

_LEVEL = np.uint64(0xA24BAED4963EE407)
_POINT = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Search:
    """Which pairs are near: those at `threshold` or more. `bands` of `rows` components find them."""

    threshold: float = THRESHOLD
    bands: int = BANDS
    rows: int = ROWS

    @classmethod
    def at(cls, threshold: float, miss: float = 1e-4) -> Search:
        """The longest bands that miss a pair at the threshold with a probability of `miss` at most, within
        MOST components; single components if even those miss more."""
        if not 0 < threshold <= 1:
            raise ValueError("a threshold of near-duplicates lies above 0 and is 1 at most")
        for rows in range(MOST, 0, -1):
            p = threshold**rows
            bands = 1 if p >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-p)) if p > 1e-9 else MOST + 1
            if bands * rows <= MOST:
                return cls(threshold, bands, rows)
        return cls(threshold, MOST, 1)

    def missed(self, similarity: float) -> float:
        """The probability that a pair of this similarity shares no band."""
        return (1 - similarity**self.rows) ** self.bands


DEFAULT = Search()


def bag(ids: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their multiplicities."""
    return np.unique(shingles(ids, width), return_counts=True)


def _processes(keys: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, document, interval start, interval length, multiplicity) of every process."""
    seeds, owner, low, length, weight = [], [], [], [], []
    start, k = 0, 0
    while len(keys):
        size = max(1, start)
        seeds.append(mix(keys + np.uint64(int(_LEVEL) * (k + 1) % 2**64)))
        owner.append(docs)
        low.append(np.full(len(keys), start))
        length.append(np.full(len(keys), size))
        weight.append(counts)
        start, k = start + size, k + 1
        more = counts > start
        keys, counts, docs = keys[more], counts[more], docs[more]
    return tuple(map(np.concatenate, (seeds, owner, low, length, weight)))


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (documents x m, uint64) of non-empty multisets (keys, multiplicities)."""
    n = len(bags)
    out = np.zeros((n, m), np.uint64)
    if not n:
        return out
    sizes = np.array([len(k) for k, _ in bags])
    seeds, owner, low, length, weight = _processes(
        np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags]), np.repeat(np.arange(n), sizes)
    )
    total = np.array([c.sum() for _, c in bags], float)
    bound = (np.log(m) + 3) / total
    todo = np.arange(n)
    while len(todo):
        own = np.isin(owner, todo) if len(todo) < n else slice(None)
        s, d, lo, ln, w = seeds[own], owner[own], low[own], length[own], weight[own]
        least = np.full(n * m, np.inf)
        who = np.zeros(n * m, np.uint64)
        at = np.zeros(len(s))
        k = 1
        cells, xs, names = [], [], []
        while len(s):
            h = mix(s + np.uint64(int(_POINT) * k % 2**64))
            at = at - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (m * ln)
            keep = at <= bound[d]
            s, d, lo, ln, w, at, h = s[keep], d[keep], lo[keep], ln[keep], w[keep], at[keep], h[keep]
            g = mix(h ^ _LEVEL)
            level = lo + ((g & np.uint64(0xFFFFFFFF)).astype(np.int64) * ln >> 32)
            hit = level < w
            cells.append((d * m + ((g >> np.uint64(32)).astype(np.int64) * m >> 32))[hit])
            xs.append(at[hit])
            names.append(h[hit])
            k += 1
        cell, x, name = np.concatenate(cells), np.concatenate(xs), np.concatenate(names)
        order = np.lexsort((name, x, cell))
        first = order[np.r_[True, cell[order][1:] != cell[order][:-1]]] if len(order) else order
        least[cell[first]], who[cell[first]] = x[first], name[first]
        full = np.isfinite(least.reshape(n, m)).all(axis=1)
        done = todo[full[todo]]
        out[done] = who.reshape(n, m)[done]
        todo = todo[~full[todo]]
        bound[todo] *= 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band (documents x bands), distinct between bands."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = mix(key * _POINT + sig[:, r::rows][:, :bands])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[pa.RecordBatch]:
    cache = WordIds()
    for part in slices(batches):
        ids = [cache.of(WORDS((t or "").lower())) for t in part.column("text").to_pylist()]
        at = [i for i, x in enumerate(ids) if len(x)]
        keys = band_keys(bag_minhash([bag(ids[i]) for i in at], search.bands * search.rows), search.bands, search.rows).view(np.int64)
        where = dict(zip(at, range(len(at)), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("th"),
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in ids], pa.binary()),
                pa.array([max(0, len(x) - WIDTH + 1) if len(x) >= WIDTH else min(1, len(x)) for x in ids], pa.int64()),
                pa.array([keys[where[i]] if i in where else None for i in range(len(ids))], pa.list_(pa.int64())),
            ],
            ["doc_id", "th", "digest", "n", "bands"],
        )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordIds()
    for part in slices(batches):
        ids = [x for x in (cache.of(WORDS((t or "").lower())) for t in part.column("text").to_pylist()) if len(x)]
        digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in ids], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, pa.array([np.sort(shingles(x, WIDTH)).tobytes() for x in ids], pa.binary())], ["digest", "bag"])


def overlap(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard of two sorted shingle lists (with repeats)."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    (ux, cx), (uy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(uy, ux), len(uy) - 1)
    both = int(np.minimum(cx, np.where(uy[at] == ux, cy[at], 0)).sum())
    return both / (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        ok = [overlap(x, y) >= threshold for x, y in zip(part.column("bag_a").to_pylist(), part.column("bag_b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        at, keys, times = [], [], []
        for i, x in enumerate(part.column("bag").to_pylist()):
            k, n = np.unique(np.frombuffer(x, np.uint64), return_counts=True)
            at.append(np.full(len(k), i)), keys.append(k.view(np.int64)), times.append(n)
        if at:
            yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(times).astype(np.int64))], ["digest", "shingle", "times"])


def _within(threshold: float, shared: Column, n: Column, m: Column) -> Column:
    """Whether texts of n and m shingles can reach the threshold if they share `shared` at most."""
    return shared >= F.lit(threshold) * (n + m - shared)


def _flat(members: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles with repetitions told apart, ascending, their owners, and the sizes of the members."""
    bags = [np.frombuffer(x["bag"], np.uint64) for x in members]
    size = np.array([len(x) for x in bags])
    value, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
    first = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
    at = np.arange(len(value))
    value = mix(value + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _POINT)
    order = np.argsort(value, kind="stable")
    return value[order], owner[order], size


def links_between(left: list[dict], right: list[dict], threshold: float = THRESHOLD) -> list[tuple[bytes, bytes]]:
    """One link for each two components with members (digest, label, bag) that reach the threshold."""
    value, owner, size = _flat(right)
    codes: dict[bytes, int] = {}
    label = np.array([codes.setdefault(x["label"], len(codes)) for x in right])
    found: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
    for x in left:
        mine, _, (n,) = _flat([x])
        lo, hi = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
        reach = hi - lo
        at = np.repeat(lo - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for j in np.nonzero((both >= threshold * (n + size - both)) & (label != codes.get(x["label"], -1)))[0]:
            pair = tuple(sorted((x["digest"], right[j]["digest"])))
            found.setdefault(tuple(sorted((x["label"], right[j]["label"]))), pair)
    return list(found.values())


def _cross(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        links = links_between(part.column("p").to_pylist()[0], part.column("q").to_pylist()[0], threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def _across(fit: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components of the same bucket of `fit` (key, digest, n, label).

    Each bucket's largest component is its major side. Both sides are dealt into chunks of
    bounded size; minor chunks meet major chunks and each other, and only links leave a meeting.
    Meetings are listed as numbers first and get their chunks after, so that those of a large
    bucket are spread over tasks.
    """
    sizes = fit.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("mass"))
    major = sizes.groupBy("key").agg(F.max(F.struct("rows", "label", "mass")).alias("m"), F.sum("rows").alias("rows"), F.sum("mass").alias("mass"))
    major = major.where("m.rows < rows")
    rows = fit.join(major, "key").withColumn("major", F.col("label") == F.col("m.label"))
    count = F.when(F.col("major"), F.col("m.rows")).otherwise(F.col("rows") - F.col("m.rows"))
    mass = F.when(F.col("major"), F.col("m.mass")).otherwise(F.col("mass") - F.col("m.mass"))
    parts = F.greatest(F.ceil(count / CHUNK_ROWS), F.ceil(mass / CHUNK_MASS))
    dealt = rows.select("key", "digest", "label", "major", F.pmod(F.xxhash64("digest"), parts).alias("chunk")).join(bags, "digest")
    named = dealt.withColumn("id", F.xxhash64("key", "major", "chunk")).groupBy("key", "major", "chunk", "id")
    chunks = cut(named.agg(F.collect_list(F.struct("digest", "label", "bag")).alias("members")), "chunks")
    minor = chunks.where(~F.col("major")).select("key", F.col("chunk").alias("c"), F.col("id").alias("id_p"))
    other = chunks.select("key", "major", "chunk", F.col("id").alias("id_q"))
    met = cut(minor.join(other, "key").where(F.col("major") | (F.col("chunk") >= F.col("c"))).select("id_p", "id_q"), "meetings")
    full = met.join(chunks.select(F.col("id").alias("id_p"), F.col("members").alias("p")), "id_p").join(chunks.select(F.col("id").alias("id_q"), F.col("members").alias("q")), "id_q")
    return full.select("p", "q").mapInArrow(partial(_cross, threshold=threshold), "a binary, b binary").distinct()


def _checked(pairs: DataFrame, bags: DataFrame, name: str, threshold: float) -> DataFrame:
    """`pairs` (a, b) with whether they reach the threshold."""
    full = pairs.join(bags.select(F.col("digest").alias("a"), F.col("bag").alias("bag_a")), "a").join(
        bags.select(F.col("digest").alias("b"), F.col("bag").alias("bag_b")), "b"
    )
    return cut(full.select("a", "b", "bag_a", "bag_b").mapInArrow(partial(_verify, threshold=threshold), "a binary, b binary, ok boolean"), name, 500)


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_duplicates(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """(doc_id, class_id, n_shingles) for every row of `docs` (doc_id, text, any others).

    `class_id` is the least doc_id of the row's near-duplicate class. A text without words
    (null, empty, punctuation only) has no shingle and is never a duplicate: its class is its
    own id. Repeated rows are equal texts and share a class. Very long texts are compared
    whole. An empty table gives no rows. `search` sets the threshold: `Search.at(0.5)`.
    """
    with Scratch():
        return _classes(docs, search)


def _classes(docs: DataFrame, search: Search) -> DataFrame:
    rows = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(partial(_sketch, search=search), f"{_id(docs)}, th long, digest binary, n long, bands array<long>"), "sketch")
    own = rows.where("digest is not null").groupBy("digest")
    texts = cut(own.agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "th")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    # Keys alone are counted first; only members of shared keys go on.
    keys = texts.select("digest", "n", F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "shared")
    maybe, _ = maybe_in(keys, F.col("key"), shared.select(F.col("key").alias("hash")))
    member = cut(maybe.join(shared, "key"), "members")
    ends = member.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("lo"), F.max(F.struct("digest", "n")).alias("hi"))
    buckets = cut(member.join(ends, "key").select("key", "digest", "n", "lo", "hi"), "buckets")

    def close(n, m):
        return F.least(n, m) >= F.lit(search.threshold) * F.greatest(n, m)

    # The texts of candidates are read again: far fewer than all. The bitmap lets a few others
    # through, whose shingles are made in vain.
    wanted = buckets.select("digest").distinct().join(texts.select("digest", F.xxhash64("first.doc_id", "first.th").alias("hash")), "digest")
    wanted = cut(wanted, "wanted")
    again = docs.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("row"))
    again, _ = maybe_in(again, F.col("row"), wanted.select("hash"))
    bags = cut(again.mapInArrow(_bags, "digest binary, bag binary"), "bags")
    if bags.count() > 2 * wanted.count():  # many rows that repeat id and text
        bags = cut(bags.dropDuplicates(["digest"]), "bags")

    def star(end):
        return buckets.where((F.col("digest") != F.col(f"{end}.digest")) & close(F.col("n"), F.col(f"{end}.n"))).select("digest", F.col(f"{end}.digest").alias("lead"))

    votes = star("lo").union(star("hi")).groupBy("digest", "lead").count()
    best = votes.groupBy("digest").agg(F.max(F.struct("count", "lead")).alias("m"))
    one = _checked(best.select(*_ordered(F.col("digest"), F.col("m.lead"))).distinct(), bags, "round1", search.threshold)
    links = one.where("ok").select("a", "b")
    label = components(links, "cc1")

    # Buckets whose members are in more than one component so far.
    at = buckets.join(label, buckets.digest == label.node, "left").select("key", "digest", "n", F.coalesce("label", "digest").alias("label"))
    some = at.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("members")).where("l0 <> l1").select("key", "members")
    open_ = cut(at.join(some, "key"), "mixed")
    # Of small ones all pairs between components are few.
    few = open_.where(F.col("members") <= SMALL)
    left = few.select("key", F.col("label").alias("x"), F.col("digest").alias("p"), F.col("n").alias("n_p"))
    right = few.select("key", F.col("label").alias("y"), F.col("digest").alias("q"), F.col("n").alias("n_q"))
    pairs = left.join(right, "key").where((F.col("x") < F.col("y")) & close(F.col("n_p"), F.col("n_q"))).select(*_ordered(F.col("p"), F.col("q")))
    # In large ones only such texts matter as can have a partner there: shingles that no other
    # text of large mixed buckets has can't be shared with any partner.
    many = open_.where(F.col("members") > SMALL).drop("members")
    large = cut(many.select("digest").distinct(), "large")
    some, _ = maybe_in(bags, F.xxhash64("digest"), large.select(F.xxhash64("digest").alias("hash")))
    counts = some.join(large, "digest", "left_semi").mapInArrow(_counts, "digest binary, shingle long, times long")
    counts = counts.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("digest").alias("digest"), F.min("times").alias("times"))
    own = cut(counts.where("texts = 1").groupBy("digest").agg(F.sum("times").alias("own")), "own")
    many = cut(many.join(own, "digest", "left").select("key", "digest", "n", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")), "many")

    def able(o: DataFrame) -> DataFrame:
        """Rows that can reach the threshold with the shortest text of their bucket."""
        least = o.groupBy("key").agg(F.min("n").alias("n_min"))
        return o.join(least, "key").where(_within(search.threshold, F.col("shared"), F.col("n"), F.greatest("n_min", "shared"))).drop("n_min")

    fit = cut(able(many), "fit")
    leads = fit.groupBy("key").agg(F.max(F.struct(F.col("shared") / F.col("n"), "digest", "n", "shared", "label")).alias("l"))
    star2 = fit.join(leads, "key").where((F.col("label") != F.col("l.label")) & _within(search.threshold, F.least("shared", "l.shared"), F.col("n"), F.col("l.n")))
    star2 = star2.select(*_ordered(F.col("digest"), F.col("l.digest")))
    two = _checked(pairs.union(star2).distinct().join(one.select("a", "b"), ["a", "b"], "left_anti"), bags, "round2", search.threshold)
    if not two.where("ok").isEmpty():
        links = links.union(two.where("ok").select("a", "b"))
        label = components(links, "cc2")
        many = many.drop("label").join(label, many.digest == label.node, "left").select("key", "digest", "n", "shared", F.coalesce("label", "digest").alias("label"))
        fit = cut(able(many), "fit")
    three = cut(_across(fit, bags, search.threshold), "round3", 4)
    if not three.isEmpty():
        label = components(links.union(three), "cc3")

    ids = texts.select("digest", "least_id").join(label, texts.digest == label.node, "left").select("digest", "least_id", F.coalesce("label", "digest").alias("label"))
    least = ids.groupBy("label").agg(F.min("least_id").alias("class_id"))
    of = ids.join(least, "label").select("digest", "class_id")
    return cut(rows.join(of, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").alias("n_shingles")), "classes", result=True)


def _id(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def deduplicate(docs: DataFrame, search: Search = DEFAULT) -> DataFrame:
    """`docs` with one row of each near-duplicate class: the row whose doc_id is the class id.

    Rows that repeat an id stay apart if their texts differ; of equal ones one stays. Rows
    with a null doc_id all stay, and so do texts without words.
    """
    near = near_duplicates(docs, search)
    marks = cut(near.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("_slotmill_stays"), F.count("*").alias("_slotmill_rows")), "kept")
    # Most rows stay and are told by a bitmap that they do: they aren't shuffled.
    odd = marks.where("doc_id is not null and (_slotmill_stays = 0 or _slotmill_rows > 1)").withColumnRenamed("doc_id", "_slotmill_id")
    maybe, surely = maybe_in(docs, F.xxhash64("doc_id"), odd.select(F.xxhash64("_slotmill_id").alias("hash")))
    known = maybe.join(odd, maybe["doc_id"] == F.col("_slotmill_id"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = surely.unionByName(known.where("_slotmill_id is null").select(*columns))
    if not odd.where("_slotmill_stays = 1").isEmpty():
        kept = kept.unionByName(known.where("_slotmill_stays = 1").select(*columns).dropDuplicates(["doc_id", "text"]))
    return kept
