"""Quality rules (operator 9): robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. Per language and source the minimum
covariance determinant estimate gives a centre and a scatter that a minority of odd texts
can't move. It is sought from several starts (the coordinate-wise quartiles, scaled by the floors,
which no rows can inflate): concentration steps take the (n + p + 1) / 2 of n rows in p coordinates
that lie nearest by Mahalanobis distance and estimate anew from them. After a few steps each group
goes on from the start whose scatter has the least determinant, until that falls no more; a last
step takes all rows within the RELIABLE distance. Equal vectors count once in all of this. Texts farther than CUTOFF are rejected, as
are those that fail the base rules, which take no part in the estimates.

Native: DataFrame functions only. One pass over the narrow table of statistics per step: rows
are summed by group and distance bin (counts, sums, products), the bins are cut at that half (the
last one counts in part, so that many copies in it don't all get in), and the Cholesky factors of
all groups are column expressions. Groups are never gathered; a group holding any share of the
rows combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

#: Rows that a group needs for an estimate of its own; smaller ones are pooled by language, then altogether.
LEAST_ROWS = 40
#: Starts: quantiles of each coordinate. Steps from all of them, then steps from the best one at most,
#: and the fall of the logarithm of the determinant that counts as none.
STARTS, STEPS, MORE_STEPS, NO_FALL = (0.5, 0.25, 0.75), 2, 10, 1e-3
#: Chi-square 0.975 of six coordinates; squared distance beyond which a text goes. The vectors aren't
#: Gaussian (counts that are mostly 0, few languages and lengths in a group), so the cut-off lies far
#: beyond any chi-square quantile; README has the shares of good documents beyond each.
RELIABLE, CUTOFF = 14.45, 80.0
#: Consistency factor in six coordinates where an estimate rests on a half and on 0.6 of a group; linear between.
CONSISTENCY = (1.7845, 1.5942)
#: Distance bins: as many to a factor of e.
BINS = 24
#: Tables of groups up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
#: Least standard deviation of each coordinate: what counts as no difference.
FLOOR = {"v0": 0.25, "v1": 0.25, "v2": 0.12, "v3": 0.08, "v4": 0.06, "v5": 0.04}
MIN_WORDS, MAX_REPEAT = 50, 50

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a window's place beside those of its hash.
PLACE_BITS = 26


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column, place_bits: int = PLACE_BITS) -> Column:
    """Words that lie in three-word windows found twice or more; linear but for sorts.

    Windows are sorted as numbers, hash bits above and the place below. Only neighbours that
    agree in the hash bits can be equal. If the words of all such neighbours are equal, too, their
    places are those of the repeated windows; if not (hash bits that agree by chance could
    part equal windows), or if places don't fit, the windows are sorted by their words.
    """
    low = (1 << place_bits) - 1
    none = F.expr("cast(array() as array<bigint>)")

    def alike(a: Column, b: Column) -> Column:
        return F.shiftright(a, place_bits) == F.shiftright(b, place_bits)

    def place(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def beside(p: Column, same):
        """The elements of `p` with an equal neighbour."""
        before = lambda x, k: F.when(k > 0, same(p[k - 1], x)).otherwise(F.lit(False))
        after = lambda x, k: F.when(k < F.size(p) - 1, same(p[k + 1], x)).otherwise(F.lit(False))
        return F.filter(p, lambda x, k: before(x, k) | after(x, k))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.sort_array(places), start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        numbers = F.when(F.size(w) >= 3, F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(~low).bitwiseOR(i.cast("long")))).otherwise(none)

        def differ(a: Column, b: Column) -> Column:
            i, j = place(a), place(b)
            return (w[i] != w[j]) | (w[i + 1] != w[j + 1]) | (w[i + 2] != w[j + 2])

        def by_words() -> Column:
            same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
            windows = F.transform(places, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.cast("long").alias("i")))
            return covered(_let(F.sort_array(windows), lambda p: F.transform(beside(p, same), lambda x: x["i"])))

        def counted(near: Column) -> Column:
            chance = F.filter(near, lambda x, k: F.when(k > 0, alike(near[k - 1], x) & differ(near[k - 1], x)).otherwise(F.lit(False)))
            return F.when((F.size(w) > low) | (F.size(chance) > 0), by_words()).otherwise(covered(F.transform(near, lambda x: x.bitwiseAND(low))))

        return _let(_let(F.sort_array(numbers), lambda p: beside(p, alike)), counted)

    return _let(words, of)


def base_statistics(text: Column) -> dict[str, Column]:
    """The counted statistics of a text without nulls."""
    words = F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, SPACES) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
        "_upper": (F.length(text) - F.length(_without(text, UPPER))).cast("long"),
    }


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "v0": F.log1p(F.col("n_words")),
        "v1": F.col("word_chars") / n,
        "v2": F.log1p(20 * F.col("n_symbols") / n),
        "v3": F.log1p(F.col("n_dup_lines")) / F.log(n + 2),
        "v4": F.col("n_repeat_words") / n,
        "v5": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


DIMS = tuple(FLOOR)
PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]


def _sized(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    for i, a in enumerate(DIMS):
        z = F.col(a) - F.col(f"m_{a}")
        for b in DIMS[:i]:
            z = z - F.col(f"l_{a}{b}") * F.col(f"z_{b}")
        rows = rows.withColumn(f"z_{a}", z / F.col(f"l_{a}{a}"))
    return rows.withColumn("d2", sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in DIMS), F.lit(0.0))).drop(*(f"z_{a}" for a in DIMS))


def _factor(groups: DataFrame) -> DataFrame:
    """From (grp, start, m_*, s_*): (grp, start, m_*, l_*, logdet), the Cholesky factor of the scatter
    with the floors added, and the logarithm of its determinant."""
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            s = F.col(f"s_{a}{b}") + (FLOOR[a] ** 2 if a == b else 0.0)
            for c in DIMS[:j]:
                s = s - F.col(f"l_{a}{c}") * F.col(f"l_{b}{c}")
            groups = groups.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(s, F.lit(1e-9))) if a == b else s / F.col(f"l_{b}{b}"))
    logdet = sum((2 * F.log(F.col(f"l_{a}{a}")) for a in DIMS), F.lit(0.0))
    return groups.select("grp", "start", *(f"m_{a}" for a in DIMS), *(f"l_{a}{b}" for a, b in PAIRS), logdet.alias("logdet"))


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates per group: quantiles, from fixed-width bins, and no scatter but the floors."""
    long = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(a).alias("dim"), F.floor(F.col(a) / (FLOOR[a] / 8)).alias("bin")) for a in DIMS))).alias("x"))
    binned = long.groupBy("grp", "x.dim", "x.bin").count()
    order = Window.partitionBy("grp", "dim").orderBy("bin")
    share = binned.withColumn("upto", F.sum("count").over(order) / F.sum("count").over(Window.partitionBy("grp", "dim")))
    q = share.groupBy("grp", "dim").agg(F.array(*(F.min(F.when(F.col("upto") >= x, F.col("bin"))) for x in STARTS)).alias("at"))
    q = q.select("grp", "dim", F.posexplode("at").alias("start", "mid"))
    pick = lambda a, c: F.max(F.when(F.col("dim") == a, c))
    wide = q.groupBy("grp", "start").agg(*(pick(a, (F.col("mid") + 0.5) * (FLOOR[a] / 8)).alias(f"m_{a}") for a in DIMS))
    return wide.withColumns({f"s_{a}{b}": F.lit(0.0) for a, b in PAIRS})


def _estimate(rows: DataFrame, groups: DataFrame, reliable: bool) -> DataFrame:
    """The next (grp, start, m_*, s_*): from the nearest half of each group, or from all reliable rows."""
    full = _distance(rows.join(_sized(groups.drop("logdet")), "grp"))
    sums = [F.count("*").alias("n"), *(F.sum(a).alias(f"t_{a}") for a in DIMS), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a, b in PAIRS)]
    if reliable:
        got, factor = full.where(F.col("d2") <= RELIABLE).groupBy("grp", "start").agg(*sums), 1.0
    else:
        binned = full.withColumn("bin", F.floor(F.log1p("d2") * BINS)).groupBy("grp", "start", "bin").agg(*sums)
        order = Window.partitionBy("grp", "start").orderBy("bin")
        before = F.sum("n").over(order) - F.col("n")
        counted = binned.withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "start")))
        half = F.floor((F.col("all") + len(DIMS) + 1) / 2)
        near = counted.withColumn("part", F.least(F.lit(1.0), (half - F.col("before")) / F.col("n"))).where("part > 0")
        got = near.groupBy("grp", "start").agg(F.first("all").alias("all"), *(F.sum(F.col(c) * F.col("part")).alias(c) for c in ("n", *(f"t_{a}" for a in DIMS), *(f"p_{a}{b}" for a, b in PAIRS))))
        factor = CONSISTENCY[0] - (CONSISTENCY[0] - CONSISTENCY[1]) * (F.col("n") / F.col("all") - 0.5) / 0.1
    mean = {a: F.col(f"t_{a}") / F.col("n") for a in DIMS}
    return got.select("grp", "start", *(mean[a].alias(f"m_{a}") for a in DIMS), *((factor * (F.col(f"p_{a}{b}") / F.col("n") - mean[a] * mean[b])).alias(f"s_{a}{b}") for a, b in PAIRS))


def _least(groups: DataFrame) -> DataFrame:
    """Of each group the estimate with the least determinant, ties by the first start."""
    rest = [c for c in groups.columns if c not in ("grp", "start", "logdet")]
    best = groups.groupBy("grp").agg(F.min(F.struct("logdet", "start", *rest)).alias("x"))
    return best.select("grp", *(F.col(f"x.{c}").alias(c) for c in groups.columns if c != "grp"))


def falling(best: DataFrame, nearer: DataFrame) -> DataFrame:
    """The estimates of `nearer` whose determinant is less than their group's in `best`: floors and
    the consistency factor may let a step's rise, and such a step isn't taken."""
    was = best.select("grp", F.col("logdet").alias("was"))
    return nearer.join(was, "grp").where(F.col("logdet") < F.col("was") - NO_FALL).drop("was")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(grp, m_*, l_*) for `rows` (grp, v0..v5): centre and Cholesky factor of each group. Equal
    vectors of a group count once: a group of copies has no scatter, so it would win any determinant."""
    rows = cut(rows.select("grp", *DIMS).distinct(), "vectors")
    groups = cut(_factor(_starts(rows)), "mcd")
    for _ in range(STEPS):
        groups = cut(_factor(_estimate(rows, groups, reliable=False)), "mcd")
    best = cut(_least(groups), "mcd")
    for _ in range(MORE_STEPS):
        # Written first: a filter on a determinant would spell out all factors it is made of.
        nearer = falling(best, cut(_factor(_estimate(rows, best, reliable=False)), "mcd"))
        if nearer.isEmpty():
            break
        best = cut(_least(best.unionByName(nearer)), "mcd")
    return cut(_factor(_estimate(rows, best, reliable=True)).drop("start", "logdet"), "mcd")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang, source, any others): the statistics,
    base_failed, kept and distance (squared, null where nothing was estimated).

    Null texts have no words. Null languages and sources are groups like others. Groups under
    LEAST_ROWS are pooled; where even the last pool is smaller, only the base rules decide.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    with Scratch():
        return cut(_judged(docs), "judged", result=True)


def _judged(docs: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    counted = plain.select("doc_id", "lang", "source", *(c.alias(k) for k, c in base_statistics(F.col("text")).items()))
    stats = cut(counted, "statistics")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumns(_vector())
    good = judged.where(~F.col("base_failed"))
    sites = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\1", "lang", "source"))
    pools = sites.where(F.col("n") < LEAST_ROWS).groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("pooled"))
    pool = F.when(F.col("pooled") >= LEAST_ROWS, F.concat_ws("\1", "lang", F.lit(""), F.lit("")))
    named = sites.join(pools, F.col("lang") == F.col("of"), "left").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.coalesce(own, pool, F.lit("")).alias("grp"))
    named = _sized(cut(named, "groups"))
    rows = judged.join(named, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left")
    fitted = rows.where(~F.col("base_failed")).select("grp", *DIMS)
    enough = fitted.where("grp = ''").limit(LEAST_ROWS).count() >= LEAST_ROWS
    estimates = robust_estimates(fitted if enough else fitted.where("grp <> ''"))
    full = _distance(rows.join(_sized(estimates), "grp", "left"))
    kept = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= CUTOFF))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))
