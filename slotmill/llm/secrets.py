"""Secret scans (operator 8): a trigram inverted index in front of regular expressions.

Every rule is a regular expression. From its syntax tree comes a Boolean query over trigrams
that any match must contain, brought to a disjunction of trigram sets. Of the trigrams in the
queries the index keeps the postings as bit columns: a row's bit in the column of a trigram says
that the trigram occurs in its text. A query intersects the columns of each of its sets and unites
the sets; only rows that remain are verified by the expression itself. A rule without mandatory
trigrams is run over all rows. Texts are indexed in lower case, which can only add candidates.
The columns stand beside the rows, so that no text moves: nothing here shuffles.

Native: DataFrame functions only. Offsets of matches are running sums of the lengths of the
matches and of what lies between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alternatives a rule's query may have; beyond, the wider query "no trigram" is used.
MAX_SETS = 32
#: Characters a class may have to be spelled out.
MAX_CLASS = 8
#: Trigrams in a column of posting bits.
BITS = 62
#: Matches of a text whose offsets are added up together; only speed depends on it.
RUN = 64


@dataclass(frozen=True)
class Rule:
    """`group` must have `least` characters, or the match is dropped.

    `regex` says what matches. Where a backtracking engine would try each character of a long run
    as a start, `once` has the same matches but enters a run at its first character alone, and
    doesn't give back what it took: a match begins where its run does, as the leftmost does.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    once: str = ""

    @property
    def search(self) -> str:
        return self.once or self.regex


#: A private key: its header through its END line, else through the lines of base64 after it.
#: Line breaks may be spelled \n, lines quoted or indented. Without END the lines are at most 256
#: (16 KB), as Java's expressions go a stack frame deeper with each.
_GAP = r"""[\x20\t\r\n\\>|*#"',;+-]+(?:r\\+)?"""
_LONG = "[A-Za-z0-9+/]" * 20 + "*"  # twenty at least, spelled out: DuckDB has no counts of more than 1000 in all
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[\x20\t\r\n]|\\[rn]){1,4}[A-Za-z]+-[A-Za-z]+:[^\r\n\\]*){0,8}"
    r"(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}{_LONG}={{0,2}}){{1,256}}(?:{_GAP}[A-Za-z0-9+/]{{1,19}}={{0,2}})?)?"
)

BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule(
        "jwt",
        r"[A-Za-z0-9_-]*eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        once=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    ),
    Rule("pem", PEM),
    Rule("login", r"[a-z0-9+.-]+://[^\s/:@]*:[^\s/:@]+@", once=r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s/:@]*+:[^\s/:@]++@"),
)
RULES = BASE + MORE

Sets = list[frozenset[str]]


def _and(a: Sets, b: Sets) -> Sets:
    out = list(dict.fromkeys(x | y for x in a for y in b))
    return out if len(out) <= MAX_SETS else [frozenset()]


def _trigrams(text: str) -> Sets:
    return [frozenset(text[i : i + 3] for i in range(len(text) - 2))]


def _any(texts: list[str]) -> Sets:
    return [s for t in texts for s in _trigrams(t)]


def _few(op, arg) -> list[str] | None:
    """The characters that an element stands for, in lower case, if they are at most MAX_CLASS."""
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and len(arg) <= MAX_CLASS and all(o is sre.LITERAL for o, _ in arg):
        return sorted({chr(c).lower() for _, c in arg})
    return None


def _query(items) -> Sets:
    """Trigram sets of a parsed sequence: any match contains all trigrams of one of them."""
    out, runs = [frozenset()], [""]
    for op, arg in items:
        few = _few(op, arg)
        if few and len(runs) * len(few) <= MAX_SETS:
            runs = [r + c for r in runs for c in few]
            continue
        out, runs = _and(out, _any(runs)), [""]
        if op is sre.SUBPATTERN:
            out = _and(out, _query(arg[3]))
        elif op is sre.BRANCH:
            out = _and(out, [s for branch in arg[1] for s in _query(branch)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            out = _and(out, _query(arg[2]))
    out = _and(out, _any(runs))
    return [s for s in out if not any(o < s for o in out)]


def trigram_query(regex: str) -> Sets:
    """Mandatory trigrams of `regex` in lower case, as alternatives; [empty set] if there are none."""
    return list(dict.fromkeys(_query(_parser.parse(regex))))


def _parts(text: Column, rule: Rule) -> Column:
    """array<struct<skip,take,ok>>: each match of the rule, after what lies before it; at last what follows."""
    whole = F.regexp_extract_all(text, F.lit(rule.search), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.search), F.lit(rule.group)), F.length)
    parts = F.arrays_zip(F.transform(F.split(text, rule.search, -1), F.length).alias("skip"), F.transform(whole, F.length).alias("take"), size.alias("size"))
    return F.transform(parts, lambda x: F.struct(x["skip"].alias("skip"), F.coalesce(x["take"], F.lit(0)).alias("take"), (x["size"] >= rule.least).alias("ok")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _added(some: Column, size) -> Column:
    return F.aggregate(some, F.lit(0).cast("long"), lambda n, x: n + size(x))


def _spans(parts: Column) -> Column:
    """array<struct<start,end>> of `_parts`, offsets in code points.

    A match begins after the parts before it in its run, and the runs before that. (A fold
    that carries the spans would copy all of them at each step.)
    """

    def length(x: Column) -> Column:
        return x["skip"] + x["take"]

    def of_runs(runs: Column, sizes: Column) -> Column:
        def of_run(run: Column, i: Column) -> Column:
            before = _added(F.slice(sizes, F.lit(1), i), lambda n: n)
            return F.transform(run, lambda x, j: F.struct((before + _added(F.slice(run, F.lit(1), j), length) + x["skip"]).alias("start"), x["take"].alias("take"), x["ok"].alias("ok")))

        hits = F.filter(F.flatten(F.transform(runs, of_run)), lambda x: x["ok"])
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["take"]).alias("end")))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda k: F.slice(parts, k * RUN + 1, F.lit(RUN)))
    return _let(runs, lambda r: _let(F.transform(r, lambda run: _added(run, length)), lambda sizes: of_runs(r, sizes)))


def postings(text: Column, terms: Sequence[str]) -> list[Column]:
    """The index of a text column (lower case) for `terms`, BITS of them to a column of bits."""
    out = []
    for at in range(0, len(terms), BITS):
        bits = [F.when(F.contains(text, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(terms[at : at + BITS])]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=False)] + bits[len(bits) // 2 * 2 :]
        out.append(bits[0])
    return out


def may_match(regex: str, index: Sequence[Column], terms: Sequence[str]) -> Column:
    """Whether a row of the index fulfils the trigram query of `regex`; true where it has none."""
    sets = trigram_query(regex)
    if not all(sets):
        return F.lit(True)
    any_set = F.lit(False)
    for s in sets:
        every = F.lit(True)
        for k, have in enumerate(index):
            if need := sum(1 << i for i, t in enumerate(terms[k * BITS : (k + 1) * BITS]) if t in s):
                every = every & (have.bitwiseAND(F.lit(need)) == F.lit(need))
        any_set = any_set | every
    return any_set


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _marked(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All columns of `docs` in a struct `row`, its text as `body` (null: empty) and `spans`, by start and rule."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("body"))
    terms = sorted({t for r in rules for s in trigram_query(r.regex) for t in s})
    index = [p.alias(f"p{k}") for k, p in enumerate(postings(F.col("low"), terms))]
    full = rows.withColumn("low", F.lower("body")).select("row", "body", *index)
    columns = [F.col(f"p{k}") for k in range(len(index))]
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = F.array(*(F.when(may_match(r.regex, columns, terms) & F.col("body").rlike(r.search), _parts(F.col("body"), r)) for r in rules))

    def labelled(parts: Column, i: Column) -> Column:
        return F.when(parts.isNotNull(), F.transform(_spans(parts), lambda s: F.struct(s["start"].alias("start"), i.alias("rule"), s["end"].alias("end"), F.get(kinds, i).alias("kind"))))

    return full.select("row", "body", F.array_sort(F.flatten(F.array_compact(F.transform(found, labelled)))).alias("spans"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<start,rule,end,kind>>) for every row of `docs` (doc_id, text, any others).

    Offsets count code points, ends are exclusive; matches of one rule are leftmost and don't
    overlap, those of different rules may. Null and empty texts have no spans. Repeated rows
    are scanned each; an empty table gives no rows. `rule` is the rule's place in `rules`.
    """
    return _marked(docs, rules).select(F.col("row.doc_id").alias("doc_id"), "spans")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret replaced by `mark`, overlapping ones by one; all rows stay.

    Only `text` changes, and `n_chars` with it where the table has that column. Rows without a
    secret stay as they are, null texts null, empty ones empty; repeated rows change alike; an
    empty table gives no rows.
    """
    marked = _marked(docs, rules)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("body"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, F.length("body"))))
    done = marked.select("row", F.when(F.size("spans") > 0, clean).alias("clean"))
    changed = {"text": F.coalesce("clean", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("clean"), "row.n_chars").cast(docs.schema["n_chars"].dataType)
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(found: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in base]
    first = F.filter("spans", lambda s: s["rule"] < len(base))
    return found.select("doc_id", *counts, F.sha2(joined(first), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
