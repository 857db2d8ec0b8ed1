"""The queries opN_<name> over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate
from .alignment import alignment, tokenizer_paths
from .common import table
from .filter_audit import filter_audit
from .language_id import identify
from .licenses import license_scan
from .near_dedup import near_duplicates
from .packing import pack, tokenizer_path
from .quality import quality
from .quality_rules import quality_rules
from .secrets import BASE, RULES, digest, find_secrets
from .token_counts import token_counts
from .token_counts import tokenizer_path as byte_tokenizer_path
from .toxicity import toxicity
from .url_filter import GLOBS, judge_urls, regex_of


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents. Texts without words are classes of their own, repeated rows share
    one, very long texts are compared whole; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document. Null and empty texts score by the bias alone, repeated rows alike, very long
    texts whole; an empty table gives no rows."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Texts without a letter are `und`, repeated rows are judged alike, very long
    texts whole; an empty table gives no rows."""
    return identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences. Null and empty texts are the end id alone, repeated rows are packed
    each, very long texts in pieces of a sequence; an empty table gives no rows."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document. Null and empty texts have none, repeated rows the same, very long
    texts are scanned whole; an empty table gives no rows."""
    return license_scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, with source and language as its site. Null and empty texts are texts without
    words, repeated rows are judged alike, very long texts whole; an empty table gives no rows."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url. A null url has no host and no path, repeated rows are judged each, very
    long urls whole; an empty table gives no rows."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Null and empty texts have none, repeated rows are scanned each, very long texts
    whole and in linear time; an empty table gives no rows."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on every document. Null texts have no words, repeated rows are judged alike, very long texts
    are counted whole; an empty table gives no rows."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null texts have no words, repeated rows share their result, very long
    texts are searched whole; an empty table, on either side, gives no hits."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, spliced from overlapping chunks where it is long. Null and empty
    texts have none, repeated rows are counted each, an empty table gives no rows."""
    return token_counts(table(spark, sf_dir, "documents"), byte_tokenizer_path())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, by source. Null texts are empty, repeated rows count each, an
    empty table gives no rows."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned by bytes, with corpus-wide counts of id pairs. Null and
    empty texts have zeros, repeated rows count each, an empty table gives no rows."""
    return alignment(table(spark, sf_dir, "documents"), *tokenizer_paths())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_toxicity,
        op3_language_id,
        op4_packing,
        op5_license_scan,
        op6_quality,
        op7_url_filter,
        op8_secrets,
        op9_quality_rules,
        op10_decontamination,
        op11_token_counts,
        op12_filter_audit,
        op13_cross_tokenizer,
    )
}

_GLOB_ROWS = ", ".join(f"({i}, '{g}', '{regex_of(g)}')" for i, g in enumerate(GLOBS))



def _spans_sql(k: int, kind: str, regex: str, group: int, least: int) -> str:
    regex = regex.replace("'", "''")
    return f"""
SELECT rid, {k} AS k, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(m[i]) AS BIGINT) AS e FROM (
  SELECT rid, i, m, v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM (
    SELECT rid, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, string_split_regex(t, '{regex}') AS g, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {group}) AS v
      FROM d WHERE regexp_matches(t, '{regex}'))))
WHERE length(v[i]) >= {least}"""


_SPANS = " UNION ALL ".join(_spans_sql(k, r.kind, r.regex, r.group, r.least) for k, r in enumerate(RULES))

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         translate(coalesce(regexp_extract(url, '(?s)^[^#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS canon
  FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT rid, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS v
      FROM p JOIN r ON ends_with('.' || host, '.' || h) AND starts_with(path, q) GROUP BY rid),
g(k, pattern, regex) AS (VALUES {_GLOB_ROWS}),
m AS (SELECT rid, arg_min(pattern, k) AS pattern FROM p JOIN g ON regexp_full_match(canon, regex) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern AS glob
FROM p LEFT JOIN f USING (rid) LEFT JOIN m USING (rid)
""",
    "op8_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_SPANS}),
a AS (
  SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) AS base
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS o FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS a FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(a, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
""",
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
x AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
k(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.a || q.a || r.a || s.a || u.a AS filter_order FROM k p, k q, k r, k s, k u
      WHERE len(list_distinct([p.a, q.a, r.a, s.a, u.a])) = 5),
os AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
e AS (
  SELECT part, filter_order, step, n, good, toxic, fails[instr('ABCDE', substr(filter_order, step, 1))] AS here,
         list_bool_or([false] || list_transform(range(1, step), lambda i: fails[instr('ABCDE', substr(filter_order, i, 1))])) AS earlier,
         len(list_filter(fails, lambda b: b)) = 1 AS alone
  FROM c, os),
r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
         coalesce(sum(n) FILTER (WHERE NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (WHERE here AND alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE here AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT earlier), 0) AS toxic_lost
  FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
""",
}
