"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

_DOCS = "prog AS (SELECT CAST(doc_id AS VARCHAR) AS program_id, hex(encode(coalesce(text, ''))) AS t FROM documents)"
_EDIT = "substr(t, 1, 16 * (length(t) // 32)) || '5858585858585858' || substr(t, 16 * (length(t) // 32) + 17)"
_PLAIN = "plain AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, hex(encode(coalesce(text, ''))) AS t FROM conversations)"
#: Turns with their copies, with a slot overwritten, and with half of them repeated a byte out of step.
_TURNS = f"""{_PLAIN},
prog AS (SELECT id AS program_id, t FROM plain UNION ALL SELECT id || '~copy', t FROM plain UNION ALL SELECT id || '~edit', {_EDIT} FROM plain
         UNION ALL SELECT id || '~more', t || substr(t, 3, 16 * (length(t) // 32)) FROM plain)"""
#: The files that turns are saved as; every fifth conversation is no program.
_FILES = f"""{_PLAIN},
fil AS (SELECT conv_id, turn, 'd' || (conv_id % 10) || '/' || CASE turn % 4 WHEN 0 THEN 'p' || conv_id || '_' || turn || '.so' WHEN 1 THEN '_p' || conv_id || '_' || turn || '.so'
               WHEN 2 THEN '.p' || conv_id || '_' || turn || '.so' ELSE 'p' || conv_id || '.' || turn END AS path,
               CASE turn % 4 WHEN 0 THEN 'p' || conv_id || '_' || turn WHEN 1 THEN '_p' || conv_id || '_' || turn WHEN 2 THEN '.p' || conv_id || '_' || turn ELSE 'p' || conv_id END AS id, t FROM plain
        UNION ALL SELECT conv_id, turn, 'e/' || conv_id || '_' || turn || '.tar.so', conv_id || '_' || turn || '.tar', {_EDIT} FROM plain)"""
_FILE_PROGRAMS = f"{_FILES}, prog AS (SELECT path AS program_id, t FROM fil WHERE conv_id % 5 <> 4)"
#: Of files with one id the last by path.
_FILE_IDS = f"{_FILES}, pick AS (SELECT id, arg_max(path, path) AS path, arg_max(t, path) AS t FROM fil WHERE conv_id % 5 <> 4 GROUP BY id), prog AS (SELECT id AS program_id, t FROM pick)"
_USERS = """
ev AS (SELECT user_id, event_id,
         list_extract(['18', 'B7', '18', '07', 'B7'], CAST(event_id * 7 % 5 + 1 AS BIGINT)) ||
         CASE WHEN event_id % 3 = 0 THEN '00' ELSE lpad(to_hex(event_id * 37 % 256), 2, '0') END ||
         CASE WHEN event_id % 2 = 0 THEN '000000000000' ELSE '0000' || lpad(to_hex(event_id), 8, '0') END AS s FROM events),
prog AS (SELECT CAST(user_id AS VARCHAR) AS program_id, upper(string_agg(s, '' ORDER BY event_id)) AS t FROM ev GROUP BY user_id)"""

#: Slots and tokens as they are.
_SLOTS = """
sl AS (SELECT program_id, i, substr(t, CAST(i * 16 + 1 AS BIGINT), 16) AS s
       FROM (SELECT program_id, t, unnest(range(0, length(t) // 16)) AS i FROM prog)),
dec AS (SELECT program_id, i, s, CAST('0x' || substr(s, 1, 2) AS INTEGER) AS opcode, CAST('0x' || substr(s, 4, 1) AS INTEGER) AS dst,
               CAST('0x' || substr(s, 3, 1) AS INTEGER) AS src FROM sl)"""
_RAW = """
tok AS (SELECT program_id, i, CAST(opcode * 65536 + dst * 256 + src AS HUGEINT) AS k FROM dec)"""

#: Normalization: wide loads take every second slot of a run and what follows, no-ops go, registers are renumbered.
_NORMAL = """
isl AS (SELECT *, i - coalesce(max(CASE WHEN opcode <> 24 THEN i END) OVER (PARTITION BY program_id ORDER BY i), -1) AS run,
               count(*) OVER (PARTITION BY program_id) AS total FROM dec),
lead AS (SELECT *, opcode = 24 AND run % 2 = 1 AS opens FROM isl),
tak AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY program_id ORDER BY i), false) AS taken FROM lead),
nop AS (SELECT *, opcode = 183 AND dst = 0 AND src = 0 AND substr(s, 9, 8) = '00000000' AND NOT taken AS gone FROM tak),
kept AS (SELECT * FROM nop WHERE NOT taken AND NOT gone),
evt AS (SELECT program_id, 2 * i AS p, dst AS reg FROM kept UNION ALL SELECT program_id, 2 * i + 1, src FROM kept WHERE src <> 0),
fst AS (SELECT program_id, reg, min(p) AS p FROM evt GROUP BY program_id, reg),
map AS (SELECT program_id, reg, row_number() OVER (PARTITION BY program_id ORDER BY p) - 1 AS new FROM fst),
ren AS (SELECT k.program_id, k.i, k.s, k.opcode, k.opens AND k.i < k.total - 1 AS wide, d.new AS dst, CASE WHEN k.src = 0 THEN 0 ELSE m.new END AS src
        FROM kept k JOIN map d ON d.program_id = k.program_id AND d.reg = k.dst LEFT JOIN map m ON m.program_id = k.program_id AND m.reg = k.src)"""
_NTOK = """
tok AS (SELECT program_id, row_number() OVER (PARTITION BY program_id ORDER BY i) AS i, CAST(opcode * 65536 + dst * 256 + src AS HUGEINT) AS k FROM ren)"""

#: Distinct 3-grams: tokens OR-ed at 21 bits from each other, modulo 2^64.
_GRAMS = """
win AS (SELECT program_id, k AS a, lead(k, 1) OVER w AS b, lead(k, 2) OVER w AS c FROM tok WINDOW w AS (PARTITION BY program_id ORDER BY i)),
gram AS (SELECT DISTINCT program_id, CAST(a AS UBIGINT) | CAST(b * 2097152 AS UBIGINT) | CAST(c * 4398046511104 % 18446744073709551616 AS UBIGINT) AS f
         FROM win WHERE c IS NOT NULL)"""


def _swapped(h: str) -> str:
    """Hex digits with their bytes in reverse order."""
    return " || ".join(f"substr({h}, {at}, 2)" for at in range(15, 0, -2))


def _hex(x: str, digits: int = 16) -> str:
    return f"lpad(lower(to_hex({x})), {digits}, '0')"


def _minhash(k: int) -> str:
    seed = _hex("i", 8)
    seed = " || ".join(f"substr({seed}, {at}, 2)" for at in (7, 5, 3, 1))
    return f"""
le AS (SELECT program_id, {_swapped(_hex("f"))} AS h FROM gram),
perm AS (SELECT program_id, i, sha256(unhex(h || s)) AS d FROM le, (SELECT i, {seed} AS s FROM range(0, {k}) t(i))),
mh AS (SELECT program_id, i, min({_swapped("d")}) AS v FROM perm GROUP BY program_id, i)"""


_SIM = f"""
le2 AS (SELECT program_id, {_swapped(_hex("f"))} AS h FROM gram),
fh AS (SELECT program_id, CAST('0x' || {_swapped("sha256(unhex(h))")} AS UBIGINT) AS x FROM le2),
bits AS (SELECT program_id, b, 2 * sum(CAST((x >> b) & 1 AS BIGINT)) > count(*) AS is_set FROM fh, range(0, 64) t(b) GROUP BY program_id, b),
sh AS (SELECT program_id, CAST(sum(CASE WHEN is_set THEN CAST(pow(2, b) AS HUGEINT) ELSE 0 END) AS UBIGINT) AS simhash FROM bits GROUP BY program_id)"""
_COUNTS = """
cnt AS (SELECT program_id, count(*) AS n FROM gram GROUP BY program_id)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


def _tier(x: str) -> str:
    return f"CASE WHEN {x} >= 0.98 THEN 'identical' WHEN {x} >= 0.8 THEN 'near_duplicate' WHEN {x} >= 0.4 THEN 'related' ELSE 'distinct' END"


#: Metrics of the pairs in `pr` (a, b), b2 the name to show for b.
def _report(k: int) -> str:
    return f"""
eq AS (SELECT a, b, count(*) / {k}.0 AS e FROM pr JOIN mh x ON x.program_id = a JOIN mh y ON y.program_id = b AND y.i = x.i AND y.v = x.v GROUP BY a, b),
ix AS (SELECT a, b, count(*) AS c FROM pr JOIN gram x ON x.program_id = a JOIN gram y ON y.program_id = b AND y.f = x.f GROUP BY a, b),
met AS (
  SELECT pr.a, pr.b, pr.b2, CAST(coalesce(e, 0) AS DOUBLE) AS jaccard_estimate, CAST(coalesce(c, 0) / (na.n + nb.n - coalesce(c, 0)) AS DOUBLE) AS jaccard_exact,
         1 - bit_count(xor(sa.simhash, sb.simhash)) / 64.0::DOUBLE AS simhash_similarity, CAST(bit_count(xor(sa.simhash, sb.simhash)) AS INTEGER) AS hamming_distance,
         na.n AS ngram_count_a, nb.n AS ngram_count_b
  FROM pr JOIN cnt na ON na.program_id = pr.a JOIN cnt nb ON nb.program_id = pr.b JOIN sh sa ON sa.program_id = pr.a JOIN sh sb ON sb.program_id = pr.b
  LEFT JOIN eq ON eq.a = pr.a AND eq.b = pr.b LEFT JOIN ix ON ix.a = pr.a AND ix.b = pr.b),
rep AS (
  SELECT a, b2 AS b, jaccard_estimate, jaccard_exact, simhash_similarity, hamming_distance, ngram_count_a, ngram_count_b, {_tier("jaccard_estimate")} AS tier,
         concat_ws('; ', CASE WHEN hamming_distance <= 3 THEN 'simhash hamming distance within clone detection threshold' END,
                   CASE WHEN jaccard_exact >= 0.9 AND jaccard_estimate < 0.7 THEN 'minhash estimate diverges from exact jaccard; increase hash count' END) AS notes
  FROM met)"""


_NEXT = """
pr AS (SELECT a, b, b AS b2 FROM (SELECT conv_id || '-' || turn AS a, unnest([conv_id || '-' || (turn + 1), conv_id || '-' || turn || '~copy', conv_id || '-' || turn || '~edit', conv_id || '-' || turn || '~more']) AS b FROM conversations))"""
_TURN_GRAMS = (_TURNS, _SLOTS, _NORMAL, _NTOK, _GRAMS)


def _bands(bands: int, k: int = 128) -> str:
    r = k // bands
    return f"""
sg AS (SELECT program_id, list(CAST('0x' || v AS UBIGINT) ORDER BY i) AS sig FROM mh GROUP BY program_id),
sb AS (SELECT program_id, sig, CAST(unnest(range(0, {bands})) AS INTEGER) AS band FROM sg),
bk AS (SELECT program_id, band, list_reduce(list_transform(sig[band * {r} + 1 : band * {r} + {r}], lambda z: CAST(z AS HUGEINT)),
         lambda h, v: (xor(h, v) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS x FROM sb),
bu AS (SELECT program_id, band, {_hex("CAST(x AS UBIGINT)")} AS bucket_key FROM bk)"""


_QUERIES = """
qb AS (SELECT program_id AS query_id, band, bucket_key FROM bu WHERE CAST(split_part(program_id, '-', 1) AS BIGINT) % 50 = 0),
cd AS (SELECT query_id, bu.program_id, min(bu.band) AS band, arg_min(bu.bucket_key, bu.band) AS bucket_key FROM bu JOIN qb USING (band, bucket_key) GROUP BY query_id, bu.program_id)"""

_CATALOG = """
ent AS (SELECT CAST(conv_id AS VARCHAR) AS program_id, conv_id || '-' || turn AS source_path, turn, n AS ngram_count, nl.len AS normalized_len, {hex} AS simhash
        FROM plain c JOIN cnt ON cnt.program_id = conv_id || '-' || turn JOIN sh ON sh.program_id = cnt.program_id
        JOIN (SELECT program_id, 8 * count(*) AS len FROM kept GROUP BY program_id) nl ON nl.program_id = cnt.program_id)""".format(hex=_hex("simhash"))
#: Entries of the stored index: turns, grown ones, overwritten ones in place of odd turns; not those of each seventh conversation.
_STORED = """
sx AS (SELECT CASE WHEN program_id LIKE '%~edit' THEN split_part(program_id, '~', 1) ELSE program_id END AS program_id, program_id AS origin, band, bucket_key FROM bu
       WHERE CAST(split_part(program_id, '-', 1) AS BIGINT) % 7 <> 3 AND (program_id LIKE '%~more'
         OR (program_id NOT LIKE '%~%' AND (CAST(split_part(program_id, '-', 2) AS BIGINT) % 2 = 0 OR program_id || '~edit' NOT IN (SELECT program_id FROM sg)))
         OR (program_id LIKE '%~edit' AND CAST(split_part(split_part(program_id, '~', 1), '-', 2) AS BIGINT) % 2 = 1)))"""
_LIST = "SELECT program_id, source_path, ngram_count, normalized_len, simhash FROM"


def _normal_sql(programs: str, text: str) -> str:
    return _with(programs, _SLOTS, _NORMAL) + f"""
SELECT p.program_id, CAST(length(t) // 2 AS BIGINT) AS original_len, CAST(8 * coalesce(k.n, 0) AS BIGINT) AS normalized_len, CAST(coalesce(g.n, 0) AS BIGINT) AS removed_instructions,
       CASE WHEN length(t) = 0 THEN 1.0::DOUBLE ELSE 8.0::DOUBLE * coalesce(k.n, 0) / (length(t) // 2) END AS compression_ratio, coalesce(r.remap, '') AS remap{text}
FROM prog p LEFT JOIN (SELECT program_id, count(*) AS n FROM kept GROUP BY program_id) k ON k.program_id = p.program_id
LEFT JOIN (SELECT program_id, count(*) AS n FROM nop WHERE gone GROUP BY program_id) g ON g.program_id = p.program_id
LEFT JOIN (SELECT program_id, string_agg(reg || '>' || new, ',' ORDER BY new) AS remap FROM map GROUP BY program_id) r ON r.program_id = p.program_id
LEFT JOIN (SELECT program_id, string_agg(substr(s, 1, 2) || upper(to_hex(src)) || upper(to_hex(dst)) || CASE WHEN wide THEN '000000000000' ELSE substr(s, 5, 12) END, '' ORDER BY i) AS h
           FROM ren GROUP BY program_id) b ON b.program_id = p.program_id
"""


def _exact_sql(sets: str) -> str:
    """Pairs of equal-set classes at 0.5 or more, from `it` (key, item)."""
    return sets + """,
st AS (SELECT key, list(item ORDER BY item) AS items FROM it GROUP BY key),
cl AS (SELECT min(key) AS id, items, count(*) AS size FROM st GROUP BY items),
x AS (SELECT id, unnest(items) AS item FROM cl),
c AS (SELECT l.id AS a, r.id AS b, count(*) AS n FROM x l JOIN x r ON l.item = r.item AND l.id < r.id GROUP BY l.id, r.id)
SELECT a, b, l.size AS size_a, r.size AS size_b, CAST(n / (len(l.items) + len(r.items) - n) AS DOUBLE) AS jaccard_exact
FROM c JOIN cl l ON l.id = a JOIN cl r ON r.id = b WHERE n / (len(l.items) + len(r.items) - n) >= 0.5
"""


_DOC_GRAMS = (_DOCS, _SLOTS, _NORMAL, _NTOK, _GRAMS)


def _estimate_sql(*parts: str) -> str:
    """Pairs of equal-signature classes at 0.5 or more."""
    return _with(*parts, _minhash(128)) + """,
sg AS (SELECT program_id, string_agg(v, ',' ORDER BY i) AS s FROM mh GROUP BY program_id),
cl AS (SELECT min(program_id) AS id, count(*) AS size FROM sg GROUP BY s),
m AS (SELECT id, size, i, v FROM cl JOIN mh ON mh.program_id = id)
SELECT x.id AS a, y.id AS b, any_value(x.size) AS size_a, any_value(y.size) AS size_b, CAST(count(*) / 128.0 AS DOUBLE) AS jaccard_estimate
FROM m x JOIN m y ON x.i = y.i AND x.v = y.v AND x.id < y.id GROUP BY x.id, y.id HAVING count(*) >= 64
"""


_REACH = """,
est AS (SELECT x.program_id AS a, y.program_id AS b, count(*) / 128.0 AS e FROM mh x JOIN mh y ON x.i = y.i AND x.v = y.v AND x.program_id <> y.program_id GROUP BY x.program_id, y.program_id),
ids AS (SELECT DISTINCT program_id FROM mh),
reach(a, b) AS (SELECT program_id, program_id FROM ids UNION SELECT reach.a, est.b FROM reach JOIN est ON est.a = reach.b AND e >= 0.5),
lab AS (SELECT a AS program_id, min(b) AS label FROM reach GROUP BY a)"""

_LENGTHS = "len8 AS (SELECT program_id, 8 * count(*) AS len FROM kept GROUP BY program_id)"
_SIGNATURES = "sig AS (SELECT program_id, string_agg(v, ',' ORDER BY i) AS minhash FROM mh GROUP BY program_id)"
_FILE_GRAMS = (_FILE_PROGRAMS, _SLOTS, _NORMAL, _NTOK, _GRAMS, _minhash(128), _SIM, _COUNTS)
_ID_GRAMS = (_FILE_IDS, _SLOTS, _NORMAL, _NTOK, _GRAMS, _minhash(128), _SIM, _COUNTS)
_SCANNED = f"""
db AS (SELECT c.program_id, pick.path AS source_path, c.n AS ngram_count, len AS normalized_len, {_hex("simhash")} AS simhash, minhash FROM cnt c
       JOIN pick ON pick.id = c.program_id JOIN len8 USING (program_id) JOIN sh USING (program_id) JOIN sig USING (program_id))"""
_METRICS = """'jaccard_estimate: ' || printf('%.4f', jaccard_estimate) || chr(10) || {p}'jaccard_exact:    ' || printf('%.4f', jaccard_exact) || chr(10)
|| {p}'simhash_similarity: ' || printf('%.4f', simhash_similarity) || chr(10) || {p}'hamming_distance: ' || hamming_distance"""
_FILE_PAIRS = """
pr AS (SELECT x.path AS a, y.path AS b, y.path AS b2 FROM fil x JOIN fil y ON x.conv_id = y.conv_id AND x.turn = y.turn AND starts_with(x.path, 'd') AND starts_with(y.path, 'e'))"""
_GROUPS = """,
grp AS (SELECT label, string_agg(program_id, ',' ORDER BY program_id) AS members, count(*) AS size FROM lab GROUP BY label),
sim AS (SELECT l.label, sum(e) / 2 AS s FROM est JOIN lab l ON l.program_id = a JOIN lab r ON r.program_id = b AND r.label = l.label GROUP BY l.label),
clu AS (SELECT row_number() OVER (ORDER BY size DESC, grp.label) - 1 AS cluster_id, grp.label, size,
        CASE WHEN size = 1 THEN 1.0::DOUBLE ELSE CAST(coalesce(s, 0) / (size * (size - 1) / 2) AS DOUBLE) END AS avg_similarity
        FROM grp LEFT JOIN sim ON sim.label = grp.label),
clm AS (SELECT cluster_id, program_id, size, avg_similarity FROM lab JOIN clu USING (label))"""


def _lines(parts: str) -> str:
    """(line_no, line) of the rows (o1, o2, line) in `parts`, by their order."""
    return f" SELECT row_number() OVER (ORDER BY o1, o2) - 1 AS line_no, line FROM ({parts})"


def _prints_sql(*grams: str) -> str:
    return _with(*grams, _minhash(128), _SIM, _COUNTS) + f"""
SELECT c.program_id, c.n AS ngram_count, l.n AS normalized_len, m.minhash, {_hex("simhash")} AS simhash FROM cnt c
JOIN (SELECT program_id, 8 * count(*) AS n FROM kept GROUP BY program_id) l ON l.program_id = c.program_id
JOIN (SELECT program_id, string_agg(v, ',' ORDER BY i) AS minhash FROM mh GROUP BY program_id) m ON m.program_id = c.program_id
JOIN sh ON sh.program_id = c.program_id
"""


ORACLE_SQL = {
    "slots_decode": _with(_DOCS, _SLOTS) + " SELECT program_id, CAST(i AS INTEGER) AS i, opcode, dst, src, CAST(opcode * 65536 + dst * 256 + src AS INTEGER) AS token FROM dec",
    "ngram_total_count": _with(_DOCS) + " SELECT program_id, CAST(greatest(0, length(t) // 16 - 2) AS BIGINT) AS n_grams FROM prog",
    "normalize_documents": _normal_sql(_DOCS, ""),
    "normalize_streams": _normal_sql(_USERS, ", coalesce(b.h, '') AS normalized"),
    "normalize_documents_native": _normal_sql(_DOCS, ""),
    "normalize_native": _normal_sql(_USERS, ", coalesce(b.h, '') AS normalized"),
    "ngrams_distinct": _with(_DOCS, _SLOTS, _RAW, _GRAMS) + f" SELECT program_id, {_hex('f')} AS feature FROM gram",
    "ngram_count": _with(_DOCS, _SLOTS, _RAW, _GRAMS) + " SELECT p.program_id, count(f) AS n_grams FROM prog p LEFT JOIN gram g ON g.program_id = p.program_id GROUP BY p.program_id",
    "normalized_ngram_count": _with(_USERS, _SLOTS, _NORMAL, _NTOK, _GRAMS) + " SELECT p.program_id, count(f) AS n_grams FROM prog p LEFT JOIN gram g ON g.program_id = p.program_id GROUP BY p.program_id",
    "minhash_signature": _with(*_TURN_GRAMS, _minhash(128)) + " SELECT program_id, string_agg(v, ',' ORDER BY i) AS minhash FROM mh GROUP BY program_id",
    "simhash": _with(_DOCS, _SLOTS, _NORMAL, _NTOK, _GRAMS, _SIM) + f" SELECT program_id, {_hex('simhash')} AS simhash FROM sh",
    "jaccard_exact_pairs": _exact_sql(_with(_DOCS, _SLOTS, _NORMAL, _NTOK, _GRAMS, " it AS (SELECT program_id AS key, f AS item FROM gram)")),
    "jaccard_estimate_pairs": _estimate_sql(*_TURN_GRAMS),
    "document_pairs": _estimate_sql(*_DOC_GRAMS),
    "fingerprint_documents": _prints_sql(*_DOC_GRAMS),
    "fingerprint_native": _prints_sql(*_TURN_GRAMS),
    "cluster_documents": _with(_DOCS, _SLOTS, _RAW, _GRAMS, _minhash(128)) + _REACH + " SELECT program_id, label FROM lab",
    "compare_report": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, _NEXT, _report(128)) + " SELECT * FROM rep",
    "tier_counts": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, _NEXT, _report(128)) + " SELECT tier, count(*) AS n FROM rep GROUP BY tier",
    "lsh_buckets": _with(*_TURN_GRAMS, _minhash(128), _bands(8)) + " SELECT program_id, band, bucket_key FROM bu",
    "lsh_candidates": _with(*_TURN_GRAMS, _minhash(128), _bands(16), _QUERIES) + " SELECT query_id, program_id, band, bucket_key FROM cd",
    "exact_query": _with(*_TURN_GRAMS, _minhash(128)) + """
SELECT x.program_id AS query_id, y.program_id, CAST(count(*) / 128.0 AS DOUBLE) AS score FROM mh x JOIN mh y ON x.i = y.i AND x.v = y.v
WHERE CAST(split_part(x.program_id, '-', 1) AS BIGINT) % 50 = 0 GROUP BY x.program_id, y.program_id HAVING count(*) / 128.0 >= 0.6
""",
    "lsh_query": _with(*_TURN_GRAMS, _minhash(128), _bands(8), _QUERIES) + """
SELECT query_id, cd.program_id, CAST(count(*) / 128.0 AS DOUBLE) AS score, any_value(band) AS band FROM cd JOIN mh x ON x.program_id = query_id JOIN mh y ON y.program_id = cd.program_id AND x.i = y.i AND x.v = y.v
GROUP BY query_id, cd.program_id HAVING count(*) / 128.0 >= 0.6
""",
    "lsh_documents": _with(*_DOC_GRAMS, _minhash(128), _bands(16), _QUERIES) + """
SELECT query_id, cd.program_id, CAST(count(*) / 128.0 AS DOUBLE) AS score, any_value(band) AS band FROM cd JOIN mh x ON x.program_id = query_id JOIN mh y ON y.program_id = cd.program_id AND x.i = y.i AND x.v = y.v
GROUP BY query_id, cd.program_id HAVING count(*) / 128.0 >= 0.3
""",
    "cluster_document_summary": _with(_DOCS, _SLOTS, _RAW, _GRAMS, _minhash(128)) + _REACH + _GROUPS + " SELECT * FROM clm",
    "cluster_summary": _with(_TURNS, _SLOTS, _RAW, _GRAMS, _minhash(128)) + _REACH + _GROUPS + " SELECT * FROM clm",
    "batch_compare": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, " pr AS (SELECT x.program_id AS a, y.program_id AS b, y.program_id AS b2 FROM prog x JOIN prog y ON x.program_id <> y.program_id WHERE CAST(split_part(x.program_id, '-', 1) AS BIGINT) % 50 = 0)", _report(128))
    + " SELECT * FROM rep WHERE jaccard_estimate >= 0.1",
    "one_against_every": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, " pr AS (SELECT q.a, program_id AS b, program_id AS b2 FROM prog, (SELECT min(program_id) AS a FROM cnt) q WHERE program_id <> q.a)", _report(128)) + " SELECT * FROM rep",
    "register_lookup": _with(_USERS, _SLOTS, _NORMAL) + " SELECT p.program_id, CAST(r.reg AS INTEGER) AS register, CAST(coalesce(m.new, r.reg) AS INTEGER) AS new FROM prog p, range(0, 16) r(reg) LEFT JOIN map m ON m.program_id = p.program_id AND m.reg = r.reg",
    "empty_programs": _with(*_DOC_GRAMS) + " SELECT program_id, 'no opcode n-grams extracted from bytecode' AS error FROM prog WHERE program_id NOT IN (SELECT program_id FROM gram)",
    "elf_sections": """
SELECT CAST(doc_id AS VARCHAR) AS program_id, CASE WHEN doc_id % 5 < 2 THEN octet_length(encode(x)) ELSE -1 END AS n_bytes, CASE WHEN doc_id % 5 < 2 THEN sha256(encode(x)) END AS sha256,
       CASE WHEN doc_id % 5 < 2 THEN 0::BIGINT ELSE -1 END AS entry_offset,
       CASE doc_id % 5 WHEN 2 THEN 'not a valid elf: bad magic' WHEN 3 THEN 'not a valid elf: text section exceeds file bounds' WHEN 4 THEN 'no executable text section found' END AS load_error
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)
""",
    "scan_programs": _with(_FILES) + " SELECT path, id AS program_id, CASE WHEN conv_id % 5 <> 4 THEN sha256(unhex(t)) END AS sha256, CASE WHEN conv_id % 5 = 4 THEN 'not a valid elf: bad magic' END AS load_error FROM fil",
    "scan_catalog": _with(*_ID_GRAMS, _LENGTHS, _SIGNATURES, _SCANNED) + " SELECT * FROM db",
    "catalog_json": _with(*_ID_GRAMS, _LENGTHS, _SIGNATURES, _SCANNED) + " SELECT *, ngram_count AS n_sample, 3 AS version, count(*) OVER () AS entries FROM db",
    "index_programs": _with(*_ID_GRAMS, _bands(16)) + " SELECT program_id, band, bucket_key FROM bu",
    "scan_clusters": _with(_FILE_PROGRAMS, _SLOTS, _RAW, _GRAMS, _minhash(128)) + _REACH + _GROUPS + " SELECT * FROM clm",
    "file_fingerprints": _with(*_FILE_GRAMS) + f""",
val AS (SELECT program_id, string_agg(CASE WHEN i % 4 = 0 THEN chr(10) ELSE '' END || ' ' || v, '' ORDER BY i) AS vs FROM mh GROUP BY program_id)
SELECT program_id, 'file: ' || program_id || chr(10) || 'ngram_count: ' || n || chr(10) || 'simhash: ' || {_hex("simhash")} || chr(10) || 'minhash_signature:' || vs AS text
FROM cnt JOIN sh USING (program_id) JOIN val USING (program_id)
""",
    "file_comparisons": _with(*_FILE_GRAMS, _FILE_PAIRS, _report(128)) + " SELECT a, b, 'file_a: ' || a || chr(10) || 'file_b: ' || b || chr(10) || " + _METRICS.format(p="") + " AS text FROM rep",
    "file_reports": _with(*_FILE_GRAMS, _FILE_PAIRS, _report(128)) + " SELECT a, b, 'similarity report' || chr(10) || '  a: ' || a || chr(10) || '  b: ' || b || chr(10) || '  tier: ' || tier || chr(10) || '  ' || "
    + _METRICS.format(p="'  ' || ") + " || chr(10) || '  ngrams: ' || ngram_count_a || ' vs ' || ngram_count_b || CASE WHEN notes = '' THEN '' ELSE chr(10) || '  note: ' || replace(notes, '; sim', chr(10) || '  note: sim') END AS text FROM rep",
    "batch_lines": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, " pr AS (SELECT x.program_id AS a, y.program_id AS b, y.program_id AS b2 FROM prog x JOIN prog y ON x.program_id <> y.program_id WHERE CAST(split_part(x.program_id, '-', 1) AS BIGINT) % 50 = 0)", _report(128))
    + """,
rk AS (SELECT a, b, jaccard_estimate, tier, count(*) OVER (PARTITION BY a) AS matches, row_number() OVER (PARTITION BY a ORDER BY jaccard_estimate DESC, b) - 1 AS i FROM rep WHERE jaccard_estimate >= 0.4)
SELECT a, b, 'batch similarity for ' || a || chr(10) || 'matches: ' || matches || chr(10) || '  [' || i || '] ' || b || ' jaccard=' || printf('%.4f', jaccard_estimate) || ' tier='
       || CASE tier WHEN 'identical' THEN 'Identical' WHEN 'near_duplicate' THEN 'NearDuplicate' WHEN 'related' THEN 'Related' ELSE 'Distinct' END AS text FROM rk
""",
    "cli_cluster": _with(_FILE_PROGRAMS, _SLOTS, _RAW, _GRAMS, _minhash(128)) + _REACH + _GROUPS
    + _lines("""SELECT -4 AS o1, '' AS o2, 'directory: ' AS line UNION ALL SELECT -3, '', 'threshold: 0.50' UNION ALL SELECT -2, '', 'clusters: ' || count(*) FROM clu UNION ALL SELECT -1, '', ''
UNION ALL SELECT cluster_id, '', 'cluster ' || cluster_id || ' (' || size || ' members, avg_similarity ' || printf('%.4f', avg_similarity) || ')' FROM clu
UNION ALL SELECT cluster_id, program_id, '  ' || program_id FROM clm UNION ALL SELECT cluster_id, '~', '' FROM clu WHERE cluster_id < (SELECT max(cluster_id) FROM clu)"""),
    "cli_index": _with(*_FILE_GRAMS) + _lines("""SELECT 0 AS o1, '' AS o2, CASE WHEN bare IS NULL THEN 'indexed ' || n || ' programs' ELSE 'error: no ngrams extracted from ' || bare END AS line
FROM (SELECT min(path) FILTER (WHERE path NOT IN (SELECT program_id FROM cnt)) AS bare, count(DISTINCT id) AS n FROM fil WHERE conv_id % 5 <> 4)
UNION ALL SELECT 1, '', 'catalog: out/db.json' WHERE NOT EXISTS (SELECT 1 FROM fil WHERE conv_id % 5 <> 4 AND path NOT IN (SELECT program_id FROM cnt))"""),
    "file_entries": _with(*_FILE_GRAMS, _LENGTHS, _SIGNATURES) + f"""
SELECT 'as ' || path AS program_id, path AS source_path, coalesce(c.n, -1) AS ngram_count, CASE WHEN c.n IS NULL THEN -1 ELSE len END AS normalized_len,
       coalesce({_hex("simhash")}, '') AS simhash, coalesce(sig.minhash, '') AS minhash, coalesce(c.n, -1) AS n_sample,
       CASE WHEN conv_id % 5 = 4 THEN 'not a valid elf: bad magic' WHEN c.n IS NULL THEN 'no ngrams extracted from ' || path ELSE '' END AS error
FROM fil LEFT JOIN cnt c ON c.program_id = path LEFT JOIN len8 ON len8.program_id = path LEFT JOIN sh ON sh.program_id = path LEFT JOIN sig ON sig.program_id = path
""",
    "quick_comparisons": _with(*_FILE_GRAMS, _FILE_PAIRS, _report(128)) + " SELECT * FROM rep",
    "cli_query": _with(*_ID_GRAMS, _bands(8)) + """,
src AS (SELECT * FROM fil WHERE path = 'd0/p0_0.so'),
hit AS (SELECT y.program_id, count(*) / 128.0 AS e FROM mh x JOIN mh y ON x.i = y.i AND x.v = y.v WHERE x.program_id = (SELECT id FROM src) AND y.program_id IN
        (SELECT b.program_id FROM bu b JOIN bu q USING (band, bucket_key) WHERE q.program_id = (SELECT id FROM src)) GROUP BY y.program_id)"""
    + _lines("SELECT 0 AS o1, '' AS o2, 'query: d0/p0_0.so' AS line UNION ALL SELECT 1, '', 'catalog: ' || count(*) || ' entries' FROM cnt UNION ALL SELECT 3 - e, program_id, '  ' || program_id || ' jaccard=' || printf('%.4f', e) FROM hit WHERE e >= 0.3"),
    "catalog_summary": _with(*_ID_GRAMS, _LENGTHS, _SIGNATURES, _SCANNED)
    + _lines("SELECT 0 AS o1, '' AS o2, 'fingerprint_db version=1 entries=' || count(*) AS line FROM db UNION ALL SELECT 1, source_path, '  ' || program_id || ' ngrams=' || ngram_count || ' simhash=' || simhash || ' path=' || source_path FROM db"),
    "cli_errors": """
SELECT * FROM (VALUES ('compare', 1, 'error: not a valid elf: bad magic'), ('fingerprint', 1, 'error: not a valid elf: bad magic'),
  ('report', 1, 'error: no opcode n-grams extracted from bytecode'), ('index', 1, 'error: no ngrams extracted from few/short.so'), ('good', 0, '')) v(command, code, message)
""",
    "lsh_configs": """
SELECT CAST(b AS INTEGER) AS bands, CASE WHEN b > 0 AND 128 % b = 0 THEN CAST(128 // b AS INTEGER) ELSE 0 END AS rows_per_band,
       CASE WHEN b = 0 OR 128 % b <> 0 THEN 'signature length 128 must be divisible by bands ' || b ELSE '' END AS error FROM (SELECT range AS b FROM range(0, 33))
""",
    "stores": _with(*_TURN_GRAMS, _COUNTS) + """
SELECT 'new index' AS store, 0::BIGINT AS size, true AS is_empty, 0 AS version UNION ALL SELECT 'index', count(*), count(*) = 0, 0 FROM cnt
UNION ALL SELECT 'new catalog', 0, true, 1 UNION ALL SELECT 'catalog', count(*), count(*) = 0, 1 FROM cnt
""",
    "catalog_upsert": _with(*_TURN_GRAMS, _SIM, _COUNTS, _CATALOG) + f" {_LIST} ent QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY turn DESC) = 1",
    "catalog_merge": _with(*_TURN_GRAMS, _SIM, _COUNTS, _CATALOG) + """,
pl AS (SELECT *, CAST(program_id AS BIGINT) * 1000 + turn AS pos, turn = 0 AND CAST(program_id AS BIGINT) % 3 <> 0 AS mine FROM ent),
las AS (SELECT program_id, arg_max(source_path, pos) AS source_path, arg_max(ngram_count, pos) AS ngram_count, arg_max(normalized_len, pos) AS normalized_len, arg_max(simhash, pos) AS simhash, min(pos) AS first FROM pl WHERE NOT mine GROUP BY program_id)
SELECT program_id, source_path, ngram_count, normalized_len, simhash, pos AS place FROM pl WHERE mine AND program_id NOT IN (SELECT program_id FROM las)
UNION ALL SELECT las.program_id, las.source_path, las.ngram_count, las.normalized_len, las.simhash, coalesce(o.pos, (SELECT coalesce(max(pos), -1) FROM pl WHERE mine) + 1 + las.first)
FROM las LEFT JOIN pl o ON o.mine AND o.program_id = las.program_id
""",
    "stored_catalog": _with(*_TURN_GRAMS, _SIM, _COUNTS, _CATALOG) + """,
pl AS (SELECT *, CAST(program_id AS BIGINT) * 1000 + turn AS pos, turn = 0 AND CAST(program_id AS BIGINT) % 3 <> 0 AS mine FROM ent),
las AS (SELECT * FROM pl WHERE NOT mine QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY pos DESC) = 1)
SELECT program_id, source_path, ngram_count, normalized_len, simhash FROM pl WHERE mine AND program_id NOT IN (SELECT program_id FROM las)
UNION ALL SELECT program_id, source_path, ngram_count, normalized_len, simhash FROM las
""",
    "stored_index": _with(*_TURN_GRAMS, _minhash(128), _bands(8), _STORED) + " SELECT program_id, band, bucket_key FROM sx",
    "stored_search": _with(*_TURN_GRAMS, _minhash(128), _bands(8), _STORED) + """,
cd AS (SELECT q.program_id AS query_id, sx.program_id, sx.origin, min(sx.band) AS band FROM sx JOIN bu q USING (band, bucket_key)
       WHERE CAST(split_part(q.program_id, '-', 1) AS BIGINT) % 50 = 0 GROUP BY ALL),
sc AS (SELECT query_id, cd.program_id, band, (SELECT count(*) FROM mh x JOIN mh y ON x.i = y.i AND x.v = y.v WHERE x.program_id = query_id AND y.program_id = origin) / 128.0 AS score FROM cd)
SELECT query_id, program_id, CAST(score AS DOUBLE) AS score, band FROM sc WHERE score >= 0.3
""",
    "catalog_lookup": _with(*_TURN_GRAMS, _SIM, _COUNTS, _CATALOG) + f" {_LIST} ent WHERE program_id = '7' QUALIFY row_number() OVER (ORDER BY turn DESC) = 1",
    "compare_stored": _with(*_TURN_GRAMS, _minhash(128), _SIM, _COUNTS, """
pr AS (SELECT id AS a, CASE turn % 4 WHEN 0 THEN id || '~copy' WHEN 1 THEN id || '~edit' WHEN 2 THEN id || '~more' ELSE conv_id || '-' || (turn + 1) END AS b, 'db/' || id AS b2 FROM plain)""", _report(128))
    + " SELECT a, b, jaccard_estimate, jaccard_exact, simhash_similarity, hamming_distance, ngram_count_a, ngram_count_b, tier, '' AS notes FROM rep",
    "basket_jaccard": _exact_sql("WITH it AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS item FROM lineitem)"),
}
