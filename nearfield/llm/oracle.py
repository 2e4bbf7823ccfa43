"""The queries of this subpackage in DuckDB SQL, where SQL can express them. They don't take the operators' ways: windows are compared as text."""

from __future__ import annotations

from .licenses import LICENSE_FILE, NOTICE, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def quality_rules(min_repeat: int = 10, max_share: float = 0.3, max_repeat: int = 100, levels: int = 15) -> str:
    """Classes of equal windows of 2^t words by doubling; the longest repeat is then put together from the greatest t downwards."""
    parts = [
        rf"""docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents)""",
        """g0 AS MATERIALIZED (SELECT doc_id AS d, i, min(i) OVER (PARTITION BY doc_id, word) AS c FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs))""",
    ]
    for t in range(levels - 1):
        parts.append(f"g{t + 1} AS MATERIALIZED (SELECT x.d, x.i, min(x.i) OVER (PARTITION BY x.d, x.c, y.c) AS c FROM g{t} x JOIN g{t} y ON x.d = y.d AND y.i = x.i + {1 << t})")
    parts.append(f"s{levels} AS MATERIALIZED (SELECT d, i, 0::BIGINT AS c, 0::BIGINT AS m FROM g0)")
    for t in reversed(range(levels)):
        s = f"s{t + 1}"
        parts.append(f"c{t} AS MATERIALIZED (SELECT s.d, s.i, min(s.i) OVER (PARTITION BY s.d, s.c, g.c) AS c, m + {1 << t} AS m FROM {s} s JOIN g{t} g ON g.d = s.d AND g.i = s.i + s.m)")
        parts.append(f"u{t} AS MATERIALIZED (SELECT DISTINCT d FROM c{t} WHERE c < i)")
        parts.append(f"s{t} AS MATERIALIZED (SELECT * FROM c{t} SEMI JOIN u{t} USING (d) UNION ALL SELECT * FROM {s} ANTI JOIN u{t} USING (d))")
    for k in (3, min_repeat):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT doc_id AS d, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (
 SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM (
  SELECT doc_id, unnest(range(len(w) - {k - 1})) AS i, unnest(list_transform(range(len(w) - {k - 1}), lambda i: array_to_string(w[i + 1:i + {k}], ' '))) AS win FROM docs WHERE len(w) >= {k})) WHERE times > 1) GROUP BY doc_id)""")
    parts.append(r"""lines AS MATERIALIZED (SELECT doc_id AS d, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)""")
    parts.append(f"""rows AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(r3.n, 0)::BIGINT AS n_repeat_words,
 coalesce(r{min_repeat}.n, 0)::BIGINT AS repeated_words, coalesce(m, 0)::BIGINT AS longest_repeat
 FROM docs LEFT JOIN lines ON lines.d = doc_id LEFT JOIN r3 ON r3.d = doc_id LEFT JOIN r{min_repeat} ON r{min_repeat}.d = doc_id LEFT JOIN (SELECT d, max(m) AS m FROM s0 GROUP BY d) l ON l.d = doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rows)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT *, NOT base_failed AND repeated_words <= {max_share}::DOUBLE * n_words AND longest_repeat <= {max_repeat} AS kept FROM judged"


def decontamination(window: int = 10) -> str:
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS win FROM (
 SELECT item, w, least(len(w), {window}) AS k, unnest(range(greatest(1, len(w) - {window - 1}))) AS i FROM items WHERE len(w) > 0)),
seen AS MATERIALIZED (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS win FROM (
 SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT doc_id, seen.k, i, item FROM seen JOIN wins ON seen.k = wins.k AND seen.win = wins.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, places.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN places ON places.doc_id = docs.doc_id LEFT JOIN own ON own.doc_id = docs.doc_id"""


def near_duplicates(n: int = 5, percent: int = 75) -> str:
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {n}], ' ') AS g FROM (
 SELECT doc_id, w, unnest(range(greatest(1, len(w) - {n - 1}))) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS c FROM sets GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.c >= {percent} * (x.c + y.c - p.c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT walk.a, l.b FROM walk JOIN both_ways l ON walk.b = l.a)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a) LEFT JOIN sizes USING (doc_id)"""


def suffix_dedup(length: int = 400) -> str:
    """Texts as hexadecimal digits, in overlapping pieces so that a window is found near its piece's start."""
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, {4 * length}) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, {length})) AS pos FROM docs)),
wins AS MATERIALIZED (SELECT doc_id, pos + i AS i, md5_number(substr(piece, 2 * i + 1, {2 * length})) AS win FROM (
 SELECT *, unnest(range(least({length}, len(piece) // 2 - {length - 1}))) AS i FROM pieces WHERE len(piece) >= {2 * length})),
again AS MATERIALIZED (SELECT doc_id, i FROM wins JOIN (SELECT win FROM wins GROUP BY win HAVING count(*) > 1) USING (win)),
runs AS (SELECT doc_id, min(i) AS s, max(i) + {length} AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
 SELECT *, coalesce((i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {length})::INT, 1) AS fresh FROM again)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, -1, 0 FROM docs)),
texts AS (SELECT doc_id, string_agg(CASE WHEN e IS NULL THEN substr(h, 2 * s + 1) ELSE substr(h, 2 * s + 1, 2 * (e - s)) END, '' ORDER BY s) AS left_ FROM kept JOIN docs USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(left_)) AS kept_sha256
FROM docs JOIN texts USING (doc_id) LEFT JOIN cut USING (doc_id)"""


def license_scan(threshold: float = 0.5) -> str:
    known = ", ".join(f"('{k:03d}', '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return rf"""WITH paths AS (SELECT doc_id, coalesce(text, '') AS text,
 concat_ws('/', source, floor(doc_id / 1000)::BIGINT::VARCHAR, floor(doc_id / 100)::BIGINT::VARCHAR) AS dir,
 (CASE WHEN length(text) < 400 AND contains(text, 'icense') THEN 'LICENSE.' ELSE '' END) || doc_id || '.txt' AS name FROM documents),
files AS MATERIALIZED (SELECT *, regexp_matches(name, '{LICENSE_FILE}') AS whole FROM paths),
spoken AS MATERIALIZED (SELECT DISTINCT doc_id, dir, whole, unnest(CASE WHEN whole THEN [text] ELSE list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOTICE}')) END) AS line FROM files),
known AS (SELECT * FROM (VALUES {known}) t(unit, license, line)),
units AS MATERIALIZED (SELECT 'n' || line AS unit, line, false AS model FROM (SELECT DISTINCT line FROM spoken) UNION ALL SELECT 't' || unit, line, true FROM known),
terms AS MATERIALIZED (SELECT unit, model, term, count(*) AS tf FROM (
 SELECT unit, model, unnest(regexp_extract_all(regexp_replace(lower(line), '\.+([\t-\r ]|$)', ' ', 'g'), '[\pL\pN.]+')) AS term FROM units) GROUP BY ALL),
weights AS MATERIALIZED (SELECT unit, model, term, tf * (ln((1 + (SELECT count(*) FROM units)) / (1.0::DOUBLE + df)) + 1) AS w FROM terms JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weights GROUP BY unit),
cosine AS (SELECT substr(a.unit, 2) AS line, license, round(dot / (x.norm * y.norm), 6) AS s
 FROM (SELECT a.unit, b.unit AS template, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.term = b.term AND NOT a.model AND b.model GROUP BY ALL) a
 JOIN norms x ON x.unit = a.unit JOIN norms y ON y.unit = template JOIN known k ON 't' || k.unit = template),
own AS MATERIALIZED (SELECT DISTINCT ON (doc_id) doc_id, dir, whole, license, s FROM spoken JOIN cosine USING (line) WHERE s >= {threshold} ORDER BY doc_id, s DESC, license),
holders AS (SELECT DISTINCT ON (dir) dir, license, s FROM own WHERE whole ORDER BY dir, s DESC, license),
up AS (SELECT DISTINCT ON (f.dir) f.dir, license, s FROM (SELECT DISTINCT dir FROM files) f JOIN holders h ON h.dir = f.dir OR h.dir = '' OR starts_with(f.dir, h.dir || '/') ORDER BY f.dir, length(h.dir) DESC)
SELECT f.doc_id, coalesce(own.license, up.license) AS license, coalesce(own.s, up.s) AS similarity,
 CASE WHEN own.license IS NOT NULL THEN 'own' WHEN up.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM files f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN up ON up.dir = f.dir"""


ORACLE_SQL = {
    "op2_quality_rules": quality_rules(),
    "op7_benchmark_decontamination": decontamination(),
    "op8_minhash_near_dedup": near_duplicates(),
    "op9_suffix_array_dedup": suffix_dedup(),
    "op10_license_scan": license_scan(),
}
