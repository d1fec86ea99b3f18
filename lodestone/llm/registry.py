"""Queries of the corpus operators, over whole tables, and their SQL where SQL can express them.

Spans that a method learns, robust distances, merges of tokens and labels of several hundred rules have no SQL; strings of
400 bytes at every position of a corpus are too many for it. The tests hold these against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, pii, quality, set_join, substring_dedup, suffix_dedup, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]

WORDS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ARCHIVE = """
WITH p AS (SELECT page_id, nullif(url, '') AS uri, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY 1),
d AS (SELECT p.*, owner, sha1(p.html) AS h FROM p JOIN o USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10))::UBIGINT >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31::UBIGINT AS INTEGER) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to, uri
FROM d"""

SETS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, (SELECT min(y) FROM r WHERE x = doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS l FROM documents),
g AS (SELECT doc_id, a, array_to_string(l[a:a + 12], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS a FROM w)),
f AS (SELECT s, min(doc_id) AS d FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 13)) AS p FROM g JOIN f USING (s) WHERE d < doc_id),
k AS (SELECT x.doc_id, x.p, x.l[x.p] AS word FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM w) x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""

LEAKS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS l FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS l FROM benchmark),
v AS (SELECT DISTINCT item_id, m, array_to_string(l[a:a + m - 1], ' ') AS s FROM (SELECT item_id, l, least(10, len(l)) AS m, unnest(range(1, greatest(len(l) - 10, 0) + 2)) AS a FROM i WHERE len(l) > 0)),
g AS (SELECT doc_id, a, m, array_to_string(l[a:a + m - 1], ' ') AS s FROM (SELECT doc_id, l, m, unnest(range(1, len(l) - m + 2)) AS a FROM w, (SELECT DISTINCT m FROM v))),
h AS (SELECT doc_id, a, m, item_id FROM g JOIN v USING (m, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + m)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def queries() -> dict[str, Query]:
    return {
        "op1_warc": warc.query,
        "op2_pii": pii.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_set_join": set_join.query,
        "op5_window_dedup": substring_dedup.query,
        "op6_license_scan": licenses.query,
        "op7_token_counts": token_counts.query,
        "op8_quality_rules": quality.query,
        "op9_decontaminate": decontaminate.query,
        "op10_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": ARCHIVE, "op4_set_join": SETS, "op5_window_dedup": WINDOWS, "op9_decontaminate": LEAKS}
