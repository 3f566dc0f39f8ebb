"""DuckDB SQL for the queries that SQL can express; brute force over the same tables, by other ways than Spark's."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str) -> str:
    """(key, k, w, l1 .. l9): each word of a text, its place and the nine after it."""
    after = ", ".join(f"lead(w, {j}) OVER o AS l{j}" for j in range(1, 10))
    lowered = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"
    return f"""(SELECT *, {after} FROM (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT {key}, {lowered} AS ws FROM {table})) WINDOW o AS (PARTITION BY {key} ORDER BY k))"""


def _joined(n: int) -> str:
    return "concat_ws(' ', w" + "".join(f", l{j}" for j in range(1, n)) + ")"


def decontaminate() -> str:
    """op10: every window of every document beside every window of every item."""
    have = lambda n: f"l{n - 1} IS NOT NULL" if n > 1 else "true"
    items = " UNION ALL ".join(f"SELECT item_id, {n} AS n, {_joined(n)} AS win FROM iw JOIN len_of USING (item_id) WHERE n = {n} AND {have(n)}" for n in range(1, 11))
    docs = " UNION ALL ".join(f"SELECT doc_id, k, {n} AS n, {_joined(n)} AS win FROM dw WHERE {have(n)} AND {n} IN (SELECT n FROM len_of)" for n in range(1, 11))
    return f"""WITH dw AS MATERIALIZED {_words('documents', 'doc_id')}, iw AS MATERIALIZED {_words('benchmark', 'item_id')},
len_of AS (SELECT item_id, least(10, count(*)) AS n FROM iw GROUP BY 1), windows AS MATERIALIZED (SELECT DISTINCT * FROM ({items})),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, k, d.n, item_id FROM ({docs}) d JOIN windows i ON i.n = d.n AND i.win = d.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items, list(item_id ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM dw GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(item_ids, []) AS item_ids
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def suffix(length: int = 100, chunk: int = 1000) -> str:
    """op5: the digest of every string of ``length`` bytes of every document, grouped; texts as hexadecimal digits."""
    n = 2 * length
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j * {chunk} AS base, substr(h, {2 * chunk} * j + 1, {2 * chunk + n - 2}) AS part FROM (SELECT doc_id, h, unnest(range(CAST(ceil(length(h) / {2 * chunk}.0) AS BIGINT))) AS j FROM d)),
w AS (SELECT doc_id, base + k AS start, md5(substr(part, 2 * k + 1, {n})) AS m FROM (SELECT doc_id, base, part, unnest(range(least({chunk}, length(part) // 2 - {length - 1}))) AS k FROM c WHERE length(part) >= {n})),
marked AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY m ORDER BY doc_id, start) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(start) AS a, max(start) + {length} AS b FROM (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (
  SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + {length} THEN 0 ELSE 1 END AS new FROM marked)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM runs UNION ALL SELECT doc_id, NULL, NULL, max(b) FROM runs GROUP BY 1),
texts AS (SELECT k.doc_id, string_agg(substr(h, 2 * from_ + 1, CASE WHEN a IS NULL THEN length(h) - 2 * from_ ELSE 2 * (a - from_) END), '' ORDER BY from_, a NULLS LAST) AS left_ FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY 1),
gone AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256 FROM d LEFT JOIN texts USING (doc_id) LEFT JOIN gone USING (doc_id)"""


_COMPONENTS = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""


def vectors(cosine: float = 0.93) -> str:
    """op7: the cosine of all pairs of a label."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= {cosine}),
nodes AS (SELECT DISTINCT a AS id FROM links), {_COMPONENTS}, root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, coalesce(root, v.id) AS component_id, v.id = coalesce(root, v.id) AS kept FROM v LEFT JOIN n USING (id) LEFT JOIN root USING (id)"""


def simhash(similarity: float = 0.8) -> str:
    """op3: the Jaccard similarity of all pairs of texts that share a shingle of five words."""
    shingle = "CASE WHEN l4 IS NOT NULL THEN concat_ws(' ', w, l1, l2, l3, l4) WHEN k = 0 THEN concat_ws(' ', w, l1, l2, l3) END"
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS MATERIALIZED (SELECT DISTINCT id, hash({shingle}) AS g FROM {_words('t', 'id')} WHERE {shingle} IS NOT NULL), size AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
half AS MATERIALIZED (SELECT a, b FROM shared JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE common >= {similarity} * (p.n + q.n - common) - 1e-9),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), nodes AS (SELECT DISTINCT a AS id FROM links), {_COMPONENTS}, root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(root, t.id, d.doc_id) AS class_id, d.doc_id = coalesce(root, t.id, d.doc_id) AS kept FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN root ON root.id = t.id"""


ORACLE = {"op3_simhash": simhash(), "op5_suffix": suffix(), "op7_vectors": vectors(), "op10_decontaminate": decontaminate()}
