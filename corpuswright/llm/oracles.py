"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAM = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM p, (SELECT DISTINCT k FROM q) WHERE i + k - 1 <= len(w)),
m AS (SELECT doc_id, item_id, i, v.k FROM v JOIN q USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 75 * (a.n + b.n - inter)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, root FROM reach JOIN edge ON doc_id = x WHERE root < y),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

_WARC = """
WITH t AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first,
             list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT)) AS bits FROM t)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((bits[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, (r & 1) * 3988292384)))"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _row(text: str) -> str:
    return " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text))


_MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_row("text")}) AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN sha256({_row(_LOWER.format("text"))}) END AS changed FROM documents),
l AS (SELECT *, coalesce('s' || source, '-') AS grp, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
      FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)),
below(lv, grp, pos, n, h) AS (
  SELECT 0, grp, pos, n, leaf FROM l
  UNION ALL SELECT max(lv) + 1, grp, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM below WHERE n > 1 GROUP BY grp, pos // 16),
s AS (SELECT grp, h, lv AS deep, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM below WHERE n = 1),
above(lv, pos, n, h) AS (
  SELECT 0, pos, n, h FROM s
  UNION ALL SELECT max(lv) + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY pos // 16),
root AS (SELECT h AS root FROM above WHERE n = 1),
nodes AS (SELECT grp, lv, pos, h FROM below WHERE n > 1 UNION ALL SELECT '', lv, pos, h FROM above WHERE n > 1),
sides AS (SELECT a.grp, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
          FROM nodes a JOIN nodes b ON a.grp = b.grp AND a.lv = b.lv AND a.pos // 16 = b.pos // 16 GROUP BY ALL),
steps AS (SELECT l.doc_id, l.leaf, l.grp, l.pos, lv AS step, x.l, x.r FROM l JOIN sides x ON x.grp = l.grp AND x.pos = l.pos // CAST(16 ** lv AS BIGINT)
          UNION ALL SELECT l.doc_id, l.leaf, l.grp, l.pos, s.deep + lv, x.l, x.r FROM l JOIN s ON s.grp = l.grp JOIN sides x ON x.grp = '' AND x.pos = s.pos // CAST(16 ** lv AS BIGINT)),
fold(grp, pos, step, h) AS (
  SELECT grp, pos, 0, coalesce(changed, leaf) FROM l
  UNION ALL SELECT f.grp, f.pos, f.step + 1, sha256(t.l || f.h || t.r) FROM fold f JOIN steps t ON t.grp = f.grp AND t.pos = f.pos AND t.step = f.step),
ends AS (SELECT grp, pos, arg_max(h, step) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT grp, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS p FROM steps GROUP BY ALL)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (grp) CROSS JOIN root JOIN ends e ON e.grp = l.grp AND e.pos = l.pos LEFT JOIN proof p ON p.grp = l.grp AND p.pos = l.pos
"""

_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
                  row_number() OVER () AS k
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
p AS (SELECT ak, anchor_id, k, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, k) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.ak, p.k ORDER BY s.score DESC, s.vec_id, s.k)
QUALIFY row_number() OVER w <= 10
"""

SQL = {"op1_decontam": _DECONTAM, "op5_near_dedup": _NEAR, "op9_exact_dedup": _EXACT, "op10_warc": _WARC, "op11_merkle": _MERKLE, "op12_hard_negatives": _NEGATIVES}
