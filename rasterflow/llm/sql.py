"""The numbered queries that DuckDB can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w FROM {table}"


_CONTAMINATION = rf"""
WITH d AS ({_words("documents", "doc_id", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
i AS ({_words("benchmark", "item_id", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
places AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS win, least(len(w), 10) AS n FROM places),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, k, s.n, item_id FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM starts) s JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", r"[^\x20\x09-\x0D]+")}),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], chr(9)) AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

_GROUPS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{g + 1}] >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT page_id, top, strlen(html) AS n, [('0x' || substr(sha1(html), 5 * g + 1, 5))::BIGINT FOR g IN range(8)] AS v FROM p)
SELECT page_id, n AS payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM h
"""

_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 100)) AS m FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
firsts AS (SELECT m, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT doc_id, s FROM w JOIN firsts USING (m) WHERE first < doc_id),
heads AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS head FROM gone),
numbered AS (SELECT doc_id, s, sum(head) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM heads),
spans AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY 1, 2),
lists AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM spans GROUP BY 1),
kept AS (SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN aa IS NULL THEN h ELSE substr(h, 1, 2 * aa[1]) || array_to_string([substr(h, 2 * bb[k] + 1, 2 * (CASE WHEN k = len(aa) THEN len(h) // 2 ELSE aa[k + 1] END - bb[k])) FOR k IN range(1, len(aa) + 1)], '') END AS rest FROM d LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[('0x' || substr(hex(encode({0})), 2 * k + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR k IN range(strlen({0}))])), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
_TRIE = rf"""
WITH r AS (SELECT conv_id, turn, role, text, sha256(strlen(role)::VARCHAR || ':' || role || text) AS x FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, x) AS own, ({_CRC.format("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM r GROUP BY 1),
b AS (SELECT t.conv_id, list_concat(CASE WHEN d.own IS NULL THEN t.own[1:0] ELSE d.own[1:t.h] END, t.own[t.h + 1:len(t.own)]) AS s FROM t LEFT JOIN t d ON d.conv_id = t.conv_id - t.conv_id % 20),
m AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids FROM m GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.k[n.d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k),
up AS (SELECT k[1:a] AS k, a AS d, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own)),
below AS (SELECT k, d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1, 2)
SELECT own.conv_id, own.d AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ids) AS ends_sha256
FROM own JOIN below ON below.d = own.d AND below.k = own.k LEFT JOIN n p ON p.d = own.d - 1 AND p.k = own.k[1:own.d - 1]
"""

_VARIANTS = rf"""
WITH RECURSIVE r AS (SELECT id, run, count(*) AS times FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
c AS (SELECT run, times, {_CRC.format("id || ':' || run")} AS h FROM r),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = less UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = less),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND k = 1),
way AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT way.word, way.next, forms.form FROM way JOIN forms ON forms.word = way.next)
SELECT forms.word, forms.form, way.root, forms.n, n_near, form_n FROM forms JOIN way ON way.word = forms.word AND way.next IS NULL
"""

ORACLE_SQL = {
    "op1_decontamination": _CONTAMINATION,
    "op4_near_dedup": _NEAR,
    "op6_warc": _WARC,
    "op7_suffix_dedup": _REPEATS,
    "op11_prefix_trie": _TRIE,
    "op13_spelling_variants": _VARIANTS,
}
