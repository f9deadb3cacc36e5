"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from docmill.llm.bpe import op7_byte_bpe
from docmill.llm.decontaminate import op9_decontaminate
from docmill.llm.exact import op12_exact_dedup
from docmill.llm.fingerprint import op8_order_minhash
from docmill.llm.jaccard import op10_ngram_jaccard
from docmill.llm.lexical import op11_ranked_lexical
from docmill.llm.pii import op5_pii
from docmill.llm.secrets import op1_secret_scan
from docmill.llm.toxicity import op2_toxicity
from docmill.llm.urlfilter import op3_url_filter
from docmill.llm.warc import op6_warc
from docmill.llm.wrapper import op4_html_text

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_order_minhash": op8_order_minhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ranked_lexical": op11_ranked_lexical,
    "op12_exact_dedup": op12_exact_dedup,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

#: The other operators hold trained models, sketches or tokenizers that SQL can't express;
#: tests/llm holds them against brute force, exact round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
  g AS (SELECT d, min(page_id) AS first, count(*) AS k FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.k > 1 AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.k > 1 AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND p.n >= 100 AND g.first IS NOT NULL
""",
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS ss FROM w),
  n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n, md5(array_to_string(list_sort(ss), chr(10))) AS k FROM s),
  e AS (SELECT doc_id, unnest(ss) AS x FROM s),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)
    UNION SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
  groups AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
  counts AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT n.doc_id, g.class_id, min(n.doc_id) OVER (PARTITION BY n.k) AS copy_of, coalesce(c.k, 0) AS n_links, n.n AS n_shingles
FROM n JOIN groups g ON g.a = n.doc_id LEFT JOIN counts c ON c.a = n.doc_id
""",
    "op11_ranked_lexical": f"""
WITH d AS (SELECT doc_id, {_TERMS} FROM documents), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
  p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
  l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
  s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
  x AS (SELECT q.item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
  r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""",
    "op12_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256, {_FOLDED} AS f FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY f)
""",
}
