"""The ten operators' queries, and what SQL can say of them."""

from __future__ import annotations

from goldweave.llm.chat import OP6_SQL, op6_chat_round_trip
from goldweave.llm.decontaminate import op7_decontaminate
from goldweave.llm.langid import op10_language_bitmask
from goldweave.llm.neardup import op2_bagminhash
from goldweave.llm.packing import op5_hilbert_packing
from goldweave.llm.pii import op3_bootstrapped_pii, personal_data_base
from goldweave.llm.shards import OP1_SQL, op1_hilbert_shards
from goldweave.llm.token_counts import op8_token_counts
from goldweave.llm.topk import op9_block_topk
from goldweave.llm.toxicity import op4_toxicity_trees

QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards,
        op2_bagminhash,
        op3_bootstrapped_pii,
        op4_toxicity_trees,
        op5_hilbert_packing,
        op6_chat_round_trip,
        op7_decontaminate,
        op8_token_counts,
        op9_block_topk,
        op10_language_bitmask,
    )
} | {"personal_data_base": personal_data_base}

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: A text's words, as DuckDB lists them: A-Z lower-cased, digits, letters and non-ASCII characters.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS w FROM i, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS u(p) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, p, array_to_string(ws[p : p + k - 1], ' ') AS w FROM d, ks, unnest(range(1, len(ws) - k + 2)) AS u(p)),
hits AS (SELECT rid, iw.k, p, item FROM dw JOIN iw ON dw.k = iw.k AND dw.w = iw.w),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rid),
s AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT doc_id, hash(array_to_string(ws[p : p + 4], ' ')) AS s, count(*) AS c FROM (SELECT DISTINCT doc_id, ws FROM d WHERE len(ws) > 0), unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS u(p) GROUP BY 1, 2),
t AS MATERIALIZED (SELECT doc_id, sum(c) AS n FROM b GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS shared FROM b x JOIN b y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN t x ON a = x.doc_id JOIN t y ON b = y.doc_id WHERE 5 * shared >= 4 * (x.n + y.n - shared)
  UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM d WHERE text IS NOT NULL),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON r.id = u.a WHERE r.root < u.b)
SELECT doc_id, class_id FROM documents LEFT JOIN (SELECT id, min(root) AS class_id FROM r GROUP BY id) c ON doc_id = c.id
"""


def _kind_sql(kind: str, pattern: str, good: str) -> str:
    """(rid, kind, start, stop) of a pattern's valid matches: their places are the lengths of all that stands before them."""
    return f"""SELECT rid, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(between[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, found[i] AS surface
    FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS between FROM d), unnest(range(1, len(found) + 1)) AS u(i) WHERE {good.replace("{s}", "found[i]")}"""


_DIGITS = "regexp_replace({s}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda p: CASE WHEN p % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), p, 1) AS INT) ELSE CAST(substr(reverse({_DIGITS}), p, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse({_DIGITS}), p, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PERSONAL_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
s AS (
  {_kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE")}
  UNION ALL {_kind_sql("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split({s}, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0")}
  UNION ALL {_kind_sql("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")}
  UNION ALL {_kind_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}
), a AS (SELECT rid, count(*) FILTER (kind = 'email') AS e, count(*) FILTER (kind = 'ip') AS i, count(*) FILTER (kind = 'card') AS c, count(*) FILTER (kind = 'phone') AS p,
  string_agg(kind || ':' || start || ':' || (start + length(surface)), ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), start) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (rid)
"""

ORACLE = {"op1_hilbert_shards": OP1_SQL, "op2_bagminhash": OP2_SQL, "op6_chat_round_trip": OP6_SQL, "op7_decontaminate": OP7_SQL, "op9_block_topk": OP9_SQL, "personal_data_base": PERSONAL_SQL}
