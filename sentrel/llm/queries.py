"""Registered queries of the operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrel.llm.decontamination import op7_decontaminate
from sentrel.llm.hard_negatives import op12_hard_negatives
from sentrel.llm.mixing import op1_mix_sources
from sentrel.llm.near_dedup import op8_minhash_dedup
from sentrel.llm.pii import op2_pii
from sentrel.llm.quality import op6_quality_classifier
from sentrel.llm.scoring import op13_lm_scoring
from sentrel.llm.substring_dedup import op5_substring_dedup
from sentrel.llm.token_counts import op10_token_counts
from sentrel.llm.token_store import op9_token_store
from sentrel.llm.url_filter import op4_url_filter
from sentrel.llm.vector_codes import op11_vector_codes
from sentrel.llm.vector_dedup import op3_vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_pii": op2_pii,
        "op3_vector_dedup": op3_vector_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_decontaminate": op7_decontaminate,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_token_store": op9_token_store,
        "op10_token_counts": op10_token_counts,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_lm_scoring": op13_lm_scoring,
    }


_CLOSURE = """near(a, b) AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
 root AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""



def _rounds(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Lloyd rounds as one pair of common tables each: all distances to all entries, then floors of means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT id, p, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := k)) AS b
  FROM part JOIN book{i} USING (p) GROUP BY id, p)""")
        if i < rounds:
            steps.append(f"""sum{i} AS (SELECT p, b.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM near{i}, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL),
 mean{i} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM sum{i} GROUP BY p, k),
 book{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, c) AS c FROM book{i} LEFT JOIN mean{i} USING (p, k))""")
    return f"""ok AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 part AS MATERIALIZED (SELECT id, p, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] AS x FROM ok, unnest(range({parts})) AS u(p)),
 seeds AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM ok QUALIFY k < {entries}),
 book0 AS (SELECT p, k, x AS c FROM part JOIN seeds USING (id)), {", ".join(steps)},
 coded AS (SELECT id, string_agg(printf('%02x', b.k::INT), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM near{rounds} GROUP BY id),
 name AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, j)) AS h FROM (SELECT p, k, unnest(c) AS v, unnest(range(len(c))) AS j FROM book{rounds}))
 SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN ok USING (id), name"""


#: Plain statements of the contracts: all pairs, all shingles, all 50-byte strings, all distances.
SQL = {
    "op11_vector_codes": f"WITH {_rounds()}",
    "op12_hard_negatives": """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 pos AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
 SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
 FROM pos p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s QUALIFY rank <= 5""",
    "op3_vector_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98), {_CLOSURE},
 n AS (SELECT a, count(*) AS n_links FROM near GROUP BY a)
 SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
 FROM v LEFT JOIN root ON root.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_substring_dedup": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS MATERIALIZED (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 100) AS g FROM d, unnest(range(length(h) // 2 - 49)) AS u(i)),
 least_ AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g HAVING count(*) > 1),
 gone AS (SELECT doc_id, i FROM s JOIN least_ USING (g) WHERE doc_id > m),
 edges AS (SELECT doc_id, i AS a, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gone),
 runs AS (SELECT doc_id, a, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS r FROM edges),
 spans AS (SELECT doc_id, r, min(a) AS a, max(a) + 50 AS b FROM runs GROUP BY doc_id, r),
 cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
 kept AS (SELECT c.doc_id, string_agg(substr(h, (2 * before + 1)::INT, (2 * (a - before))::INT), '' ORDER BY a) AS k, max(b) AS last, sum(b - a) AS n, count(*) AS c FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
 SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k || substr(h, (2 * last + 1)::INT), h))) AS kept_sha256
 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)), {_CLOSURE}
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id)::BIGINT AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
