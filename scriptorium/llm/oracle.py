"""SQL for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_ROWS = """rows AS (SELECT 'rag_chunks' AS src_table, chunk_row AS row_id, content AS text FROM rag_chunks
  UNION ALL SELECT 'vector_documents', vec_row, text FROM vector_documents)"""


def _canon(c: str) -> str:
    return rf"regexp_replace(lower(replace({c}, 'ß', 'ss')), '[^\p{{L}}\p{{N}}]', '', 'g')"


_COPIES = rf"""{_ROWS},
worded AS (SELECT *, regexp_extract_all(lower(replace(text, 'ß', 'ss')), '[\p{{L}}\p{{N}}]+') AS words,
  list_filter(list_transform(string_split_regex(text, '[\r\n;|]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS parts FROM rows WHERE text IS NOT NULL),
long AS (SELECT * FROM worded WHERE len(words) >= 30),
keyed AS (SELECT src_table, row_id, words, {_canon("text")} AS k, CASE WHEN len(parts) >= 4
  AND len(list_filter(parts, lambda x: regexp_matches(x, '^[^:]*[^:\s][^:]*:[^:]*[^:\s][^:]*$'))) = len(parts)
  THEN array_to_string(list_sort(list_transform(parts, lambda x: {_canon("x")})), '|') END AS f FROM long),
classes AS (SELECT *, coalesce(min(f) OVER (PARTITION BY src_table, k), k) AS c FROM keyed),
firsts AS (SELECT *, min(row_id) OVER (PARTITION BY src_table, c) AS row_a, count(*) OVER (PARTITION BY src_table, c) AS n FROM classes)"""

_NEAR = f"""{_COPIES},
grams AS (SELECT DISTINCT src_table, row_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS g FROM keyed),
sizes AS (SELECT src_table, row_id, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT a.src_table, a.row_id AS row_a, b.row_id AS row_b, count(*) AS common FROM grams a JOIN grams b
  ON a.src_table = b.src_table AND a.g = b.g AND a.row_id < b.row_id GROUP BY ALL),
near AS (SELECT s.src_table, s.row_a, s.row_b FROM shared s
  JOIN sizes x ON x.src_table = s.src_table AND x.row_id = s.row_a JOIN sizes y ON y.src_table = s.src_table AND y.row_id = s.row_b
  JOIN keyed p ON p.src_table = s.src_table AND p.row_id = s.row_a JOIN keyed q ON q.src_table = s.src_table AND q.row_id = s.row_b
  WHERE 5 * common >= 3 * (x.n + y.n - common) AND p.k <> q.k AND (p.f IS NULL OR q.f IS NULL OR p.f <> q.f))"""

_GROUPS = f"""WITH RECURSIVE {_NEAR},
same AS (SELECT src_table, row_id, min(row_id) OVER (PARTITION BY src_table, array_to_string(words, ' '), coalesce(f, '')) AS least FROM keyed),
edges AS (SELECT src_table, row_a AS a, row_b AS b FROM near UNION SELECT src_table, row_b, row_a FROM near
  UNION SELECT src_table, least, row_id FROM same WHERE least <> row_id UNION SELECT src_table, row_id, least FROM same WHERE least <> row_id),
reach AS (SELECT src_table, row_id, row_id AS r FROM keyed UNION SELECT e.src_table, e.b, reach.r FROM reach JOIN edges e ON e.src_table = reach.src_table AND e.a = reach.row_id),
ids AS (SELECT src_table, row_id, min(r) AS group_id FROM reach GROUP BY ALL),
ends AS (SELECT src_table, row_a AS row_id FROM near UNION ALL SELECT src_table, row_b FROM near),
degrees AS (SELECT src_table, row_id, count(*) AS links FROM ends GROUP BY ALL)
SELECT src_table, row_id, coalesce(group_id, row_id) AS group_id, coalesce(links, 0) AS links
FROM rows LEFT JOIN ids USING (src_table, row_id) LEFT JOIN degrees USING (src_table, row_id)"""

#: One step of the recursion settles a run, against what the runs before it accepted.
_HISTORY = f"""WITH RECURSIVE {_NEAR},
placed AS (SELECT chunk_row AS row_id, run_no FROM rag_chunks JOIN pipeline_runs USING (pipeline_run_id)),
alike AS (SELECT row_a AS x, row_b AS y FROM near WHERE src_table = 'rag_chunks'
  UNION SELECT p.row_id, q.row_id FROM classes p JOIN classes q ON p.src_table = q.src_table AND p.c = q.c AND p.row_id < q.row_id WHERE p.src_table = 'rag_chunks'),
links AS (SELECT CASE WHEN p.run_no < q.run_no THEN x ELSE y END AS a, CASE WHEN p.run_no < q.run_no THEN y ELSE x END AS b, greatest(p.run_no, q.run_no) AS run_b
  FROM alike JOIN placed p ON p.row_id = x JOIN placed q ON q.row_id = y WHERE p.run_no <> q.run_no),
settled AS (SELECT 0 AS run, []::BIGINT[] AS cases UNION ALL SELECT run + 1, list_concat(cases,
  coalesce((SELECT list(DISTINCT b) FROM links WHERE run_b = settled.run + 1 AND NOT list_contains(settled.cases, a)), [])) FROM settled WHERE run < (SELECT max(run_no) FROM pipeline_runs)),
jobs AS (SELECT id, run_no, lower(nullif(regexp_extract(checksum, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{64}})(?:[^0-9a-fA-F]|$)', 1), '')) AS s,
  coalesce(upper(trim(job_status)) = 'COMPLETED' OR upper(trim(status)) = 'SUCCESS', false) AS done FROM document_jobs JOIN pipeline_runs USING (pipeline_run_id))
SELECT 'chunk' AS kind, unnest(cases) AS row_id FROM (SELECT cases FROM settled ORDER BY run DESC LIMIT 1)
UNION ALL SELECT 'job', id FROM jobs j WHERE EXISTS (SELECT 1 FROM jobs o WHERE o.s = j.s AND coalesce(o.done, false) AND o.run_no < j.run_no)"""

_NEIGHBOURS = """WITH u AS (SELECT vec_row, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM vector_documents
  WHERE NOT metadata.deduplicated AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_row AS a, b.vec_row AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS cosine FROM u a, u b WHERE a.vec_row <> b.vec_row),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t WHERE cosine >= 0.9"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_COPIES} SELECT src_table, row_a, row_id AS row_b FROM firsts WHERE row_id <> row_a",
        "p1_records": f"""WITH {_COPIES} SELECT src_table, row_id, coalesce(n, 1)::BIGINT AS copies FROM rows
            LEFT JOIN firsts USING (src_table, row_id) WHERE row_a IS NULL OR row_a = row_id""",
        "p3_found": _NEIGHBOURS,
        "p4_found": f"WITH {_NEAR} SELECT src_table, row_a, row_b FROM near",
        "p4_groups": _GROUPS,
        "p6_found": _HISTORY,
        "p5_found": "SELECT chunk_row FROM rag_chunks WHERE length(content) > 1600",
    }
