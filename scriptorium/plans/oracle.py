"""The SQL oracle of the core's queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from scriptorium.functions import text as T
from scriptorium.functions.predicates import ASKS_FOR_CODE, ASKS_FOR_RESUME, CODE_MARKS, INDEX_MARKS, NOTICE_MARKS
from scriptorium.operators.synthesis import NOISE_PARTS, NOISE_PARTS_ANY_CASE, NOISE_STARTS, NOISE_STARTS_ANY_CASE, OUTLINE_PREFIXES

PHRASE = "medical certificate of the insurer"
NOTHING = "zyx wvu"  # words that no text holds
SECOND = "grievance panel earned leave price schedule"
_SPACE = r"[ \t\n\x0B\f\r]"
_CHARS = "concat(" + ", ".join(f"chr({i})" for i in range(1, 33)) + ")"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"trim({c}, {_CHARS})"


def blank(c: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), {_q(T.BLANK)})"


def content_hash(c: str) -> str:
    normal = f"regexp_replace(lower({trim(c)}), '{_SPACE}+', ' ', 'g')"
    return f"(CASE WHEN {blank(c)} THEN 'chk_empty' ELSE 'chk_' || substr(sha256({normal}), 1, 16) END)"


def source(document: str = "document_name", page: str = "page_number") -> str:
    return f"(coalesce({document}, '') || ':p' || coalesce({page}, 0)::VARCHAR)"


def any_of(c: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(m)})" for m in marks) + ")"


def words(query: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) > 2 and w not in T.STOP_WORDS]


def lexical(query: str, text: str = "content") -> str:
    target = f"lower(coalesce(document_name, '') || ' ' || coalesce(heading, '') || ' ' || coalesce({text}, ''))"
    share = "(" + " + ".join(f"contains({target}, {_q(w)})::INT" for w in words(query)) + f")::DOUBLE / {len(words(query))}"
    return f"(CASE WHEN contains({target}, {_q(query.lower().strip())}) THEN least(1.0, {share} + 0.3) ELSE {share} END)"


def rules(text: str = "content") -> str:
    low, size = f"lower(coalesce({text}, ''))", f"length(coalesce({text}, ''))"
    return (
        f"((starts_with({low}, '# document:') AND {size} < 280)::INT + {any_of(low, (*INDEX_MARKS, 'table of contents'))}::INT"
        f" + ({any_of(low, NOTICE_MARKS)} AND {size} < 220)::INT)"
    )


def hybrid(v: str, l: str, m: str) -> str:  # noqa: E741
    lex, vec = f"({l} * power(0.05, {m}))", f"({v} * power(0.1, {m}))"
    return f"(CASE WHEN {lex} > 0 THEN 0.35 * {vec} + 0.65 * {lex} ELSE 0.75 * {vec} END)"


_TOKENS = "list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_HASH = "list_reduce(list_transform(string_split(t, ''), lambda ch: ascii(ch)::BIGINT), lambda a, x: (a * 31 + x) % 4294967296, 0::BIGINT)"
_BUCKETS = f"""
tokens AS (SELECT chunk_row, unnest({_TOKENS}) AS t FROM rag_chunks),
vocabulary AS (SELECT t, {_HASH} AS h FROM (SELECT DISTINCT t FROM tokens)),
histogram AS (
  SELECT chunk_row, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 128)::INT AS bucket, count(*) AS n
  FROM tokens JOIN vocabulary USING (t) GROUP BY ALL
)"""


_BUCKET = "(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 128)::INT"


def query_vector(query: str, name: str) -> str:
    """A CTE with the embedding of a literal query: (bucket, w)."""
    tokens = ", ".join(_q(t) for t in re.split("[^a-z0-9]+", query.lower()) if t)
    return f"""{name} AS (SELECT bucket, n / sqrt(sum(n * n) OVER ()) AS w FROM (SELECT {_BUCKET} AS bucket, count(*)::DOUBLE AS n
  FROM (SELECT {_HASH} AS h FROM (SELECT unnest([{tokens}]) AS t)) GROUP BY 1))"""


def scored(query: str, name: str) -> str:
    """CTEs that score all chunks once for a query."""
    return f"""
{query_vector(query, name + "_q")},
{name}_v AS (SELECT chunk_row, sum(n * coalesce(w, 0)) / sqrt(sum(n * n)) AS v FROM histogram LEFT JOIN {name}_q USING (bucket) GROUP BY chunk_row),
{name} AS (
  SELECT {content_hash("content")} AS id, chunk_row AS row_key, document_name, page_number, heading, coalesce(content, '') AS content, [{source()}] AS listed,
    {lexical(query)} AS l, {rules()} AS m, {hybrid("coalesce(v, 0)", lexical(query), rules())} AS score
  FROM rag_chunks LEFT JOIN {name}_v USING (chunk_row)
)"""


def stored(query: str, name: str) -> str:
    """CTEs that score all stored vectors once for a query."""
    listed = f"CASE WHEN {blank('metadata.sources')} THEN [{source()}] ELSE list_filter(string_split_regex(metadata.sources, ';\\s*'), lambda x: {trim('x')} <> '') END"
    dot = "CASE WHEN len(embedding) = 128 THEN d ELSE 0 END"
    return f"""{query_vector(query, name + "_q")},
{name}_e AS (SELECT vec_row, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS bucket FROM vector_documents WHERE embedding IS NOT NULL),
{name}_v AS (SELECT vec_row, sum(x::DOUBLE * w) AS d FROM {name}_e JOIN {name}_q USING (bucket) GROUP BY vec_row),
{name} AS (
  SELECT id, vec_row AS row_key, document_name, page_number, heading, coalesce(text, '') AS content, {listed} AS listed,
    {lexical(query, "text")} AS l, {rules("text")} AS m, {hybrid(f"coalesce({dot}, 0)", lexical(query, "text"), rules("text"))} AS score
  FROM vector_documents LEFT JOIN {name}_v USING (vec_row) WHERE embedding IS NOT NULL
)"""


def searched(query: str, k: int, rows: str | None = None) -> str:
    """CTEs down to `shown`: the k results of a search, of the chunks or of other scored `rows`."""
    return f"""WITH {rows or f"{_BUCKETS}, {scored(query, 's')}"},
top AS (SELECT * FROM s ORDER BY score DESC, id, row_key LIMIT {4 * k}),
one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, row_key) = 1),
again AS (SELECT * EXCLUDE (score), {hybrid("score", "l", "m")} AS score FROM one),
ranked AS (SELECT *, row_number() OVER w AS n, first_value(document_name) OVER w AS doc, first_value(score) OVER w AS best
  FROM again WINDOW w AS (ORDER BY score DESC, id, row_key)),
shown AS (SELECT row_number() OVER (ORDER BY CASE WHEN best >= 0.55 AND document_name IS DISTINCT FROM doc THEN 1 ELSE 0 END, n)::INT AS rank, *
  FROM ranked WHERE best < 0.55 OR document_name IS NOT DISTINCT FROM doc OR score >= 0.40 QUALIFY rank <= {k})"""


def clean(c: str) -> str:
    line = trim("x")
    keep = " AND ".join(f"NOT starts_with({line}, {_q(m)})" for m in T.METADATA_LINES)
    keep += f" AND NOT starts_with(lower({line}), '## page ') AND NOT starts_with(lower({line}), 'page ')"
    return trim(f"array_to_string(list_filter(string_split_regex(coalesce({c}, ''), '\\r?\\n'), lambda x: {keep}), chr(10))")


def strip(c: str) -> str:
    out = f"coalesce({c}, '')"
    for pattern in T.OUTLINE_PATTERNS:
        out = f"regexp_replace({out}, {_q(pattern)}, '', 'g')"
    return f"CASE WHEN {blank(c)} THEN '' ELSE {trim(out)} END"


def boilerplate(c: str) -> str:
    bare = trim(f"coalesce({c}, '')")
    return (
        f"({blank(c)} OR (length({bare}) < 240 AND (starts_with({bare}, '# Document:') OR starts_with({bare}, '> Source:')))"
        f" OR regexp_matches({bare}, '(?is)^#\\s*Document:.*>\\s*Source:.*>\\s*Total Pages:.*$'))"
    )


def cover(c: str) -> str:
    low, size = f"lower(coalesce({c}, ''))", f"length(coalesce({c}, ''))"
    return f"({blank(c)} OR (starts_with({low}, '# document:') AND {size} < 280) OR ({any_of(low, NOTICE_MARKS)} AND {size} < 220) OR {any_of(low, INDEX_MARKS)})"


def resume(c: str, query: str) -> str:
    if any(w in query.lower() for w in ASKS_FOR_RESUME):
        return "false"
    doc, low = "lower(coalesce(document_name, ''))", f"lower(coalesce({c}, ''))"
    return (
        f"({any_of(doc, ('resume', 'cv'))} OR (NOT {blank(c)} AND ({any_of(low, ('b.tech', 'curriculum vitae', 'full-stack web development intern'))}"
        f" OR (contains({low}, 'education') AND contains({low}, 'cgpa')) OR (contains({low}, 'technical skills') AND {any_of(low, ('github', 'linkedin'))}))))"
    )


def code_dump(c: str, query: str) -> str:
    if any(w in query.lower() for w in ASKS_FOR_CODE):
        return "false"
    low = f"lower(coalesce({c}, ''))"
    return "(" + " + ".join(f"contains({low}, {_q(m)})::INT" for m in CODE_MARKS) + " >= 2)"


def preview(c: str, length: int, collapse: bool) -> str:
    flat = trim(f"regexp_replace(coalesce({c}, ''), '{_SPACE}+', ' ', 'g')") if collapse else f"coalesce({c}, '')"
    return f"CASE WHEN length({flat}) > {length} THEN substr({flat}, 1, {length}) || '...' ELSE {flat} END"


def state() -> str:
    names = ", ".join(_q(s) for s in ("DISCOVERED", "PROCESSING", "VALIDATED", "CHUNKED", "EMBEDDED", "STORED", "COMPLETED", "FAILED", "SKIPPED"))

    def parse(c: str) -> str:
        up = f"upper({trim(c)})"
        return f"CASE WHEN {up} = 'SUCCESS' THEN 'COMPLETED' WHEN {up} IN ({names}) THEN {up} END"

    return f"coalesce({parse('job_status')}, {parse('status')})"


def completed() -> str:
    return f"(coalesce({state()} = 'COMPLETED', false) OR coalesce(upper({trim('status')}) = 'SUCCESS', false))"


def _relevant(phrase: str = PHRASE) -> str:
    text = "clean"
    return (
        searched(phrase, 15)
        + f""",
cleaned AS (SELECT *, {clean("content")} AS clean FROM shown),
content_rows AS (SELECT * FROM cleaned WHERE NOT ({boilerplate("content")} OR {blank(text)} OR {cover(text)} OR {resume(text, phrase)} OR {code_dump(text, phrase)})),
judged AS (SELECT *, max(score) FILTER (score >= 0.25) OVER () AS strongest, min(rank) OVER () AS earliest FROM content_rows),
kept AS (SELECT * FROM judged WHERE (score >= 0.25 AND score >= CASE WHEN strongest >= 0.65 THEN greatest(0.40, strongest * 0.70) ELSE 0.25 END)
  OR (strongest IS NULL AND rank = earliest)),
final AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY rank)::INT AS rank FROM kept QUALIFY row_number() OVER (ORDER BY rank) <= 5)"""
    )


_FIRST = "coalesce(document_name, ''), coalesce(page_number, 0), chunk_row"
_KIND = """CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '[ \\t\\n\\x0B\\f\\r]{3,}') AND length(line) > 10 THEN 'table'
  WHEN regexp_matches(line, '^(\\d+(\\.\\d+)+)\\s+(.+)$') THEN 'legal' WHEN regexp_matches(line, '^(\\d+\\.)\\s+(.+)$') THEN 'numbered'
  WHEN regexp_matches(line, '^[•\\-*–—]\\s+(.+)$') THEN 'bullet'
  WHEN length(line) BETWEEN 5 AND 80 AND NOT regexp_matches(line, '[.,;]$') AND ((upper(line) = line AND regexp_matches(line, '[A-Z]'))
    OR starts_with(line, 'Order') OR starts_with(line, 'Chapter') OR starts_with(line, 'Section') OR starts_with(line, 'कार्यालय')) THEN 'heading'
  ELSE 'paragraph' END"""
_MARKDOWN = """CASE kind
            WHEN 'legal' THEN '### ' || regexp_replace(line, '^(\\d+(\\.\\d+)+)\\s+(.+)$', '\\1 \\3')
            WHEN 'numbered' THEN regexp_replace(line, '^(\\d+\\.)\\s+(.+)$', '\\1 \\2')
            WHEN 'bullet' THEN '- ' || regexp_replace(line, '^[•\\-*–—]\\s+(.+)$', '\\1')
            WHEN 'heading' THEN '### ' || line ELSE line END"""
_LINES = f"""WITH split AS (SELECT chunk_row, string_split_regex(coalesce(content, ''), '\\r?\\n') AS parts FROM rag_chunks),
numbered AS (SELECT chunk_row, unnest(generate_series(0, len(parts) - 1))::INT AS line_no, unnest(parts) AS raw FROM split),
lines AS (SELECT chunk_row, line_no, {trim("raw")} AS line FROM numbered),
kinds AS (SELECT *, {_KIND} AS kind FROM lines)"""
_PIECES = "string_split(coalesce(text, ''), chr(10) || chr(10))"
_PREAMBLE = """'# Document: doc_' || doc_id || chr(10) || '> Source: doc_' || doc_id || chr(10) || '> Total Pages: ' || {n} || chr(10) || chr(10)"""
_STAGED = f"""staged AS (SELECT 'doc_' || doc_id AS document_name, {_PREAMBLE.format(n=f"len({_PIECES})")}
  || array_to_string(list_transform({_PIECES}, lambda x, i: '## Page ' || i || chr(10) || chr(10) || x), chr(10) || chr(10)) AS text FROM documents)"""

_WHITE = r"[\t-\r\x1c-\x1f \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"


def _chunked() -> str:
    """CTEs down to `chunks`: one step of the recursion takes the next line of every document."""
    mark, title = r"(?i)^##\s+Page\s+(\d+)", r"^###?\s+(.+)$"
    filled = f"{trim('buffer')} <> ''"
    tail = trim(f"regexp_extract(right(grown, 150), '(?s){_WHITE}.*$')")
    return f"""WITH RECURSIVE {_STAGED},
split AS (SELECT document_name, string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS parts FROM staged),
lines AS (SELECT document_name, unnest(generate_series(0, len(parts) - 1)) AS i, unnest(parts) AS x FROM split),
fold AS (
  SELECT document_name, 0::BIGINT AS i, 1 AS page, 'General' AS heading, '' AS buffer, 0 AS n,
    NULL::VARCHAR AS e_content, NULL::INT AS e_page, NULL::VARCHAR AS e_heading, NULL::INT AS e_size FROM split
  UNION ALL
  SELECT document_name, i + 1,
    CASE WHEN marked THEN regexp_extract(x, '{mark}', 1)::INT ELSE page END,
    new_heading,
    CASE WHEN marked THEN (CASE WHEN closes THEN '' ELSE buffer END) WHEN closes THEN (CASE WHEN {tail} <> '' THEN {tail} || ' ' ELSE '' END) ELSE grown END,
    n + closes::INT,
    CASE WHEN closes THEN {trim("CASE WHEN marked THEN buffer ELSE grown END")} END,
    CASE WHEN closes THEN page END, CASE WHEN closes THEN new_heading END,
    CASE WHEN closes THEN length(CASE WHEN marked THEN buffer ELSE grown END)::INT END
  FROM (SELECT *, CASE WHEN marked THEN {filled} ELSE length(grown) >= 1200 END AS closes,
      CASE WHEN NOT marked AND regexp_matches(x, '{title}') THEN {trim(f"regexp_extract(x, '{title}', 1)")} ELSE heading END AS new_heading
    FROM (SELECT f.*, l.x, regexp_matches(l.x, '{mark}') AS marked, f.buffer || l.x || chr(10) AS grown
      FROM fold f JOIN lines l ON l.document_name = f.document_name AND l.i = f.i))
),
emitted AS (SELECT document_name, n - 1 AS k, e_page AS page_number, e_heading AS heading, e_content AS content, e_size AS character_count FROM fold WHERE e_size IS NOT NULL
  UNION ALL SELECT document_name, n, page, heading, {trim("buffer")}, length(buffer)::INT FROM fold JOIN split USING (document_name) WHERE i = len(parts) AND {filled}),
chunks AS (SELECT document_name || '_chunk_' || k AS chunk_id, document_name, page_number, heading, content, character_count FROM emitted)"""


def _steps(key: str, value: str, first: str, then: str) -> str:
    """CTEs down to `steps`: the events of each key in order, one step of the recursion an event.

    `first` and `then` give the columns of a step, from the event (ms, value) and the step before (p).
    """
    return f"""WITH RECURSIVE events_ AS (SELECT request_id, CASE WHEN {blank(key)} THEN 'anonymous' ELSE {key} END AS key, epoch_us(ts) // 1000 AS ms, {value} AS value
  FROM query_log WHERE ts IS NOT NULL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, request_id) AS i FROM events_),
steps AS (SELECT o.request_id, o.key, o.i, o.ms, {first} FROM ordered o WHERE o.i = 1
  UNION ALL SELECT o.request_id, o.key, o.i, o.ms, {then} FROM steps p JOIN ordered o ON o.key = p.key AND o.i = p.i + 1)"""


def _bucket() -> str:
    room = "least(30.0::DOUBLE, p.tokens + (o.ms - p.ms) / 1000.0::DOUBLE)"
    return _steps("client_key", "NULL", "true AS allowed, 29.0::DOUBLE AS tokens", f"{room} >= 1, CASE WHEN {room} >= 1 THEN {room} - 1 ELSE {room} END")


def _cache() -> str:
    key = f"('rag:answer:' || substr(sha256(lower({trim('coalesce(query_text, chr(32))')}) || ':' || coalesce(top_k, 5)), 1, 16))"
    hit = "o.ms <= p.expires"
    return _steps(key, "NULL", "false AS hit, o.ms + 900000 AS expires", f"{hit}, CASE WHEN {hit} THEN p.expires ELSE o.ms + 900000 END")


def _flights() -> str:
    normal = f"regexp_replace({trim('coalesce(query_text, chr(32))')}, '{_SPACE}+', ' ', 'g')"
    ends = "o.ms + greatest(0.0::DOUBLE, coalesce(o.value, 0.0::DOUBLE))"
    shared = "o.ms < p.ends"
    return _steps(f"(lower({normal}) || ':' || coalesce(top_k, 5))", "latency_ms", f"false AS shared, {ends} AS ends", f"{shared}, CASE WHEN {shared} THEN p.ends ELSE {ends} END")


def _breaker() -> str:
    failed = f"coalesce(upper({trim('outcome')}), 'UNKNOWN') <> 'SUCCESS'"
    waits = "(p.state = 'OPEN' AND o.ms - p.since < 5000)"
    trial = "(p.state = 'HALF_OPEN' OR p.state = 'OPEN')"
    ring = "list_slice(list_append(p.ring, o.value), -20, -1)"
    trips = f"(o.value AND (CASE WHEN {trial} THEN true ELSE len({ring}) >= 10 AND len(list_filter({ring}, lambda x: x)) / len({ring}) >= 0.5 END))"
    state = f"CASE WHEN {waits} THEN p.state WHEN {trips} THEN 'OPEN' WHEN {trial} THEN 'CLOSED' ELSE p.state END"
    since = f"CASE WHEN {waits} THEN p.since WHEN {trips} OR {trial} THEN o.ms ELSE p.since END"
    kept = f"CASE WHEN {waits} THEN p.ring WHEN {trial} AND NOT o.value THEN [] ELSE {ring} END"
    return _steps(
        "client_key", failed, "true AS allowed, 'CLOSED' AS state, 0::BIGINT AS since, [o.value] AS ring", f"NOT {waits}, {state}, {since}, {kept}"
    )


def _salient() -> str:
    def starts(c: str, marks: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"starts_with({c}, {_q(m)})" for m in marks) + ")"

    bare = "s"
    for prefix in OUTLINE_PREFIXES:
        bare = f"regexp_replace({bare}, {_q(prefix)}, '')"
    return f"""WITH parts AS (SELECT chunk_row, string_split(regexp_replace(coalesce(content, ''), '([.!?\\n]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM rag_chunks),
u AS (SELECT chunk_row, unnest(generate_series(1, len(p))) AS i, {trim(f"regexp_replace(unnest(p), '{_SPACE}+', ' ', 'g')")} AS s FROM parts),
good AS (SELECT chunk_row, i, {trim(bare)} AS s FROM u WHERE length(s) >= 25 AND NOT {starts("s", NOISE_STARTS)} AND NOT {starts("lower(s)", NOISE_STARTS_ANY_CASE)}
  AND NOT {any_of("s", NOISE_PARTS)} AND NOT {any_of("lower(s)", NOISE_PARTS_ANY_CASE)}),
kept AS (SELECT chunk_row, row_number() OVER (PARTITION BY chunk_row ORDER BY i)::INT - 1 AS sentence_no,
  CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS sentence FROM good WHERE length(s) >= 20 AND {any_of("lower(s)", tuple(words(PHRASE)))})
SELECT * FROM kept WHERE sentence_no < 3"""


def _markdown() -> str:
    """Staged Markdown: lines by kind, runs of table lines as pipe tables, pages, documents."""
    nl, gap = "chr(10)", "[ \\t\\n\\x0B\\f\\r]{3,}"

    def cell(x: str) -> str:
        return trim(f"replace({x}, '|', '\\|')")

    def row(cells: str, rest: str) -> str:
        return f"'|' || array_to_string(list_transform(range(1, width + 1), lambda k: ' ' || (CASE WHEN k <= len({cells}) THEN {cell(f'{cells}[k]')} ELSE {rest} END) || ' |'), '')"

    return f"""WITH pages AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS page, unnest(p) AS txt, len(p) AS n_pages FROM (SELECT doc_id, {_PIECES} AS p FROM documents)),
numbered AS (SELECT doc_id, page, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS raw FROM (SELECT doc_id, page, string_split_regex(txt, '\\r?\\n') AS parts FROM pages)),
lines AS (SELECT doc_id, page, i, {trim("raw")} AS line FROM numbered),
kinds AS (SELECT *, {_KIND} AS kind FROM lines),
islands AS (SELECT *, sum((kind <> 'table')::INT) OVER (PARTITION BY doc_id, page ORDER BY i) AS island FROM kinds),
grids AS (SELECT doc_id, page, min(i) AS i, list(string_split_regex(line, '{gap}') ORDER BY i) AS rows, max(len(string_split_regex(line, '{gap}')))::BIGINT AS width
  FROM islands WHERE kind = 'table' GROUP BY doc_id, page, island),
items AS (SELECT doc_id, page, i, {_MARKDOWN} AS md FROM kinds WHERE kind <> 'table'
  UNION ALL SELECT doc_id, page, i, {row("rows[1]", "'Col ' || k")} || {nl} || '|' || repeat('---|', width)
    || array_to_string(list_transform(rows[2:], lambda r: {nl} || {row("r", "''")}), '') || {nl} FROM grids),
whole AS (SELECT doc_id, page, string_agg(md, {nl} ORDER BY i) || {nl} AS md FROM items GROUP BY doc_id, page),
shown AS (SELECT doc_id, page, n_pages, CASE WHEN regexp_matches(txt, '[^\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{3000}}]') THEN md ELSE '*(blank page)*' || {nl} END AS md
  FROM pages JOIN whole USING (doc_id, page))
SELECT 'doc_' || doc_id AS document_name, {_PREAMBLE.format(n="max(n_pages)")} || string_agg('## Page ' || page || {nl} || {nl} || md, {nl} ORDER BY page) AS text
FROM shown GROUP BY doc_id"""


def _paragraphs() -> str:
    bullet = "(starts_with(line, '- ') OR starts_with(line, '• ') OR starts_with(line, '* '))"
    return f"""WITH split AS (SELECT chunk_row, string_split_regex(regexp_replace(coalesce(content, ''), '[⮚✓➢❖■➔]+', chr(10) || '- ', 'g'), '\\r?\\n') AS p FROM rag_chunks),
lines AS (SELECT chunk_row, unnest(generate_series(1, len(p))) AS i, {trim("unnest(p)")} AS line FROM split),
seen AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY chunk_row ORDER BY i), '') AS before FROM lines),
begun AS (SELECT *, ({bullet} OR before = '') AS begins FROM seen WHERE line <> ''),
grouped AS (SELECT *, sum(begins::INT) OVER (PARTITION BY chunk_row ORDER BY i) AS g FROM begun),
joined AS (SELECT chunk_row, g, string_agg((CASE WHEN begins THEN '' WHEN ends_with(before, '-') THEN '' ELSE ' ' END) || line, '' ORDER BY i) AS p FROM grouped GROUP BY 1, 2)
SELECT chunk_row, (g - 1)::INT AS paragraph_no, {trim("p")} AS paragraph FROM joined"""


def _definitions() -> str:
    bare = "regexp_replace(regexp_replace(regexp_extract(line, '^([^:–-]*)', 1), '[*#_`~⮚✓➢❖■➔()]+', '', 'g'), '^\\s*\\d+(\\.\\d+)*[:.)-]\\s*', '')"
    meaning = "regexp_replace(regexp_extract(line, '(?s)^[^:–-]*[:–-](.*)$', 1), '^[:–-]\\s*', '')"
    return f"""WITH lines AS (SELECT chunk_row, unnest(generate_series(1, len(p))) AS i, {trim("unnest(p)")} AS line
  FROM (SELECT chunk_row, string_split(coalesce(content, ''), chr(10)) AS p FROM rag_chunks)),
told AS (SELECT chunk_row, i, {trim(bare)} AS term, {trim(meaning)} AS definition FROM lines
  WHERE NOT starts_with(line, 'http') AND (contains(line, ':') OR contains(line, ' - ') OR contains(line, ' – '))),
good AS (SELECT * FROM told WHERE length(regexp_replace(term, '[^a-zA-Z0-9]', '', 'g')) >= 2 AND length(term) <= 50 AND length(definition) >= 12
  AND NOT contains(term, ',') AND len(string_split_regex(term, '{_SPACE}+')) <= 5)
SELECT chunk_row, term, definition FROM good QUALIFY row_number() OVER (PARTITION BY chunk_row, term ORDER BY length(definition) DESC, i) = 1"""


def _merged(checksum: str) -> str:
    """CTEs down to `ledger`: all attempts merged, one row a checksum."""
    carried = ", ".join(f"arg_max({c}, id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("total_chunks", "embedded_chunks", "execution_time_ms", "completed_at"))
    return f"""WITH r AS (SELECT *, {checksum} AS c, {state()} AS st, coalesce(error_message, failure_reason) AS err FROM document_jobs),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY id DESC) = 1),
x AS (SELECT c, max(id) FILTER (st = 'COMPLETED') AS done_at, max(id) FILTER (err IS NOT NULL) AS err_at, arg_max(err, id) FILTER (err IS NOT NULL) AS err,
  arg_min(started_at, id) FILTER (started_at IS NOT NULL) AS started_at, {carried} FROM r GROUP BY c),
ledger AS (SELECT l.id, l.filename, c AS checksum, l.total_pages, CASE WHEN st = 'COMPLETED' THEN l.total_pages ELSE l.processed_pages END AS processed_pages,
  x.total_chunks, x.embedded_chunks, st AS job_status, CASE WHEN st = 'COMPLETED' THEN 'SUCCESS' ELSE st END AS status, l.pipeline_run_id, x.execution_time_ms,
  CASE WHEN NOT coalesce(st = 'COMPLETED', false) AND (x.done_at IS NULL OR x.err_at > x.done_at) THEN x.err END AS error_message,
  x.started_at, x.completed_at, l.processed_at FROM l JOIN x USING (c))"""


def oracle_sql() -> dict[str, str]:
    h = content_hash("content")
    form = f"regexp_replace(regexp_replace(lower({trim('coalesce(query_text, chr(32))')}), '[^a-z \\t\\n\\x0B\\f\\r]', '', 'g'), '{_SPACE}+', ' ', 'g')"
    talk = ", ".join(_q(w) for w in (*T.GREETINGS, *T.PLEASANTRIES, *T.ABOUT_ME, "how are you"))
    stop = ", ".join(_q(w) for w in T.STOP_WORDS)
    keys = f"list_filter(string_split_regex(lower(coalesce(query_text, '')), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({stop}))"
    outcome = f"coalesce(upper({trim('outcome')}), 'UNKNOWN')"
    checksum = f"(CASE WHEN {blank('checksum')} THEN 'unknown_' || coalesce(filename, '') ELSE checksum END)"
    quantiles = ", ".join(f"coalesce(quantile_disc(latency_ms, {p}), 0) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return {
        "content_hash": f"SELECT chunk_row, {h} AS content_hash FROM rag_chunks",
        "dedup_flags": f"SELECT chunk_row, {h} AS content_hash, row_number() OVER (PARTITION BY {h} ORDER BY {_FIRST}) > 1 AS is_duplicate FROM rag_chunks",
        "running_sources": f"""SELECT chunk_row, {h} AS content_hash,
            array_to_string(list_sort(list_distinct(list({source()}) OVER (PARTITION BY {h} ORDER BY {_FIRST}))), '; ') AS sources FROM rag_chunks""",
        "source_rollup": f"""WITH r AS (SELECT *, {h} AS h, {source()} AS s, row_number() OVER (PARTITION BY {h} ORDER BY {_FIRST}) AS n FROM rag_chunks)
            SELECT h AS content_hash, max(document_name) FILTER (n = 1) AS document_name, max(page_number) FILTER (n = 1) AS page_number,
            max(heading) FILTER (n = 1) AS heading, count(*) AS copies, array_to_string(list_sort(list(DISTINCT s)), '; ') AS sources FROM r GROUP BY h""",
        "dedup_summary": f"""SELECT count(DISTINCT document_name) AS files, count(*) AS chunks, count(DISTINCT {h}) AS indexed,
            count(*) - count(DISTINCT {h}) AS deduplicated FROM rag_chunks""",
        "vector_registry": f"""WITH u AS (SELECT id, CASE WHEN {blank("metadata.sources")} THEN [{source()}]
            ELSE list_filter(string_split_regex(metadata.sources, ';\\s*'), lambda x: {trim("x")} <> '') END AS l
            FROM vector_documents WHERE embedding IS NOT NULL AND NOT {blank("id")} AND NOT {blank("text")}),
            e AS (SELECT id, unnest(l) AS s FROM u)
            SELECT id AS content_hash, array_to_string(list_sort(list(DISTINCT s)), '; ') AS sources FROM e GROUP BY id""",
        "registry_join": f"""SELECT chunk_row, {h} AS content_hash, {h} IN (SELECT id FROM vector_documents
            WHERE embedding IS NOT NULL AND NOT {blank("id")} AND NOT {blank("text")}) AS known FROM rag_chunks""",
        "term_histogram": f"WITH {_BUCKETS} SELECT chunk_row, bucket, n FROM histogram",
        "embed_once": f"""WITH {_BUCKETS}, weights AS (SELECT chunk_row, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_row)) AS x FROM histogram)
            SELECT DISTINCT {h} AS content_hash, bucket, round(x, 3) AS weight FROM weights JOIN rag_chunks USING (chunk_row)""",
        "cosine_topk": """WITH p AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0),
            s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], probe::DOUBLE[]), 6) AS cosine FROM embeddings, p)
            SELECT vec_id, cosine, round(greatest(0, least(1, 1 - (2 - 2 * cosine) / 2)), 6) AS score FROM s ORDER BY cosine DESC, vec_id LIMIT 10""",
        "lexical_scores": f"SELECT chunk_row, round({lexical(PHRASE)}, 6) AS lexical, {rules()} AS rules FROM rag_chunks",
        "hybrid_search": f"{searched(PHRASE, 5)} SELECT rank, id, document_name, page_number, round(score, 5) AS score FROM shown",
        "sibling_promotion": f"{searched(SECOND, 20)} SELECT rank, id, document_name, round(score, 5) AS score FROM shown",
        "union_dedup": f"""WITH {_BUCKETS}, {scored(PHRASE, "a")}, {scored(SECOND, "b")},
            u AS (SELECT 0 AS p, * FROM (SELECT id, row_key, score FROM a ORDER BY score DESC, id, row_key LIMIT 40)
              UNION ALL SELECT 1, * FROM (SELECT id, row_key, score FROM b ORDER BY score DESC, id, row_key LIMIT 40))
            SELECT id, row_key, round(score, 5) AS score FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, score DESC, row_key) = 1""",
        "batch_retrieval": """WITH v AS (SELECT vec_row, embedding::DOUBLE[] AS e FROM vector_documents WHERE len(embedding) = 128),
            s AS (SELECT q.vec_row AS query_id, v.vec_row AS id, round(list_dot_product(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_row % 100 = 0)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, round(score, 5) AS score
            FROM s QUALIFY rank <= 5""",
        "line_classes": f"{_LINES} SELECT chunk_row, line_no, line, kind, {_MARKDOWN} AS markdown FROM kinds",
        "table_islands": f"""{_LINES}, islands AS (SELECT *, sum((kind <> 'table')::INT) OVER (PARTITION BY chunk_row ORDER BY line_no) AS island FROM kinds)
            SELECT chunk_row, min(line_no) AS first_line, count(*) AS n_rows, max(len(string_split_regex(line, '[ \\t\\n\\x0B\\f\\r]{{3,}}')))::INT AS n_cols
            FROM islands WHERE kind = 'table' GROUP BY chunk_row, island""",
        "page_heading_carry": f"""WITH {_STAGED}, split AS (SELECT document_name, string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS parts FROM staged),
            lines AS (SELECT document_name, unnest(generate_series(0, len(parts) - 1))::INT AS line_no, unnest(parts) AS line FROM split),
            marks AS (SELECT *, regexp_extract(line, '(?i)^##\\s+Page\\s+(\\d+)', 1) AS mark FROM lines),
            known AS (SELECT *, CASE WHEN mark <> '' THEN try_cast(mark AS INT) END AS p,
              CASE WHEN mark = '' AND regexp_matches(line, '^###?\\s+.+$') THEN {trim("regexp_extract(line, '^###?\\s+(.+)$', 1)")} END AS t FROM marks)
            SELECT document_name, line_no, coalesce(last_value(p IGNORE NULLS) OVER w, 1) AS page, coalesce(last_value(t IGNORE NULLS) OVER w, 'General') AS heading
            FROM known WINDOW w AS (PARTITION BY document_name ORDER BY line_no ROWS UNBOUNDED PRECEDING)""",
        "chunk_fold": f"{_chunked()} SELECT * FROM chunks",
        "chunk_summary": f"{_chunked()} SELECT count(DISTINCT document_name) AS files, count(*) AS chunks FROM chunks",
        "vector_rows": f"""WITH r AS (SELECT chunk_row AS vec_row, {h} AS id, {source()} AS s, row_number() OVER w AS k, regexp_matches(lower(coalesce(content, '')), '[a-z0-9]') AS told,
            array_to_string(list_sort(list_distinct(list({source()}) OVER w)), '; ') AS sources FROM rag_chunks WINDOW w AS (PARTITION BY {h} ORDER BY {_FIRST}))
            SELECT vec_row, id, sources, k > 1 AS deduplicated, 128 AS dimensions, told::INT::DOUBLE AS squares FROM r""",
        "vector_rows_again": f"""WITH c AS (SELECT chunk_row, {h} AS h, {source()} AS s, {blank("content")} AS empty, coalesce(run_no >= 7, false) AS late, {_FIRST.replace("chunk_row", "chunk_row AS c3").replace("coalesce(document_name, '')", "coalesce(document_name, '') AS c1").replace("coalesce(page_number, 0)", "coalesce(page_number, 0) AS c2")}
            FROM rag_chunks LEFT JOIN pipeline_runs USING (pipeline_run_id)),
            old AS (SELECT h, list(DISTINCT s) AS listed FROM c WHERE NOT late AND NOT empty GROUP BY h),
            r AS (SELECT chunk_row, h, row_number() OVER w AS k, list(s) OVER w AS seen FROM c WHERE late WINDOW w AS (PARTITION BY h ORDER BY c1, c2, c3))
            SELECT chunk_row AS vec_row, h AS id, array_to_string(list_sort(list_distinct(list_concat(coalesce(listed, []), seen))), '; ') AS sources,
            (k > 1 OR listed IS NOT NULL) AS deduplicated, 128 AS dimensions FROM r LEFT JOIN old USING (h)""",
        "stored_search": f"""{searched(PHRASE, 5, stored(PHRASE, "s"))} SELECT rank, id, document_name, array_to_string(listed, '; ') AS sources, round(score, 5) AS score FROM shown""",
        "staged_markdown": _markdown(),
        "markdown_files": f"WITH {_STAGED} SELECT document_name, text FROM staged",
        "file_inventory": f"""WITH {_STAGED} SELECT document_name || '.md' AS file_name, strlen(text)::BIGINT AS length, sha256(text) AS checksum,
            round(strlen(text) / (1024.0 * 1024.0), 1)::DOUBLE AS megabytes, CASE WHEN strlen(text) > 50000000 THEN 'PAGE_BATCH_STREAMING' ELSE 'STANDARD_STREAMING' END AS strategy FROM staged""",
        "chunk_lines": """SELECT coalesce(chunk_id, '') AS chunk_id, coalesce(document_name, '') AS document_name, coalesce(page_number, 0) AS page_number, coalesce(heading, '') AS heading,
            coalesce(content, '') AS content, coalesce(character_count, 0) AS character_count, count(*) AS n FROM rag_chunks GROUP BY 1, 2, 3, 4, 5, 6""",
        "vector_lines": """SELECT id, count(*) AS n, sum(len(embedding))::BIGINT AS numbers, count(*) FILTER (metadata.deduplicated) AS duplicates, max(metadata.sources) AS sources,
            (SELECT count(*) FROM vector_documents) AS lines FROM vector_documents WHERE embedding IS NOT NULL GROUP BY id""",
        "index_batches": "SELECT count(*) AS sent, 0::BIGINT AS failed FROM vector_documents",
        "resync_rows": f"""SELECT id, document_name, page_number, {source()} AS sources, count(*) AS n, sum(len(embedding))::BIGINT AS numbers FROM vector_documents
            WHERE embedding IS NOT NULL AND NOT {blank("id")} AND NOT {blank("text")} GROUP BY 1, 2, 3, 4""",
        "paragraphs": _paragraphs(),
        "term_definitions": _definitions(),
        "query_metrics": f"""WITH s AS (SELECT latency_ms FROM query_log WHERE latency_ms IS NOT NULL ORDER BY ts DESC NULLS LAST, request_id DESC LIMIT 2048)
            SELECT (SELECT count(*) FROM query_log) AS requests, (SELECT count(*) FROM query_log WHERE {outcome} = 'SUCCESS') AS succeeded, count(*) AS samples, {quantiles},
            (SELECT round(coalesce(avg(first_token_ms), 0), 2) FROM query_log) AS mean_first_token_ms FROM s""",
        "memory_states": "SELECT p_partkey, CASE WHEN p_size / 50.0 < 0.75 THEN 'NORMAL' WHEN p_size / 50.0 < 0.90 THEN 'WARNING' ELSE 'CRITICAL' END AS state FROM part",
        "run_jobs": "SELECT pipeline_run_id, id FROM document_jobs JOIN pipeline_runs USING (pipeline_run_id)",
        "clean_content": f"SELECT chunk_row, {clean('content')} AS clean FROM rag_chunks",
        "strip_outline": f"SELECT chunk_row, {strip('content')} AS stripped FROM rag_chunks",
        "salient_sentences": _salient(),
        "small_talk": f"""SELECT request_id, NOT {blank("query_text")} AND {form} IN ({talk}) AS conversational,
            CASE WHEN {form} IN ({", ".join(_q(w) for w in T.GREETINGS)}) THEN {_q(T.REPLIES["greeting"])}
            WHEN {form} IN ({", ".join(_q(w) for w in T.ABOUT_ME)}) THEN {_q(T.REPLIES["about"])}
            WHEN {form} = 'how are you' THEN {_q(T.REPLIES["how"])}
            WHEN {form} IN ({", ".join(_q(w) for w in T.PLEASANTRIES)}) THEN {_q(T.REPLIES["thanks"])} ELSE {_q(T.REPLIES["other"])} END AS reply,
            regexp_replace({trim("coalesce(query_text, '')")}, '{_SPACE}+', ' ', 'g') AS query, greatest(1, least(20, coalesce(top_k, 5))) AS k,
            array_to_string({keys}, ' ') AS keywords,
            array_to_string(list_transform(list_filter(list_zip({keys}, range(1, len({keys}) + 1)), lambda z: list_position({keys}, z[1]) = z[2]), lambda z: z[1]), ' ') AS distinct_keywords
            FROM query_log""",
        "cache_keys": f"SELECT request_id, 'rag:answer:' || substr(sha256(lower({trim('coalesce(query_text, chr(32))')}) || ':' || coalesce(top_k, 5)), 1, 16) AS cache_key FROM query_log",
        "predicate_flags": f"""SELECT chunk_row, {boilerplate("content")} AS boilerplate, {cover("content")} AS cover_page,
            {resume("content", PHRASE)} AS resume, {code_dump("content", PHRASE)} AS code_dump FROM rag_chunks""",
        "previews": f"""SELECT chunk_row, {preview("content", 250, True)} AS preview, {preview("content", 180, False)} AS summary,
            regexp_replace(document_name, '\\.[^.]*$', '') AS base_name FROM rag_chunks""",
        "relevance_filter": f"{_relevant()} SELECT rank, id, round(score, 5) AS score FROM final",
        "citations": f"""{_relevant()} SELECT rank, document_name AS document, page_number AS page, heading, round(score, 5) AS score, {preview('clean', 250, True)} AS preview,
            '[' || rank || '] Document: ' || document_name || ' | Page: ' || page_number || ' | Section: ' || heading || chr(10) || clean || chr(10) || chr(10) AS context FROM final""",
        "relevance_fallback": f"{_relevant(NOTHING)} SELECT rank, id, round(score, 5) AS score FROM final",
        "answer_prompts": f"""{_relevant()}, told AS (SELECT string_agg('[' || rank || '] Document: ' || document_name || ' | Page: ' || page_number || ' | Section: ' || heading
            || chr(10) || clean || chr(10) || chr(10), '' ORDER BY rank) AS c FROM final)
            SELECT 0 AS query_id, {_q(PHRASE)} AS query, 'Answer the question from the context alone. If the context has no answer, say so.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10)
            || c || chr(10) || 'QUESTION:' || chr(10) || {_q(PHRASE)} || chr(10) || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM told""",
        "client_addresses": f"""SELECT request_id, CASE WHEN NOT {blank("string_split(query_text, ',')[1]")} THEN {trim("string_split(query_text, ',')[1]")}
            WHEN NOT {blank("client_key")} THEN {trim("client_key")} ELSE outcome END AS address FROM query_log""",
        "token_stream": """WITH w AS (SELECT request_id, string_split(coalesce(query_text, ''), ' ') AS p FROM query_log),
            u AS (SELECT request_id, unnest(generate_series(0, len(p) - 1)) AS i, unnest(p) AS word FROM w)
            SELECT request_id, ceil(i / 3)::INT AS group_no, string_agg(word, ' ' ORDER BY i) || ' ' AS token FROM u GROUP BY 1, 2""",
        "browse_vectors": f"""SELECT vec_row, id, document_name, page_number, heading, {preview("text", 180, False)} AS preview, 128 AS dimensions
            FROM vector_documents ORDER BY vec_row LIMIT 50""",
        "store_status": "SELECT count(*) AS vectors, count(DISTINCT id) AS contents, count(DISTINCT document_name) AS documents FROM vector_documents",
        "ledger_upsert": f"""{_merged(checksum)} SELECT id, filename, checksum, total_pages, processed_pages, total_chunks, embedded_chunks, job_status, status, pipeline_run_id,
            execution_time_ms, error_message, error_message AS failure_reason, started_at, completed_at, processed_at FROM ledger""",
        "ledger_saved": f"""{_merged(checksum)}, hit AS (SELECT min(pipeline_run_id) AS run FROM ledger WHERE job_status = 'VALIDATED'),
            j AS (SELECT l.*, coalesce(pipeline_run_id = run AND job_status = 'VALIDATED', false) AS done FROM ledger l, hit)
            SELECT checksum, id, CASE WHEN done THEN 'COMPLETED' ELSE job_status END AS job_status, CASE WHEN done THEN 'SUCCESS' ELSE status END AS status,
            CASE WHEN done THEN total_pages ELSE processed_pages END AS processed_pages, CASE WHEN done THEN total_chunks ELSE embedded_chunks END AS embedded_chunks,
            CASE WHEN NOT done THEN error_message END AS error_message, pipeline_run_id FROM j""",
        "run_report": f"""WITH j AS (SELECT *, {state()} AS st FROM document_jobs),
            a AS (SELECT count(*) AS discovered, count(*) FILTER (coalesce(st <> 'FAILED', true)) AS processed, count(*) FILTER (st = 'FAILED') AS failed,
              coalesce(sum(processed_pages), 0)::BIGINT AS pages, greatest(1, coalesce(max(execution_time_ms), 0))::BIGINT AS elapsed_ms FROM j)
            SELECT a.*, round(pages * 1000.0 / elapsed_ms, 2)::DOUBLE AS pages_per_second, c.* FROM a, (SELECT count(DISTINCT document_name) AS files, count(*) AS chunks,
            count(DISTINCT {h}) AS indexed, count(*) - count(DISTINCT {h}) AS deduplicated FROM rag_chunks) c""",
        "skip_set": f"""WITH j AS (SELECT d.*, run_no FROM document_jobs d JOIN pipeline_runs USING (pipeline_run_id)),
            done AS (SELECT checksum FROM j WHERE run_no < 10 AND {completed()} AND checksum IS NOT NULL)
            SELECT id, CASE WHEN coalesce(checksum IN (SELECT checksum FROM done), false) THEN 'skip' ELSE 'work' END AS what FROM j WHERE run_no >= 10""",
        "resumable_jobs": f"SELECT id, filename, pipeline_run_id FROM document_jobs WHERE {state()} IN ('DISCOVERED', 'PROCESSING', 'VALIDATED', 'CHUNKED', 'EMBEDDED', 'FAILED')",
        "job_states": f"""SELECT id, {state()} AS state, CASE WHEN {state()} = 'COMPLETED' THEN 'SUCCESS' ELSE {state()} END AS status_text, {completed()} AS completed FROM document_jobs""",
        "latest_job": "SELECT id, filename FROM document_jobs ORDER BY processed_at DESC NULLS LAST, id DESC LIMIT 1",
        "last_attempts": "SELECT id, filename FROM document_jobs QUALIFY row_number() OVER (PARTITION BY filename ORDER BY id DESC) = 1",
        "parse_summary": f"""WITH j AS (SELECT *, {state()} AS st FROM document_jobs),
            a AS (SELECT count(*) AS discovered, count(*) FILTER (coalesce(st <> 'FAILED', true)) AS processed, count(*) FILTER (st = 'FAILED') AS failed,
              coalesce(sum(processed_pages), 0)::BIGINT AS pages, greatest(1, coalesce(max(execution_time_ms), 0))::BIGINT AS elapsed_ms FROM j)
            SELECT *, round(pages * 1000.0 / elapsed_ms, 2)::DOUBLE AS pages_per_second FROM a""",
        "latency_percentiles": f"""WITH s AS (SELECT latency_ms FROM query_log WHERE latency_ms IS NOT NULL ORDER BY ts DESC NULLS LAST, request_id DESC LIMIT 2048)
            SELECT count(*) AS samples, {quantiles} FROM s""",
        "all_percentiles": f"SELECT count(*) AS samples, {quantiles} FROM query_log WHERE latency_ms IS NOT NULL",
        "load_percentiles": """WITH l AS (SELECT list(latency_ms ORDER BY latency_ms) AS v FROM query_log WHERE latency_ms IS NOT NULL)
            SELECT v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM l""",
        "outcome_counts": f"SELECT {outcome} AS outcome, count(*) AS requests FROM query_log GROUP BY 1",
        "first_token": "SELECT count(first_token_ms) AS samples, round(coalesce(avg(first_token_ms), 0), 2) AS mean_first_token_ms FROM query_log",
        "recent_failures": f"""SELECT request_id, count(*) OVER w AS calls, round(avg(({outcome} <> 'SUCCESS')::INT) OVER w, 6) AS failure_rate FROM query_log
            WINDOW w AS (PARTITION BY client_key ORDER BY ts NULLS FIRST, request_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "token_bucket": f"{_bucket()} SELECT request_id, key, allowed, round(tokens, 6) AS tokens FROM steps",
        "circuit_breaker": f"{_breaker()} SELECT request_id, key, allowed, state FROM steps",
        "ttl_cache": f"{_cache()} SELECT request_id, key, hit, expires::DOUBLE AS expires_ms FROM steps",
        "coalesced_requests": f"{_flights()} SELECT request_id, key, shared, ends::DOUBLE AS ends_ms FROM steps",
        "cache_hit_rate": f"""{_cache()} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
            coalesce(round(count(*) FILTER (hit) * 100.0 / nullif(count(*), 0), 2), 0)::DOUBLE AS hit_rate FROM steps""",
        "event_last_samples": """WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)
            SELECT user_id, count(*) AS events, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM e GROUP BY user_id""",
    }
