"""The same queries in SQL, written on their own as window and join statements."""

from __future__ import annotations

from html.entities import html5

from moderata.operators import logistic

_TOKEN = r"[\p{L}\p{N}]+"
_WORD = r"[^ \t\r\n]+[ \t\r\n]*"
_SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{_TOKEN}')"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip().rstrip(",") for p in parts if p)


_LABELLED = """
labelled AS (
  SELECT d.doc_id, d.text, d.lang, CAST(l.toxic AS BIGINT) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

_HOLDOUT = f"""
{_LABELLED.strip()},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER () AS n
  FROM labelled),
train AS (SELECT doc_id, text, lang, label FROM ranked WHERE rn > ceil(CAST(0.2 AS DOUBLE) * n)),
test AS (SELECT doc_id, text, lang, label FROM ranked WHERE rn <= ceil(CAST(0.2 AS DOUBLE) * n))
"""

_MODEL = f"""
train_tok AS (SELECT label, unnest({_tokens('text')}) AS token FROM train),
cnt AS (SELECT token, CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(label) AS BIGINT) AS n1
        FROM train_tok GROUP BY token),
tot AS (SELECT CAST(sum(n0) AS DOUBLE) AS t0, CAST(sum(n1) AS DOUBLE) AS t1, CAST(count(*) AS DOUBLE) AS v FROM cnt),
params AS (SELECT token, n0, n1,
                  ln((CAST(n0 AS DOUBLE) + CAST(1 AS DOUBLE)) / (t0 + v)) AS lp0,
                  ln((CAST(n1 AS DOUBLE) + CAST(1 AS DOUBLE)) / (t1 + v)) AS lp1
           FROM cnt, tot),
prior AS (SELECT CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(label) AS BIGINT) AS n1,
                 ln(CAST(sum(1 - label) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS lp0,
                 ln(CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE)) AS lp1
          FROM train)
"""


def _scored(name: str, source: str) -> str:
    """``name(doc_id, lang, label, l0, l1, pred)`` of the texts in ``source``."""
    return f"""
{name}_tok AS (SELECT doc_id, unnest({_tokens('text')}) AS token FROM {source}),
{name}_sum AS (
  SELECT k.doc_id, sum(p.lp0) AS s0, sum(p.lp1) AS s1
  FROM {name}_tok k JOIN params p ON k.token = p.token GROUP BY k.doc_id),
{name} AS (
  SELECT *, CAST(CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS BIGINT) AS pred FROM (
    SELECT s.doc_id, s.lang, s.label,
           round(coalesce(x.s0, CAST(0 AS DOUBLE)) + r.lp0, 4) AS l0,
           round(coalesce(x.s1, CAST(0 AS DOUBLE)) + r.lp1, 4) AS l1
    FROM {source} s LEFT JOIN {name}_sum x ON s.doc_id = x.doc_id CROSS JOIN prior r))
"""


_PREDICTED = _HOLDOUT + ", " + _MODEL + ", " + _scored("predicted", "test")


def _chunks(source: str, budget: int = 512, overlap: int = 200) -> str:
    """``chunks(doc_id, pos, text, n_words)`` of ``source(doc_id, text)``; needs RECURSIVE."""
    return f"""
sent AS (
  SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{_SENTENCE}') AS ss FROM {source})),
sized AS (SELECT doc_id, i, s, regexp_extract_all(s, '{_WORD}') AS w FROM sent),
runs AS (
  SELECT doc_id, i, 0 AS r, s AS t, len(w) AS n FROM sized WHERE len(w) <= {budget}
  UNION ALL
  SELECT doc_id, i, r, array_to_string(list_slice(w, r * {budget} + 1, (r + 1) * {budget}), '') AS t,
         least({budget}, len(w) - r * {budget}) AS n
  FROM (SELECT *, unnest(range(0, (len(w) + {budget} - 1) // {budget})) AS r FROM sized WHERE len(w) > {budget})),
upto AS (
  SELECT doc_id, i, r, t, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i, r) AS BIGINT) AS hi,
         CAST(n AS BIGINT) AS n
  FROM runs),
docs AS (
  SELECT doc_id, list(t ORDER BY i, r) AS t, list(hi ORDER BY i, r) AS hi, list(hi - n ORDER BY i, r) AS lo,
         count(*) AS m
  FROM upto GROUP BY doc_id),
step AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS s,
         CAST(len(list_filter(hi, lambda h: h <= {budget})) AS BIGINT) AS e
  FROM docs
  UNION ALL
  SELECT doc_id, pos, s, CAST(len(list_filter(hi, lambda h: h - lo[s] <= {budget})) AS BIGINT) AS e
  FROM (
    SELECT d.doc_id, p.pos + 1 AS pos, d.hi, d.lo,
           CAST(len(list_filter(d.lo, lambda l: d.hi[p.e] - l > {overlap} OR d.hi[p.e + 1] - l > {budget})) AS BIGINT)
             + 1 AS s
    FROM step p JOIN docs d ON p.doc_id = d.doc_id
    WHERE p.e < d.m)),
chunks AS (
  SELECT p.doc_id, CAST(p.pos AS INTEGER) AS pos,
         CAST(p.doc_id AS VARCHAR) || ':' || CAST(p.pos AS VARCHAR) AS node_id,
         trim(array_to_string(list_slice(d.t, p.s, p.e), ''), E' \\t\\r\\n') AS text,
         CAST(d.hi[p.e] - d.lo[p.s] AS INTEGER) AS n_words
  FROM step p JOIN docs d ON p.doc_id = d.doc_id
  WHERE d.hi[p.e] - d.lo[p.s] > 0)
"""


def _weights(source: str) -> str:
    """``idf`` and unit-length ``nw(id, term, w)`` of ``source(id, content)``."""
    return f"""
n_tf AS (SELECT id, term, count(*) AS tf
         FROM (SELECT id, unnest({_tokens('content')}) AS term FROM {source}) GROUP BY id, term),
idf AS (SELECT term, count(*) AS n_docs,
               ln((SELECT CAST(count(*) AS DOUBLE) FROM {source}) / CAST(count(*) AS DOUBLE)) + CAST(1 AS DOUBLE) AS idf
        FROM n_tf GROUP BY term),
n_raw AS (SELECT t.id, t.term, t.tf * i.idf AS w FROM n_tf t JOIN idf i ON t.term = i.term),
nw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM n_raw)
"""


def _search(source: str, k: int) -> str:
    """``hits(query_id, rank, node_id, score)`` of ``source(query_id, content)``."""
    return f"""
q_tf AS (SELECT query_id, term, count(*) AS tf
         FROM (SELECT query_id, unnest({_tokens('content')}) AS term FROM {source}) GROUP BY query_id, term),
q_raw AS (SELECT t.query_id, t.term, t.tf * i.idf AS w FROM q_tf t JOIN idf i ON t.term = i.term),
qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM q_raw),
scores AS (SELECT q.query_id, n.id AS node_id, round(sum(q.w * n.w), 6) AS score
           FROM qw q JOIN nw n ON q.term = n.term GROUP BY q.query_id, n.id),
hits AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, node_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank
    FROM scores WHERE score > 0) WHERE rank <= {k})
"""


_ATTRIBUTES = """(?:[^>=]|= *"[^"]*"|= *''[^'']*''|=)*>"""


def _references(column: str) -> str:
    """References of the parts between ampersands, by the names of the HTML standard."""
    spelt = {"nbsp": " ", "copy": "(C)"}
    quoted = {name: spelt.get(name.rstrip(";"), text).replace("'", "''") for name, text in html5.items()}
    names = "MAP {" + ", ".join(f"'{name}': '{text}'" for name, text in quoted.items()) + "}"
    bare = "|".join(sorted((name for name in quoted if name[-1] != ";"), key=len, reverse=True))
    number, name, short = "'^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});'", "'^[A-Za-z][A-Za-z0-9]*;'", f"'^(?:{bare})'"
    return rf"""array_to_string(list_transform(list_transform(string_split({column}, '&'), lambda p, i: struct_pack(
      i := i, p := p, d := lower(regexp_extract(p, {number}, 1)),
      n := coalesce(nullif(regexp_extract(p, {name}), ''), regexp_extract(p, {short})),
      s := regexp_extract(p, {short}))), lambda r: CASE
        WHEN r.i = 1 THEN r.p
        WHEN r.d <> '' THEN coalesce(
          CASE WHEN try_cast(replace(r.d, 'x', '0x') AS INTEGER) BETWEEN 1 AND 55295
                 OR try_cast(replace(r.d, 'x', '0x') AS INTEGER) BETWEEN 57344 AND 1114111
               THEN chr(try_cast(replace(r.d, 'x', '0x') AS INTEGER)) || r.p[length(r.d) + 3:] END, '&' || r.p)
        ELSE coalesce({names}[r.n] || r.p[length(r.n) + 1:], {names}[r.s] || r.p[length(r.s) + 1:], '&' || r.p) END), '')"""


def _html(column: str) -> str:
    out = f"regexp_replace({column}, '(?s)<!--.*?-->', '', 'g')"
    for block in ("script", "style", "head"):
        out = rf"regexp_replace({out}, '(?is)<{block}\b{_ATTRIBUTES}.*?</{block}\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '[ \t\r\n]+', ' ', 'g')"
    blocks = (
        "p|div|br|hr|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|"
        "blockquote|pre|title|body|html|main|aside|form|dl|dt|dd"
    )
    out = rf"regexp_replace({out}, '(?i)</?(?:{blocks})\b{_ATTRIBUTES}', E'\n', 'g')"
    out = f"regexp_replace({out}, '(?i)<[!/]?[a-z]{_ATTRIBUTES}', '', 'g')"
    out = _references(out)
    out = rf"regexp_replace({out}, ' *\n[ \n]*', E'\n', 'g')"
    return rf"trim(regexp_replace({out}, ' +', ' ', 'g'), E' \t\r\n')"


_PAGES = f"""pages_text AS (SELECT page_id AS doc_id, url, {_html('html')} AS text FROM pages)"""

_VOCAB = f"""
tok_count AS (SELECT token, count(*) AS n
              FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token),
vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id
          FROM tok_count ORDER BY n DESC, token)
"""


def _encoded(length: int) -> str:
    return f"""
item_tok AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) AS at
             FROM (SELECT item_id, list_slice({_tokens('text')}, 1, {length}) AS t FROM benchmark)),
item_ids AS (SELECT b.item_id,
                    coalesce(list(coalesce(v.token_id, 1) ORDER BY k.at) FILTER (WHERE k.token IS NOT NULL), []) AS ids
             FROM benchmark b LEFT JOIN item_tok k ON b.item_id = k.item_id
             LEFT JOIN vocab v ON k.token = v.token GROUP BY b.item_id)
"""


_CHAT = "'<|im_start|>' || {role} || E'\\n' || {text} || E'<|im_end|>\\n'"


def _chat(role: str, text: str) -> str:
    return "(" + _CHAT.format(role=role, text=text) + ")"


_SYSTEM = f"CASE WHEN length(coalesce(system, '')) > 0 THEN {_chat(chr(39) + 'system' + chr(39), 'system')} ELSE '' END"

_HEADS = """
heads AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS system,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user
  FROM conversations GROUP BY conv_id)
"""

_TURNS = f"""
{_HEADS.strip()},
ahead AS (
  SELECT conv_id, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS completion,
         lead(turn) OVER w AS next_turn
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (
  SELECT a.conv_id, a.next_turn AS turn, a.prompt, a.completion, h.system, h.first_user, a.next_turn % 4 = 1 AS label
  FROM ahead a JOIN heads h ON a.conv_id = h.conv_id
  WHERE a.role = 'user' AND a.next_role = 'assistant'),
unpaired AS (SELECT conv_id, turn, {_SYSTEM} || prompt AS prompt, completion, label FROM asked)
"""

_PAIRS = f"""
{_HEADS.strip()},
answers AS (
  SELECT h.first_user AS prompt, c.text AS completion, c.turn % 4 = 1 AS label, c.conv_id, c.turn
  FROM conversations c JOIN heads h ON c.conv_id = h.conv_id
  WHERE c.role = 'assistant' AND h.first_user IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY prompt, label ORDER BY conv_id, turn) - 1 AS place,
         count(*) FILTER (WHERE label) OVER (PARTITION BY prompt) AS good,
         count(*) FILTER (WHERE NOT label) OVER (PARTITION BY prompt) AS bad
  FROM answers),
pairs AS (
  SELECT a.prompt, CASE WHEN a.label THEN a.completion ELSE b.completion END AS chosen,
         CASE WHEN a.label THEN b.completion ELSE a.completion END AS rejected
  FROM placed a JOIN placed b
    ON a.prompt = b.prompt AND a.label <> b.label AND b.place = a.place % least(a.good, a.bad)
  WHERE a.good > 0 AND a.bad > 0 AND a.label = (a.good >= a.bad) AND b.place < least(a.good, a.bad))
"""

_LOG = "log AS (SELECT strftime(ts, '%Y-%m-%d') AS epoch, ts, event_id, value AS loss FROM events)"

_STEPS = f"""
{_LOG},
steps AS (SELECT epoch, ts, event_id, loss, row_number() OVER (PARTITION BY epoch ORDER BY ts, event_id) - 1 AS step,
                 count(*) OVER (PARTITION BY epoch) AS steps FROM log)
"""

_SCORED_EVENTS = """
scored AS (
  SELECT event_id, event_type,
         CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) WHEN event_type = 'signup' THEN NULL
              ELSE value END AS score
  FROM events)
"""


def _above(score: str, threshold: str) -> str:
    return f"CAST(coalesce(NOT isnan({score}) AND {score} > {threshold}, false) AS BIGINT)"


def _rates(select: str) -> str:
    return f"""
SELECT *, round(CAST(correct AS DOUBLE) / CAST(n AS DOUBLE), 6) AS accuracy
FROM ({select})"""


_HIT_COUNTS = "count(*) AS n, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct"

_ROLLUP = _rates(
    f"SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS dataset, {_HIT_COUNTS} "
    "FROM predicted GROUP BY ROLLUP (lang)"
)


def _split_union(rows: str, key: str, size: str, columns: str) -> str:
    return f"""
SELECT {columns}, CASE WHEN rn <= ceil(CAST({size} AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR))) AS rn, count(*) OVER () AS n
      FROM {rows})"""


ORACLES: dict[str, str] = {
    "labelled_docs": _with(_LABELLED) + "SELECT doc_id, text, label FROM labelled",
    "filter_not_null": """
SELECT doc_id, lang FROM (SELECT doc_id, nullif(lang, 'de') AS lang FROM documents) WHERE lang IS NOT NULL""",
    "dropna_then_project": """
SELECT doc_id, text FROM documents
WHERE doc_id IS NOT NULL AND text IS NOT NULL AND nullif(lang, 'de') IS NOT NULL
  AND nullif(source, 'src8') IS NOT NULL AND n_chars IS NOT NULL""",
    "binarize_sum": """
SELECT doc_id, CAST(coalesce(CAST(nullif(quality, 0) AS DOUBLE) * CAST(3 AS DOUBLE)
                             + CAST(toxic AS DOUBLE) * CAST(3 AS DOUBLE) > CAST(5.5 AS DOUBLE), false) AS BIGINT) AS label
FROM labels""",
    "binarize_threshold": _with(_SCORED_EVENTS)
    + f"SELECT event_id, {_above('score', 'CAST(50 AS DOUBLE)')} AS label FROM scored",
    "binarize_not_equal": """
SELECT doc_id, CAST(nullif(lang, 'fr') IS DISTINCT FROM 'en' AS BIGINT) AS label FROM documents""",
    "concat_sources": """
SELECT doc_id AS id, text, lang, 'train' AS split, CAST(NULL AS BIGINT) AS turn, 'documents' AS dataset FROM documents
UNION ALL SELECT conv_id, text, NULL, NULL, turn, 'conversations' FROM conversations
UNION ALL SELECT item_id, text, NULL, 'test', NULL, 'benchmark' FROM benchmark""",
    "dataset_toxigen": """
SELECT text, label, split FROM (
  SELECT d.text, CAST(l.toxic AS BIGINT) AS label, 'train' AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'de'
  UNION ALL
  SELECT d.text, CAST(coalesce(CAST(nullif(l.quality, 0) AS DOUBLE) * CAST(3 AS DOUBLE)
                      + CAST(l.toxic AS DOUBLE) * CAST(3 AS DOUBLE) > CAST(5.5 AS DOUBLE), false) AS BIGINT), 'test'
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "dataset_twitter": _with(_LABELLED, "kept AS (SELECT * FROM labelled WHERE lang <> 'fr')")
    + _split_union("kept", "doc_id", "0.2", "text, label, lang"),
    "dataset_berkeley": _with(
        _SCORED_EVENTS,
        f"""kept AS (SELECT event_id, event_type || ' ' || CAST(event_id AS VARCHAR) AS text,
                     {_above('score / CAST(100 AS DOUBLE)', 'CAST(0.5 AS DOUBLE)')} AS label
              FROM scored WHERE event_type <> 'view')""",
    )
    + _split_union("kept", "event_id", "0.2", "text, label"),
    "dataset_gender": _with(_LABELLED)
    + "SELECT text, label, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM labelled",
    "dataset_cad": """
SELECT text, CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS BIGINT) AS label,
       CASE WHEN lang = 'es' THEN 'test' ELSE 'train' END AS split
FROM documents""",
    "tsv_concat": "SELECT text, lang AS label FROM documents",
    "preference_split": _with(
        _TURNS,
        """kept AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS row_id, prompt, completion, label
            FROM asked WHERE prompt IS NOT NULL AND completion IS NOT NULL)""",
    )
    + _split_union("kept", "row_id", "0.05", "prompt, completion, label"),
    "shuffle_order": """
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS position FROM documents""",
    "split_exact": """
SELECT doc_id, rn <= ceil(CAST(0.2 AS DOUBLE) * n) AS test_20, rn <= ceil(CAST(0.05 AS DOUBLE) * n) AS test_05
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER () AS n
      FROM documents)""",
    "split_stratified": _with(
        _LABELLED,
        """sizes AS (SELECT label, count(*) AS c FROM labelled GROUP BY label),
wanted AS (SELECT CAST(sum(c) AS HUGEINT) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(c)) AS HUGEINT) AS w FROM sizes),
shares AS (SELECT label, c * w // n AS base, c * w % n AS rest, w FROM sizes, wanted),
quotas AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= w - sum(base) OVER ()
                                     THEN 1 ELSE 0 END AS quota FROM shares)""",
    )
    + """
SELECT r.doc_id, r.label, r.rn <= q.quota AS is_test
FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn
      FROM labelled) r JOIN quotas q ON r.label = q.label""",
    "batch_ids": """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch_id FROM documents""",
    "length_stats": """
SELECT lang, max_len, n, least(max_len, 512) AS max_length, b AS n_batches, b * 3 AS total_steps
FROM (SELECT lang, max(length(text)) AS max_len, count(*) AS n, CAST((count(*) + 31) // 32 AS BIGINT) AS b
      FROM documents GROUP BY lang)""",
    "vocab_build": _with(_VOCAB) + "SELECT token, n, token_id FROM vocab",
    "encode_fixed": _with(_VOCAB, _encoded(64))
    + """
SELECT item_id,
       array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda x: 0)), ' ') AS input_ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1),
                                   list_transform(range(0, 64 - len(ids)), lambda x: 0)), ' ') AS attention_mask,
       CAST(len(ids) AS INTEGER) AS n_tokens
FROM item_ids""",
    "encode_budget": f"""
SELECT item_id, rag, CAST(width AS INTEGER) AS width, CAST(least(n, width) AS INTEGER) AS n_tokens,
       CAST(width AS INTEGER) AS max_length, CAST(CASE WHEN rag THEN 8 ELSE 16 END AS INTEGER) AS batch_size
FROM (SELECT item_id, len({_tokens('text')}) AS n, rag, CASE WHEN rag THEN 1280 ELSE 256 END AS width
      FROM benchmark CROSS JOIN (VALUES (false), (true)) v(rag))""",
    "chat_render": f"""
SELECT conv_id, turn, {_chat('role', 'text')} AS rendered,
       {_chat("'user'", 'text')} || E'<|im_start|>assistant\\n' AS asked,
       CASE WHEN role = 'system' AND length(text) > 0 THEN {_chat("'system'", 'text')} ELSE '' END AS system
FROM conversations""",
    "html_to_text": _with(_PAGES) + "SELECT doc_id, url, text FROM pages_text",
    "chunk_documents": _with(_chunks("documents"), recursive=True)
    + "SELECT node_id, doc_id, pos, text, n_words FROM chunks",
    "chunk_metadata": _with(_chunks("documents"), recursive=True)
    + "SELECT c.doc_id, c.pos, c.node_id, d.lang, d.source FROM chunks c JOIN documents d ON c.doc_id = d.doc_id",
    "tfidf_index": _with("nodes AS (SELECT doc_id AS id, text AS content FROM documents)", _weights("nodes"))
    + "SELECT id AS doc_id, term, round(w, 6) AS weight FROM nw",
    "topk_dense": """
WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT query_id, CAST(rank AS INTEGER) AS rank, node_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (
    SELECT q.vec_id AS query_id, n.vec_id AS node_id, round(list_cosine_similarity(q.e, n.e), 6) AS score
    FROM vecs q CROSS JOIN vecs n))
WHERE rank <= 3""",
    "topk_sparse": _with(
        "nodes AS (SELECT doc_id AS id, text AS content FROM documents)",
        _weights("nodes"),
        "asks AS (SELECT item_id AS query_id, text AS content FROM benchmark)",
        _search("asks", 3),
    )
    + "SELECT query_id, rank, node_id, score FROM hits",
    "rag_augment": _with(
        _chunks("documents"),
        """nodes AS (SELECT c.node_id AS id, concat_ws(' ', d.lang, d.source, c.text) AS content
             FROM chunks c JOIN documents d ON c.doc_id = d.doc_id)""",
        _weights("nodes"),
        "asks AS (SELECT item_id AS query_id, text AS content FROM benchmark)",
        _search("asks", 2),
        """contexts AS (SELECT h.query_id, string_agg(c.text, '' ORDER BY h.rank) AS context
                FROM hits h JOIN chunks c ON h.node_id = c.node_id GROUP BY h.query_id)""",
        recursive=True,
    )
    + """
SELECT b.item_id, 'You are given the following context: ' || coalesce(x.context, '') || E'\\n'
       || 'Is the following hate speech: ' || b.text AS text
FROM benchmark b LEFT JOIN contexts x ON b.item_id = x.query_id""",
    "page_nodes": _with(_PAGES, _chunks("pages_text"), recursive=True)
    + """
SELECT c.node_id, c.doc_id, c.pos, c.text, c.n_words, p.url
FROM chunks c JOIN pages_text p ON c.doc_id = p.doc_id""",
    "index_roundtrip": _with(
        _chunks("documents"),
        "nodes AS (SELECT c.*, d.lang, d.source FROM chunks c JOIN documents d ON c.doc_id = d.doc_id)",
        recursive=True,
    )
    + f"""
SELECT node_id, doc_id, n_words, lang,
       CAST(len(list_distinct({_tokens("concat_ws(' ', lang, source, text)")})) AS INTEGER) AS n_terms
FROM nodes""",
    "json_props": """
SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_path
FROM events""",
    "kto_examples": _with(_TURNS) + "SELECT conv_id, turn, prompt, completion, label FROM unpaired",
    "kto_weights": _with(_TURNS)
    + """
SELECT conv_id, turn, label, CASE WHEN label THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS weight
FROM unpaired""",
    "kto_lengths": _with(
        _TURNS,
        f"lens AS (SELECT *, len({_tokens('prompt')}) AS p, len({_tokens('completion')}) AS c FROM unpaired)",
    )
    + """
SELECT conv_id, turn, CAST(least(p, 32) AS INTEGER) AS prompt_len,
       CAST(least(c, 64 - least(p, 32)) AS INTEGER) AS completion_len,
       p > 32 OR c > 64 - least(p, 32) AS truncated
FROM lens""",
    "dpo_pairs": _with(_PAIRS)
    + f"""
SELECT {_chat("'user'", 'prompt')} || E'<|im_start|>assistant\\n' AS prompt,
       chosen || E'<|im_end|>\\n' AS chosen, rejected || E'<|im_end|>\\n' AS rejected
FROM pairs""",
    "kto_from_dpo": _with(_PAIRS)
    + """
SELECT prompt, chosen AS completion, true AS label FROM pairs
UNION ALL SELECT prompt, rejected, false FROM pairs""",
    "nb_train": _with(_HOLDOUT, _MODEL)
    + """
SELECT token, n0, n1, round(lp0, 6) AS lp0, round(lp1, 6) AS lp1 FROM params
UNION ALL SELECT '', n0, n1, round(lp0, 6), round(lp1, 6) FROM prior""",
    "nb_predict": _with(_PREDICTED) + "SELECT doc_id, l0, l1, pred FROM predicted",
    "model_roundtrip": _with(_PREDICTED) + "SELECT doc_id, pred FROM predicted",
    "argmax_logits": """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings""",
    "accuracy_overall": _with(_PREDICTED) + _rates(f"SELECT {_HIT_COUNTS} FROM predicted"),
    "accuracy_rollup": _with(_PREDICTED) + _ROLLUP,
    "metrics_log": _with(_PREDICTED)
    + f"""
SELECT 'naive_bayes' AS model_id, dataset, false AS rag, 'accuracy' AS metric, accuracy AS value
FROM ({_ROLLUP})""",
    "accuracy_cube": _with(
        _PREDICTED,
        _PAGES,
        _chunks("pages_text"),
        """nodes AS (SELECT c.node_id AS id, concat_ws(' ', p.url, c.text) AS content
             FROM chunks c JOIN pages_text p ON c.doc_id = p.doc_id)""",
        _weights("nodes"),
        "asks AS (SELECT doc_id AS query_id, text AS content FROM test)",
        _search("asks", 1),
        """augmented AS (
  SELECT t.doc_id, t.lang, t.label, 'You are given the following context: ' || coalesce(c.text, '') || E'\\n'
         || 'Is the following hate speech: ' || t.text AS text
  FROM test t LEFT JOIN hits h ON t.doc_id = h.query_id LEFT JOIN chunks c ON h.node_id = c.node_id)""",
        _scored("rag_predicted", "augmented"),
        """all_rows AS (
  SELECT 'naive_bayes' AS model_id, 'false' AS rag, lang AS dataset, label, pred FROM predicted
  UNION ALL SELECT 'naive_bayes', 'true', lang, label, pred FROM rag_predicted
  UNION ALL SELECT 'majority', 'false', lang, label,
                   (SELECT CAST(CASE WHEN sum(label) * 2 > count(*) THEN 1 ELSE 0 END AS BIGINT) FROM train)
            FROM test)""",
        recursive=True,
    )
    + _rates(
        f"""SELECT CASE WHEN grouping(model_id) = 1 THEN '(all)' ELSE model_id END AS model_id,
       CASE WHEN grouping(rag) = 1 THEN '(all)' ELSE rag END AS rag,
       CASE WHEN grouping(dataset) = 1 THEN '(all)' ELSE dataset END AS dataset, {_HIT_COUNTS}
FROM all_rows GROUP BY CUBE (model_id, rag, dataset)"""
    ),
    "epoch_loss": _with(_LOG)
    + """
SELECT epoch, avg_loss, steps, format('{:.2f}', avg_loss) AS shown
FROM (SELECT epoch, round(avg(loss), 6) AS avg_loss, count(*) AS steps FROM log GROUP BY epoch)""",
    "epoch_elapsed": _with(
        _LOG,
        """spans AS (SELECT CASE WHEN grouping(epoch) = 1 THEN '(all)' ELSE epoch END AS epoch,
                     CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS seconds
              FROM log GROUP BY ROLLUP (epoch))""",
        "whole AS (SELECT epoch, seconds, CAST(round_even(seconds, 0) AS BIGINT) AS s FROM spans)",
    )
    + """
SELECT epoch, seconds,
       CASE WHEN s >= 172800 THEN CAST(s // 86400 AS VARCHAR) || ' days, '
            WHEN s >= 86400 THEN '1 day, ' ELSE '' END
       || CAST(s % 86400 // 3600 AS VARCHAR) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
       || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed
FROM whole""",
    "progress_rows": _with(_STEPS)
    + """
SELECT epoch, step, steps, loss, '  Batch ' || format('{:>5}', format('{:,}', step)) || '  of  '
       || format('{:>5}', format('{:,}', steps)) || '.' AS shown
FROM steps WHERE step % 40 = 0 AND step <> 0""",
    "log_rows": _with(_STEPS)
    + "SELECT 'events' AS run, epoch, step, loss FROM steps WHERE step % 100 = 0 AND step > 0",
    "stream_labels": f"SELECT event_id, {_above('value', 'CAST(50 AS DOUBLE)')} AS label FROM events",
}


def _logistic() -> str:
    """The steps of ``operators.logistic`` one after another, with its constants and the idf of the training rows."""
    counted = lambda name: f"""
{name}_cnt AS (
  SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM {name}) GROUP BY ALL)"""  # noqa: E731
    idf = """
idf AS (
  SELECT token, ln(CAST((SELECT count(*) FROM train) AS DOUBLE) / CAST(count(*) AS DOUBLE)) + CAST(1 AS DOUBLE) AS idf
  FROM train_cnt GROUP BY token)"""
    scaled = lambda name: f"""
{name}_x AS MATERIALIZED (
  SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x
  FROM (SELECT doc_id, token, tf * idf AS w FROM {name}_cnt JOIN idf USING (token))
  UNION ALL SELECT doc_id, '', CAST(1 AS DOUBLE) FROM {name})"""  # noqa: E731
    margins = lambda name, step: f"""
  SELECT doc_id, sum(x * coalesce(weight, 0)) AS margin FROM {name}_x LEFT JOIN w{step} USING (token) GROUP BY doc_id"""  # noqa: E731
    parts = ["w0 AS (SELECT '' AS token, CAST(0 AS DOUBLE) AS weight)"]
    for k in range(logistic.STEPS):
        parts.append(f"""
w{k + 1} AS MATERIALIZED (
  SELECT token, coalesce(any_value(weight), 0) * (1 - CAST({logistic.RATE} AS DOUBLE) * CAST({logistic.DECAY} AS DOUBLE))
         + CAST({logistic.RATE} AS DOUBLE) * sum(x * missed) / any_value(n) AS weight
  FROM train_x JOIN (
    SELECT doc_id, label - 1 / (1 + exp(-margin)) AS missed, count(*) OVER () AS n
    FROM train JOIN ({margins("train", k)}) USING (doc_id)) USING (doc_id) LEFT JOIN w{k} USING (token)
  GROUP BY token)""")
    head = _with(_HOLDOUT, counted("train"), counted("test"), idf, scaled("train"), scaled("test"), *parts)
    return f"""{head}
SELECT doc_id, label, logit, CAST(logit > 0 AS BIGINT) AS pred
FROM (SELECT doc_id, label, round(margin, {logistic.DIGITS}) + 0.0 AS logit
      FROM test JOIN ({margins("test", logistic.STEPS)}) USING (doc_id))"""


ORACLES["lr_predict"] = _logistic()
ORACLES["accuracy_observed"] = ORACLES["accuracy_overall"]
ORACLES["stream_scores"] = ORACLES["model_roundtrip"]
ORACLES["manifest_nodes"] = _with(_chunks("documents"), recursive=True) + """
SELECT 'part' || CAST(doc_id // 100 AS VARCHAR) AS index_key, 'vector_store' AS type,
       'part' || CAST(doc_id // 100 AS VARCHAR) AS index_id, node_id, node_id AS ref_id FROM chunks"""


def _dataset(name: str, oracle: str) -> str:
    kept = "text IS NOT NULL AND label IS NOT NULL"
    return f"SELECT '{name}' AS dataset, split, text, label FROM ({oracle}) WHERE {kept}"


_HUMAN = """
SELECT d.text, CAST(coalesce(CAST(nullif(l.quality, 0) AS DOUBLE) * 3 + CAST(l.toxic AS DOUBLE) * 3 > 5.5, false) AS BIGINT) AS label,
       CASE WHEN d.lang = 'en' THEN 'train' ELSE 'test' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

ORACLES["job_training_set"] = "\nUNION ALL\n".join(
    _dataset(name, ORACLES.get(f"dataset_{name}", _HUMAN)) for name in ("twitter", "gender", "berkeley", "toxigen_human")
)
ORACLES["job_preference_set"] = ORACLES["preference_split"]

_PREPARED = f"""
{_LABELLED.strip()},
tweets AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER () AS n
  FROM labelled WHERE lang <> 'fr' AND text IS NOT NULL),
prepared AS (
  SELECT 'twitter:' || CAST(doc_id AS VARCHAR) AS doc_id, text, 'twitter' AS lang, label,
         rn <= ceil(CAST(0.2 AS DOUBLE) * n) AS held_out
  FROM tweets
  UNION ALL
  SELECT 'gender:' || CAST(doc_id AS VARCHAR), text, 'gender', label, lang IS DISTINCT FROM 'en'
  FROM labelled WHERE text IS NOT NULL),
train AS (SELECT doc_id, text, lang, label FROM prepared WHERE NOT held_out),
test AS (SELECT doc_id, text, lang, label FROM prepared WHERE held_out)
"""
ORACLES["job_evaluation"] = ORACLES["accuracy_cube"].replace(_HOLDOUT.strip(), _PREPARED.strip()).replace(
    "UNION ALL SELECT 'majority', 'false',", "UNION ALL SELECT 'majority', unnest(['false', 'true']),"
)
