"""The queries of ``queries.py`` as DuckDB SQL over the same tables."""

from __future__ import annotations

from moderata.llm import quality_rules

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _count(chars: str) -> str:
    return f"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{chars}]+', '', 'g'))"


def _quality_rules() -> str:
    q = quality_rules
    bins = " UNION ALL ".join(
        f"SELECT '{lang}' AS lang, unnest({list(words)!r}) AS word" for lang, words in q.COMMON_WORDS.items()
    )
    kinds = [*q.CLASSES, "other"]
    term = lambda p, q: (
        f"(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END"
        f" + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END)"
    )
    js = lambda nats: f"round(sqrt(greatest({nats}, 0) / 2 / ln(2)), 6)"
    limit = lambda pair: f"{pair[0]} + {pair[1]} / sqrt(n_words)"
    return f"""
    WITH base AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
               {_WORDS} AS w
        FROM documents),
    windows AS (
        SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
    again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    repeated AS (
        SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
    lines AS (
        SELECT r, count(*) - count(DISTINCT line) AS n
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    counted AS (
        SELECT b.r, doc_id, lang, len(w) AS n_words, length(text) AS n_chars,
               length(array_to_string(w, '')) AS word_chars,
               {_count(q.SYMBOLS)} AS n_symbols,
               {_count('a-z')} AS n_lower, {_count(r'\x20\x09-\x0D')} AS n_blank,
               {", ".join(f"{_count(chars)} AS n_{name}" for name, chars in q.REST.items())},
               coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
        FROM base b LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
    known AS (
        SELECT lang, sum(n_words) AS q_words,
               {", ".join(f"sum(n_{name}) / sum(n_chars) AS q_{name}" for name in q.CLASSES)}
        FROM counted GROUP BY lang HAVING sum(n_words) >= {q.MIN_REFERENCE_WORDS}),
    bins AS ({bins}),
    hits AS (
        SELECT r, bins.lang, bins.word, count(t.word) AS n
        FROM base JOIN bins USING (lang)
        LEFT JOIN (SELECT r, unnest(w) AS word FROM base) t USING (r, word)
        GROUP BY ALL),
    shares AS (
        SELECT lang, word, sum(n) / any_value(q_words) AS q
        FROM hits JOIN known USING (lang) GROUP BY lang, word),
    word_parts AS (
        SELECT r, n / nullif(n_words, 0) AS p, q
        FROM hits JOIN shares USING (lang, word) JOIN counted USING (r)),
    by_word AS (
        SELECT r, {js(f"sum({term('p', 'q')}) + {term('greatest(1 - sum(p), 0)', 'greatest(1 - sum(q), 0)')}")}
               AS word_distance
        FROM word_parts GROUP BY r),
    class_parts AS (
        SELECT r, {", ".join(f"n_{name} / nullif(n_chars, 0) AS p_{name}, q_{name}" for name in q.CLASSES)}
        FROM counted JOIN known USING (lang)),
    class_all AS (
        SELECT *, greatest(1 - ({" + ".join(f"p_{k}" for k in q.CLASSES)}), 0) AS p_other,
               greatest(1 - ({" + ".join(f"q_{k}" for k in q.CLASSES)}), 0) AS q_other
        FROM class_parts),
    by_class AS (SELECT r, {js(" + ".join(term(f"p_{k}", f"q_{k}") for k in kinds))} AS class_distance FROM class_all),
    judged AS (
        SELECT c.*, CASE WHEN n_words >= {q.MIN_WORDS} THEN class_distance END AS class_distance,
               CASE WHEN n_words >= {q.MIN_WORDS} THEN word_distance END AS word_distance,
               n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed
        FROM counted c LEFT JOIN by_class USING (r) LEFT JOIN by_word USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           CASE WHEN base_failed THEN false
                ELSE (class_distance IS NULL OR class_distance <= {limit(q.CLASS_LIMIT)})
                 AND (word_distance IS NULL OR word_distance <= {limit(q.WORD_LIMIT)}) END AS kept,
           class_distance, word_distance
    FROM judged"""


ORACLES["op1_quality_rules"] = _quality_rules()


def _decontamination() -> str:
    words = (
        "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS w FROM documents),
    items AS (SELECT item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    windows AS (
        SELECT item_id, least(len(w), 10) AS size,
               unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
                                     lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS g
        FROM items),
    sizes AS (SELECT DISTINCT size FROM windows),
    passages AS (
        SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
    matched AS (SELECT r, i, size, item_id FROM passages JOIN windows USING (size, g)),
    hit AS (
        SELECT r, count(DISTINCT p) AS n
        FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM matched))
        GROUP BY r),
    found AS (
        SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM matched) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)"""


ORACLES["op10_decontamination"] = _decontamination()


def _warc() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hexadecimal digits are four characters of base 32.
    part = "CAST('0x' || substr(digest, 5 * j + 1, 5) AS INTEGER)"
    letters = " || ".join(f"substr('{alphabet}', (({part} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
    ranked AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
    SELECT page_id, strlen(payload) AS payload_bytes,
           array_to_string(list_transform(range(0, 8), lambda j: {letters}), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM ranked"""


ORACLES["op8_warc"] = _warc()


ORACLES["op2_line_dedup"] = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    lines AS (
        SELECT r, doc_id, i, lines[i] AS line, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS w
        FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
    sets AS (
        SELECT r, doc_id, i,
               list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END)) AS s
        FROM lines WHERE len(w) > 0),
    firsts AS (
        SELECT row_number() OVER () AS set_no, s, min({'doc_id': doc_id, 'i': i}) AS place FROM sets GROUP BY s),
    tokens AS (SELECT set_no, unnest(s) AS token FROM firsts),
    common AS (
        SELECT a.set_no AS x, b.set_no AS y, count(*) AS n
        FROM tokens a JOIN tokens b ON a.token = b.token AND a.set_no <> b.set_no GROUP BY ALL),
    matched AS (
        SELECT DISTINCT y AS set_no
        FROM common JOIN firsts a ON a.set_no = x JOIN firsts b ON b.set_no = y
        WHERE a.place < b.place AND 9 * n >= 4 * (len(a.s) + len(b.s))),
    judged AS (
        SELECT r, i, m.set_no IS NOT NULL OR f.place <> {'doc_id': t.doc_id, 'i': t.i} AS gone
        FROM sets t JOIN firsts f USING (s) LEFT JOIN matched m USING (set_no)),
    kept AS (
        SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS text,
               count(gone) AS n_lines, count(*) FILTER (gone) AS n_removed
        FROM lines LEFT JOIN judged USING (r, i) GROUP BY r)
    SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
    FROM docs LEFT JOIN kept USING (r)"""


def _prefix_nodes() -> str:
    # One step of the checksum for each bit of each byte of the decimal id.
    bit = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    step = "xor(crc, CAST(b AS BIGINT))"
    for _ in range(8):
        step = f"list_transform([{step}], lambda r: {bit})[1]"
    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''),"
        f" lambda x: CAST(ord(x) AS BIGINT))), lambda crc, b: {step}), 4294967295)"
    )
    return f"""
    WITH own AS (
        SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS seq
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    heads AS (SELECT conv_id, seq, {crc} % 9 AS h FROM own),
    convs AS (
        SELECT c.conv_id, list_concat(coalesce(f.seq[1 : c.h], []), c.seq[c.h + 1 :]) AS seq
        FROM heads c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5),
    prefixes AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM convs),
    nodes AS (
        SELECT seq[1 : depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
        FROM prefixes GROUP BY ALL),
    related AS (
        SELECT a.p AS p, b.depth - a.depth AS below, b.p AS q,
               CASE WHEN b.depth = 0 THEN 0 ELSE (b.n_convs - 1) * strlen(b.p[b.depth].t) END AS saved
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) b JOIN nodes a ON a.depth = b.d AND a.p = b.p[1 : b.d]),
    parents AS (SELECT DISTINCT p[1 : depth - 1] AS p FROM nodes WHERE depth > 0),
    leaves AS (SELECT p FROM nodes ANTI JOIN parents USING (p)),
    sums AS (
        SELECT p, count(*) FILTER (below = 1) AS n_children, sum(saved) AS saved_tokens,
               count(*) FILTER (q IN (SELECT p FROM leaves)) AS n_leaves
        FROM related GROUP BY p)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
           CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s ON n.p = s.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1 : n.depth - 1]"""


ORACLES["op13_prefix_trie"] = _prefix_nodes()
