"""DuckDB SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from storeloom.llm.licenses import (
    KEYWORDS,
    MARKS,
    RULES,
    SENTENCES,
    SPDX,
    SPDX_NAMES,
    SPDX_NO_ID,
    SPDX_OLDER,
    SPDX_TAG,
    SPDX_WORD,
)
from storeloom.llm.merkle import BORDER, EMPTY_NODE, SENTENCE
from storeloom.llm.phrase_index import NEAR_TERMS, NEAR_WORDS, WINDOW_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone
      FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM j GROUP BY doc_id
"""


def _tree(source: str, key: str) -> str:
    """Leaves, paragraph nodes, section nodes and root of ``source(key, t)``."""
    return f"""
SELECT {key}, t, leaves, paras, root_of.root FROM (
  SELECT {key}, t, list_distinct(flatten(sents)) AS leaves,
         list_transform(sents, lambda s: md5(array_to_string(s, ''))) AS paras
  FROM (SELECT {key}, t, list_transform(string_split(t, chr(10)), lambda p:
          list_transform(regexp_extract_all(p, '{SENTENCE}'), lambda s: md5(s))) AS sents
        FROM {source})), LATERAL (
  SELECT sha256(array_to_string(list_transform(string_split(array_to_string(
    list_transform(paras, lambda n: CASE WHEN starts_with(n, '{BORDER}') OR n = '{EMPTY_NODE}'
      THEN n || '|' ELSE n END), ''), '|'), lambda s: md5(s)), '')) AS root) root_of"""


def _dice(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE "
        f"2 * len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}))::DOUBLE END"
    )


def _prefix(a: str, b: str) -> str:
    """Equal nodes at the start of two lists."""
    both = f"least(len({a}), len({b}))"
    return (
        f"coalesce(list_position(list_transform(range(1, {both} + 1), "
        f"lambda i: {a}[i] = {b}[i]), false) - 1, {both})"
    )


MERKLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n
           FROM documents),
nx AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
              coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t
       FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substring(t, 1, n - n // 3) || substring(next_t, 1, n // 3) AS edited FROM nx),
own AS ({_tree("d", "doc_id")}),
ed AS ({_tree("(SELECT doc_id, edited AS t FROM e)", "doc_id")}),
j AS (SELECT e.doc_id, e.n, sha256(e.edited) AS edited_sha256, own.root AS r, ed.root AS er,
             own.leaves AS l, ed.leaves AS el, nxt.leaves AS nl, own.paras AS p, ed.paras AS ep
      FROM e JOIN own USING (doc_id) JOIN ed USING (doc_id)
      JOIN own AS nxt ON nxt.doc_id = e.next_id),
s AS (SELECT *, list_reverse(p) AS rp, list_reverse(ep) AS rep FROM j),
x AS (SELECT *, {_prefix("p", "ep")} AS head, {_prefix("rp", "rep")} AS tail FROM s)
SELECT doc_id, n AS n_chars, edited_sha256, r AS fingerprint, er AS edited_fingerprint,
       {_dice("l", "el")} AS near_edited, {_dice("l", "nl")} AS near_next,
       CASE WHEN p <> ep THEN head END AS edit_from,
       CASE WHEN p <> ep THEN greatest(head, len(p) - tail) END AS edit_to
FROM x
"""


def license_scan() -> str:
    marked = f"regexp_replace(s, {quoted(SPDX)}, ' ', 'g')"
    for name, pattern in SENTENCES:
        marked = f"regexp_replace({marked}, {quoted(pattern)}, chr(2) || '{name}' || chr(3), 'g')"
    word = "w"
    for old, new in SPDX_OLDER:
        word = f"regexp_replace({word}, {quoted(old)}, {quoted(new)})"
    known = ", ".join(quoted(n.lower()) for n in SPDX_NAMES)
    stated = "sentence_ids"
    for name, pattern in RULES:
        stated = f"regexp_replace({stated}, {quoted(pattern)}, chr(2) || '{name}' || chr(3), 'g')"
    names = list(dict.fromkeys(name for name, _ in RULES))
    order = ", ".join(quoted(n) for n in names)
    tag_line = quoted(rf"({SPDX_TAG}[^\n]*)\n")
    blanks = quoted(r"[ \t\r]*\n([ \t\r]*\n)+")
    runs = quoted(r"[ \t\r\n\x0B\f]+")
    ends = quoted(r"([.!?]) ")
    version, either = quoted(r"\bv\. (\d)"), quoted(r"\bandor\b")
    return f"""
WITH c AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        translate(t, {quoted(MARKS)}, ''), {tag_line}, '\\1' || chr(1), 'g'), {blanks}, chr(1), 'g'),
        {runs}, ' ', 'g'), {version}, 'v.\\1', 'g'), {either}, 'and/or', 'g') AS flat
      FROM c WHERE regexp_matches(t, {quoted(KEYWORDS)})),
s AS (SELECT doc_id, list_filter(list_transform(string_split(
        regexp_replace(flat, {ends}, '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
        lambda x: regexp_matches(x, {quoted(KEYWORDS)})) AS ss FROM f),
i AS (SELECT doc_id, array_to_string(list_transform(ss, lambda s: coalesce(nullif(
        array_to_string(list_transform(regexp_extract_all({marked}, '\x02([A-Za-z0-9]+)\x03', 1),
            lambda n: '<' || n || '>'), '') ||
        array_to_string(list_transform(list_filter(flatten(list_transform(
                regexp_extract_all(s, {quoted(SPDX)}, 1),
                lambda e: regexp_extract_all(e, {quoted(SPDX_WORD)}))),
            lambda w: NOT regexp_matches(w, {quoted(SPDX_NO_ID)})),
            lambda w: CASE WHEN {word} IN ({known}) THEN '<spdx ' || {word} || '>'
                      ELSE '<SpdxOther>' END), ''), ''), '<Unknown>')), '') AS ids FROM s),
r AS (SELECT c.doc_id, coalesce(i.ids, '') AS sentence_ids FROM c LEFT JOIN i USING (doc_id)),
l AS (SELECT doc_id, sentence_ids, regexp_extract_all({stated}, '\x02([^\x03]+)\x03', 1) AS found FROM r)
SELECT doc_id, sentence_ids,
       array_to_string(list_filter([{order}], lambda n: list_contains(found, n)), ',') AS licenses,
       len(regexp_extract_all(sentence_ids, '<Unknown>|<SpdxOther>')) AS n_unknown
FROM l
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS last_id FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
        substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM h)
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
           (substr(bits, i * 5 + j + 1, 1))::INTEGER * (16 >> j::INTEGER)))::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to,
       true AS complete
FROM b
"""


def _words(text: str) -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )


PHRASES = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS i, {_words("text")} AS w FROM benchmark),
ph AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
       FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
             FROM (SELECT *, least({WINDOW_WORDS}, len(w)) AS size FROM b WHERE len(w) > 0))),
g AS (SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS phrase
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p
            FROM d, (SELECT DISTINCT size FROM ph) WHERE len(w) >= size)),
m AS (SELECT r, item_id, size, p FROM g JOIN ph USING (size, phrase)),
hit AS (SELECT r, count(*) AS n_hit
        FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS at FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL)
          GROUP BY r),
post AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
cf AS (SELECT term, count(*) AS n FROM post GROUP BY term),
rare AS (SELECT i, item_id, term, row_number() OVER (PARTITION BY i ORDER BY coalesce(n, 0), term)
                AS rank FROM (SELECT DISTINCT i, item_id, unnest(w) AS term FROM b) LEFT JOIN cf USING (term)),
need AS (SELECT *, count(*) OVER (PARTITION BY i) AS need FROM rare WHERE rank <= {NEAR_TERMS}),
near AS (SELECT r, count(DISTINCT item_id) AS n_near_items FROM (
           SELECT r, item_id, need, count(DISTINCT rank) OVER (PARTITION BY r, i ORDER BY pos
                  RANGE BETWEEN {NEAR_WORDS - 1} PRECEDING AND CURRENT ROW) AS met
           FROM post JOIN need USING (term)) WHERE met = need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""
