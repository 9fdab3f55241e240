"""DuckDB twins of the page queries (I20, I21, M3, M4): tokens of a page by one pattern,
the open elements carried from token to token by a recursive query."""

from __future__ import annotations

from postlytics.operators.html import TEMPLATE, TEXT_TAGS, VOID_TAGS, _BLANK

_TOKEN = "|".join([
    "(?s)<!--.*?(?:-->|$)",
    r"(?i:<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|$))",
    r"(?i:<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|$))",
    """</?[a-zA-Z](?:[^>="']|=?"[^"]*"|=?'[^']*'|=)*>""",
    "<[!?/][^>]*>",
    "<[!?/a-zA-Z].*",
    "(?:[^<]|<[^a-zA-Z/!?<])+",
]).replace("'", "''")
#: The character references that stand in the driver's pages; the operator knows all.
_REFERENCES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&amp": "&"}


def _names(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def plain_ctes(pages: str) -> str:
    """The tables of a WITH RECURSIVE that end in ``plain`` (id, plain), from a table
    ``pages`` of (id, html)."""
    value = "t"
    for ref, char in _REFERENCES.items():
        value = f"replace({value}, '{ref}', '{char}')"
    blank = " || ".join(f"chr({ord(c)})" for c in _BLANK)
    return f"""
raw AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS j
        FROM (SELECT id, regexp_extract_all(html, '{_TOKEN}') AS toks FROM {pages} WHERE html <> '')),
named AS (SELECT id, j, t, lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name FROM raw),
kinds AS (SELECT id, j, t, name,
    CASE WHEN name = '' AND NOT regexp_matches(t, '^<[!?/]') THEN 't' WHEN name = '' OR right(t, 1) <> '>' THEN NULL
         WHEN left(t, 2) = '</' THEN 'c' WHEN list_contains({_names(VOID_TAGS + ['script', 'style'])}, name) THEN NULL
         WHEN right(t, 2) = '/>' THEN 's' ELSE 'o' END AS kind FROM named),
tok AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY j) AS i, kind, value FROM (
    SELECT id, j, kind, CASE WHEN kind = 't' THEN trim({value}, {blank}) ELSE name END AS value
    FROM kinds WHERE kind IS NOT NULL) WHERE value <> ''),
fold AS (
    SELECT DISTINCT id, 0::BIGINT AS i, []::VARCHAR[] AS tags, []::INTEGER[] AS slots, 0 AS n,
           NULL::VARCHAR AS kind, NULL::VARCHAR AS value FROM tok
    UNION ALL
    SELECT f.id, k.i,
      CASE k.kind WHEN 'o' THEN list_append(f.tags, k.value)
        WHEN 'c' THEN f.tags[1:len(f.tags) - coalesce(list_position(list_reverse(f.tags), k.value), 0)] ELSE f.tags END,
      CASE k.kind WHEN 'o' THEN list_append(f.slots, CASE WHEN list_contains({_names(TEXT_TAGS)}, k.value) THEN f.n ELSE -1 END)
        WHEN 'c' THEN f.slots[1:len(f.tags) - coalesce(list_position(list_reverse(f.tags), k.value), 0)] ELSE f.slots END,
      f.n + (k.kind IN ('o', 's') AND list_contains({_names(TEXT_TAGS)}, k.value))::INTEGER, k.kind, k.value
    FROM fold f JOIN tok k ON k.id = f.id AND k.i = f.i + 1),
elements AS (SELECT id, n - 1 AS slot FROM fold WHERE kind IN ('o', 's') AND list_contains({_names(TEXT_TAGS)}, value)),
pieces AS (SELECT id, i, value, unnest(list_filter(slots, lambda s: s >= 0)) AS slot FROM fold
           WHERE kind = 't' AND NOT list_contains(tags, '{TEMPLATE}')),
joined AS (SELECT id, slot, string_agg(value, '' ORDER BY i) AS txt FROM pieces GROUP BY id, slot),
plain AS (SELECT p.id, coalesce(x.txt, '') AS plain FROM {pages} p LEFT JOIN (
    SELECT e.id, string_agg(coalesce(j.txt, ''), chr(10) ORDER BY e.slot) AS txt
    FROM elements e LEFT JOIN joined j ON j.id = e.id AND j.slot = e.slot GROUP BY e.id) x ON x.id = p.id WHERE p.html <> '')"""


def sql_html_text() -> str:
    return f"""
WITH RECURSIVE src AS (SELECT page_id AS id, html FROM pages), {plain_ctes('src')}
SELECT id AS page_id, plain FROM plain
"""


def sql_page_text() -> str:
    return f"""
WITH RECURSIVE fetched AS (SELECT -page_id - 1 AS id, url, html FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
free AS (SELECT * FROM fetched WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
                                 AND url NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)),
src AS (SELECT id, url, html FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM free) WHERE rn = 1),
{plain_ctes('src')}
SELECT src.id, src.url, plain.plain FROM src JOIN plain ON plain.id = src.id
"""


def sql_prepare_documents(dictionary: str, words) -> str:
    """``dictionary``: the table ``dict`` (d, a list of words); ``words``: a column's
    cleaned words as a list expression."""
    def cleaned(col):
        return (f"CASE WHEN {col} IS NULL THEN ' ' ELSE array_to_string(list_filter({words(col)}, "
                "lambda x: list_contains(dict.d, x)), ' ') END")
    return f"""
WITH RECURSIVE {dictionary}, src AS (SELECT page_id AS id, html FROM pages), {plain_ctes('src')},
posts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT posts.id, title, {cleaned('text')} AS txt, {cleaned('plain')} AS doc
      FROM posts LEFT JOIN plain ON plain.id = posts.id CROSS JOIN dict)
SELECT id AS "Id", title || ' ' || txt || ' ' || doc AS "Document",
       (CASE WHEN length(doc) > 200 THEN 3 WHEN length(doc) > 50 THEN 2 ELSE 1 END)::INTEGER AS "Length" FROM c
"""
