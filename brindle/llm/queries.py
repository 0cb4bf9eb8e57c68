"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import Template, op6_chat_format
from .jaccard import op5_jaccard_join
from .licenses import COVERAGE, GRAM, NEAR, TemplateSet, op4_license_scan
from .media import op2_media_gif
from .mixing import op9_mixing
from .neighbours import op8_neighbours
from .packing import op7_packing
from .quality import op10_quality
from .substrings import op3_substring_dedup
from .token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_media_gif": op2_media_gif,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_chat_format": op6_chat_format,
    "op7_packing": op7_packing,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str) -> str:
    """The template's escapes, as nested replacements."""
    sql = f"replace({column}, '\\', '\\b')"
    for c in Template().control:
        sql = f"replace({sql}, '{c}', '{'\\l' if c[0] == '<' else '\\s'}{c[1:]}')"
    return sql


_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in Template().moves)

_TEMPLATES = ", ".join(f"({i}, '{label}', {exact}, string_split('{text}', ' '))" for i, (label, text, exact) in enumerate(TemplateSet().items))

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w)),
f AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM g JOIN f USING (h) WHERE d < doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op4_license_scan": f"""WITH w AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t(template, label, exact, ws) AS (VALUES {_TEMPLATES}),
tg AS (SELECT template, label, exact, len(ws) - {GRAM - 1} AS n_grams, i - 1 AS pos, array_to_string(ws[i:i + {GRAM - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM t)),
dg AS (SELECT key, i - 1 AS place, array_to_string(ws[i:i + {GRAM - 1}], ' ') AS g FROM (SELECT key, ws, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM w)),
h AS (SELECT DISTINCT key, template, label, exact, n_grams, place - pos AS diagonal, pos FROM dg JOIN tg USING (g)),
d AS (SELECT DISTINCT key, template, exact, diagonal FROM h),
f AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER x > {NEAR}, true) THEN 1 ELSE 0 END AS fresh FROM d WINDOW x AS (PARTITION BY key, template ORDER BY diagonal)),
m AS (SELECT key, template, diagonal, sum(fresh) OVER (PARTITION BY key, template ORDER BY diagonal) AS span FROM f),
s AS (SELECT key, template, span, any_value(label) AS label, any_value(exact) AS exact, min(diagonal) AS first, max(diagonal) AS last, count(DISTINCT pos) / any_value(n_grams) AS coverage FROM h JOIN m USING (key, template, diagonal) GROUP BY ALL),
v AS (SELECT * FROM s WHERE coverage >= CASE WHEN exact THEN 1 ELSE {COVERAGE} END)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(CASE WHEN exact THEN 1 END) AS n_base, CAST(min(CASE WHEN exact THEN first END) AS BIGINT) AS first_word, CAST(max(CASE WHEN exact THEN last END) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT CASE WHEN exact THEN label END, ',' ORDER BY CASE WHEN exact THEN label END), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0.0) AS score FROM w LEFT JOIN v USING (key) GROUP BY key""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id, coalesce(any_value(n_links), 0) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN r ON a = doc_id GROUP BY doc_id""",
    "op6_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
p AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS state, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
CAST(sum({len(Template().open) + len(Template().close) + len(Template().end)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars,
bool_and((state, role) IN ({_MOVES}) AND (i < n OR role = 'assistant')) AS valid FROM p GROUP BY conv_id""",
}
