"""SQL (DuckDB) for the queries that SQL can express in reasonable time."""

from __future__ import annotations

from tracewarden.llm import boilerplate, chosenpaths, licenses, prefixes


def _texts(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _licenses() -> str:
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"ws[i + {n + 1}] = '{p}'" for n, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(0, len(ws) - {len(parts) - 1}), lambda i: {same}), lambda i: {{'i': i, 'label': '{label}'}})")
    templates = ", ".join(f"('{label}', {_texts(words)}, {need})" for label, words, need in licenses.SETS)
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '{licenses.WORD}') AS ws FROM d),
p AS (SELECT *, flatten([{", ".join(places)}]) AS ps FROM w),
lines AS (SELECT k, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{licenses.WORD}')) AS held FROM d),
met AS (
    SELECT k, label, len(list_intersect(held, words)) / len(words) AS share
    FROM lines, (VALUES {templates}) v(label, words, need) WHERE len(list_intersect(held, words)) >= need
), best AS (SELECT k, list(DISTINCT label) AS more, max(share) AS share FROM met GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_base,
    list_min(list_transform(ps, lambda x: x.i))::BIGINT AS first_word, list_max(list_transform(ps, lambda x: x.i))::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: x.label))), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: x.label), coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN best USING (k)
"""


ORACLES = {
    "op5_licenses": _licenses(),
    "op8_lines": boilerplate.ORACLE,
    "op12_chosenpaths": chosenpaths.ORACLE,
    "op13_prefixes": prefixes.ORACLE,
}
