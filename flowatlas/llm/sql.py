"""SQL for the training-data queries that it can express, run by DuckDB on the same tables."""

import math

from flowatlas.llm import chat, fingerprints, licenses

_SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PIECES = rf"(?s)[^\n.!?]{{1,{fingerprints.PIECE}}}[.!?]*\n?|[.!?]+\n?|\n"


def _leaves(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_PIECES}'), lambda x: substr(sha256(x), 1, {fingerprints.LEAF}))"


def _lines(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '[^\n]*\n|[^\n]+'), lambda y: {_leaves('y')})"


def _sections(lines: str) -> str:
    return f"list_transform({lines}, lambda y: substr(sha256(array_to_string(y, '')), 1, {fingerprints.SECTION}))"


def _tree(lines: str) -> str:
    below = f"list_transform({lines}, lambda y: substr(sha256(array_to_string(y, '')), 1, {fingerprints.SECTION}) || '.' || array_to_string(y, ''))"
    return f"sha256(coalesce(array_to_string({_sections(lines)}, ''), '')) || ':' || coalesce(array_to_string({below}, ';'), '')"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1e0 ELSE 2e0 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b}))) END"


def _license_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = list(licenses.PHRASES.items())
    at = lambda p: "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")"
    templates = ", ".join(f"('{label}', [{', '.join(repr(x) for x in sorted(set(t.split())))}], {math.ceil(len(set(t.split())) * licenses.THRESHOLD - 1e-9)})" for label, t in licenses.TEMPLATES.items())
    sep = "chr(10)"
    return f"""
WITH t AS (SELECT doc_id, {_LOWER} AS t FROM documents), d AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w FROM t),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {', '.join(f"{at(p)} AS p{k}" for k, (p, _) in enumerate(phrases))} FROM d),
q AS (SELECT *, {' || '.join(f'p{k}' for k in range(len(phrases)))} AS spots, list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))}], lambda x: x IS NOT NULL) AS base FROM p),
v(label, words, need) AS (VALUES {templates}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS w FROM (SELECT doc_id, unnest(string_split(t, {sep})) AS line FROM t) x),
m AS (SELECT doc_id, label, len(list_intersect(w, words)) / len(words) AS c FROM lines JOIN v ON len(list_intersect(w, words)) >= need),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS best FROM m GROUP BY doc_id)
SELECT q.doc_id, n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels, CASE WHEN len(spots) > 0 THEN 1e0 ELSE coalesce(best, 0e0) END AS score FROM q LEFT JOIN f ON q.doc_id = f.doc_id
"""


def _clustering_sql(clusters: int = 16, rounds: int = 3) -> str:
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}) x)",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d, any_value(q) AS q FROM (SELECT v.vec_id, v.q, c.c, {gap} AS d FROM v, c{k} c) x GROUP BY vec_id)")
        mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        steps.append(
            f"m{k} AS (SELECT c, list({mean} ORDER BY i) AS q FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY c, i) x GROUP BY c), "
            f"c{k + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON c.c = m.c)"
        )
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"
    )


def _chat_sql() -> str:
    hidden = lambda x: f"length(regexp_replace({x}, '{chat.PLAIN}', '\\1\\\\\\2\\3', 'g'))"
    opening = f"{len(chat.START)} + {hidden('role')} + {len(chat.BODY)}"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(k)),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
sum({hidden('text')} + CASE WHEN before IS NULL THEN {opening} WHEN before = role THEN {len(chat.TURN)} ELSE {len(chat.END)} + {opening} END) AS n FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n + {len(chat.END)} AS BIGINT) AS formatted_chars FROM g
"""


ORACLE_SQL = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_chat_formatting": _chat_sql(),
    "op2_document_fingerprints": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after, length(text) AS n FROM t),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(after, 1, n // 2) AS edited FROM n),
l AS (SELECT *, {_lines('text')} AS la, {_lines('edited')} AS lb, {_lines('after')} AS lc FROM e),
h AS (SELECT *, flatten(la) AS a, flatten(lb) AS b, flatten(lc) AS c, {_sections('la')} AS sa, {_sections('lb')} AS sb FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_tree('la')} AS fingerprint, {_tree('lb')} AS edited_fingerprint,
{_like('a', 'b')} AS near_edited, {_like('a', 'c')} AS near_next, CAST(len(list_filter(list_distinct(sb), lambda x: NOT list_contains(sa, x))) AS INTEGER) AS edited_changed_sections,
CAST(len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS INTEGER) AS edited_changed_paragraphs FROM h
""",
    "op3_license_scans": _license_sql(),
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_SQUEEZED} AS body FROM documents),
best AS (SELECT body, arg_max(doc_id, (n, -doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, best.keep_id, best.group_size, t.doc_id = best.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN best ON t.body = best.body
""",
}
