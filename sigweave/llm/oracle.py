"""DuckDB SQL for the rows of those queries of this subpackage that SQL can express."""

#: The words of `documents`, as a list for each document; %s is the text.
_WORDS = r"SELECT doc_id, regexp_extract_all(%s, '[^\x20\x09-\x0D]+') AS ws FROM documents"

OP3 = f"""
WITH RECURSIVE w AS ({_WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}),
g AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT w.doc_id, count(g.shingle) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept
FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

OP7 = f"""
WITH w AS ({_WORDS % "coalesce(text, '')"}),
windows AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS nth
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM windows WHERE nth > 1),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP9 = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, role IS NOT NULL AS r, text IS NOT NULL AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', true, true
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', true, true
)
SELECT
    conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, r, role, t, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r, role, t, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(
        length('### ') + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:|\n')) + length(':') + 1
        + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + length('</turn>') + 1
    ) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

SQL = {"op3_near_duplicates": OP3, "op7_substrings": OP7, "op9_chat": OP9}
