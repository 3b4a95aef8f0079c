"""The driver's tables in the shapes that the operators take: notes, queries, usage events, turns, model outputs.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "notes_src": """
        SELECT doc_id, source AS vault,
          CASE WHEN doc_id % 10 = 1 THEN 'twin' ELSE lang END || '/doc' || cast(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS varchar(20)) || '.md' AS node_id,
          'doc' || cast(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS varchar(20)) AS title,
          '---' || chr(10) || 'tags: [' || upper(lang) || ', ' || source || ']' || chr(10)
          || CASE WHEN doc_id % 5 = 0 THEN ''
             ELSE 'date: 2024-' || lpad(cast(doc_id % 12 + 1 AS varchar(20)), 2, '0') || '-'
                  || lpad(cast(doc_id % 28 + 1 AS varchar(20)), 2, '0') || chr(10) END
          || '---' || chr(10) || '# doc' || cast(CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS varchar(20)) || chr(10)
          || substring(text, 1, cast(floor(n_chars / 3) AS int)) || chr(10)
          || '## Methods' || chr(10)
          || substring(text, cast(floor(n_chars / 3) AS int) + 1, cast(floor(n_chars / 3) AS int)) || chr(10)
          || '### Training' || chr(10)
          || substring(text, 2 * cast(floor(n_chars / 3) AS int) + 1) || chr(10)
          || CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'See [[Doc'
             || CASE WHEN floor(doc_id / 2) % 11 = 0 THEN 'less' ELSE cast(cast(floor(doc_id / 2) AS bigint) AS varchar(20)) END || '#Training|more]] and [['
             || lang || '/doc' || CASE WHEN floor(doc_id / 3) % 11 = 0 THEN 'less' ELSE cast(cast(floor(doc_id / 3) AS bigint) AS varchar(20)) END || ']].' || chr(10) END AS body
        FROM documents""",
    "usage_src": """
        SELECT event_id, ts, user_id AS session_id,
          CASE event_type WHEN 'view' THEN 'select' WHEN 'click' THEN 'evaluate'
            WHEN 'purchase' THEN 'final' WHEN 'signup' THEN 'summarize' ELSE 'other' END AS phase,
          cast(floor(value * 10) AS bigint) AS prompt,
          cast(floor(value) AS bigint) AS completion,
          value / 100 AS elapsed, event_id % 2 = 0 AS cacheable
        FROM events""",
    "queries_src": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "turns_src": """
        SELECT conv_id AS session_id, turn, text AS question, answer
        FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer,
                lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) t
        WHERE role = 'user' AND next_role = 'assistant'""",
    "snapshot_prev": "SELECT doc_id AS path, doc_id AS mtime FROM documents WHERE doc_id % 10 <> 0",
    "snapshot_cur": "SELECT doc_id AS path, doc_id + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 <> 1",
    "model_output_src": """
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'NONE' ELSE 'Noise' || chr(10) || 'ENTITY: '
          || split_part(replace(replace(text, chr(10), ' '), '|', ' '), ' ', 2) || ' | ' || upper(lang) || ' | '
          || replace(replace(text, chr(10), ' '), '|', ' ') END AS response
        FROM documents""",
    "select_output_src": """
        SELECT item_id AS query_id, t AS said, CASE item_id % 5
          WHEN 0 THEN 'ok' || chr(10) || 'SELECT: ' || t WHEN 1 THEN 'DONE: ' || t
          WHEN 2 THEN '```json' || chr(10) || '{"action": "select", "node_id": "' || t || '"}' || chr(10) || '```'
          WHEN 3 THEN 'x {"action": "DONE", "reason": "' || t || '"} y' ELSE t END AS response
        FROM (SELECT item_id, trim(replace(replace(replace(replace(replace(text, chr(10), ' '), chr(92), ' '), chr(34), ' '), chr(123), ' '), chr(125), ' ')) AS t FROM benchmark) b""",
}
TABLES = re.compile(r"\bFROM (documents|events|benchmark|conversations|labels|pages)\b")

#: Views that only the SQL side needs, on top of those above.
DERIVED = {
    "notes": """
        SELECT vault, node_id, title, body, greatest(1, length(body) // 3) AS token_count,
          CASE WHEN greatest(1, length(body) // 3) < 500 THEN 'micro' WHEN greatest(1, length(body) // 3) < 3000 THEN 'atomic' ELSE 'long' END AS tier,
          string_split(regexp_extract(body, '^---\\ntags: \\[([^\\]\\n]*)\\]', 1), ', ') AS tags,
          nullif(regexp_extract(body, '^---\\ntags: [^\\n]*\\ndate: ([^\\n]*)\\n', 1), '') AS date,
          row_number() OVER (PARTITION BY vault ORDER BY node_id) - 1 AS position
        FROM notes_src""",
    "links": """
        SELECT vault, node_id, title, unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]*)?\\]\\]', 1)) AS raw_target,
          nullif(unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]*)?\\]\\]', 2)), '') AS anchor,
          unnest(range(0, len(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|[^\\]]*)?\\]\\]')))) AS pos
        FROM notes_src""",
    "resolved": """
        SELECT l.vault, l.node_id AS source_id, l.title AS source_title, l.pos, l.raw_target, l.anchor, n.vault AS target_vault, n.node_id AS target_id, n.title AS target_title
        FROM links l JOIN notes n ON lower(split_part(l.raw_target, '/', -1)) = lower(n.title)
          AND (NOT contains(l.raw_target, '/') OR ends_with(n.node_id, l.raw_target || '.md'))""",
    "lines": """
        SELECT vault, node_id, title, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no,
          len(string_split(body, chr(10))) AS n_lines FROM notes_src""",
    "fenced": """
        SELECT *, sum(starts_with(trim(line), '```')::INT) OVER w % 2 = 1 AS fenced, sum(length(line) + 1) OVER w - length(line) - 1 AS before
        FROM lines WINDOW w AS (PARTITION BY vault, node_id ORDER BY line_no)""",
    "heads": """
        SELECT vault, node_id, title AS note_title, length(regexp_extract(line, '^(#{1,6})\\s+\\S', 1)) AS level,
          trim(regexp_extract(line, '^#{1,6}\\s+(\\S.*)$', 1)) AS title, line_no AS start_line, n_lines, before,
          row_number() OVER (PARTITION BY vault, node_id ORDER BY line_no) AS seq
        FROM fenced WHERE NOT fenced AND regexp_matches(line, '^#{1,6}\\s+\\S')""",
    "section_ends": """
        SELECT h.vault, h.node_id, h.seq, min(e.start_line) AS end_line, min(e.before) AS end_before
        FROM heads h JOIN heads e ON e.vault = h.vault AND e.node_id = h.node_id AND e.seq > h.seq AND e.level <= h.level GROUP BY h.vault, h.node_id, h.seq""",
    "section_parents": """
        SELECT h.vault, h.node_id, h.seq, max(p.seq) AS parent_seq
        FROM heads h JOIN heads p ON p.vault = h.vault AND p.node_id = h.node_id AND p.seq < h.seq AND p.level < h.level GROUP BY h.vault, h.node_id, h.seq""",
    "note_totals": "SELECT vault, node_id, max(before + length(line) + 1) AS total FROM fenced GROUP BY vault, node_id",
    "sections": """
        SELECT h.vault, h.node_id, h.note_title, h.seq, h.level, h.title, h.start_line, h.n_lines, coalesce(e.end_line, h.n_lines + 1) AS end_line, p.parent_seq,
          (coalesce(e.end_before, t.total) - h.before - 1)::BIGINT AS chars
        FROM heads h LEFT JOIN section_ends e USING (vault, node_id, seq) LEFT JOIN section_parents p USING (vault, node_id, seq) JOIN note_totals t USING (vault, node_id)""",
    "thinned": """
        SELECT *, row_number() OVER (PARTITION BY vault, node_id ORDER BY seq) AS kept_seq, greatest(1, chars // 3) AS subtree_tokens
        FROM sections WHERE parent_seq IS NULL OR greatest(1, chars // 3) >= 500""",
    "first_titled": """
        SELECT vault, node_id, lower(title) AS key, arg_min(node_id || '#' || lpad(kept_seq::VARCHAR, 4, '0'), seq) AS section_id FROM thinned GROUP BY vault, node_id, lower(title)""",
    "anchored": """
        SELECT r.*, coalesce(f.section_id, r.target_id) AS target_node
        FROM resolved r LEFT JOIN first_titled f ON f.vault = r.target_vault AND f.node_id = r.target_id AND f.key = lower(r.anchor)""",
    "query_tokens": """
        SELECT query_id, t AS token, count(*) AS n FROM (SELECT query_id, unnest(string_split_regex(lower(query), '[\\s,.;:!?\\-()\\[\\]{}"''`/\\\\]+')) AS t FROM queries_src)
        WHERE length(t) >= 2 GROUP BY ALL""",
    "note_tokens": """
        SELECT vault, node_id, t AS token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY vault, node_id) AS len
        FROM (SELECT vault, node_id, unnest(string_split_regex(lower(title || ' ' || body), '[\\s,.;:!?\\-()\\[\\]{}"''`/\\\\]+')) AS t FROM notes_src)
        WHERE length(t) >= 2 GROUP BY vault, node_id, t""",
    "bm25": """
        SELECT query_id, vault, node_id, round(sum(n * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE)) + greatest(0, 1 - max(len) / 50), 6) AS score
        FROM note_tokens JOIN query_tokens USING (token) GROUP BY query_id, vault, node_id""",
    "entities_raw": """
        SELECT doc_id, trim(regexp_extract(response, '(?m)^ENTITY:\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|\\s*(.+)$', 1)) AS name,
          lower(trim(regexp_extract(response, '(?m)^ENTITY:\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|\\s*(.+)$', 2))) AS category,
          trim(regexp_extract(response, '(?m)^ENTITY:\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|\\s*(.+)$', 3)) AS description
        FROM model_output_src WHERE regexp_matches(response, '(?m)^ENTITY:\\s*(.+?)\\s*\\|\\s*(.+?)\\s*\\|\\s*(.+)$')""",
    "mentions": "SELECT lower(name) AS key, * FROM entities_raw WHERE name <> ''",
    "entities": """
        SELECT key, arg_min(name, doc_id) AS name, arg_min(category, doc_id) AS category, arg_min(description, doc_id) AS first_description, count(*) AS n_mentions, min(doc_id) AS first_note
        FROM mentions GROUP BY key""",
    "diff": """
        SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind
        FROM snapshot_cur c FULL OUTER JOIN snapshot_prev p ON c.path = p.path
        WHERE p.path IS NULL OR c.path IS NULL OR p.mtime <> c.mtime""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir`` in Spark."""
    sql = VIEWS[name]
    for table in set(TABLES.findall(sql)):
        at = f"{table}_{sf_dir.encode().hex()}"
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(at)
        sql = re.sub(rf"\bFROM {table}\b", f"FROM `{at}`", sql)
    return spark.sql(sql)


def oracle(sql: str) -> str:
    """SQL for DuckDB: the text with all views that it names in front of it, in the order of their needs."""
    known, need = VIEWS | DERIVED, []

    def add(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(known[name])
                if name not in need:
                    need.append(name)

    add(sql)
    own = sql.lstrip().startswith("WITH ")
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({known[name]})" for name in need) + (", " + sql.lstrip()[5:] if own else " " + sql) if need else sql
