"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words are runs without ASCII white space.
SPLIT = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"



def _crc32(keys: str) -> str:
    """Common tables that give ``sums(k, crc)``, the checksum of ASCII strings ``k``."""
    return f"""
        keys AS ({keys}),
        crc AS (
          SELECT k, 0 AS i, 4294967295 AS c FROM keys
          UNION ALL
          SELECT k, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
          FROM (SELECT k, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1))) ELSE c END AS v
                FROM crc WHERE i < 8 * length(k))),
        sums AS MATERIALIZED (SELECT k, xor(c, 4294967295) AS crc FROM crc WHERE i = 8 * length(k))"""


def _before_a_turn() -> str:
    """Per state four times the least cost before a turn plus the number of its edit
    (D, I, K, R), but for turns put in; ``f0`` to ``f3`` are the costs after the turn."""
    follows, keeps = (2, 2, 3, 2), ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
    found = []
    for state in range(4):
        kept = " ".join(f"WHEN initial = {k} THEN 4 * (extra + f{to[state]}) + 2" for k, to in enumerate(keeps) if state in to)
        keep = f"CASE WHEN gone THEN 1000000000 {kept} ELSE 1000000000 END" if kept else "1000000000"
        rerole = f"CASE WHEN gone THEN 1000000000 ELSE 4 * (3 + extra + f{follows[state]}) + 3 END"
        found.append(f"least(4 * (4 + f{state}), {keep}, {rerole}) AS b{state}")
    return ", ".join(found)


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_SQL = {
    "op3_suffix_trees": f"""
        WITH docs AS MATERIALIZED (
          SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS ws FROM documents),
        words AS MATERIALIZED (
          SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs),
        windows AS MATERIALIZED (
          SELECT doc_id, begins, array_to_string(ws[begins : begins + 12], ' ') AS run
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS begins FROM docs WHERE len(ws) >= 13)),
        firsts AS (SELECT run, min(doc_id) AS low FROM windows GROUP BY run),
        gone AS MATERIALIZED (
          SELECT DISTINCT doc_id, begins + unnest(range(13)) AS pos
          FROM windows JOIN firsts USING (run) WHERE low < doc_id),
        kept AS (
          SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS text FROM words w ANTI JOIN gone USING (doc_id, pos)
          GROUP BY w.doc_id),
        counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE docs AS MATERIALIZED (
          SELECT doc_id, {SPLIT.format(text=LOWERED)} AS ws FROM documents),
        sets AS MATERIALIZED (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4
            THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM docs),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
          FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (
          SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reached AS (
          SELECT doc_id AS a, doc_id AS b FROM docs
          UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id,
               d.doc_id = min(r.b) AS kept
        FROM docs d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWERED} AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """,
    "op11_suffix_array": """
        WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS MATERIALIZED (
          SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS w
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM docs WHERE length(h) >= 400)),
        repeated AS (
          SELECT doc_id, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
        runs AS (
          SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
          FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new
                FROM repeated)),
        spans AS MATERIALIZED (
          SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
        edges AS (
          SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
          UNION ALL
          SELECT doc_id, length(h) // 2, coalesce((SELECT max(b) FROM spans s WHERE s.doc_id = d.doc_id), 0) FROM docs d),
        kept AS (
          SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY before, a) AS h
          FROM edges JOIN docs USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
        FROM docs d JOIN kept k USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op12_conversation_repair": f"""
        WITH RECURSIVE named AS MATERIALIZED (
          SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
          FROM conversations),
        {_crc32("SELECT DISTINCT k FROM named")},
        damaged AS MATERIALIZED (
          SELECT conv_id, turn,
                 CASE WHEN crc % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                 CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
          FROM named JOIN sums USING (k) JOIN (VALUES (1), (2)) t(time) ON crc % 20 <> 0 AND (time = 1 OR crc % 20 = 3)),
        copies AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
                 rtrim(text, {_SPACE}) AS ended FROM damaged),
        turns AS MATERIALIZED (
          SELECT conv_id, turn, role, text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                 CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial,
                 ended = '' AS blank, ended <> '' AND copy > 1 AS duplicate,
                 ended <> '' AND copy = 1 AND right(ended, 1) NOT IN ('.', '!', '?') AS truncated
          FROM copies),
        sizes AS MATERIALIZED (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
        costs AS (
          SELECT conv_id, n + 1 AS pos, 0 AS f0, 6 AS f1, 3 AS f2, 0 AS f3, 0 AS e0, 0 AS e1, 0 AS e2, 0 AS e3 FROM sizes
          UNION ALL
          SELECT conv_id, pos, x0 // 4, x1 // 4, x2 // 4, x3 // 4, x0 % 4, x1 % 4, x2 % 4, x3 % 4
          FROM (SELECT conv_id, pos, least(b0, 4 * (3 + x2 // 4) + 1) AS x0, least(b1, 4 * (3 + x2 // 4) + 1) AS x1, x2, x3
                FROM (SELECT *, least(b2, 4 * (3 + b3 // 4) + 1) AS x2, least(b3, 4 * (3 + b2 // 4) + 1) AS x3
                      FROM (SELECT conv_id, pos, {_before_a_turn()}
                            FROM (SELECT c.conv_id, t.pos, f0, f1, f2, f3, initial, blank OR duplicate AS gone,
                                         CASE WHEN truncated THEN 3 ELSE 0 END AS extra
                                  FROM costs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos = c.pos - 1))))),
        steps AS MATERIALIZED (
          SELECT c.conv_id, c.pos, s.state, f0,
                 CASE WHEN role IS NULL THEN CASE WHEN s.state IN (1, 2) THEN 1 ELSE 9 END
                      ELSE CASE s.state WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END END AS edit,
                 role, text, initial
          FROM costs c CROSS JOIN (VALUES (0), (1), (2), (3)) s(state)
          LEFT JOIN turns t ON t.conv_id = c.conv_id AND t.pos = c.pos),
        walk AS (
          SELECT conv_id, 1 AS pos, 0 AS state, '' AS audit, CAST(NULL AS VARCHAR) AS said FROM sizes
          UNION ALL
          SELECT conv_id, CASE WHEN edit = 1 THEN pos ELSE pos + 1 END, after, audit || substr('DIKR', CAST(edit + 1 AS BIGINT), 1),
                 CASE WHEN edit = 0 THEN said ELSE coalesce(said || chr(10), '')
                   || CASE WHEN edit = 2 THEN role WHEN after = 2 THEN 'user' ELSE 'assistant' END || ':'
                   || CASE WHEN edit = 1 THEN '' ELSE text END END
          FROM (SELECT w.conv_id, w.pos, w.audit, w.said, s.edit, s.role, s.text,
                       CASE WHEN s.edit = 0 THEN w.state
                            WHEN s.edit = 2 AND s.initial = 0 THEN 1
                            WHEN w.state = 2 THEN 3 ELSE 2 END AS after
                FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.pos = w.pos AND s.state = w.state WHERE s.edit < 9)),
        done AS (SELECT w.conv_id, audit, said FROM walk w JOIN sizes s ON s.conv_id = w.conv_id AND w.pos = s.n + 1 WHERE state IN (0, 3)),
        pairs AS (
          SELECT conv_id, count(*) AS illegal
          FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS a, initial AS b FROM turns)
          WHERE a IS NOT NULL AND NOT (a = 0 AND b = 1 OR a = 1 AND b = 2 OR a = 2 AND b = 1) GROUP BY conv_id),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated
          FROM turns GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(f0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN pairs USING (conv_id)
        LEFT JOIN done USING (conv_id) LEFT JOIN costs ON costs.conv_id = o.conv_id AND costs.pos = 1
    """,
    "op13_conversation_trie": f"""
        WITH RECURSIVE convs AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
        {_crc32("SELECT CAST(conv_id AS VARCHAR) AS k FROM convs")},
        turns AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS pos
          FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, substr(sha256(
                  CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS name
                FROM conversations WHERE conv_id IS NOT NULL)),
        heads AS MATERIALIZED (SELECT conv_id, crc % 6 AS h FROM convs JOIN sums ON k = CAST(conv_id AS VARCHAR)),
        rebuilt AS (
          SELECT c.conv_id, 0 AS part, pos, name, chars FROM heads c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
          UNION ALL SELECT c.conv_id, 1, pos, name, chars FROM heads c JOIN turns b ON b.conv_id = c.conv_id AND pos > h),
        chains AS MATERIALIZED (
          SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM convs
          UNION ALL
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos),
                 string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING), chars FROM rebuilt),
        nodes AS MATERIALIZED (
          SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM chains GROUP BY path, depth),
        lengths AS (SELECT conv_id, max(depth) AS depth FROM chains GROUP BY conv_id),
        ends AS (
          SELECT path, string_agg(CAST(c.conv_id AS VARCHAR), ',' ORDER BY c.conv_id) AS ids
          FROM chains c JOIN lengths USING (conv_id, depth) GROUP BY path),
        children AS MATERIALIZED (
          SELECT substr(path, 1, CAST(32 * (depth - 1) AS BIGINT)) AS path, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY 1),
        whole AS MATERIALIZED (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN children USING (path)),
        below AS (
          SELECT a.path, count(*) FILTER (b.children = 0) AS leaves, sum((b.n - 1) * b.chars) AS saved
          FROM whole a JOIN whole b ON starts_with(b.path, a.path) GROUP BY a.path)
        SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs,
               CAST(w.children AS BIGINT) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
               sha256(coalesce(ids, '')) AS ends_sha256
        FROM whole w JOIN below USING (path) LEFT JOIN ends USING (path)
        LEFT JOIN whole p ON w.depth > 0 AND p.path = substr(w.path, 1, CAST(32 * (w.depth - 1) AS BIGINT))
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
