"""DuckDB SQL for the queries of this subpackage that SQL can express, written without their methods."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op10_line_dedup"] = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text IS NULL AS missing FROM documents
), numbered AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), full_lines AS (
    SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM numbered
), windows AS (
    SELECT doc_id, pos AS first, lead(pos, 2) OVER w AS last,
           line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
    FROM full_lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, first, last FROM windows WHERE last IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) > 1
), gone AS (
    SELECT DISTINCT n.doc_id, n.pos FROM numbered n JOIN later l ON n.doc_id = l.doc_id AND n.pos BETWEEN l.first AND l.last
), kept AS (
    SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text, count(*) AS n
    FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
)
SELECT s.doc_id, CASE WHEN s.missing THEN 0 ELSE len(s.lines) END AS n_lines,
       len(s.lines) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

# Every window that starts where a shared shingle puts an item's start, compared in full.
ORACLE["op3_decontamination"] = r"""
WITH item_words AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), doc_words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), item_at AS (
    SELECT item_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM item_words WHERE len(w) > 0
), doc_at AS (
    SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM doc_words WHERE len(w) > 0
), item_shingles AS (SELECT item_id, w, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM item_at
), doc_shingles AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM doc_at
), weights AS (
    SELECT s, least(16, 1 + floor(log2((SELECT count(DISTINCT w) FROM item_words WHERE len(w) > 0) / count(DISTINCT w)) + 1e-9)) AS weight
    FROM item_shingles GROUP BY s
), most AS (SELECT least(16, 1 + floor(log2(greatest(count(DISTINCT w), 1)) + 1e-9)) AS weight FROM item_words WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT d.doc_id, i.item_id, d.p - i.p AS start, greatest(len(i.w) - 4, 1) AS size
    FROM doc_shingles d JOIN item_shingles i USING (s)
), of_window AS (
    SELECT v.doc_id, v.item_id, v.start, d.s, count(*) * any_value(coalesce(x.weight, m.weight)) AS weight
    FROM windows v JOIN doc_shingles d ON d.doc_id = v.doc_id AND d.p >= v.start AND d.p < v.start + v.size
    CROSS JOIN most m LEFT JOIN weights x ON x.s = d.s GROUP BY ALL
), of_item AS (
    SELECT i.item_id, i.s, count(*) * any_value(x.weight) AS weight FROM item_shingles i JOIN weights x USING (s) GROUP BY ALL
), whole_items AS (SELECT item_id, sum(weight) AS weight FROM of_item GROUP BY ALL
), scored AS (
    SELECT o.doc_id, o.item_id, o.start, sum(least(o.weight, coalesce(i.weight, 0))) AS shared, sum(o.weight) AS own
    FROM of_window o LEFT JOIN of_item i ON i.item_id = o.item_id AND i.s = o.s GROUP BY ALL
), alike AS (
    SELECT doc_id, item_id, max(shared / (own + t.weight - shared)) AS similarity
    FROM scored JOIN whole_items t USING (item_id) GROUP BY ALL HAVING similarity >= 0.8 - 1e-12
)
SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, round(max(similarity), 6) AS similarity
FROM alike GROUP BY doc_id
"""

# All pairs that share a shingle, compared in full; labels spread until nothing changes.
ORACLE["op7_minhash"] = r"""
WITH RECURSIVE doc_words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - 3, 1)), lambda p: array_to_string(w[p + 1 : p + 4], ' ')))) AS s
    FROM doc_words WHERE len(w) > 0
), classes AS (SELECT min(doc_id) AS node, s FROM sets GROUP BY s
), members AS (SELECT x.doc_id, c.node FROM sets x JOIN classes c USING (s)
), spread AS (SELECT node, len(s) AS n, unnest(s) AS x FROM classes
), shared AS (
    SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
    FROM spread a JOIN spread b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node
), links AS (SELECT a, b FROM shared WHERE 100 * n >= 80 * (na + nb - n)
), two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT node, node AS other FROM classes
    UNION
    SELECT r.node, b.b FROM reached r JOIN two_way b ON b.a = r.other
), labels AS (SELECT node, min(other) AS component FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(len(s.s), 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id
LEFT JOIN members m ON m.doc_id = d.doc_id LEFT JOIN labels l ON l.node = m.node
"""

# The checksum bit by bit; costs and audits from the last row to the first, all texts of equal cost compared.
ORACLE["op13_conversations"] = r"""
WITH RECURSIVE source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), keyed AS (
    SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
        lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 20 AS fault FROM source
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM keyed
), ordered AS (
    SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS kind
    FROM damaged
), marked AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
           lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM ordered
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM marked GROUP BY conv_id
), back AS (
    SELECT conv_id, n AS pos, {'c': 0, 'a': ''} AS s, {'c': 4, 'a': 'II'} AS y, {'c': 2, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS a FROM counted
    UNION ALL
    SELECT conv_id, pos - 1,
        least(fs, {'c': least(fu, ia).c + 2, 'a': 'I' || least(fu, ia).a}), least(fy, {'c': least(fu, ia).c + 2, 'a': 'I' || least(fu, ia).a}),
        least(fu, ia), least(fa, iu)
    FROM (
        SELECT *, {'c': fa.c + 2, 'a': 'I' || fa.a} AS ia, {'c': fu.c + 2, 'a': 'I' || fu.a} AS iu FROM (
            SELECT b.conv_id, b.pos,
                list_min([{'c': s.c + 3, 'a': 'D' || s.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + cut, 'a': 'R' || u.a}] END
                    || CASE WHEN gone THEN [] WHEN kind = 's' THEN [{'c': y.c + cut, 'a': 'K' || y.a}] WHEN kind = 'u' THEN [{'c': u.c + cut, 'a': 'K' || u.a}] ELSE [] END) AS fs,
                list_min([{'c': y.c + 3, 'a': 'D' || y.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + cut, 'a': 'R' || u.a}] END
                    || CASE WHEN gone THEN [] WHEN kind = 'u' THEN [{'c': u.c + cut, 'a': 'K' || u.a}] ELSE [] END) AS fy,
                list_min([{'c': u.c + 3, 'a': 'D' || u.a}] || CASE WHEN gone THEN [] ELSE [{'c': a.c + 2 + cut, 'a': 'R' || a.a}] END
                    || CASE WHEN gone THEN [] WHEN kind = 'a' THEN [{'c': a.c + cut, 'a': 'K' || a.a}] ELSE [] END) AS fu,
                list_min([{'c': a.c + 3, 'a': 'D' || a.a}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + cut, 'a': 'R' || u.a}] END
                    || CASE WHEN gone THEN [] WHEN kind = 'u' THEN [{'c': u.c + cut, 'a': 'K' || u.a}] ELSE [] END) AS fa
            FROM back b JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS cut FROM marked) m
            ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = b.pos
        )
    )
), audits AS (SELECT conv_id, s.c AS cost, s.a AS audit FROM back WHERE pos = 0
), edits AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS step FROM audits WHERE audit <> ''
), numbered AS (
    SELECT *, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS place
    FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY step)
), placed AS (
    SELECT e.conv_id, e.edit, e.place, m.role, m.text FROM numbered e LEFT JOIN marked m ON e.edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.pos = e.pos
    WHERE e.edit <> 'D'
), starts AS (SELECT conv_id, max(place) FILTER (edit = 'K' AND role[1] = 's' AND place = 1) AS system FROM placed GROUP BY conv_id
), final AS (
    SELECT p.conv_id, string_agg((CASE WHEN p.edit = 'K' THEN p.role WHEN (p.place - coalesce(s.system, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END)
               || ':' || coalesce(p.text, ''), chr(10) ORDER BY p.place) AS repaired
    FROM placed p JOIN starts s ON s.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY p.conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost,
       coalesce(a.audit, '') AS audit, sha256(coalesce(f.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM source) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
"""

# Every document that shares a term with an item, scored in full.
ORACLE["op11_lexical_search"] = r"""
WITH doc_terms AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (SELECT item_id, term, count(*) AS repeats FROM item_terms GROUP BY ALL
), totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS all_terms FROM doc_terms
), postings AS (
    SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM doc_terms)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, totals GROUP BY term
), impacts AS (
    SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // all_terms))) AS impact
    FROM postings JOIN weights USING (term), totals
), scored AS (
    SELECT item_id, row, doc_id, sum(repeats * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
