"""DuckDB's SQL for the queries of judged.py, and for the properties of notes."""

from __future__ import annotations

from ..operators import answers
from .oracles import DEFECTS, HEDGED, NORMAL, NOTES, ONE_BYTE, PRF, SQL as OTHERS, V, claims, snippet, stripped

UNSURE = f"{V}, {claims('vault', 'source_rel', 'raw')}, unsure AS (SELECT source_rel, sentence_index, claim FROM claims WHERE {HEDGED})"
DRIFT = f"""aligned AS (SELECT * FROM ({OTHERS['claim_alignment']})), plain_ AS (SELECT *, {NORMAL.format('before_claim')} AS x, {NORMAL.format('after_claim')} AS y FROM aligned),
    kept AS (SELECT *, CASE WHEN cosine < 0.5 THEN 5 WHEN cosine < 0.6 THEN 4 ELSE 3 END AS score FROM plain_ WHERE x <> y AND list_sort(string_split(x, ' ')) <> list_sort(string_split(y, ' '))
        AND (length(x) > 1000 OR length(y) > 1000 OR levenshtein({ONE_BYTE.format('x')}, {ONE_BYTE.format('y')}) >= 3))"""
NL2 = "chr(10) || chr(10)"
WITHOUT_RELATED = f"'{answers.SAYS}' || {NL2} || 'So it is.[^1]' || {NL2} || '{answers.GAPS}' || {NL2} || '- none' || {NL2} || '{answers.RELATED}' || chr(10) || "
BODY = WITHOUT_RELATED + f"chr(10) || '{answers.CITED}' || {NL2} || '[^1]: `c1`' || chr(10)"
DRAFTED = f"drafted AS (SELECT *, CASE WHEN n_nationkey % 3 > 0 THEN {BODY} ELSE 'Nothing.' END AS body FROM nation)"
#: A property block of the made vault is flat; the one that is no YAML has an open list.
YAML = f"{NOTES}, blocks AS (SELECT source_rel, body, frontmatter, contains(frontmatter, 'title: [a, b' || chr(10)) AS is_wrong FROM parsed)"

SQL: dict[str, str] = {
    "frontmatter_yaml": f"""WITH {YAML} SELECT source_rel, CASE WHEN is_wrong THEN [] ELSE list_sort(regexp_extract_all(frontmatter, '(?m)^([a-z]+):', 1)) END AS names,
        CASE WHEN NOT is_wrong THEN nullif(regexp_extract(frontmatter, '(?m)^title: (.*)$', 1), '') END AS title, is_wrong FROM blocks""",
    "ingest_counts": f"""WITH {YAML}, cut AS (SELECT unnest(list_filter(regexp_split_to_array(body, '\\n[ \\t]*\\n+'), lambda x: {stripped('x')} <> '')) AS p FROM blocks)
        SELECT count(*) AS files, count(*) FILTER (frontmatter <> '') AS with_frontmatter, count(*) FILTER (is_wrong) AS frontmatter_errors, (SELECT count(*) FROM cut) AS chunks,
            CAST((SELECT sum(len(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'))) FROM cut) AS BIGINT) AS tokens FROM blocks""",
    "contradiction_gate": """SELECT l_orderkey, l_partkey, true AS verdict, 'factual' AS type, round(l_discount * 10, 4) AS score FROM lineitem
        WHERE l_linenumber % 2 = 1 AND l_linenumber % 3 = 1 AND round(l_discount * 10, 4) BETWEEN 0.5 AND 1""",
    "pair_verdicts_mock": "SELECT event_id, false AS verdict, 'none' AS type, 0.0::DOUBLE AS score, 'no model' AS reasoning FROM events",
    "drift_gate": "SELECT event_id, true AS drift, event_id % 5 + 1 AS score FROM events WHERE event_id % 2 = 0 AND event_id % 5 >= 3",
    "drift_mock": "SELECT event_id, false AS drift, 'none' AS type, 1 AS score, 'no model' AS reasoning FROM events",
    "drift_command": f"WITH {DRIFT} SELECT conv_id AS rel_path, turn AS seq, before_index, after_index, score FROM kept WHERE score >= 4",
    "drift_counters": f"WITH {DRIFT} SELECT (SELECT count(*) FROM conversations) AS walked_commits, (SELECT count(*) FROM aligned) AS pairs_aligned, count(*) AS pairs_considered, count(*) FILTER (score >= 4) AS events FROM kept",
    "concept_mock": "SELECT DISTINCT label AS cluster_id, 'mock_concept' AS term, 0.9::DOUBLE AS confidence FROM embeddings",
    "json_verdicts": """SELECT o_orderkey, CASE WHEN good THEN CAST(o_orderkey % 7 AS INTEGER) ELSE 3 END AS level, CASE WHEN good THEN 'by number' ELSE 'abstained' END AS rationale, CASE WHEN good THEN 0.5::DOUBLE ELSE 0 END AS confidence
        FROM (SELECT o_orderkey, o_orderkey % 11 <> 0 AND o_orderkey % 7 BETWEEN 1 AND 5 AS good FROM orders)""",
    "verdict_prompts": "SELECT item_id AS query_id, 'Is <q>' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '</q> of a &lt; b {other}?' AS prompt FROM benchmark",
    "verdict_retries": "SELECT o_orderkey, o_orderkey % 3 = 2 AS abstained, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 4 END AS score, CASE WHEN o_orderkey % 3 = 2 THEN 'abstained' ELSE 'yes' END AS reasoning FROM orders",
    "gold_pair_lookup": """WITH n AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1),
        g AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1)
        SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.a = least(l_partkey, l_suppkey) AND n.b = greatest(l_partkey, l_suppkey)""",
    "greedy_assignment": """WITH RECURSIVE s AS (SELECT n_nationkey, n_name, r_name, (n_nationkey * 3 + r_regionkey * 2) % 6 AS score FROM nation CROSS JOIN region),
        o AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS place, wanted FROM (SELECT n_nationkey, n_name, list(r_name ORDER BY score DESC, r_name) AS wanted FROM s WHERE score >= 4 GROUP BY ALL)),
        walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS proposal_id, NULL::VARCHAR AS gold_id
            UNION ALL SELECT place, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END, n_name, best
            FROM (SELECT place, n_name, taken, list_filter(wanted, lambda w: NOT list_contains(taken, w))[1] AS best FROM walk JOIN o ON o.place = i + 1))
        SELECT proposal_id, gold_id FROM walk WHERE gold_id IS NOT NULL""",
    "drift_gold_match": """SELECT f.p_partkey AS event_id, g.p_partkey AS id FROM part f JOIN part g ON g.p_partkey % 5 = 0 AND f.p_brand = g.p_brand
        WHERE contains(f.p_name, substring(g.p_name, 1, 10)) AND contains(f.p_type, substring(g.p_type, 1, 10))""",
    "concept_gold_match": """WITH n AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g') AS x, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9 ]', '', 'g') AS y FROM part)
        SELECT f.p_partkey AS concept_id, g.p_partkey AS id FROM n f JOIN n g ON g.p_partkey % 7 = 0 AND f.p_brand = g.p_brand
        WHERE contains(f.x, g.y) OR contains(g.y, f.x) OR len(list_intersect(regexp_split_to_array(f.x, ' +'), regexp_split_to_array(g.y, ' +'))) >= 0.5 * len(list_distinct(regexp_split_to_array(g.y, ' +')))""",
    "claim_gold_match": """WITH e AS (SELECT event_id, user_id, event_type, event_id % 50 AS s, event_id % 50 + 20 + event_id % 7 AS e FROM events), g AS (SELECT event_id AS id, user_id, event_type, s + event_id % 13 AS s, e FROM e WHERE event_id % 10 = 0),
        m AS (SELECT event_id, id, e.event_type = g.event_type AS same, greatest(least(e.e, g.e) - greatest(e.s, g.s), 0) AS both_, (e.e - e.s) + (g.e - g.s) AS sizes FROM e JOIN g USING (user_id))
        SELECT event_id AS claim_id, id FROM m WHERE same OR (both_ > 0 AND both_ * 2 >= sizes - both_)""",
    "class_metrics": f"""WITH c AS (SELECT l_returnflag, count(*) FILTER (l_tax > 0.04 AND l_discount > 0.05) AS tp, count(*) FILTER (l_tax > 0.04 AND NOT l_discount > 0.05) AS fp, count(*) FILTER (NOT l_tax > 0.04 AND l_discount > 0.05) AS fn
        FROM lineitem GROUP BY l_returnflag) SELECT *, {PRF} FROM c""",
    "borderline_matches": "SELECT event_id, event_id % 5 + 1 AS score FROM events WHERE event_id % 5 IN (2, 3)",
    "findings_by_note": f"WITH {UNSURE} SELECT source_rel, count(*) AS findings FROM unsure GROUP BY source_rel",
    "findings_markdown": f"""WITH {UNSURE}, blocks AS (SELECT source_rel, '## ' || source_rel || ' (' || count(*) || ')' || chr(10) || string_agg('- ' || claim, chr(10) ORDER BY sentence_index) || chr(10) AS b FROM unsure GROUP BY source_rel)
        SELECT '# Unsure claims' || {NL2} || (SELECT count(*) FROM unsure) || ' findings.' || {NL2} || coalesce(string_agg(b, chr(10) ORDER BY source_rel), '') AS report FROM blocks""",
    "findings_json": f"""WITH {UNSURE} SELECT '{{"findings":[' || coalesce(string_agg('{{"claim":' || CAST(to_json(claim) AS VARCHAR) || ',"level":1,"sentence_index":' || sentence_index || ',"source_rel":' || CAST(to_json(source_rel) AS VARCHAR) || '}}', ','
        ORDER BY source_rel, sentence_index), '') || '],"schema_version":1,"threshold":2}}' AS report FROM unsure""",
    "answers_json": """SELECT '{"findings":[' || string_agg(CASE WHEN n_nationkey % 3 > 0 THEN '{"cited_sentences":1,"n_nationkey":' || n_nationkey || ',"rate":0.3333,"total_sentences":1}'
        ELSE '{"cited_sentences":0,"n_nationkey":' || n_nationkey || ',"rate":0.3333,"total_sentences":0}' END, ',' ORDER BY n_nationkey) || '],"k":8,"schema_version":1}' AS report FROM nation""",
    "query_text": f"""SELECT item_id AS query_id, string_agg('[' || r || '] ' || source || ' — ' || coalesce(lang, '') || CASE r WHEN 1 THEN ' (1.0000)' WHEN 2 THEN ' (0.5000)' ELSE ' (0.3333)' END || chr(10) || '    ' || {snippet('d.text', 240)}, chr(10) ORDER BY r) AS report
        FROM benchmark b CROSS JOIN range(1, 4) n(r) JOIN documents d ON doc_id = item_id + r GROUP BY item_id""",
    "audit_classes": f"""WITH {DEFECTS} SELECT 'broken' AS defect, source, target_raw AS target, CASE WHEN is_embed THEN 'embed' ELSE 'link' END AS detail FROM broken
        UNION ALL SELECT 'shadowed', source, target_raw, candidates FROM shadowed""",
    "fallback_drafts": f"""WITH {DRAFTED} SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN body ELSE '{answers.SAYS}' || {NL2} || 'No draft could be made.' || {NL2} || '{answers.GAPS}' || {NL2} || '- ' || n_name || {NL2}
        || '{answers.RELATED}' || {NL2} || '{answers.CITED}' || chr(10) END AS body FROM drafted""",
    "stub_render": f"""SELECT n_nationkey, '---' || chr(10) || 'title: nation-' || n_nationkey || chr(10) || 'generated_by: quillspark-answer' || chr(10) || 'generated_at: 2024-01-01T00:00:00Z' || chr(10) || 'source_gap_question: "Is ''' || n_name || ''' one?"' || chr(10)
        || 'source_cluster_id: ' || n_regionkey || chr(10) || 'generator: mock' || chr(10) || 'evidence_strength: thin' || chr(10) || 'supporting_chunks:' || chr(10) || '  - c1' || chr(10) || '---' || {NL2} || '# Nation ' || n_nationkey || {NL2}
        || '> **Gap:** Is "' || n_name || '" one?' || {NL2} || {WITHOUT_RELATED} CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '- [[' || n_name || ']]' || chr(10) || '- [[other]]' || chr(10) ELSE '' END
        || chr(10) || '{answers.CITED}' || {NL2} || '[^1]: `c1`' || chr(10) AS stub FROM nation""",
    "answers_markdown": f"WITH {DRAFTED} SELECT string_agg(rtrim(body, chr(10)), {NL2} || '---' || {NL2} ORDER BY n_nationkey) AS report FROM drafted",
    "cited_notes": """SELECT conv_id AS query_id, array_to_string(list(DISTINCT p_brand ORDER BY p_brand), ', ') AS related FROM conversations JOIN part ON p_partkey = conv_id % 50 + turn GROUP BY conv_id""",
    "stored_hits": "SELECT p_partkey, 2 AS depth, p_name || '/' || p_type AS heading_path, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS score FROM part",
    "selected_notes": f"WITH {V} SELECT source_rel FROM vault WHERE contains(lower(regexp_extract(source_rel, '[^/]*$')), 'c1') UNION ALL SELECT source_rel FROM vault WHERE regexp_extract(source_rel, '[^/]*$') = 'c2.md'",
}
