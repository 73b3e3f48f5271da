"""The registered queries in DuckDB's SQL, written apart from the Spark plans: other functions, other patterns (RE2 has no lookaround), the same rows."""

from __future__ import annotations

from ..functions import text as t
from ..operators import answers
from .vault import vault_sql

V = f"vault AS ({vault_sql()})"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
FM = r"(?s)\A---[ \t]*\n((?:.*?\n)?)---[ \t]*(?:\n|\z)(.*)\z"
NOTES = f"""{V}, parsed AS (
    SELECT source_rel, CASE WHEN regexp_matches(raw, '{FM}') THEN regexp_extract(raw, '{FM}', 1) ELSE '' END AS frontmatter,
        CASE WHEN regexp_matches(raw, '{FM}') THEN regexp_extract(raw, '{FM}', 2) ELSE raw END AS body
    FROM vault
), plain AS (SELECT source_rel, regexp_replace(regexp_replace(body, '(?ms)^```[^\\n]*\\n.*?^```[ \\t]*$', '', 'g'), '`[^`\\n]+`', '', 'g') AS body FROM parsed)"""
WIKI = r"(!?)\[\[([^\[\]|#\n]+?)(?:#([^\[\]|\n]+?))?(?:\|([^\[\]\n]+?))?\]\]"


def stripped(x: str) -> str:
    return STRIP.format(x)


FOUND_LINKS = f"""{NOTES}, raw_links AS (
    SELECT source_rel, unnest(regexp_extract_all(body, '{WIKI}', 1)) AS bang, unnest(regexp_extract_all(body, '{WIKI}', 2)) AS target,
        unnest(regexp_extract_all(body, '{WIKI}', 3)) AS heading, unnest(regexp_extract_all(body, '{WIKI}', 4)) AS alias, generate_subscripts(regexp_extract_all(body, '{WIKI}', 0), 1) AS i
    FROM plain
), found AS (
    SELECT source_rel, {stripped('target')} AS target, nullif({stripped('heading')}, '') AS heading, nullif({stripped('alias')}, '') AS alias, bang = '!' AS is_embed, min(i) AS i
    FROM raw_links GROUP BY ALL
)"""
GRAPH = f"""{FOUND_LINKS}, nodes AS (SELECT DISTINCT regexp_replace(source_rel, '\\.md$', '') AS node FROM vault),
keys AS (SELECT node, lower(node) AS key FROM nodes UNION SELECT node, lower(regexp_extract(node, '[^/]*$')) FROM nodes),
asked AS (SELECT DISTINCT regexp_replace(source_rel, '\\.md$', '') AS source, target AS target_raw, is_embed FROM found),
meant AS (
    SELECT source, target_raw, is_embed, list(node ORDER BY node) FILTER (node IS NOT NULL) AS every, list(node ORDER BY node) FILTER (node IS NOT NULL AND node <> source) AS resolved
    FROM asked LEFT JOIN keys ON key = lower(regexp_replace(replace(target_raw, chr(92), '/'), '\\.md$', '', 'i')) GROUP BY ALL
),
links AS (SELECT source, target_raw, is_embed, coalesce(resolved, []) AS resolved FROM meant WHERE len(resolved) > 0 OR every IS NULL OR len(every) = 0),
edges AS (SELECT source, unnest(resolved) AS target FROM links)"""
DEFECTS = f"""{GRAPH}, broken AS (SELECT source, target_raw, is_embed FROM links WHERE len(resolved) = 0),
one_way AS (SELECT source, target FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.source = e.target AND b.target = e.source)),
orphans AS (SELECT source AS node, count(*) AS outbound_count FROM links WHERE source NOT IN (SELECT target FROM edges) GROUP BY source),
shadowed AS (SELECT source, target_raw, array_to_string(resolved, ', ') AS candidates FROM links WHERE len(resolved) >= 2)"""

TERMS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def terms(x: str) -> str:
    return TERMS.format(x)


def ranked_bm25(k: int) -> str:
    return f"""words AS (SELECT doc_id, {terms('text')} AS w FROM documents), lengths AS (SELECT doc_id, len(w) AS length FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), facts AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lengths),
terms AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({terms('text')}) AS term FROM benchmark)),
sums AS (
    SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
    FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id), facts GROUP BY ALL
),
bm25 AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sums) WHERE rank <= {k})"""


def hashed(source: str, key: str, text: str, name: str) -> str:
    """A table (key, vector) of hashed embeddings."""
    return f"""{name}_b AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS bucket FROM (SELECT {key}, unnest({terms(text)}) AS w FROM {source})),
{name}_c AS (SELECT {key}, bucket, CAST(count(*) AS DOUBLE) AS n FROM {name}_b GROUP BY ALL),
{name}_g AS (SELECT k.{key}, d.bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN range(64) d(bucket) LEFT JOIN {name}_c c ON c.{key} = k.{key} AND c.bucket = d.bucket),
{name} AS (SELECT {key}, list(n ORDER BY bucket) AS counts, sqrt(sum(n * n)) AS norm FROM {name}_g GROUP BY {key})"""


def fused(k: int) -> str:
    return f"""{ranked_bm25(50)}, {hashed('documents', 'doc_id', 'text', 'dv')}, {hashed('benchmark', 'item_id', 'text', 'qv')},
dense AS (SELECT * FROM (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT item_id, doc_id, round(list_dot_product(list_transform(dv.counts, lambda c: CASE WHEN dv.norm > 0 THEN c / dv.norm ELSE 0 END), list_transform(qv.counts, lambda c: CASE WHEN qv.norm > 0 THEN c / qv.norm ELSE 0 END)), 6) AS score FROM dv CROSS JOIN qv
)) WHERE rank <= 50),
both_lists AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.doc_id, b.doc_id) AS doc_id, d.rank AS r1, b.rank AS r2 FROM dense d FULL JOIN bm25 b ON d.query_id = b.query_id AND d.doc_id = b.doc_id),
rrf AS (SELECT query_id, doc_id, r1, r2, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 9) AS score FROM both_lists),
fused AS (SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank FROM rrf) WHERE rank <= {k})"""


EMPTIED = "replace(s, chr(1), '')"
CLAIM_STEPS = [(r"(?s)\A[ \t]*---[ \t]*\n(?:.*?\n)?[ \t]*---[ \t]*(?:\n|\z)", "", ""), (r"(?ms)^```.*?^```", "", "g"), (r"(?m)^#{1,6}\s+.*$", "", "g"), (r"(?m)^\|.*\|$", "", "g"), (r"!?\[\[[^\n]*?\]\]", "", "g"), (r"\[([^\]]*)\]\([^)]*\)", r"\1", "g"), (r"`[^`]+`", "", "g"), (r"\n{3,}", r"' || chr(10) || chr(10) || '", "g")]


def claims(source: str, keys: str, text: str) -> str:
    """Tables prose, split and claims (keys, sentence_index from 0, claim, all)."""
    prose = text
    for pattern, put, how in CLAIM_STEPS:
        prose = f"regexp_replace({prose}, '{pattern}', '{put}', '{how}')" if how else f"regexp_replace({prose}, '{pattern}', '{put}')"
    prose = stripped(prose)
    line = f"regexp_replace(regexp_replace({prose}, '[ \\t]+', ' ', 'g'), '\\n+', ' ', 'g')"
    held = f"regexp_replace({line}, '{t.ABBREVIATED}', '\\1\\2\\3' || chr(1), 'g')"
    parts = f"string_split(regexp_replace({held}, '([.?!])\\s+([A-Z\"])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    clean = f"list_filter(list_transform({parts}, lambda s: {stripped(EMPTIED)}), lambda s: length(s) > 10)"
    return f"""split AS (SELECT {keys}, CASE WHEN strlen({text}) > 1000000 THEN [] ELSE {clean} END AS every FROM {source}),
claims AS (SELECT {keys}, every, CAST(unnest(range(len(every))) AS INTEGER) AS sentence_index, unnest(every) AS claim FROM split)"""


HEDGED = "(" + " OR ".join("contains(lower(claim), '" + h.replace("'", "''") + "')" for h in t.HEDGES) + ")"
NORMAL = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
#: DuckDB's levenshtein counts bytes: letters of two become signs, which normalised texts do not hold.
ACCENTED = "àâäáãçéèêëíìîïñóòôöõúùûüßœæ"
ONE_BYTE = "translate({0}, '" + ACCENTED + "', '" + "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "_'{}")[: len(ACCENTED)] + "')"
LINE = "replace(" + STRIP + ", chr(10), ' ')"


def snippet(x: str, width: int) -> str:
    line = LINE.format(x)
    return f"CASE WHEN length({line}) > {width} THEN substring({line}, 1, {width}) || '...' ELSE {line} END"


def content_words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in t.STOPWORDS)
    line = f"regexp_replace(regexp_replace({stripped(f'lower({x})')}, '\\s+', ' ', 'g'), '[?.,]', '', 'g')"
    return f"list_filter(list_distinct(regexp_split_to_array({line}, '\\s+')), lambda w: length(w) >= 3 AND w NOT IN ({stop}))"


PRF = """round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""
JUDGED = "judged AS (SELECT l.*, source, CAST(NOT regexp_matches(text, '[|%]') AS INTEGER) AS guess FROM labels l JOIN documents USING (doc_id))"
CENTRES = """parts AS (SELECT label AS cluster_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings), means AS (SELECT cluster_id, i, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY ALL),
centres AS (SELECT cluster_id, list(round(x, 9) ORDER BY i) AS centre FROM means GROUP BY cluster_id),
far AS (SELECT vec_id, cluster_id, round(list_sum(list_transform(list_zip(centre, embedding), lambda p: (p[1] - CAST(p[2] AS DOUBLE)) * (p[1] - CAST(p[2] AS DOUBLE)))), 9) AS d FROM embeddings CROSS JOIN centres),
assigned AS (SELECT vec_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS r FROM far) WHERE r = 1)"""
COSINE = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
NEAR = """near AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)"""
DRAFTS = f"""lines AS (
    SELECT conv_id, turn, regexp_replace({stripped('text')}, '^(##\\s)', ' \\1', 'gm') || CASE WHEN turn % 2 = 0 THEN '[^' || turn || ']' ELSE '' END AS line FROM conversations
), sentences AS (
    SELECT conv_id, turn, unnest(string_split(line, chr(10))) AS line FROM lines
), judged_drafts AS (
    SELECT conv_id, CAST(count(*) FILTER ({stripped('line')} <> '' AND NOT starts_with({stripped('line')}, '[^')) AS INTEGER) AS total_sentences,
        CAST(count(*) FILTER ({stripped('line')} <> '' AND NOT starts_with({stripped('line')}, '[^') AND regexp_matches(line, '\\[\\^[0-9]+\\]')) AS INTEGER) AS cited_sentences, bool_or(turn % 2 = 0) AS has_notes,
        coalesce(array_to_string(list(DISTINCT turn ORDER BY turn) FILTER (turn % 4 = 2), ','), '') AS orphan_footnotes,
        coalesce(array_to_string(list(DISTINCT 'c' || turn ORDER BY 'c' || turn) FILTER (turn % 4 = 0 AND turn NOT IN (0, 8)), ','), '') AS invalid_refs
    FROM sentences GROUP BY conv_id
), attributed AS (
    SELECT conv_id, CASE WHEN has_notes THEN total_sentences ELSE 0 END AS total_sentences, CASE WHEN has_notes THEN cited_sentences ELSE 0 END AS cited_sentences,
        CASE WHEN has_notes AND total_sentences > 0 THEN round(cited_sentences / total_sentences, 4) ELSE 1.0::DOUBLE END AS attribution_rate, orphan_footnotes, invalid_refs FROM judged_drafts
)"""
DOC_NOTES = "SELECT 'docs/' || doc_id || '.md' AS source_rel, unnest(range(len(p))) AS chunk_index, unnest(p) AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n[ \\t]*\\n+'), lambda x: " + stripped("x") + " <> '') AS p FROM documents)"
HEADING = r"(?m)^(#{1,3})[ \t]+([^\n]+?)[ \t]*#*[ \t]*$"
NODE_COUNT = "(SELECT count(*) FROM nodes)"


def audit_part(title: str, source: str, line: str, order: str) -> str:
    return f"""(SELECT '## {title} (' || count(*) || ')' || chr(10) || CASE WHEN count(*) = 0 THEN '_none found._' ELSE string_agg({line}, chr(10) ORDER BY {order}) END || chr(10) FROM {source})"""


SQL: dict[str, str] = {
    "bm25_topk": f"WITH {ranked_bm25(10)} SELECT * FROM bm25",
    "bm25_index": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY term",
    "dense_topk": """SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 10""",
    "hybrid_rrf": f"WITH {fused(10)} SELECT * FROM fused",
    "rerank_topk": f"""WITH {fused(20)}, scored AS (
        SELECT query_id, doc_id, f.rank AS before, round(len(list_intersect(list_distinct({terms('q.text')}), {terms('d.text')})) / greatest(len(list_distinct({terms('q.text')})), 1), 6) AS score
        FROM fused f JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = query_id
    ) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM scored) WHERE rank <= 5""",
    "evidence_union": f"""WITH {ranked_bm25(5)}, hints AS (SELECT item_id AS query_id, item_id + place AS doc_id, place FROM benchmark CROSS JOIN range(3) r(place)),
        every AS (SELECT query_id, doc_id, 0 AS part, rank AS place, score FROM bm25 UNION ALL
            SELECT query_id, doc_id, 1, place, 0 FROM hints h WHERE doc_id IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM bm25 b WHERE b.query_id = h.query_id AND b.doc_id = h.doc_id))
        SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS rank FROM every) WHERE rank <= 7""",
    "wikilink_extract": f"WITH {FOUND_LINKS} SELECT source_rel, CAST(row_number() OVER (PARTITION BY source_rel ORDER BY i) - 1 AS INTEGER) AS place, target, heading, alias, is_embed FROM found",
    "tag_extract": f"WITH {NOTES} SELECT DISTINCT source_rel, unnest(regexp_extract_all(body, '(?:^|[^0-9A-Za-z_/])#([A-Za-z_][\\p{{L}}\\p{{M}}\\p{{N}}_\\-/]*)', 1)) AS tag FROM plain",
    "md_link_extract": f"""WITH {NOTES} SELECT DISTINCT source_rel, unnest(regexp_extract_all(body, '(?:^|[^!])\\[([^\\[\\]\\n]+)\\]\\(([^\\s)]+(?:\\s+"[^"]*")?)\\)', 1)) AS text,
        unnest(regexp_extract_all(body, '(?:^|[^!])\\[([^\\[\\]\\n]+)\\]\\(([^\\s)]+(?:\\s+"[^"]*")?)\\)', 2)) AS url FROM plain""",
    "frontmatter_split": f"WITH {NOTES} SELECT source_rel, frontmatter, body FROM parsed",
    "sections": f"""WITH {NOTES}, parts AS (SELECT source_rel, string_split(regexp_replace(body, '{HEADING}', chr(1) || '\\1' || chr(2) || '\\2' || chr(2) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM parsed),
        rows_ AS (SELECT source_rel, unnest(range(len(p))) AS i, string_split(unnest(p), chr(2)) AS f FROM parts),
        cut AS (SELECT source_rel, i, CASE WHEN i > 0 THEN length(f[1]) END AS level, f[2] AS title, CASE WHEN i > 0 THEN length(f[3]) ELSE 0 END AS line, CASE WHEN i > 0 THEN f[4] ELSE f[1] END AS rest FROM rows_),
        placed AS (SELECT *, coalesce(sum(line + length(rest)) OVER (PARTITION BY source_rel ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + line + CASE WHEN i > 0 AND starts_with(rest, chr(10)) THEN 1 ELSE 0 END AS char_start,
            CASE WHEN i > 0 AND starts_with(rest, chr(10)) THEN substring(rest, 2) ELSE rest END AS section FROM cut),
        opened AS (SELECT a.source_rel, a.i, coalesce(string_agg({stripped('b.title')}, ' > ' ORDER BY b.i), '') AS heading_path FROM placed a JOIN placed b ON a.source_rel = b.source_rel AND b.i <= a.i AND b.level IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM placed c WHERE c.source_rel = a.source_rel AND c.i > b.i AND c.i <= a.i AND c.level <= b.level) GROUP BY ALL)
        SELECT source_rel, CAST(row_number() OVER (PARTITION BY source_rel ORDER BY i) - 1 AS INTEGER) AS section_index, coalesce(heading_path, '') AS heading_path, section, CAST(char_start AS INTEGER) AS char_start
        FROM placed LEFT JOIN opened USING (source_rel, i) WHERE {stripped('section')} <> ''""",
    "paragraphs": f"""WITH {NOTES}, cut AS (SELECT source_rel, list_filter(regexp_split_to_array(body, '\\n[ \\t]*\\n+'), lambda x: {stripped('x')} <> '') AS p FROM parsed)
        SELECT source_rel, CAST(unnest(range(len(p))) AS INTEGER) AS place, unnest(p) AS paragraph FROM cut""",
    "sentences": f"""WITH cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: {stripped('x')} <> '') AS s FROM documents)
        SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS place, unnest(s) AS sentence FROM cut""",
    "token_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) AS INTEGER) AS tokens FROM documents",
    "chunk_ids": f"""SELECT source_rel, CAST(chunk_index AS INTEGER) AS chunk_index, substr(sha256(source_rel || '::' || chunk_index), 1, 32) AS chunk_id, substr(sha256(text), 1, 32) AS content_hash FROM ({DOC_NOTES})""",
    "link_targets": f"""WITH {FOUND_LINKS}, targets AS (SELECT DISTINCT target FROM found), cut AS (
        SELECT target, lower(regexp_replace(replace(target, chr(92), '/'), '\\.md$', '', 'i')) AS key, lower(regexp_replace(regexp_replace(target, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM targets
    ) SELECT target, key, CASE WHEN target NOT IN ('', '.', '..') AND NOT regexp_matches(target, '[\\\\/:]') AND slug <> '' THEN slug END AS file_name, regexp_full_match(target, '[a-z0-9]+(?:-[a-z0-9]+)*') AS is_kebab FROM cut""",
    "snippets": f"SELECT doc_id, replace(replace({snippet('text', 240)}, '<', '&lt;'), '>', '&gt;') AS snippet FROM documents",
    "broken_links": f"WITH {DEFECTS} SELECT * FROM broken",
    "one_way_links": f"WITH {DEFECTS} SELECT * FROM one_way",
    "orphan_notes": f"WITH {DEFECTS} SELECT * FROM orphans",
    "shadowed_links": f"WITH {DEFECTS} SELECT * FROM shadowed",
    "link_degree": f"""WITH {GRAPH} SELECT node, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound, coalesce(i.f, '') AS inbound_from FROM nodes
        LEFT JOIN (SELECT source, count(*) AS n FROM links GROUP BY source) o ON o.source = node
        LEFT JOIN (SELECT target, count(DISTINCT source) AS n, array_to_string(list(DISTINCT source ORDER BY source), ', ') AS f FROM edges GROUP BY target) i ON i.target = node""",
    "page_links": """SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS target FROM pages) GROUP BY target""",
    "audit_totals": f"""WITH {DEFECTS} SELECT 'broken' AS defect, count(*) AS findings FROM broken HAVING count(*) > 0 UNION ALL SELECT 'one-way', count(*) FROM one_way HAVING count(*) > 0
        UNION ALL SELECT 'orphan', count(*) FROM orphans HAVING count(*) > 0 UNION ALL SELECT 'shadowed', count(*) FROM shadowed HAVING count(*) > 0""",
    "audit_markdown": f"""WITH {DEFECTS} SELECT '# Link audit — vault' || chr(10) || chr(10) || 'Scanned ' || {NODE_COUNT} || ' notes. ' ||
        ((SELECT count(*) FROM broken) + (SELECT count(*) FROM one_way) + (SELECT count(*) FROM orphans) + (SELECT count(*) FROM shadowed)) || ' findings.' || chr(10) || chr(10) ||
        {audit_part('Broken links', 'broken', "'- `' || source || '` → `' || target_raw || '`' || CASE WHEN is_embed THEN ' ![[...]]' ELSE ' [[...]]' END", 'source, target_raw, is_embed DESC')} || chr(10) ||
        {audit_part('One-way links', 'one_way', "'- `' || source || '` → `' || target || '` (no backlink)'", 'source, target')} || chr(10) ||
        {audit_part('Orphan notes', 'orphans', "'- `' || node || '` (' || outbound_count || ' outbound, 0 inbound)'", 'node')} || chr(10) ||
        {audit_part('Shadowed links', 'shadowed', "'- `' || source || '` → `' || target_raw || '` (candidates: `' || replace(candidates, ', ', '`, `') || '`)'", 'source, target_raw')} AS report""",
    "similar_pairs": f"""WITH {NEAR}, pairs AS (SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, arg_min(score, query_id) AS retrieval_score FROM near WHERE query_id <> vec_id GROUP BY ALL)
        SELECT a, b, retrieval_score FROM pairs JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE a // 4 <> b // 4 AND {COSINE.format('x.embedding', 'y.embedding')} <= 0.95""",
    "near_duplicate_pairs": """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        every AS (SELECT vec_id, v FROM x UNION ALL SELECT -1 - vec_id, list_transform(v, lambda e, i: e * (CASE WHEN i % 2 = 1 THEN 0.9 ELSE 1.1 END)) FROM x),
        unit AS (SELECT vec_id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM every)
        SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM unit a JOIN unit b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) > 0.95""",
    "cluster_assign": f"WITH {CENTRES} SELECT * FROM assigned",
    "cluster_sizes": f"WITH {CENTRES} SELECT cluster_id, count(*) AS size, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM assigned GROUP BY cluster_id HAVING count(*) >= 3 ORDER BY size DESC, cluster_id LIMIT 30",
    "gap_mock": """WITH sizes AS (SELECT label AS cluster_id, count(*) AS cluster_size, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY label HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 30)
        SELECT cluster_id, cluster_size, 'mock-gap-' || row_number() OVER (ORDER BY cluster_size DESC, cluster_id) AS suggested_note_title, 'Which wider subject holds these notes together?' AS gap_question, array_to_string(members[1:3], ',') AS supporting_chunk_ids FROM sizes""",
    "valid_support": "SELECT label AS cluster_id, 1 AS proposal, array_to_string(list(vec_id ORDER BY vec_id), ',') AS ids FROM embeddings WHERE vec_id BETWEEN 0 AND 49 GROUP BY label",
    "absence_filter": f"""WITH words AS (SELECT DISTINCT source, unnest({terms('text')}) AS term FROM documents), best AS (SELECT source AS cluster_id, term FROM words QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(term) DESC, term) = 1),
        share AS (SELECT term, round(avg(CAST(contains(lower(text), term) AS INTEGER)), 6) AS term_freq FROM (SELECT DISTINCT term FROM best) CROSS JOIN documents GROUP BY term)
        SELECT cluster_id, term, round(length(term) / 100, 4) AS confidence, term_freq FROM best JOIN share USING (term) WHERE term_freq < 0.2 ORDER BY confidence DESC, cluster_id LIMIT 10""",
    "concept_evidence": "SELECT label AS cluster_id, array_to_string(list(DISTINCT vec_id // 40 ORDER BY vec_id // 40), ',') AS notes, array_to_string(list(vec_id ORDER BY vec_id), ',') AS chunk_ids FROM embeddings GROUP BY label",
    "claim_extract": f"WITH {claims('documents', 'doc_id', 'text')} SELECT doc_id, sentence_index, claim FROM claims",
    "claim_context": f"WITH {claims('conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, sentence_index, claim, array_to_string(every[greatest(sentence_index - 1, 1):sentence_index + 3], ' ') AS context FROM claims",
    "vault_claims": f"WITH {V}, {claims('vault', 'source_rel', 'raw')} SELECT source_rel, sentence_index, claim FROM claims",
    "confidence_mock": f"WITH {V}, {claims('vault', 'source_rel', 'raw')} SELECT source_rel, sentence_index, claim, 1 AS level, 0.9::DOUBLE AS confidence, 'speculation' AS label FROM claims WHERE {HEDGED}",
    "confidence_counts": f"WITH {V}, {claims('vault', 'source_rel', 'raw')} SELECT count(*) AS claims, count(*) FILTER ({HEDGED}) AS findings, CAST(0 AS BIGINT) AS abstentions FROM claims",
    "claim_alignment": f"""WITH {claims('conversations', 'conv_id, turn', 'text')}, numbered AS (SELECT *, row_number() OVER () AS id FROM claims), {hashed('numbered', 'id', 'claim', 'cv')},
        full_ AS (SELECT n.*, cv.counts, cv.norm FROM numbered n LEFT JOIN cv USING (id)),
        unit AS (SELECT *, list_transform(counts, lambda c: CASE WHEN norm > 0 THEN c / norm ELSE 0 END) AS v FROM full_),
        met AS (SELECT a.conv_id, a.turn, a.sentence_index AS before_index, a.claim AS before_claim, b.sentence_index AS after_index, b.claim AS after_claim,
            round(CASE WHEN coalesce(a.norm, 0) > 0 AND coalesce(b.norm, 0) > 0 THEN {COSINE.format('a.v', 'b.v')} ELSE 0 END, 6) AS cosine FROM unit a JOIN unit b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
        SELECT * FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY conv_id, turn, before_index ORDER BY cosine DESC, after_index) = 1) WHERE cosine >= 0.3 AND cosine < 0.98""",
    "revision_pairs": """WITH seq AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, props FROM events)
        SELECT a.user_id, a.seq, a.props AS before, b.props AS after, b.seq AS after_seq FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.seq = a.seq + 1""",
    "noise_filters": f"""WITH b AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS next FROM benchmark),
        rows_ AS (SELECT item_id, text, unnest([0, 1, 2, 3]) AS variant, unnest([translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!?', array_to_string(list_reverse(string_split(text, ' ')), ' '), text || 'x', next]) AS other FROM b),
        n AS (SELECT item_id, variant, {NORMAL.format('text')} AS x, {NORMAL.format('other')} AS y FROM rows_ WHERE other IS NOT NULL),
        d AS (SELECT *, CAST(CASE WHEN length(x) > 1000 OR length(y) > 1000 THEN 1000 ELSE levenshtein({ONE_BYTE.format('x')}, {ONE_BYTE.format('y')}) END AS INTEGER) AS distance FROM n)
        SELECT item_id, variant, distance, x = y OR list_sort(string_split(x, ' ')) = list_sort(string_split(y, ' ')) OR distance < 3 AS is_noise FROM d""",
    "part_name_distance": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance, CAST(CASE WHEN length(p_name) * 200 > 1000 THEN 1000 ELSE levenshtein(repeat(p_name, 200), p_type) END AS INTEGER) AS guarded FROM part",
    "draft_mock": f"""WITH {ranked_bm25(1)}, picked AS (SELECT item_id AS query_id, q.text AS query, d.doc_id, substring({LINE.format('d.text')}, 1, 80) AS line FROM benchmark q LEFT JOIN bm25 ON query_id = item_id LEFT JOIN documents d USING (doc_id))
        SELECT query_id, '{answers.SAYS}' || chr(10) || chr(10) || 'The vault notes that ' || line || '[^1]' || chr(10) || chr(10) || '{answers.GAPS}' || chr(10) || chr(10) || '- mock-gap: open in part: ' || query || chr(10) || chr(10)
            || '{answers.RELATED}' || chr(10) || chr(10) || '{answers.CITED}' || chr(10) || chr(10) || '[^1]: `' || doc_id || '` — "' || substring(line, 1, 60) || '..."' || chr(10) AS body FROM picked""",
    "attribution": f"WITH {DRAFTS} SELECT * FROM attributed",
    "answer_strength": f"""WITH {DRAFTS}, graded AS (SELECT CASE WHEN total_sentences < 2 THEN 'e' WHEN orphan_footnotes <> '' OR invalid_refs <> '' OR attribution_rate < 0.5 THEN 't' ELSE 's' END AS g FROM attributed)
        SELECT count(*) AS drafts, count(*) FILTER (g = 's') AS strong, count(*) FILTER (g = 't') AS thin, count(*) FILTER (g = 'e') AS external_research FROM graded""",
    "prf_metrics": f"""WITH {JUDGED}, c AS (SELECT source, count(*) FILTER (guess = 0 AND quality = 0) AS tp, count(*) FILTER (guess = 0 AND quality = 1) AS fp, count(*) FILTER (guess = 1 AND quality = 0) AS fn FROM judged GROUP BY source) SELECT *, {PRF} FROM c""",
    "confusion_matrix": f"WITH {JUDGED} SELECT quality, count(*) FILTER (guess = 0) AS predicted_0, count(*) FILTER (guess = 1) AS predicted_1 FROM judged GROUP BY quality",
    "qwk": """WITH r AS (SELECT CAST(floor(((value % 5) + 5) % 5) + 1 AS INTEGER) AS g, CAST(floor((((value + event_id % 3 * 0.5) % 5) + 5) % 5) + 1 AS INTEGER) AS p FROM events WHERE value IS NOT NULL),
        c AS (SELECT g, p, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT g, sum(n) AS n FROM c GROUP BY g), b AS (SELECT p, sum(n) AS n FROM c GROUP BY p)
        SELECT round(1 - (SELECT sum(n * (g - p) * (g - p)) FROM c) * (SELECT sum(n) FROM c) / (SELECT sum(a.n * b.n * (g - p) * (g - p)) FROM a CROSS JOIN b), 6) AS kappa""",
    "gold_sets": f"""WITH {DEFECTS}, found_ AS (SELECT DISTINCT source, target_raw FROM broken), gold AS (SELECT 'customers/c' || c_custkey AS source, 'missing-' || c_custkey % 13 AS target_raw FROM customer WHERE c_custkey % 7 = 0),
        c AS (SELECT (SELECT count(*) FROM (SELECT * FROM found_ INTERSECT SELECT * FROM gold)) AS tp, (SELECT count(*) FROM (SELECT * FROM found_ EXCEPT SELECT * FROM gold)) AS fp, (SELECT count(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM found_)) AS fn)
        SELECT *, {PRF} FROM c""",
    "hit_at_k": f"""WITH {ranked_bm25(10)}, starts AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS start FROM benchmark),
        expected AS (SELECT query_id, list(DISTINCT doc_id) AS titles FROM starts JOIN documents ON contains(text, start) GROUP BY query_id),
        hits AS (SELECT e.query_id, CASE WHEN len(titles) = 1 THEN 'easy' ELSE 'hard' END AS difficulty, len(list_intersect(titles, coalesce(f.found, []))) AS n, len(titles) AS m FROM expected e LEFT JOIN (SELECT query_id, list(doc_id) AS found FROM bm25 GROUP BY query_id) f USING (query_id))
        SELECT difficulty, count(*) AS queries, round(avg(CAST(n > 0 AS INTEGER)), 6) AS hit_rate, round(avg(round(n / m, 6)), 6) AS recall FROM hits GROUP BY difficulty""",
    "latency_percentile": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, min(value) FILTER (i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, min(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95, round(median(value), 6) AS median, round(avg(value), 6) AS mean, count(*) AS n FROM o GROUP BY event_type""",
    "axis_report": """WITH r AS (SELECT l_linenumber = 7 AS skipped, (l_orderkey + l_linenumber) % 3 + 3 AS faith, (l_orderkey * 2 + l_linenumber) % 3 + 3 AS coverage, (l_orderkey * 3 + l_linenumber) % 3 + 3 AS structure FROM lineitem)
        SELECT round(avg(CAST(faith >= 4 AND coverage >= 4 AND structure >= 4 AS INTEGER)) FILTER (NOT skipped), 6) AS pass_rate, round(avg(faith) FILTER (NOT skipped), 6) AS mean_faith, round(avg(coverage) FILTER (NOT skipped), 6) AS mean_coverage,
            round(avg(structure) FILTER (NOT skipped), 6) AS mean_structure, round(avg(CAST(skipped AS INTEGER)), 6) AS skip_rate FROM r""",
    "stage_recall": f"WITH {ranked_bm25(10)}, c AS (SELECT count(*) AS gold, count(*) FILTER (doc_id IN (SELECT doc_id FROM bm25)) AS hit FROM labels) SELECT gold, hit, CASE WHEN gold = 0 THEN 1 ELSE round(hit / gold, 6) END AS recall FROM c",
    "span_overlap": """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS before FROM events),
        g AS (SELECT event_id, greatest(86400 - (at_ - before), 0) AS inter FROM e WHERE before IS NOT NULL) SELECT event_id, round(inter / (172800 - inter), 6) AS jaccard FROM g""",
    "upsert_merge": """SELECT * FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'NEW ' || c_mktsegment FROM customer WHERE c_custkey % 3 = 0""",
    "sanitise_scan": """WITH l AS (SELECT doc_id, unnest(range(len(s))) + 1 AS line, unnest(s) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
        p AS (SELECT * FROM (VALUES ('mail', '[a-z0-9.]+@[a-z0-9.]+\\.[a-z]+'), ('address', '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b'), ('key', '(?:api[_-]?key|secret|token)[=: ]')) v(reason, pattern))
        SELECT doc_id, CAST(line AS INTEGER) AS line, reason, substring(content, 1, 120) AS excerpt FROM l JOIN p ON regexp_matches(content, pattern, 'i')""",
}
