"""DuckDB SQL for the queries of the catalog, written from their definitions and not from their plans."""

from __future__ import annotations

_W = r"[\p{L}\p{N}_]+"
_TERM = r"[\p{L}\p{N}]+"
_CAPS = r"\b[A-Z][A-Z0-9_]{2,}\b"

_DOCS = """docs AS (
  SELECT doc_id, text, lang, source, n_chars, source || '/doc-' || doc_id || '.md' AS path,
    'document:' || substr(sha1('document:' || lower(source || '/doc-' || doc_id || '.md')), 1, 20) AS id FROM documents
)"""
_TIERS = (
    _DOCS
    + """, tiers AS (
  SELECT d.doc_id, d.path, d.source, d.lang, d.n_chars,
    CASE WHEN l.toxic = 1 THEN 'untrusted' WHEN l.quality = 1 THEN 'validated' WHEN l.quality = 0 THEN 'generated' ELSE 'authored' END AS tier,
    CASE d.lang WHEN 'fr' THEN 'deprecated' WHEN 'de' THEN 'draft' ELSE 'active' END AS status
  FROM docs d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
)"""
)
_ADJUST = """(CASE tier WHEN 'validated' THEN 8 WHEN 'authored' THEN 5 WHEN 'generated' THEN -5 WHEN 'external' THEN -10 WHEN 'untrusted' THEN -30 ELSE 0 END
  + CASE status WHEN 'deprecated' THEN -20 WHEN 'superseded' THEN -20 WHEN 'draft' THEN -8 WHEN 'archived' THEN -8 ELSE 0 END)"""
_STAR = """star AS (
  SELECT DISTINCT * FROM (
    SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'CONTAINS' AS kind, 5.0 AS weight, 1.0 AS confidence FROM nation
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'DEFINES', 10.0, 0.85 FROM supplier
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'DEPENDS_ON', 9.0, 1.0 FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'DEPENDS_ON', 9.0, 1.0 FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'REFERENCES', 4.0, 0.6 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'LINKS_TO', 7.0, 0.9 FROM lineitem
    UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'IMPLEMENTS', 8.0, 1.0 FROM lineitem)
)"""
_PAGES = r"""page AS (
  SELECT page_id, html, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS lang,
    trim(regexp_replace(regexp_extract(html, '<h[1-4][^>]*>([^<]*)<', 1), '\s+', ' ', 'g')) AS h1 FROM pages
), words AS (SELECT *, lower(regexp_extract(h1, '^[^\s]+')) AS word FROM page),
hrefs AS (
  SELECT page_id, lang, unnest(list) AS href, generate_subscripts(list, 1) - 1 AS pos
  FROM (SELECT page_id, lang, regexp_extract_all(html, 'href="([^"]*)"', 1) AS list FROM words)
)"""
_ALIASES = (
    _PAGES
    + """, claims AS (
  SELECT DISTINCT alias, page_id FROM (
    SELECT 'p/' || page_id AS alias, page_id FROM words
    UNION ALL SELECT page_id::VARCHAR, page_id FROM words
    UNION ALL SELECT regexp_replace(word, '\\.mdx?$', ''), page_id FROM words WHERE word <> '')
), aliases AS (SELECT alias, min(page_id) AS target FROM claims GROUP BY alias HAVING count(*) = 1),
asked AS (SELECT page_id, lang, pos, href, regexp_replace(href, '^/', '') AS ref FROM hrefs),
linked AS (
  SELECT a.*, t.target FROM (SELECT *, regexp_replace(lower(trim(ref)), '\\.mdx?$', '') AS want FROM asked) a LEFT JOIN aliases t ON a.want = t.alias AND a.want <> ''
)"""
)
_SLUG = r"""CASE WHEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\x{{4e00}}-\x{{9fff}}\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'section'
  ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\x{{4e00}}-\x{{9fff}}\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') END"""
_SNAPS = (
    _DOCS
    + """, hashed AS (SELECT id, path, lang, source, sha256(text) AS hash FROM docs),
old AS (SELECT id, path, hash, lang FROM hashed WHERE NOT (lang = 'en' AND source = 'src1')),
new AS (SELECT CASE WHEN lang = 'es' THEN 'new-' || id ELSE id END AS id, path, CASE WHEN lang = 'fr' THEN reverse(hash) ELSE hash END AS hash, lang FROM hashed WHERE lang <> 'de')"""
)
_STALE = """stale AS (
  SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.id <> n.id THEN 'id_changed' WHEN o.hash <> n.hash THEN 'modified' END AS reason
  FROM new n FULL JOIN old o ON n.path = o.path
)"""
_INFER = r"""CASE
  WHEN regexp_matches({0}, '^(?:GET|POST|PUT|PATCH|DELETE)\s+/|^/') THEN 'api_route'
  WHEN regexp_matches({0}, '(?:^|\s)([\w@.-]+/[\w@./-]+\.(?:ts|tsx|js|jsx|md|mdx|json|yaml|yml|toml|rs|go|py|java|cs|sql))') THEN 'file_path'
  WHEN regexp_matches({0}, '^(?:npm|pnpm|yarn|go|cargo|docker|kubectl|node|npx)\s+') THEN 'command'
  WHEN regexp_matches({0}, '\b(?:[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{{3,}}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*)\b') THEN 'error_code'
  WHEN regexp_matches({0}, '^[A-Z][A-Z0-9_]{{2,}}$|^[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){{2,}}$') THEN 'config_key'
  WHEN regexp_matches({0}, '^@?[a-z0-9_.-]+/[a-z0-9_.-]+$') THEN 'package'
  WHEN regexp_matches({0}, '(?i)^ADR-?[0-9]+$') THEN 'decision' ELSE 'symbol' END"""
_TAGS = _PAGES + r""", tags AS (SELECT DISTINCT page_id::VARCHAR AS path, regexp_replace(href, '^/', '') AS tag FROM hrefs), bad AS (SELECT * FROM tags WHERE NOT regexp_full_match(tag, '[a-z0-9][a-z0-9._/-]*'))"""


def _bm25(prefixes: list[str]) -> str:
    listed = ", ".join(f"('{p}')" for p in prefixes)
    return rf"""words AS (
  SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '{_TERM}')) AS term FROM documents
), lengths AS (SELECT d.doc_id, count(w.term) AS dl FROM documents d LEFT JOIN words w USING (doc_id) GROUP BY d.doc_id),
asked(prefix) AS (VALUES {listed}),
tfs AS (SELECT prefix, doc_id, count(*) AS tf FROM words JOIN asked ON starts_with(term, prefix) GROUP BY prefix, doc_id),
idfs AS (SELECT prefix, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs GROUP BY prefix),
ranked AS (
  SELECT doc_id, -sum((CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lengths)))) AS score
  FROM tfs JOIN idfs USING (prefix) JOIN lengths USING (doc_id) GROUP BY doc_id
)"""


_CHANNELS = (
    _TIERS
    + """, one AS (SELECT 'fts' AS channel, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, source AS key, 100 - n_chars / 1000.0 AS score, doc_id FROM tiers),
two AS (SELECT 'semantic' AS channel, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, source AS key, 80 + n_chars / 2000.0 AS score, doc_id FROM tiers WHERE tier = 'validated'),
both_ AS (SELECT * FROM one WHERE rank <= 40 UNION ALL SELECT * FROM two WHERE rank <= 40),
boosts AS (SELECT key, round(sum(1.0 / (60 + rank)) * 1000, 4) AS boost, string_agg(channel, '; ' ORDER BY channel) AS reasons FROM (SELECT channel, key, min(rank) AS rank FROM both_ GROUP BY channel, key) GROUP BY key),
fused AS (SELECT b.channel, b.rank, b.key, b.doc_id, boost, round(b.score + boost, 4) AS score, reasons, CASE b.channel WHEN 'fts' THEN 0 ELSE 1000 END + b.rank AS ord FROM both_ b JOIN boosts USING (key))"""
)
_ORDER_EDGES = """line AS (SELECT *, l_orderkey || '-' || l_linenumber AS ln FROM lineitem),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'order:' || o_orderkey AS f, 'customer:' || o_custkey AS t, 'REFERENCES' AS kind FROM orders
    UNION ALL SELECT 'section:' || ln, 'part:' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 'DEFINES' ELSE 'REFERENCES' END FROM line
    UNION ALL SELECT 'chunk:' || ln, 'supplier:' || l_suppkey, 'LINKS_TO' FROM line WHERE l_linestatus = 'F')
)"""
_JUDGED = (
    _TIERS
    + """, wanted AS (SELECT source, path FROM tiers WHERE tier = 'validated'),
seen AS (SELECT source, path FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM tiers) WHERE place <= 20),
judged AS (
  SELECT s.source, (SELECT count(*) FROM wanted w WHERE w.source = s.source) AS n_wanted, (SELECT count(*) FROM seen x WHERE x.source = s.source) AS n_seen,
    (SELECT count(*) FROM wanted w JOIN seen x USING (source, path) WHERE w.source = s.source) AS hits
  FROM (SELECT DISTINCT source FROM tiers) s
), metrics AS (SELECT source, CASE WHEN n_wanted = 0 THEN 1.0 ELSE round(hits / n_wanted, 4) END AS recall, CASE WHEN n_seen = 0 THEN 0.0 ELSE hits / n_seen END AS precision FROM judged)"""
)
_LIFE = (
    _ALIASES
    + """, state AS (SELECT page_id, 'p/' || page_id AS path, CASE lang WHEN 'de' THEN 'deprecated' WHEN 'fr' THEN 'superseded' ELSE 'active' END AS st FROM words),
used AS (SELECT l.page_id, l.pos, l.href, l.target, s.path FROM linked l JOIN state s USING (page_id) WHERE l.target IS NOT NULL AND l.target <> l.page_id AND s.st = 'active'),
super AS (SELECT DISTINCT l.target, l.page_id AS by_page FROM linked l JOIN state s USING (page_id) WHERE l.pos < 1 AND l.target IS NOT NULL AND l.target <> l.page_id AND s.st = 'active'),
named AS (SELECT target, string_agg('p/' || by_page, ',' ORDER BY 'p/' || by_page) AS by_paths FROM super GROUP BY target)"""
)

#: FNV-1a of 32 bits over characters below 0x10000.
_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)"
_NAMES = (
    r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_./:{}-]+|/[A-Za-z0-9_./:{}-]+",
    r"\b(?:[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{3,}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*)\b",
    r"\b(?:[A-Z][A-Z0-9_]{2,}|[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){2,})\b",
    r"\b(?:npm|pnpm|yarn|go|cargo|docker|kubectl|node|npx)\s+[^\n`]+",
    r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?\(\)",
    r"\b[A-Z][A-Za-z0-9]+(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?\b",
)
_TRIGGERS = [f"SELECT conv_id, turn, unnest(regexp_extract_all(text, '{n}')) AS name FROM conversations" for n in _NAMES]
_TRIGGERS.append(r"SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?:^|\s)([A-Za-z0-9_@.-]+/[A-Za-z0-9_@./-]+\.(?:ts|tsx|js|jsx|md|mdx|json|yaml|yml|toml|rs|go|py|java|cs|sql))', 1)) AS name FROM conversations")

ORACLES: dict[str, str] = {
    "doc_ids_hashes": rf"""WITH {_DOCS} SELECT doc_id, id, sha256(text) AS hash,
  greatest(1, ceil((length(text) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))) / 4.0))::BIGINT AS tokens FROM docs""",
    "chunk_lines": """SELECT doc_id, generate_subscripts(l, 1)::BIGINT AS line, unnest(l) AS line_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "tokenize_terms": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS w FROM documents),
p AS (SELECT doc_id, unnest(string_split(w, '_')) AS token FROM t)
SELECT doc_id, token, 2 * count(*) AS n FROM p WHERE length(token) > 1 AND token NOT IN ('and', 'or', 'not', 'near') GROUP BY doc_id, token""",
    "index_postings": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '{_TERM}')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM t GROUP BY term""",
    "caps_entities": rf"""WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_./:{{}}-]+|/[A-Za-z0-9_./:{{}}-]+')) AS name FROM documents
  UNION SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[A-Z][A-Za-z0-9]+Error|ERR_[A-Z0-9_]+|[A-Z]+_[0-9]{{3,}}|[A-Z]+_[A-Z0-9_]*ERROR[A-Z0-9_]*)\b')) FROM documents
  UNION SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[A-Z][A-Z0-9_]{{2,}}|[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*){{2,}})\b')) FROM documents)
SELECT doc_id, name, {_INFER.format("name")} AS kind FROM t""",
    "entity_kind_infer": rf"""WITH {_PAGES}, {_DOCS}, names AS (SELECT href AS name FROM hrefs UNION SELECT regexp_replace(href, '^/', '') FROM hrefs UNION SELECT path FROM docs)
SELECT name, {_INFER.format("name")} AS kind FROM names""",
    "entity_dedup_first": rf"""WITH c AS (SELECT doc_id, l, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_CAPS}') AS l FROM documents)),
f AS (SELECT lower(name) AS normalized_name, name, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id, pos) AS turn FROM c)
SELECT 'entity:' || substr(sha1('entity:config_key:' || normalized_name), 1, 20) AS id, name, normalized_name FROM f WHERE turn = 1""",
    "slug_headings": f"WITH {_PAGES} SELECT page_id, {_SLUG.format('h1')} AS slug FROM words",
    "slug_dup_anchor": f"""WITH {_PAGES}, s AS (SELECT page_id, host, {_SLUG.format("string_split(h1, ' ')[1]")} AS slug FROM words),
n AS (SELECT *, row_number() OVER (PARTITION BY host, slug ORDER BY page_id) AS turn FROM s)
SELECT page_id, host, CASE WHEN turn = 1 THEN slug ELSE slug || '-' || turn END AS anchor FROM n""",
    "fts_bm25_topk": f"WITH {_bm25(['the', 'license', 'apache'])} SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score, doc_id::VARCHAR LIMIT 10",
    "fts_prefix_or": f"WITH {_bm25(['the', 'er', 'tion', 'auf', 'que'])} SELECT doc_id, round(score, 5) + 0.0 AS score FROM ranked",
    "trust_status_adjust": f"WITH {_TIERS} SELECT doc_id, round(100.0 + {_ADJUST}, 4)::DOUBLE AS score FROM tiers",
    "highfreq_penalty": rf"""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_CAPS}')) AS name FROM documents),
f AS (SELECT name, count(*) AS n FROM c GROUP BY name)
SELECT doc_id, -least(60, 20 * count(*) FILTER (n > 10)) + 0.0::DOUBLE AS penalty FROM c JOIN f USING (name) GROUP BY doc_id""",
    "rrf_fusion": f"WITH {_CHANNELS} SELECT channel, rank, key, round(boost, 3) AS boost, round(score, 3) AS score FROM fused",
    "search_dedupe": f"""WITH {_CHANNELS}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS place FROM fused)
SELECT key, round(score, 3) AS score, reasons AS reason, doc_id, (length(reasons) - length(replace(reasons, ';', '')) + 1)::BIGINT AS matched FROM best WHERE place = 1""",
    "vector_topk": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: round(embedding[i]::DOUBLE, 6) * round(e[i]::DOUBLE, 6))) AS similarity FROM embeddings, q)
SELECT vec_id, round(similarity, 5) AS similarity FROM s WHERE s.similarity > 0 ORDER BY s.similarity DESC, vec_id LIMIT 10""",
    "vector_stats": "SELECT 'local-hash' AS provider, 'label-' || label AS model, len(embedding)::BIGINT AS dimensions, count(*) AS n FROM embeddings GROUP BY ALL",
    "href_links": f"WITH {_PAGES} SELECT page_id, pos::BIGINT AS pos, href FROM hrefs",
    "alias_ambiguity": f"WITH {_ALIASES} SELECT alias, count(*) AS claimants FROM claims GROUP BY alias HAVING count(*) > 1",
    "link_resolution": f"WITH {_ALIASES} SELECT page_id, pos::BIGINT AS pos, href, 'd' || target AS node_id FROM linked WHERE target IS NOT NULL",
    "edge_build": f"""WITH {_STAR} SELECT 'edge:' || substr(sha1('edge:' || from_id || ':' || kind || ':' || to_id || ':regex'), 1, 20) AS id, from_id, to_id, kind, weight::DOUBLE AS weight, confidence::DOUBLE AS confidence
FROM star""",
    "edge_dedup_last": """SELECT 'customer:' || l_suppkey AS from_id, 'part:' || l_partkey AS to_id, l_returnflag AS provenance, round(arg_max(l_discount, l_orderkey * 100 + l_linenumber), 4) AS confidence
FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag""",
    "edge_kind_stats": f"WITH {_STAR} SELECT kind, count(*) AS n, round(avg(weight), 4) AS avg_weight, round(avg(confidence), 4) AS avg_confidence FROM star GROUP BY kind",
    "degree_top10": f"""WITH {_STAR}, e AS (SELECT from_id AS node_id FROM star WHERE kind <> 'CONTAINS' UNION ALL SELECT to_id FROM star WHERE kind <> 'CONTAINS')
SELECT node_id, count(*) AS degree FROM e GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 10""",
    "node_label_join": f"""WITH {_STAR}, l AS (SELECT 'nation:' || n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier)
SELECT from_id, to_id, a.label AS from_label, b.label AS to_label FROM star LEFT JOIN l a ON a.id = from_id LEFT JOIN l b ON b.id = to_id WHERE kind = 'DEPENDS_ON'""",
    "entity_doc_frequency": f"""WITH {_STAR}, e AS (SELECT from_id AS id, to_id AS o FROM star WHERE kind <> 'CONTAINS' UNION ALL SELECT to_id, from_id FROM star WHERE kind <> 'CONTAINS')
SELECT id, count(DISTINCT o) AS documents FROM e WHERE starts_with(o, 'order:') GROUP BY id""",
    "link_stats_exact": f"""WITH {_ORDER_EDGES}, own AS (
  SELECT split_part(split_part(f, ':', 2), '-', 1) AS document_id, kind FROM edges)
SELECT o_orderkey::VARCHAR AS document_id, count(own.kind) AS links, count(*) FILTER (own.kind = 'DEFINES') AS definitions FROM orders LEFT JOIN own ON own.document_id = o_orderkey::VARCHAR GROUP BY o_orderkey""",
    "link_stats_fanout": f"""WITH {_ORDER_EDGES}, spot AS (SELECT DISTINCT l_orderkey, ln FROM line), cells AS (
  SELECT o.o_orderkey AS k, a.ln AS s, b.ln AS c FROM orders o LEFT JOIN spot a ON a.l_orderkey = o.o_orderkey LEFT JOIN spot b ON b.l_orderkey = o.o_orderkey
), met AS (
  SELECT k, s, c, e.* FROM cells JOIN edges e ON e.f = 'order:' || k
  UNION SELECT k, s, c, e.* FROM cells JOIN edges e ON e.f = 'section:' || s
  UNION SELECT k, s, c, e.* FROM cells JOIN edges e ON e.f = 'chunk:' || c)
SELECT o_orderkey::VARCHAR AS document_id, count(met.k) AS links, count(*) FILTER (met.kind = 'DEFINES') AS definitions FROM orders LEFT JOIN met ON met.k = o_orderkey GROUP BY o_orderkey""",
    "weak_links": "SELECT c_custkey::VARCHAR AS document_id, count(o_orderkey) AS links FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 5",
    "orphans": "SELECT o_orderkey::VARCHAR AS document_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "definition_collisions": """SELECT lower(p_name) AS id, count(*) AS documents, string_agg('part/' || p_partkey, ',' ORDER BY 'part/' || p_partkey) AS paths FROM part GROUP BY lower(p_name) HAVING count(*) > 1""",
    "definitions_top3": """SELECT entity_id, edge_id, place FROM (SELECT p_brand AS entity_id, p_partkey AS edge_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type, p_partkey) AS place FROM part) WHERE place <= 3""",
    "path_group_storage": f"""WITH {_DOCS} SELECT split_part(path, '/', 1) AS path_group, count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(octet_length(encode(path)) + length(text))::BIGINT AS content_bytes FROM docs GROUP BY 1""",
    "table_counts": " UNION ALL ".join(f"SELECT '{a}' AS relation, count(*) AS n FROM {b}" for a, b in (("documents", "documents"), ("sections", "pages"), ("entities", "labels"), ("source_refs", "orders"), ("edges", "lineitem"), ("chunks", "conversations"), ("vectors", "embeddings"))),
    "prune_unreferenced": "SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "upsert_incremental": f"""WITH {_SNAPS}, {_STALE}
SELECT id, path, hash FROM old WHERE path NOT IN (SELECT path FROM stale WHERE reason IS NOT NULL) UNION ALL SELECT id, path, hash FROM new WHERE path IN (SELECT path FROM stale WHERE reason IS NOT NULL)""",
    "insert_modes": "SELECT lower(p_name) AS key, min(p_partkey) AS ignored, max(p_partkey) AS replaced, round(arg_max(p_retailprice, p_partkey), 4) AS price FROM part GROUP BY lower(p_name)",
    "stale_index": f"WITH {_SNAPS}, {_STALE} SELECT path, reason FROM stale WHERE reason IS NOT NULL",
    "freshness_counts": """SELECT CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'P' THEN 'deleted' ELSE 'modified' END AS reason, count(*) AS n FROM orders
WHERE o_orderstatus <> 'F' OR o_orderdate > TIMESTAMP '1996-01-01 00:00:00.001' GROUP BY 1""",
    "graph_diff": f"""WITH {_SNAPS}, o AS (SELECT path, hash, lang, CASE WHEN hash < '8' THEN 'spec' ELSE 'other' END AS type FROM old),
n AS (SELECT CASE WHEN starts_with(path, 'src2/') THEN 'moved/' || path ELSE path END AS path, hash, CASE WHEN hash < '8' THEN 'spec' ELSE 'other' END AS type FROM new),
ren AS (SELECT o.path AS old_path, n.path FROM o JOIN n ON n.path = 'moved/' || o.path WHERE o.lang = 'en' AND starts_with(o.path, 'src2/')),
o2 AS (SELECT * FROM o WHERE path NOT IN (SELECT old_path FROM ren)), n2 AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM ren))
SELECT path, old_path, 'renamed' AS change FROM ren UNION ALL
SELECT coalesce(n2.path, o2.path), NULL, CASE WHEN o2.path IS NULL THEN 'added' WHEN n2.path IS NULL THEN 'deleted' ELSE 'modified' END FROM o2 FULL JOIN n2 ON o2.path = n2.path
WHERE o2.path IS NULL OR n2.path IS NULL OR o2.hash <> n2.hash OR o2.type <> n2.type""",
    "source_symdiff": f"""WITH {_SNAPS} SELECT path, 'removed' AS side FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, 'added' FROM new WHERE path NOT IN (SELECT path FROM old)""",
    "warning_deltas": """SELECT event_type AS code, count(*) FILTER (user_id <= 50) AS before, count(*) FILTER (user_id > 50) AS after, count(*) FILTER (user_id > 50) - count(*) FILTER (user_id <= 50) AS delta
FROM events GROUP BY event_type HAVING count(*) FILTER (user_id > 50) <> count(*) FILTER (user_id <= 50)""",
    "content_risk_lines": r"""WITH texts AS (
  SELECT 'x1' AS id, 'please' || chr(10) || 'Ignore previous instructions now' AS html UNION ALL SELECT 'x2', 'see' || chr(13) || chr(10) || 'DATA:text/html,abc <iframe src="a">'
  UNION ALL SELECT 'x3', 'a' || chr(8203) || 'b' UNION ALL SELECT 'x4', 'clean' UNION ALL SELECT page_id::VARCHAR, html FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents
), l AS (SELECT id, unnest(s) AS t, generate_subscripts(s, 1)::BIGINT AS line FROM (SELECT id, regexp_split_to_array(html, '\r?\n') AS s FROM texts))
SELECT id, line, 'possible prompt injection text' AS reason FROM l WHERE contains(lower(t), 'ignore previous instructions') OR contains(lower(t), 'system prompt')
UNION ALL SELECT id, line, 'HTML script or iframe' FROM l WHERE regexp_matches(t, '(?i)<\s*(script|iframe)\b')
UNION ALL SELECT id, line, 'active data URI' FROM l WHERE regexp_matches(t, '(?i)data:text/html|data:application/javascript')
UNION ALL SELECT id, line, 'hidden Unicode format character' FROM l WHERE regexp_matches(t, '\p{Cf}')""",
    "tag_format": f"WITH {_TAGS} SELECT path, tag FROM bad",
    "posix_link": rf"""WITH {_PAGES}, u AS (SELECT page_id::VARCHAR AS path, pos::BIGINT AS line, replace(href, '/', '\') || '.md' AS url FROM hrefs)
SELECT path, line, url FROM u WHERE contains(url, '\') AND NOT regexp_matches(url, '(?i)^(?:https?:|mailto:|#)')""",
    "lifecycle_refs": f"""WITH {_LIFE}
SELECT 'document.deprecated_referenced' AS code, u.path, u.pos::BIGINT AS line, u.href AS target, t.path AS target_path, '' AS superseded_by FROM used u JOIN state t ON t.page_id = u.target WHERE t.st = 'deprecated'
UNION ALL SELECT 'document.superseded_referenced', u.path, u.pos::BIGINT, u.href, t.path, coalesce(n.by_paths, '') FROM used u JOIN state t ON t.page_id = u.target LEFT JOIN named n ON n.target = u.target
WHERE t.st = 'superseded' OR n.target IS NOT NULL""",
    "missing_decision": f"""WITH {_PAGES} SELECT 'p/' || page_id AS path FROM words w WHERE lang <> 'de' AND NOT EXISTS (
  SELECT 1 FROM hrefs h WHERE h.page_id = w.page_id AND length(href) > 24 AND NOT regexp_matches(href, '(?i)^(?:https?:|mailto:|#)'))
  AND NOT EXISTS (SELECT 1 FROM hrefs h WHERE h.page_id = w.page_id AND length(href) <= 24 AND regexp_matches(href, '(?i)\\.mdx?|#') AND NOT regexp_matches(href, '(?i)^(?:https?:|mailto:|#)'))""",
    "warnings_union_sorted": f"""WITH {_ALIASES}, {_SNAPS}, {_STALE}, tags AS (SELECT DISTINCT page_id::VARCHAR AS path, regexp_replace(href, '^/', '') AS tag FROM hrefs),
w AS (
  SELECT 'link.dead' AS code, '0' AS rank, 'p/' || page_id AS path, pos::BIGINT AS line, 'Dead link in p/' || page_id AS message FROM linked WHERE target IS NULL
  UNION ALL SELECT 'index.stale', '0', path, NULL, 'Indexed document is ' || reason FROM stale WHERE reason IS NOT NULL
  UNION ALL SELECT 'tag.invalid_format', '1', path, NULL, 'Tag ' || tag FROM tags WHERE NOT regexp_full_match(tag, '[a-z0-9][a-z0-9._/-]*'))
SELECT row_number() OVER (ORDER BY concat_ws('|', rank, code, coalesce(path, ''), coalesce(line, 0), message)) AS place, code, path, coalesce(line, 0) AS line, message FROM w""",
    "warning_top5": f"""WITH {_ALIASES}, {_SNAPS}, {_STALE}, tags AS (SELECT DISTINCT page_id, regexp_replace(href, '^/', '') AS tag FROM hrefs),
w AS (SELECT 'link.dead' AS code FROM linked WHERE target IS NULL UNION ALL SELECT 'index.stale' FROM stale WHERE reason IS NOT NULL UNION ALL SELECT 'tag.invalid_format' FROM tags WHERE NOT regexp_full_match(tag, '[a-z0-9][a-z0-9._/-]*'))
SELECT code, count(*) AS n FROM w GROUP BY code ORDER BY n DESC, code LIMIT 5""",
    "khop_neighbors": f"""WITH RECURSIVE {_STAR}, e AS (SELECT from_id AS a, to_id AS b FROM star WHERE kind <> 'CONTAINS' UNION SELECT to_id, from_id FROM star WHERE kind <> 'CONTAINS'),
hop AS (SELECT 'nation:3' AS node_id, 0 AS depth UNION SELECT e.b, depth + 1 FROM hop JOIN e ON e.a = node_id WHERE depth < 2)
SELECT node_id, min(depth)::BIGINT AS depth FROM hop GROUP BY node_id""",
    "roundrobin_order": f"""WITH {_DOCS}, r AS (SELECT doc_id, source, row_number() OVER w AS turn, first_value(n_chars) OVER w AS best, first_value(doc_id) OVER w AS tie FROM docs WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))
SELECT doc_id, row_number() OVER (ORDER BY turn, best DESC, tie, source) AS pos FROM r""",
    "budget_pack": """WITH p AS (SELECT conv_id, turn, length(text) AS size, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT conv_id, turn, greatest(0, least(size, 600 - used))::BIGINT AS kept FROM p""",
    "eval_recall": f"WITH {_JUDGED} SELECT source, recall FROM metrics",
    "eval_precision": f"WITH {_JUDGED} SELECT source, round(precision, 4) AS precision FROM metrics",
    "eval_summary": f"""WITH {_JUDGED} SELECT count(*) AS cases, sum((recall > 0.4)::INT)::BIGINT AS passed, round(avg(recall), 3) AS document_recall, round(avg(precision), 3) AS context_precision FROM metrics""",
    "paired_delta": """WITH m AS (
  SELECT event_type AS question_id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS s, count(*) AS n, sum(round(value, 2)) AS chars, count(*) FILTER (value > 50) AS cites,
    round(count(*) FILTER (value > 100) / nullif(count(*) FILTER (value > 50), 0), 4) AS rate, min(user_id) AS low FROM events GROUP BY 1, 2
) SELECT question_id, sum(s * n)::DOUBLE AS tool_calls, round(sum(s * chars), 2) AS tool_output_chars, sum(s * cites)::DOUBLE AS citations, CASE WHEN count(rate) = 2 THEN round(sum(s * rate), 3) END AS citation_rate, sum(s * low)::DOUBLE AS latency_ms, NULL::DOUBLE AS token_estimate
FROM m WHERE question_id <> 'purchase' GROUP BY question_id HAVING count(*) = 2""",
    "paired_skipped": "SELECT DISTINCT event_type AS question_id, 'missing run with the graph' AS reason FROM events WHERE event_type = 'purchase'",
    "docsite_index": f"""WITH {_STAR}, d AS (SELECT 'nation:' || n_nationkey AS id, n_name AS path FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier),
e AS (SELECT a.id AS f, b.id AS t, a.path AS fp, b.path AS tp, kind FROM star JOIN d a ON a.id = from_id JOIN d b ON b.id = to_id WHERE kind IN ('DEFINES', 'DEPENDS_ON'))
SELECT path, coalesce((SELECT string_agg(DISTINCT tp, ',' ORDER BY tp) FROM e WHERE f = d.id AND kind = 'DEFINES'), '') AS defines, coalesce((SELECT string_agg(DISTINCT tp, ',' ORDER BY tp) FROM e WHERE f = d.id AND t <> d.id), '') AS outbound,
  coalesce((SELECT string_agg(DISTINCT fp, ',' ORDER BY fp) FROM e WHERE t = d.id AND f <> d.id), '') AS inbound FROM d""",
    "graphjson_verify": f"""WITH {_STAR}, nodes AS (SELECT 'supplier:' || s_suppkey AS id, 'document' AS kind FROM supplier UNION ALL SELECT 'nation:' || n_regionkey, CASE WHEN n_nationkey > 20 THEN 'planet' ELSE 'entity' END FROM nation),
edges AS (SELECT from_id, to_id, CASE WHEN starts_with(from_id, 'customer:1') THEN 'KNOWS' ELSE kind END AS kind FROM star WHERE kind = 'DEPENDS_ON'), errors AS (
  SELECT 'node_kind' AS code FROM nodes WHERE kind = 'planet' UNION ALL SELECT 'node_duplicate' FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'edge_kind' FROM edges WHERE kind = 'KNOWS'
  UNION ALL SELECT 'edge_endpoint' FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'edge_endpoint' FROM edges WHERE to_id NOT IN (SELECT id FROM nodes))
SELECT code, count(*) AS n FROM errors GROUP BY code""",
    "graphjson_edges": f"""WITH {_STAR} SELECT from_id, to_id, kind FROM star WHERE regexp_matches(from_id, '^(supplier|nation):') AND regexp_matches(to_id, '^(supplier|nation):')""",
    "source_bridge": f"""WITH {_PAGES}, r AS (SELECT DISTINCT 'p/' || page_id AS path, lower(word) AS np FROM words), f AS (SELECT DISTINCT lower(regexp_replace(href, '^/', '')) AS np FROM hrefs)
SELECT path, f.np IS NOT NULL AS matched, f.np AS artifact_path FROM r LEFT JOIN f USING (np)""",
    "search_full": rf"""WITH {_bm25(["the", "license", "apache"])}, {_TIERS}, best AS (SELECT doc_id, score, row_number() OVER (ORDER BY ranked.score, cid) AS rank
  FROM (SELECT r.doc_id, r.score, 'chunk:' || substr(sha1('chunk:' || 'section:' || substr(sha1('section:' || id || ':root'), 1, 20) || ':content'), 1, 20) AS cid FROM ranked r JOIN docs USING (doc_id)) ranked),
scored AS (SELECT t.path, rank, round(100 - score + {_ADJUST} + round(1000.0 / (60 + rank), 4), 4) AS score FROM best JOIN tiers t USING (doc_id) WHERE rank <= 40)
SELECT path, round(score, 3) AS score, 'full-text content match; RRF fusion (fts#' || rank || ')' AS reason FROM scored ORDER BY scored.score DESC, rank LIMIT 20""",
    "hash_embedding": rf"""WITH w AS (SELECT conv_id || '-' || turn AS turn_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS w FROM conversations),
t AS (SELECT turn_id, unnest(string_split(w, '_')) AS token FROM w), n AS (SELECT turn_id, token, 2 * count(*) AS n FROM t WHERE length(token) > 1 AND token NOT IN ('and', 'or', 'not', 'near') GROUP BY ALL),
h AS (SELECT turn_id, n, length(token) AS len, {_FNV.format("token")} % 64 AS pos, {_FNV.format("'sign:' || token")} % 2 AS odd FROM n)
SELECT turn_id, pos::BIGINT AS "at", round(sum(n * (CASE odd WHEN 0 THEN 1 ELSE -1 END) * (1 + ln(len))), 4) + 0.0 AS weight FROM h GROUP BY turn_id, pos""",
    "entity_trigger_lines": rf"""WITH t AS ({" UNION ".join(_TRIGGERS)}) SELECT name, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, trim(name) AS name FROM t) WHERE name <> '' GROUP BY name""",
    "folded_terms": rf"WITH {_PAGES} SELECT page_id, strip_accents(lower(h1)) AS folded, len(regexp_extract_all(strip_accents(lower(h1)), '{_TERM}'))::BIGINT AS terms FROM words",
}
