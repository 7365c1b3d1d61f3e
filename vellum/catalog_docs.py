"""A corpus of Markdown made from the driver's pages, and the engine's operators over it, with DuckDB SQL.

Every page gives one document with the same shape, so what each operator must find follows from
the page id alone. The SQL is written from that shape: it never sees the Markdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import QUERIES, _pages, _runs, _t, query
from .catalog_sql import _PAGES, ORACLES
from .config import Config
from .engine import Engine
from .functions.text import content_hash, index_content, prefix_terms
from .operators import context, diff, evaluate, export, health, paired, search, stats, traverse, vectors
from .plans import graph as graphs
from .plans import resolve, storage, store
from .plans.parsed import parse_documents
from .sources import files as sources

#: How a page is: whether it is there, and whether its last line is changed, in two states of the corpus.
ALL, OLD, NEW = ("true", "false"), ("p % 10 <> 3", "false"), ("p % 10 <> 7", "p % 5 = 2")


def corpus(spark: SparkSession, d: str, state: tuple[str, str] = ALL) -> DataFrame:
    """path, text of every document of a state."""
    there, changed = state
    p = _pages(spark, d).select(F.col("page_id").alias("p"), "host", "lang").where(there)
    text = F.lit("")
    front = [
        ("p % 3 = 0", "id: page-{p}"),
        ("p % 4 <> 1", "title: '  Title {p} '"),
        ("true", "type: {kind}"),
        ("true", "status: {status}"),
        ("p % 5 = 0", "trust_tier: Generated"),
        ("true", "tags: [a{p7}, 'Bad Tag']"),
        ("true", "defines: Host{p11}Store"),
        ("true", "depends_on: [p{before}.md, Missing{p6}Thing]"),
        ("true", "implements: ./src/{host}.ts"),
        ("true", "source_refs: [src/h{p13}.ts, 7]"),
    ]
    body = (
        "# Page {p}\n\nProse names ERR_CODE_{p17} and GET /v1/items/{p9} here.\n"
        "See [next](./p{after}.md#links) and [[p{later}|Other {p}]] or `Cache{p8}Reader`.\n\n"
        "## Links\n\n- [one](https://example.com/{p})\n- [gone](missing-{p10}.md)\n\n```ts\ncallService{p4}()\n```\n\n"
        "## Defines\n\n- `Alpha{p5}Thing`\n\n## Links\n\n{last}"
    )
    values = {f"p{k}": F.expr(f"cast(p % {k} as string)") for k in (4, 5, 6, 7, 8, 9, 10, 11, 13, 17)}
    values |= {"p": F.expr("cast(p as string)"), "before": F.expr("cast(p - 1 as string)"), "after": F.expr("cast(p + 1 as string)"), "later": F.expr("cast(p + 2 as string)"), "host": F.col("host")}
    values |= {"kind": F.expr("if(p % 2 = 0, 'design', 'Runbook')"), "status": F.expr("case lang when 'de' then 'deprecated' when 'fr' then 'draft' else 'active' end"), "last": F.expr(f"if({changed}, concat('Ended by `New', cast(p % 3 as string), 'Thing`.'), 'End.')")}

    def filled(template: str) -> F.Column:
        parts, at = [], 0
        while (a := template.find("{", at)) >= 0:
            b = template.index("}", a)
            parts += [F.lit(template[at:a]), values[template[a + 1 : b]]]
            at = b + 1
        return F.concat(*parts, F.lit(template[at:]))

    text = F.concat(F.lit("---\n"), *(F.when(F.expr(when), F.concat(filled(line), F.lit("\n"))).otherwise(F.lit("")) for when, line in front), F.lit("---\n"), filled(body))
    return p.select(F.concat(F.lit("docs/p"), F.col("p").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


def parsed(spark: SparkSession, d: str, state: tuple[str, str] = ALL) -> DataFrame:
    """The corpus as the parser reads it, parsed once."""
    return storage.cut(parse_documents(corpus(spark, d, state)))


def graph(spark: SparkSession, d: str, state: tuple[str, str] = ALL, config: Config | None = None) -> graphs.Graph:
    return graphs.build_graph(parsed(spark, d, state), config)


def _sql(state: tuple[str, str] = ALL, x: str = "") -> str:
    """Tables {x}doc, {x}sec, {x}ent (names by place), {x}edge of a state, from the shape of a document."""
    there, changed = state
    api = "'api_route'"
    ref = f"'source_ref:' || substr(sha1('source_ref:' || lower({{0}})), 1, 20)"
    entity = "'entity:' || substr(sha1('entity:' || {0} || ':' || lower({1})), 1, 20)"
    return f"""{x}doc AS (
  SELECT p, host, path, front_id, id, title, kind, status, tier, off, changed FROM (
    SELECT page_id AS p, host, 'docs/p' || page_id || '.md' AS path, CASE WHEN page_id % 3 = 0 THEN 'page-' || page_id END AS front_id,
      'document:' || substr(sha1('document:' || CASE WHEN page_id % 3 = 0 THEN 'page-' || page_id ELSE 'docs/p' || page_id || '.md' END), 1, 20) AS id,
      CASE WHEN page_id % 4 <> 1 THEN 'Title ' ELSE 'Page ' END || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'design' ELSE 'runbook' END AS kind,
      CASE lang WHEN 'de' THEN 'deprecated' WHEN 'fr' THEN 'draft' ELSE 'active' END AS status, CASE WHEN page_id % 5 = 0 THEN 'generated' ELSE 'authored' END AS tier,
      9 + (page_id % 3 = 0)::INT + (page_id % 4 <> 1)::INT + (page_id % 5 = 0)::INT AS off, ({changed.replace("p %", "page_id %")}) AS changed
    FROM words WHERE {there.replace("p %", "page_id %")})
), {x}sec AS (
  SELECT d.*, n, anchor, heading, level, off + a AS start_line, off + b AS end_line, 'section:' || substr(sha1('section:' || id || ':' || anchor), 1, 20) AS sid FROM {x}doc d, LATERAL (
    VALUES (0, 'page-' || p, 'Page ' || p, 1, 1, 5), (1, 'links', 'Links', 2, 6, 14), (2, 'defines', 'Defines', 2, 15, 18), (3, 'links-2', 'Links', 2, 19, 21)) v(n, anchor, heading, level, a, b)
), {x}named AS (
  SELECT id AS from_id, 'Host' || p % 11 || 'Store' AS name, 'symbol' AS ekind, 'DEFINES' AS kind, 'frontmatter' AS provenance, 1.0 AS confidence FROM {x}doc
  UNION ALL SELECT sid, 'Alpha' || p % 5 || 'Thing', 'symbol', 'DEFINES', 'declared_section', 0.85 FROM {x}sec WHERE n = 2
  UNION ALL SELECT sid, heading, 'symbol', 'DEFINES', 'heading', 0.8 FROM {x}sec WHERE n > 0
  UNION ALL SELECT sid, 'ERR_CODE_' || p % 17, 'error_code', 'REFERENCES', 'regex', 0.6 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, 'GET', 'config_key', 'REFERENCES', 'regex', 0.6 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, 'GET /v1/items/' || p % 9, {api}, 'REFERENCES', 'regex', 0.6 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, '/p' || p + 1 || '.md', {api}, 'REFERENCES', 'regex', 0.6 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, '//example.com/' || p, {api}, 'REFERENCES', 'regex', 0.6 FROM {x}sec WHERE n = 1
  UNION ALL SELECT sid, 'Cache' || p % 8 || 'Reader', 'symbol', 'REFERENCES', 'inline_code', 0.75 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, 'Alpha' || p % 5 || 'Thing', 'symbol', 'REFERENCES', 'inline_code', 0.75 FROM {x}sec WHERE n = 2
  UNION ALL SELECT sid, 'New' || p % 3 || 'Thing', 'symbol', 'REFERENCES', 'inline_code', 0.75 FROM {x}sec WHERE n = 3 AND changed
  UNION ALL SELECT sid, 'callService' || p % 4 || '()', 'symbol', 'REFERENCES', 'code_block', 0.7 FROM {x}sec WHERE n = 1
  UNION ALL SELECT sid, '/p' || p + 1 || '.md', {api}, 'REFERENCES', 'markdown_link', 0.7 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, './p' || p + 1 || '.md', 'file_path', 'REFERENCES', 'markdown_link', 0.7 FROM {x}sec WHERE n = 0
  UNION ALL SELECT sid, '//example.com/' || p, {api}, 'REFERENCES', 'markdown_link', 0.7 FROM {x}sec WHERE n = 1
  UNION ALL SELECT id, 'Missing' || p % 6 || 'Thing', 'symbol', 'DEPENDS_ON', 'frontmatter', 0.85 FROM {x}doc
  UNION ALL SELECT id, 'p' || p - 1 || '.md', 'symbol', 'DEPENDS_ON', 'frontmatter', 0.85 FROM {x}doc a WHERE NOT EXISTS (SELECT 1 FROM {x}doc b WHERE b.p = a.p - 1)
), {x}ent AS (SELECT DISTINCT {entity.format("ekind", "name")} AS id, name, lower(name) AS normalized_name, ekind AS kind FROM {x}named
), {x}src AS (
  SELECT id AS from_id, 'src/' || host || '.ts' AS path, 'IMPLEMENTS' AS kind FROM {x}doc UNION ALL SELECT id, 'src/h' || p % 13 || '.ts', 'REFERENCES_SOURCE' FROM {x}doc
), {x}refs AS (SELECT {ref.format("path")} AS id, path FROM {x}src GROUP BY path
), {x}raw AS (
  SELECT id AS from_id, sid AS to_id, 'CONTAINS' AS kind, 'heading' AS provenance, 1.0 AS confidence FROM {x}sec
  UNION ALL SELECT sid, 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20), 'CONTAINS', 'heading', 1.0 FROM {x}sec
  UNION ALL SELECT from_id, {entity.format("ekind", "name")}, kind, provenance, confidence FROM {x}named
  UNION ALL SELECT from_id, {ref.format("path")}, kind, 'frontmatter', 1.0 FROM {x}src
  UNION ALL SELECT a.id, b.id, 'DEPENDS_ON', 'frontmatter', 1.0 FROM {x}doc a JOIN {x}doc b ON b.p = a.p - 1
  UNION ALL SELECT a.sid, b.sid, 'LINKS_TO', 'markdown_link', 0.9 FROM {x}sec a JOIN {x}sec b ON a.n = 0 AND b.n = 1 AND b.p = a.p + 1
  UNION ALL SELECT a.sid, b.id, 'LINKS_TO', 'wikilink', 0.9 FROM {x}sec a JOIN {x}doc b ON a.n = 0 AND b.p = a.p + 2
), {x}edge AS (
  SELECT 'edge:' || substr(sha1('edge:' || from_id || ':' || kind || ':' || to_id || ':' || provenance), 1, 20) AS id, from_id, to_id, kind, provenance, confidence::DOUBLE AS confidence,
    CASE kind WHEN 'CONTAINS' THEN 5.0 WHEN 'DEFINES' THEN 10.0 WHEN 'REFERENCES' THEN 4.0 WHEN 'DEPENDS_ON' THEN 9.0 WHEN 'LINKS_TO' THEN 7.0 WHEN 'IMPLEMENTS' THEN 8.0 ELSE 6.0 END::DOUBLE AS weight
  FROM (SELECT DISTINCT * FROM {x}raw)
), {x}owner AS (
  SELECT id AS node_id, id AS document_id, path FROM {x}doc UNION ALL SELECT sid, id, path FROM {x}sec UNION ALL SELECT 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20), id, path FROM {x}sec
)"""


_G = f"WITH {_PAGES}, {_sql()}"


def _oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# What the parser reads.


@query
def parsed_front(spark, d):
    front = [F.col(f"front.{c}").alias(c) for c in ("type", "status", "trust_tier")] + [F.concat_ws("|", f"front.{c}").alias(c) for c in ("tags", "defines", "depends_on", "implements", "source_refs")]
    return parsed(spark, d).select("path", "id", "title", F.col("front.id").alias("front_id"), F.col("body_line_offset").cast("long").alias("off"), *front)


_oracle("parsed_front", f"""{_G} SELECT path, id, title, front_id, off::BIGINT AS off, kind AS type, status, CASE WHEN p % 5 = 0 THEN 'generated' END AS trust_tier, 'a' || p % 7 || '|Bad Tag' AS tags, 'Host' || p % 11 || 'Store' AS defines,
  'p' || p - 1 || '.md|Missing' || p % 6 || 'Thing' AS depends_on, './src/' || host || '.ts' AS implements, 'src/h' || p % 13 || '.ts' AS source_refs FROM doc""")


@query
def parsed_links(spark, d):
    return parsed(spark, d).select("path", F.explode("md_links").alias("l")).select("path", F.col("l.line").cast("long").alias("line"), "l.text", "l.url")


_oracle("parsed_links", f"""{_G} SELECT path, (off + 4)::BIGINT AS line, 'next' AS text, './p' || p + 1 || '.md#links' AS url FROM doc UNION ALL SELECT path, off + 8, 'one', 'https://example.com/' || p FROM doc UNION ALL SELECT path, off + 9, 'gone', 'missing-' || p % 10 || '.md' FROM doc""")


@query
def parsed_wiki_links(spark, d):
    return parsed(spark, d).select("path", F.explode("wiki_links").alias("l")).select("path", F.col("l.line").cast("long").alias("line"), "l.raw", "l.target", "l.anchor", "l.alias")


_oracle("parsed_wiki_links", f"""{_G} SELECT path, (off + 4)::BIGINT AS line, '[[p' || p + 2 || '|Other ' || p || ']]' AS raw, 'p' || p + 2 AS target, NULL::VARCHAR AS anchor, 'Other ' || p AS alias FROM doc""")


@query
def parsed_code(spark, d):
    return parsed(spark, d).select("path", F.explode("code").alias("c")).select("path", F.col("c.line").cast("long").alias("line"), "c.language", "c.value", "c.inline")


_oracle("parsed_code", f"""{_G} SELECT path, (off + 4)::BIGINT AS line, NULL::VARCHAR AS language, 'Cache' || p % 8 || 'Reader' AS value, true AS inline FROM doc
UNION ALL SELECT path, off + 17, NULL, 'Alpha' || p % 5 || 'Thing', true FROM doc UNION ALL SELECT path, off + 11, 'ts', 'callService' || p % 4 || '()', false FROM doc""")


@query
def parsed_sections(spark, d):
    sections = graphs.build_sections(parsed(spark, d))
    return sections.select("id", "document_id", "anchor", "heading", F.col("level").cast("long").alias("level"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("content").cast("long").alias("chars"))


_oracle("parsed_sections", f"""{_G} SELECT sid AS id, id AS document_id, anchor, heading, level::BIGINT AS level, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
  length(CASE n WHEN 0 THEN '# Page ' || p || '..Prose names ERR_CODE_' || p % 17 || ' and GET /v1/items/' || p % 9 || ' here..See [next](./p' || p + 1 || '.md#links) and [[p' || p + 2 || '|Other ' || p || ']] or `Cache' || p % 8 || 'Reader`..'
    WHEN 1 THEN '## Links..- [one](https://example.com/' || p || ').- [gone](missing-' || p % 10 || '.md)..```ts.callService' || p % 4 || '().```.' WHEN 2 THEN '## Defines..- `Alpha' || p % 5 || 'Thing`.' ELSE '## Links..End.' END)::BIGINT AS chars FROM sec""")


def _faulty(spark, d):
    """Documents whose front matter is wrong in one of six ways."""
    rows = _pages(spark, d).select(F.col("page_id").alias("p"))
    fronts = ["---\nid: 3\ntype: novel\ntags: [a, 5]\n---\nx", "---\ntitle: open", "---\n- a\n---\nx", "---\na: [\n---\nx", "---\n\n---\nbody", "---\ntitle: ''\ntrust_tier: 7\ndefines: {a: b}\n---\nx"]
    text = F.lit("no front matter")
    for k, front in enumerate(fronts):
        text = F.when(F.col("p") % 7 == k, F.lit(front)).otherwise(text)
    return rows.select(F.concat(F.lit("f/"), F.col("p").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


@query
def front_diagnostics(spark, d):
    rows = parse_documents(_faulty(spark, d)).select("path", F.length("body").cast("long").alias("body_chars"), F.explode_outer("diagnostics").alias("x"))
    return rows.select("path", "body_chars", "x.code", F.col("x.line").cast("long").alias("line"), "x.field", "x.expected")


_oracle("front_diagnostics", """WITH rules(k, body_chars, code, line, field, expected) AS (VALUES
  (0, 1, 'front_matter.invalid_field', 2, 'id', 'non-empty string'), (0, 1, 'front_matter.invalid_field', 3, 'type', 'known document kind string'), (0, 1, 'front_matter.invalid_field', 4, 'tags', 'string or string array'),
  (1, 15, 'front_matter.unclosed', 1, NULL, NULL), (2, 1, 'front_matter.not_mapping', 2, NULL, NULL), (3, 1, 'front_matter.invalid_yaml', 2, NULL, NULL), (4, 4, NULL, NULL, NULL, NULL),
  (5, 1, 'front_matter.invalid_field', 2, 'title', 'non-empty string'), (5, 1, 'front_matter.invalid_field', 3, 'trust_tier', 'known trust tier string'), (5, 1, 'front_matter.invalid_field', 4, 'defines', 'string or string array'), (6, 15, NULL, NULL, NULL, NULL))
SELECT 'f/' || page_id || '.md' AS path, body_chars::BIGINT AS body_chars, code, line::BIGINT AS line, field, expected FROM pages JOIN rules ON k = page_id % 7""")


@query
def parse_budget(spark, d):
    """Documents of 4,997 headings and more, two nodes each: from 5,000 on they are skipped with a reason."""
    rows = _t(spark, d, "region").select(F.concat(F.lit("b/"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("path"), F.expr("repeat('# h\\n', 4997 + r_regionkey)").alias("text"))
    done = parse_documents(rows)
    return done.select("path", F.col("error").isNotNull().alias("skipped"), F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("sections"))


_oracle("parse_budget", """SELECT 'b/' || r_regionkey || '.md' AS path, r_regionkey > 2 AS skipped, CASE WHEN r_regionkey > 2 THEN 0 ELSE 4997 + r_regionkey END::BIGINT AS sections FROM region""")


@query
def url_references(spark, d):
    """Reference, anchor and reach of every link target of the corpus, and of all hrefs of the pages."""
    urls = parsed(spark, d).select(F.explode("md_links.url").alias("url")).unionByName(_t(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("url"))).distinct()
    reference, anchor = resolve.url_reference(F.col("url"))
    return urls.select("url", reference.alias("reference"), anchor.alias("anchor"), resolve.is_external(F.col("url")).alias("external"), health.is_local_link(F.col("url")).alias("local"))


_oracle("url_references", f"""{_G}, u AS (SELECT './p' || p + 1 || '.md#links' AS url FROM doc UNION SELECT 'https://example.com/' || p FROM doc UNION SELECT 'missing-' || p % 10 || '.md' FROM doc UNION SELECT href FROM hrefs)
SELECT url, split_part(url, '#', 1) AS reference, split_part(url, '#', 2) AS anchor, regexp_matches(url, '(?i)^(https?:|mailto:)') AS external, NOT regexp_matches(url, '(?i)^(https?:|mailto:|#)') AND regexp_matches(url, '(?i)\\.mdx?|#') AS local FROM u""")


# The graph.


@query
def graph_rows(spark, d):
    """Rows of each relation."""
    return stats.table_counts(graph(spark, d))


_oracle("graph_rows", f"""{_G} SELECT 'documents' AS relation, count(*) AS n FROM doc UNION ALL SELECT 'sections', count(*) FROM sec UNION ALL SELECT 'chunks', count(*) FROM sec UNION ALL SELECT 'entities', count(*) FROM ent
UNION ALL SELECT 'source_refs', count(*) FROM refs UNION ALL SELECT 'edges', count(*) FROM edge UNION ALL SELECT 'vectors', 0""")


@query
def graph_edges(spark, d):
    return graph(spark, d).edges.select("id", "from_id", "to_id", "kind", "provenance", F.round("confidence", 4).alias("confidence"), "weight")


_oracle("graph_edges", f"{_G} SELECT id, from_id, to_id, kind, provenance, round(confidence, 4) AS confidence, weight FROM edge")


@query
def graph_documents(spark, d):
    return graph(spark, d).documents.select("id", "path", "title", "type", "status", "trust_tier", F.concat_ws("|", "metadata.tags").alias("tags"), F.col("metadata.frontmatter_id").alias("front_id"))


_oracle("graph_documents", f"{_G} SELECT id, path, title, kind AS type, status, tier AS trust_tier, 'a' || p % 7 || '|Bad Tag' AS tags, front_id FROM doc")


@query
def graph_names(spark, d):
    """Entities and source paths."""
    g = graph(spark, d)
    return g.entities.select("id", "name", "normalized_name", "kind").unionByName(g.source_refs.select("id", F.col("path").alias("name"), "normalized_path", F.lit("source").alias("kind")).withColumnRenamed("normalized_path", "normalized_name"))


_oracle("graph_names", f"{_G} SELECT id, name, normalized_name, kind FROM ent UNION ALL SELECT id, path, lower(path), 'source' FROM refs")


@query
def emitted_names(spark, d):
    """Names by role and provenance after the stop list and the enabled kinds: no symbols in a link's text count, stops hold for references only."""
    rows = parsed(spark, d)
    config = Config(stop_entities=("Cache1Reader", " `alpha2thing` ", "links"), enabled_kinds=("symbol", "api_route"))
    found = graphs.extract_entities(graphs.emit_entities(rows, graphs.explode_parts(rows)), config)
    return found.groupBy("name", "kind", "role", "provenance").agg(F.count("*").alias("n"))


_oracle("emitted_names", f"""{_G} SELECT name, ekind AS kind, CASE kind WHEN 'DEFINES' THEN 'definition' ELSE 'reference' END AS role, provenance, count(*) AS n FROM named
WHERE kind <> 'DEPENDS_ON' AND ekind IN ('symbol', 'api_route') AND NOT (kind = 'REFERENCES' AND name IN ('Cache1Reader', 'Alpha2Thing', 'Links')) GROUP BY ALL""")


@query
def anchor_table(spark, d):
    """Slugs that lead to a section: its own anchor, and headings of another section of that slug."""
    return resolve.section_anchors(graphs.build_sections(parsed(spark, d)))


_oracle("anchor_table", f"{_G} SELECT id AS document_id, anchor AS slug, sid AS section_id FROM sec")


@query
def node_chunk_table(spark, d):
    """The chunk that stands for each document, section and chunk."""
    return context.node_chunks(graph(spark, d))


_oracle("node_chunk_table", f"""{_G}, c AS (SELECT id, sid, n, 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20) AS cid FROM sec)
SELECT cid AS node_id, cid AS chunk_id FROM c UNION ALL SELECT sid, cid FROM c UNION ALL SELECT id, cid FROM c WHERE n = 0""")


LOOKUPS = ("docs/P8.md#Links", "./docs\\p9#links 2", " docs/p8.MD ", "docs/p9", "title 10", "page-12", "SRC/h5.ts", "links", "page 14", "Host3Store", "err_code_2", "`get`", "get", "no such thing", "docs/p8.md#nowhere", "")


@query
def node_lookup(spark, d):
    """What names mean: paths with anchors, paths, titles, source paths, headings (all of them), entities."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df))
    ids = [r.id for r in g.chunks.orderBy("id").limit(1).collect()]
    rows = None
    for ask in (*LOOKUPS, *ids):
        found = traverse.resolve_node(g, ask).select(F.lit(ask if ask not in ids else "a chunk").alias("ask"), "id", "kind", F.col("rule").cast("long").alias("rule"), "ambiguous")
        rows = found if rows is None else rows.unionByName(found)
    return rows


_oracle("node_lookup", f"""{_G}, asks(ask, rule, kind, id) AS (
  SELECT 'docs/P8.md#Links', 2, 'section', sid FROM sec WHERE p = 8 AND anchor = 'links'
  UNION ALL SELECT './docs\\p9#links 2', 2, 'section', sid FROM sec WHERE p = 9 AND anchor = 'links-2'
  UNION ALL SELECT ' docs/p8.MD ', 3, 'document', id FROM doc WHERE p = 8 UNION ALL SELECT 'title 10', 3, 'document', id FROM doc WHERE title = 'Title 10'
  UNION ALL SELECT 'SRC/h5.ts', 4, 'source_ref', id FROM refs WHERE path = 'src/h5.ts' UNION ALL SELECT 'links', 5, 'section', sid FROM sec WHERE heading = 'Links'
  UNION ALL SELECT 'page 14', 5, 'section', sid FROM sec WHERE p = 14 AND n = 0 UNION ALL SELECT 'page-12', 5, 'section', sid FROM sec WHERE anchor = 'page-12'
  UNION ALL SELECT 'Host3Store', 6, 'entity', id FROM ent WHERE name = 'Host3Store' UNION ALL SELECT 'err_code_2', 6, 'entity', id FROM ent WHERE name = 'ERR_CODE_2'
  UNION ALL SELECT 'get', 6, 'entity', id FROM ent WHERE name = 'GET' UNION ALL SELECT 'a chunk', 1, 'chunk', min(node_id) FROM owner WHERE starts_with(node_id, 'chunk:') HAVING count(*) > 0)
SELECT ask, id, kind, rule::BIGINT AS rule, rule = 5 AND count(*) OVER (PARTITION BY ask) > 1 AS ambiguous FROM asks""")


@query
def incident_edges(spark, d):
    """All edges at one name, in both directions."""
    g = graph(spark, d)
    return traverse.incident_edges(storage.cut(g.edges), _entity("config_key", "get")).select("id", "from_id", "kind", "weight")


def _entity(kind: str, normalized: str) -> str:
    import hashlib

    return "entity:" + hashlib.sha1(f"entity:{kind}:{normalized}".encode()).hexdigest()[:20]


_oracle("incident_edges", f"{_G} SELECT id, from_id, kind, weight FROM edge WHERE to_id = (SELECT id FROM ent WHERE name = 'GET')")


@query
def document_links(spark, d):
    """Edges and definitions of every document, each edge once: orphans, weak links and missing definitions are read from these."""
    g = graph(spark, d)
    return stats.link_stats(storage.cut(g.edges), stats.typed_owners(g), g.documents, fan_out=False)


_oracle("document_links", f"""{_G}, met AS (SELECT DISTINCT o.document_id, e.id, e.kind FROM edge e JOIN owner o ON o.node_id IN (e.from_id, e.to_id) WHERE e.kind <> 'CONTAINS')
SELECT doc.id AS document_id, count(met.id) AS links, count(*) FILTER (met.kind = 'DEFINES') AS definitions FROM doc LEFT JOIN met ON met.document_id = doc.id GROUP BY doc.id""")


@query
def document_frequencies(spark, d):
    """Documents that each name is tied to."""
    g = graph(spark, d)
    return stats.document_frequency(storage.cut(g.edges), stats.owners(g), g.entities)


_oracle("document_frequencies", f"""{_G} SELECT ent.id, count(DISTINCT o.document_id) AS documents FROM ent JOIN edge e ON e.to_id = ent.id JOIN owner o ON o.node_id = e.from_id GROUP BY ent.id""")


@query
def export_nodes(spark, d):
    """Nodes of the structural export, with labels and sort keys."""
    return export.graph_nodes(graph(spark, d)).select("id", "kind", "label", "sort_a", F.col("sort_b").cast("long").alias("sort_b"))


_oracle("export_nodes", f"""{_G} SELECT id, 'document' AS kind, title AS label, path AS sort_a, 0::BIGINT AS sort_b FROM doc UNION ALL SELECT sid, 'section', heading, path, start_line FROM sec
UNION ALL SELECT id, 'entity', name, kind, 0 FROM ent UNION ALL SELECT id, 'source_ref', path, lower(path), 0 FROM refs""")


@query
def export_edges(spark, d):
    """Edges of the structural export: both ends are exported, so chunks' containment isn't."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df) if name in ("edges", "entities") else df)
    return export.structural_edges(g.edges, export.graph_nodes(g)).select("id", "kind")


_oracle("export_edges", f"{_G} SELECT id, kind FROM edge WHERE NOT starts_with(to_id, 'chunk:')")


@query
def site_lists(spark, d):
    """What a documentation site lists of each document: what it defines, its sources, and documents both ways."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df) if name in ("edges", "entities", "sections") else df)
    index = export.site_index(g.documents.select("id", "path"), stats.owners(g), g.edges, stats.node_labels(g))
    return index.select("path", *(F.concat_ws(",", n).alias(n) for n in ("defines", "source_refs", "outbound", "inbound")))


_oracle("site_lists", f"""{_G}, across AS (SELECT DISTINCT a.path AS f, b.path AS t FROM edge e JOIN owner a ON a.node_id = e.from_id JOIN owner b ON b.node_id = e.to_id WHERE e.kind <> 'CONTAINS' AND a.path <> b.path)
SELECT path, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM named JOIN owner o ON o.node_id = from_id WHERE kind = 'DEFINES' AND o.path = doc.path) AS defines,
  (SELECT string_agg(DISTINCT s.path, ',' ORDER BY s.path) FROM src s WHERE s.from_id = doc.id) AS source_refs,
  coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM across WHERE f = doc.path), '') AS outbound, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM across WHERE t = doc.path), '') AS inbound FROM doc""")


@query
def collapsed_paths(spark, d):
    """Paths with `.` and `..` resolved as far as there is something to leave."""
    shapes = ("x/{}/../y/./{}", "../{}", "a//b/{}", "./{}/..", "a/../../{}/c", "/{}/d")
    ids = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), (F.col("o_orderkey") % len(shapes)).cast("int").alias("s"))
    raw = F.replace(F.element_at(F.array(*map(F.lit, shapes)), F.col("s") + 1), F.lit("{}"), F.col("k"))
    return ids.select("k", resolve.collapse(raw).alias("path"))


_oracle("collapsed_paths", """SELECT o_orderkey::VARCHAR AS k, CASE o_orderkey % 6 WHEN 0 THEN 'x/y/' || o_orderkey WHEN 1 THEN '../' || o_orderkey WHEN 2 THEN 'a/b/' || o_orderkey WHEN 3 THEN '' WHEN 4 THEN '../' || o_orderkey || '/c' ELSE o_orderkey || '/d' END AS path FROM orders""")


@query
def case_metrics(spark, d):
    """All metrics of one evaluation case over the corpus."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df))
    case = evaluate.Case("one", "!", entities=("Host3Store", "nobody"), edges=("DEFINES", "SAME_AS"), source_refs=("src/h3.ts", "src/none.ts"), sections=(("docs/p8.md", "Links"),), trace=("docs/p8.md", "docs/p9.md", 3, ("DEPENDS_ON",)))
    result = evaluate.evaluate_case(search.passing_search_index(g), case, Config())
    rows = [(name, float(value)) for name, value in result.metrics.items() if isinstance(value, (int, float))] + [("passed", float(result.passed))]
    return spark.createDataFrame(rows, "metric string, value double")


_oracle("case_metrics", """SELECT * FROM (VALUES ('document_recall', 1.0::DOUBLE), ('section_recall', 0.0), ('context_precision', 0.0), ('entity_recall', 0.5), ('source_ref_recall', 0.5), ('edge_coverage', 0.5), ('trace_success', 1.0), ('returned_chars', 0.0), ('budget_fit', 1.0),
  ('reason_coverage', 1.0), ('fusion_coverage', 1.0), ('context_diversity', 0.0), ('passed', 0.0)) v(metric, value)""")


@query
def markdown_index_lines(spark, d):
    """The vault index of linked notes, a block of Markdown for each document."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df) if name in ("edges", "entities", "sections") else df)
    return export.markdown_index(export.site_index(g.documents.select("id", "path"), stats.owners(g), g.edges, stats.node_labels(g)), "")


_oracle("markdown_index_lines", f"""{_G}, across AS (SELECT DISTINCT a.path AS f, b.path AS t FROM edge e JOIN owner a ON a.node_id = e.from_id JOIN owner b ON b.node_id = e.to_id WHERE e.kind <> 'CONTAINS' AND a.path <> b.path)
SELECT '### [[' || path || ']]' || chr(10) || chr(10) || '- Defines: ' || (SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM named JOIN owner o ON o.node_id = from_id WHERE kind = 'DEFINES' AND o.path = doc.path) || chr(10)
  || '- Source refs: ' || (SELECT string_agg(DISTINCT s.path, ', ' ORDER BY s.path) FROM src s WHERE s.from_id = doc.id) || chr(10) || '- Outbound links: ' || coalesce((SELECT string_agg(t, ', ' ORDER BY t) FROM across WHERE f = doc.path), 'none') || chr(10)
  || '- Inbound links: ' || coalesce((SELECT string_agg(f, ', ' ORDER BY f) FROM across WHERE t = doc.path), 'none') || chr(10) AS value FROM doc""")


ASKED = ("Alpha2Thing", "links", "Host3Store", "no such name")


@query
def definition_channel(spark, d):
    """The three best definitions of each name that a question asks for, as search ranks them."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df))
    asked = spark.createDataFrame([(n.lower(), i) for i, n in enumerate(ASKED)], "normalized_name string, turn int")
    found = search.definition_rows(g, g.entities.join(asked, "normalized_name").select("id", "turn"))
    return found.select("chunk_id", "weight", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


_oracle("definition_channel", f"""{_G}, asked(name, turn) AS (VALUES ('Alpha2Thing', 0), ('Links', 1), ('Host3Store', 2)), first_chunk AS (
  SELECT sid AS node, 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20) AS chunk_id, path, start_line FROM sec UNION ALL SELECT id, 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20), path, NULL FROM sec WHERE n = 0),
ranked AS (SELECT chunk_id, e.weight, turn, row_number() OVER (PARTITION BY ent.id ORDER BY e.weight DESC, c.path, c.start_line NULLS FIRST, e.id) AS place
  FROM asked JOIN ent ON ent.name = asked.name JOIN edge e ON e.to_id = ent.id AND e.kind = 'DEFINES' JOIN first_chunk c ON c.node = e.from_id)
SELECT chunk_id, weight, turn::BIGINT AS turn, place FROM ranked WHERE place <= 3""")


# Change.

_TWO = f"WITH {_PAGES}, {_sql(OLD, 'o_')}, {_sql(NEW, 'n_')}"


@query
def replace_edges(spark, d):
    """Edges after an incremental run: those of gone and changed documents leave, what touches new ones comes."""
    old, new = (graph(spark, d, s).map(lambda name, df: storage.cut(df)) for s in (OLD, NEW))
    changes = storage.cut(store.changed_documents(old.documents, new.documents))
    return store.replace_documents(old, new, changes).edges.select("id", "kind", F.round("confidence", 4).alias("confidence"))


_CHANGED = """gone AS (SELECT p FROM o_doc WHERE p % 10 = 7 OR p % 5 = 2), came AS (SELECT p FROM n_doc WHERE p % 10 = 3 OR p % 5 = 2),
goners AS (SELECT node_id FROM o_owner JOIN o_doc ON o_doc.id = document_id WHERE p IN (SELECT p FROM gone)), comers AS (SELECT node_id FROM n_owner JOIN n_doc ON n_doc.id = document_id WHERE p IN (SELECT p FROM came)),
kept AS (SELECT id, from_id, to_id, kind, confidence FROM o_edge WHERE from_id NOT IN (SELECT node_id FROM goners) AND to_id NOT IN (SELECT node_id FROM goners)),
fresh AS (SELECT id, from_id, to_id, kind, confidence FROM n_edge WHERE from_id IN (SELECT node_id FROM comers) OR to_id IN (SELECT node_id FROM comers)),
now AS (SELECT * FROM fresh UNION ALL SELECT * FROM kept WHERE id NOT IN (SELECT id FROM fresh))"""
_oracle("replace_edges", f"{_TWO}, {_CHANGED} SELECT id, kind, round(confidence, 4) AS confidence FROM now")


@query
def replace_nodes(spark, d):
    """All other relations after the same run, vectors too; names and source paths that no edge touches any more are pruned."""
    config = Config(embedding_enabled=True, embedding_dimensions=4)
    old, new = (graph(spark, d, s, config).map(lambda name, df: storage.cut(df)) for s in (OLD, NEW))
    changes = storage.cut(store.changed_documents(old.documents, new.documents))
    tables = store.replace_documents(old, new, changes).tables()
    rows = None
    for name in ("documents", "sections", "entities", "source_refs", "chunks"):
        part = tables[name].select(F.lit(name).alias("relation"), "id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.unionByName(tables["vectors"].select(F.lit("vectors").alias("relation"), F.col("chunk_id").alias("id")))


_oracle("replace_nodes", f"""{_TWO}, {_CHANGED}, ends AS (SELECT from_id AS id FROM now UNION SELECT to_id FROM now),
docs_now AS (SELECT id FROM n_doc WHERE p IN (SELECT p FROM came) UNION SELECT id FROM o_doc WHERE p NOT IN (SELECT p FROM gone)),
secs_now AS (SELECT id, sid FROM n_sec WHERE p IN (SELECT p FROM came) UNION SELECT id, sid FROM o_sec WHERE p NOT IN (SELECT p FROM gone))
SELECT 'documents' AS relation, id FROM docs_now UNION ALL SELECT 'sections', sid FROM secs_now UNION ALL SELECT 'chunks', 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20) FROM secs_now
UNION ALL SELECT 'vectors', 'chunk:' || substr(sha1('chunk:' || sid || ':content'), 1, 20) FROM secs_now
UNION ALL SELECT 'entities', id FROM (SELECT id FROM o_ent UNION SELECT id FROM n_ent) WHERE id IN (SELECT id FROM ends) UNION ALL SELECT 'source_refs', id FROM (SELECT id FROM o_refs UNION SELECT id FROM n_refs) WHERE id IN (SELECT id FROM ends)""")


@query
def snapshot_rows(spark, d):
    """Per document: sections and source references, by which two states are compared."""
    return diff.snapshot(graph(spark, d, NEW)).select("path", "status", "type", "sections", "source_refs")


_oracle("snapshot_rows", f"WITH {_PAGES}, {_sql(NEW)} SELECT path, status, kind AS type, 4::BIGINT AS sections, 1::BIGINT AS source_refs FROM doc")


@query
def graph_diff_details(spark, d):
    """Documents that differ between two states, with how many sections and source references they gained."""
    old, new = graph(spark, d, OLD), graph(spark, d, NEW)
    return diff.graph_diff(old, new)["documents"].select("path", "change", "section_delta", "source_ref_delta")


_oracle("graph_diff_details", f"""{_TWO} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'deleted' ELSE 'modified' END AS change,
  CASE WHEN o.p IS NULL THEN 4 WHEN n.p IS NULL THEN -4 ELSE 0 END::BIGINT AS section_delta, CASE WHEN o.p IS NULL THEN 1 WHEN n.p IS NULL THEN -1 ELSE 0 END::BIGINT AS source_ref_delta
FROM o_doc o FULL JOIN n_doc n ON o.p = n.p WHERE o.p IS NULL OR n.p IS NULL OR n.changed""")


# Health.


def _source_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"src/h{k}.ts",) for k in range(6)], "path string")


@query
def doctor_counts(spark, d):
    """All rules over the corpus at once: warnings by code."""
    rows = parsed(spark, d)
    g = graphs.build_graph(rows).map(lambda name, df: storage.cut(df))
    report = health.doctor(rows, g, Config(), _source_files(spark))
    return report.warnings.where(~F.col("code").startswith("storage.")).groupBy("code", "severity").agg(F.count("*").alias("n"))


_oracle("doctor_counts", f"""{_G}, active AS (SELECT * FROM doc WHERE status = 'active'), uses AS (SELECT a.p, b.p AS q FROM active a JOIN doc b ON b.p IN (a.p + 1, a.p + 2) WHERE b.status = 'deprecated'),
dead AS (SELECT p FROM doc UNION ALL SELECT p FROM doc a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 1) UNION ALL SELECT p FROM doc a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 2)),
twice AS (SELECT name FROM named JOIN owner o ON o.node_id = from_id JOIN active ON active.id = o.document_id WHERE named.kind = 'DEFINES' GROUP BY name HAVING count(DISTINCT o.document_id) > 1),
missing AS (SELECT path FROM refs WHERE NOT regexp_matches(path, '^src/h[0-5]\\.ts$')), wrong AS (SELECT p FROM doc),
found AS (
  SELECT 'link.dead' AS code, 'error' AS severity, count(*) AS n FROM dead UNION ALL SELECT 'source_ref.missing', 'error', count(*) FROM missing UNION ALL SELECT 'definition.duplicate', 'warn', count(*) FROM twice
  UNION ALL SELECT 'tag.invalid_format', 'warn', count(*) FROM doc UNION ALL SELECT 'front_matter.invalid_field', 'warn', count(*) FROM wrong UNION ALL SELECT 'document.deprecated_referenced', 'warn', count(*) FROM uses)
SELECT * FROM found WHERE n > 0""")


@query
def missing_source_paths(spark, d):
    """Source paths that don't exist, and which documents name them."""
    rows = parsed(spark, d)
    g = graphs.build_graph(rows)
    found = health.doctor(rows, g.map(lambda name, df: storage.cut(df)), Config(), _source_files(spark)).rules["missing_sources"]
    return found.select("path", "expected", F.size("documents").cast("long").alias("documents"))


_oracle("missing_source_paths", f"""{_G} SELECT s.path, s.path AS expected, count(DISTINCT from_id) AS documents FROM src s WHERE NOT regexp_matches(s.path, '^src/h[0-5]\\.ts$') GROUP BY s.path""")


@query
def scope_neighbours(spark, d):
    """Documents of a scope: two changed paths, a deleted one, and what is one edge away."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df))
    return health.scope_paths(health.Scope("changed", ("docs/p8.md", "docs/p20.md"), ("docs/lost.md",)), g)


_oracle("scope_neighbours", f"""{_G}, named_paths(path) AS (VALUES ('docs/p8.md'), ('docs/p20.md'), ('docs/lost.md')), nodes AS (SELECT node_id FROM owner WHERE path IN (SELECT path FROM named_paths)),
near AS (SELECT to_id AS n FROM edge WHERE kind <> 'CONTAINS' AND from_id IN (SELECT node_id FROM nodes) UNION SELECT from_id FROM edge WHERE kind <> 'CONTAINS' AND to_id IN (SELECT node_id FROM nodes))
SELECT path FROM named_paths UNION SELECT o.path FROM owner o JOIN near ON near.n = o.node_id""")


@query
def doctor_scoped(spark, d):
    """All rules for the documents of a scope, with a document that was deleted: warnings by code."""
    rows = parsed(spark, d)
    g = graphs.build_graph(rows).map(lambda name, df: storage.cut(df))
    scope = health.Scope("changed", ("docs/p8.md", "docs/p20.md"), ("docs/lost.md",))
    return health.doctor(rows, g, Config(), _source_files(spark), scope).warnings.groupBy("code", "severity").agg(F.count("*").alias("n"))


_oracle("doctor_scoped", f"""{_G}, named_paths(path) AS (VALUES ('docs/p8.md'), ('docs/p20.md'), ('docs/lost.md')), nodes AS (SELECT node_id FROM owner WHERE path IN (SELECT path FROM named_paths)),
near AS (SELECT to_id AS n FROM edge WHERE kind <> 'CONTAINS' AND from_id IN (SELECT node_id FROM nodes) UNION SELECT from_id FROM edge WHERE kind <> 'CONTAINS' AND to_id IN (SELECT node_id FROM nodes)),
scope AS (SELECT path FROM named_paths UNION SELECT o.path FROM owner o JOIN near ON near.n = o.node_id), ours AS (SELECT * FROM doc WHERE path IN (SELECT path FROM scope)), active AS (SELECT * FROM doc WHERE status = 'active'),
uses AS (SELECT a.p FROM active a JOIN doc b ON b.p IN (a.p + 1, a.p + 2) WHERE b.status = 'deprecated' AND (a.path IN (SELECT path FROM scope) OR b.path IN (SELECT path FROM scope))),
dead AS (SELECT p FROM ours UNION ALL SELECT p FROM ours a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 1) UNION ALL SELECT p FROM ours a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 2)),
twice AS (SELECT name FROM named JOIN owner o ON o.node_id = from_id JOIN active ON active.id = o.document_id WHERE named.kind = 'DEFINES' GROUP BY name HAVING count(DISTINCT o.document_id) > 1 AND bool_or(active.path IN (SELECT path FROM scope))),
missing AS (SELECT DISTINCT path FROM src WHERE NOT regexp_matches(path, '^src/h[0-5]\\.ts$') AND from_id IN (SELECT id FROM ours)),
found AS (
  SELECT 'link.dead' AS code, 'error' AS severity, count(*) AS n FROM dead UNION ALL SELECT 'source_ref.missing', 'error', count(*) FROM missing UNION ALL SELECT 'definition.duplicate', 'warn', count(*) FROM twice UNION ALL SELECT 'document.deleted', 'info', 1
  UNION ALL SELECT 'tag.invalid_format', 'warn', count(*) FROM ours UNION ALL SELECT 'front_matter.invalid_field', 'warn', count(*) FROM ours UNION ALL SELECT 'document.deprecated_referenced', 'warn', count(*) FROM uses)
SELECT * FROM found WHERE n > 0""")


@query
def dead_link_rows(spark, d):
    """Links of the corpus that lead nowhere, by line."""
    rows = parsed(spark, d)
    aliases = resolve.document_aliases(rows.select("id", "path", "title", F.col("front.id").alias("front_id")))
    anchors = resolve.section_anchors(graphs.build_sections(rows))
    return health.dead_links(rows, aliases, anchors).select("path", F.col("line").cast("long").alias("line"), "target", "kind")


_oracle("dead_link_rows", f"""{_G} SELECT path, (off + 9)::BIGINT AS line, 'missing-' || p % 10 || '.md' AS target, 'markdown' AS kind FROM doc
UNION ALL SELECT path, off + 4, './p' || p + 1 || '.md#links', 'markdown' FROM doc a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 1)
UNION ALL SELECT path, off + 4, '[[p' || p + 2 || '|Other ' || p || ']]', 'wikilink' FROM doc a WHERE NOT EXISTS (SELECT 1 FROM doc b WHERE b.p = a.p + 2)""")


@query
def most_connected(spark, d):
    """The ten documents of most edges, as a health report shows them."""
    rows = parsed(spark, d)
    g = graphs.build_graph(rows).map(lambda name, df: storage.cut(df))
    best = health.doctor(rows, g, Config(), _source_files(spark)).health["most_connected"]
    return best.select("path", "links", "definitions")


_oracle("most_connected", f"""{_G}, cells AS (SELECT a.id AS document_id, a.path, a.sid, 'chunk:' || substr(sha1('chunk:' || b.sid || ':content'), 1, 20) AS cid FROM sec a JOIN sec b ON b.id = a.id),
spots AS (SELECT path, sid, cid, document_id AS node FROM cells UNION ALL SELECT path, sid, cid, sid FROM cells UNION ALL SELECT path, sid, cid, cid FROM cells),
met AS (SELECT DISTINCT s.path, s.sid, s.cid, e.id, e.kind FROM spots s JOIN edge e ON s.node IN (e.from_id, e.to_id) WHERE e.kind <> 'CONTAINS')
SELECT path, count(*) AS links, count(*) FILTER (kind = 'DEFINES') AS definitions FROM met GROUP BY path ORDER BY links DESC, path LIMIT 10""")


@query
def storage_findings(spark, d):
    """What a report says of storage: generated folders, high-degree names, sizes, vectors that are missing."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.element_at(F.array(*map(F.lit, ("docs", "dist", "build", "vendor"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    degrees = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("node_id")).agg((F.count("*") * 13).alias("degree")).withColumn("label", F.lit(None).cast("string"))
    return health.storage_warnings(stats.path_groups(rows), degrees, 200 * 1024 * 1024, 150 * 1024 * 1024, 3, 4).select("code", "severity", "path", "evidence.degree", "evidence.documents")


_oracle("storage_findings", """WITH g AS (SELECT ['docs', 'dist', 'build', 'vendor'][doc_id % 4 + 1] AS path, count(*) AS n FROM documents GROUP BY 1)
SELECT 'storage.generated_path_indexed' AS code, 'warn' AS severity, path, NULL::VARCHAR AS degree, n::VARCHAR AS documents FROM g WHERE path <> 'docs'
UNION ALL SELECT 'storage.high_degree_node', 'info', NULL, (13 * count(*))::VARCHAR, NULL FROM supplier GROUP BY s_nationkey HAVING 13 * count(*) >= 50
UNION ALL SELECT code, severity, NULL, NULL, NULL FROM (VALUES ('storage.database_oversized', 'warn'), ('storage.fts_shadow_large', 'info'), ('storage.vector_anomaly', 'warn')) v(code, severity)""")


@query
def affected_documents(spark, d):
    """Documents that differ between two states, or whose warnings do."""
    old, new = graph(spark, d, OLD), graph(spark, d, NEW)
    codes = [g.documents.select("path", F.when(F.col("status") == "draft", "a").otherwise("b").alias("code")).where(f"substr(path, 7, 1) <> '{k}'") for k, g in (("1", old), ("2", new))]
    return diff.graph_diff(old, new, None, *codes)["affected"]


_oracle("affected_documents", f"""{_TWO}, a AS (SELECT path, CASE status WHEN 'draft' THEN 'a' ELSE 'b' END AS code FROM o_doc WHERE substr(path, 7, 1) <> '1'), b AS (SELECT path, CASE status WHEN 'draft' THEN 'a' ELSE 'b' END AS code FROM n_doc WHERE substr(path, 7, 1) <> '2')
SELECT coalesce(n.path, o.path) AS path FROM o_doc o FULL JOIN n_doc n ON o.p = n.p WHERE o.p IS NULL OR n.p IS NULL OR n.changed UNION SELECT coalesce(a.path, b.path) FROM a FULL JOIN b ON a.path = b.path WHERE a.code IS DISTINCT FROM b.code""")


# Questions.

BUDGET = 3000


@query
def context_known_file(spark, d):
    """A packed context for a source path that the asker knows: documents tied to it, until the budget is used up."""
    g = graph(spark, d).map(lambda name, df: storage.cut(df))
    found = context.build_context(search.passing_search_index(g), "!", Config(), max_chars=BUDGET, known_files=["src/h3.ts"])
    rows = [(i, x["path"], x["heading"], x["reason"], x["content"].endswith("..."), ",".join(r["path"] for r in x["sourceRefs"]), ",".join(x["riskNotes"])) for i, x in enumerate(found["items"], 1)]
    return spark.createDataFrame(rows, "place long, path string, heading string, reason string, cut boolean, sources string, notes string")


_oracle("context_known_file", f"""{_G}, c AS (SELECT doc.*, length('# Page ' || p || '..Prose names ERR_CODE_' || p % 17 || ' and GET /v1/items/' || p % 9 || ' here..See [next](./p' || p + 1 || '.md#links) and [[p' || p + 2 || '|Other ' || p || ']] or `Cache' || p % 8 || 'Reader`..') AS n, e.id AS eid
  FROM doc JOIN edge e ON e.from_id = doc.id AND e.kind = 'REFERENCES_SOURCE' WHERE p % 13 = 3),
packed AS (SELECT *, row_number() OVER (ORDER BY eid) AS place, sum(n) OVER (ORDER BY eid) AS upto FROM c)
SELECT place, path, 'Page ' || p AS heading, 'known file src/h3.ts via REFERENCES_SOURCE/frontmatter' AS reason, upto > {BUDGET} AS cut, CASE WHEN host < 'h3' THEN 'src/' || host || '.ts,src/h3.ts' ELSE 'src/h3.ts,src/' || host || '.ts' END AS sources,
  concat_ws(',', CASE WHEN status <> 'active' THEN 'document status: ' || status END, CASE tier WHEN 'generated' THEN 'trust tier: generated' END) AS notes FROM packed WHERE upto - n < {BUDGET}""")


QUESTIONS = ("where is `Session Store` and SessionStore.get?", "GET /v1/items or API_KEY", "a b c d e f g", "会话 auth_token", "!", "and or not near")


@query
def question_reading(spark, d):
    """How questions are read: names, prefixes, and the mode that suits them in a collection of 150 documents and of 10."""
    rows = []
    for q in QUESTIONS:
        few, many = (search.agent_mode(q, n, Config()) for n in (10, 150))
        rows.append((q, "|".join(search.query_entity_candidates(q)), "|".join(prefix_terms(q)), few["limit"], few["max_depth"], few["max_chars"], many["limit"], many["max_depth"], many["max_chars"]))
    return spark.createDataFrame(rows, "question string, names string, prefixes string, limit long, depth long, chars long, many_limit long, many_depth long, many_chars long")


_oracle("question_reading", """SELECT * FROM (VALUES
  ('where is `Session Store` and SessionStore.get?', 'Session Store|Session|Store|SessionStore.get', 'where|is|session|store|sessionstore|get', 8, 2, 16000, 12, 3, 28000),
  ('GET /v1/items or API_KEY', 'GET|API_KEY|/v1/items', 'get|v1|items|api|key', 8, 2, 16000, 12, 3, 28000), ('a b c d e f g', '', '', 12, 3, 28000, 16, 3, 28000),
  ('会话 auth_token', '', '会话|auth|token', 8, 2, 16000, 12, 3, 28000), ('!', '', '', 8, 2, 16000, 12, 3, 28000), ('and or not near', '', '', 8, 2, 16000, 12, 3, 28000))
  v(question, names, prefixes, "limit", depth, chars, many_limit, many_depth, many_chars)""")


@query
def index_texts(spark, d):
    """What the full-text index sees of a text: CJK n-grams on a line of their own."""
    more = spark.createDataFrame([(-1, "会话管理 x"), (-2, "設計 会"), (-3, "")], "doc_id long, text string")
    rows = _t(spark, d, "documents").select("doc_id", "text").unionByName(more)
    return rows.select("doc_id", content_hash(index_content(F.col("text"))).alias("hash"))


_oracle("index_texts", """SELECT doc_id, sha256(text) AS hash FROM documents
UNION ALL SELECT * FROM (VALUES (-1, sha256('会话管理 x' || chr(10) || '会话 话管 管理 会话管 话管理')), (-2, sha256('設計 会' || chr(10) || '設計')), (-3, sha256('')))""")


@query
def dot_products(spark, d):
    """Products with a fixed vector over the shorter length, stored components rounded."""
    asked = [0.5, -1.0, 0.25] + [0.001 * k for k in range(40)]
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), asked), 5).alias("product"))


_oracle("dot_products", """SELECT vec_id, round(list_sum(list_transform(range(1, 44), lambda i: round(embedding[i]::DOUBLE, 6) * CASE i WHEN 1 THEN 0.5 WHEN 2 THEN -1.0 WHEN 3 THEN 0.25 ELSE 0.001 * (i - 4) END)), 5) + 0.0 AS product FROM embeddings""")


@query
def vector_join(spark, d):
    """The most similar vectors with the documents they belong to."""
    rows = _t(spark, d, "embeddings")
    near = vectors.similar_vectors(rows, [1.0] * 64, 10, id_col="vec_id", vector_col="embedding")
    return near.join(_t(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", F.round("similarity", 5).alias("similarity"), "lang", "source")


_oracle("vector_join", """WITH s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))) AS similarity FROM embeddings), best AS (SELECT * FROM s WHERE s.similarity > 0 ORDER BY s.similarity DESC, vec_id LIMIT 10)
SELECT vec_id, round(similarity, 5) AS similarity, lang, source FROM best JOIN documents ON doc_id = vec_id""")


# Records.


@query
def invalid_run_rows(spark, d):
    """Run records that lack a field or hold a value out of range."""
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).otherwise(" ").alias("question_id"), F.lit("q").alias("question"), F.when(F.col("o_orderstatus") == "F", "with").when(F.col("o_orderstatus") == "O", "without").otherwise("maybe").alias("mode"), F.lit(None).cast("double").alias("token_estimate"), F.lit(1.0).alias("character_budget"), (F.col("o_totalprice") - 1000).alias("latency_ms"))
    return paired.invalid_runs(rows)


_oracle("invalid_run_rows", """SELECT o_orderkey::VARCHAR AS id, 'question_id is missing' AS problem FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'mode must be with or without' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey::VARCHAR, 'latency_ms is negative' FROM orders WHERE o_totalprice < 1000""")


@query
def run_metric_rows(spark, d):
    """All metrics of run records; citations count by path where a question's sources are known."""
    return _all_metrics(spark, d).select("question_id", "mode", *(F.round(F.col(m).cast("double"), 3).alias(m) for m in paired.METRICS))


def _all_metrics(spark, d):
    rows = _runs(spark, d).withColumns(
        {
            "direct_file_reads": F.transform("tool_calls", lambda c: F.struct(c["name"].alias("path"), (c["output_chars"] * 2).alias("chars"))),
            "graph_calls": F.transform(F.slice("tool_calls", 1, 3), lambda c: F.struct(F.lit("search").alias("tool"), c["name"].alias("query"), F.lit(1.0).alias("result_count"), F.lit(7.0).alias("chars"))),
            "text_searches": F.transform(F.slice("tool_calls", 1, 2), lambda c: F.struct(c["name"].alias("query"), F.lit(1.0).alias("result_count"))),
            "raw_file_fallback": F.col("mode") == "without",
        }
    )
    known = rows.select("question_id").distinct().where(F.length("question_id") > 5).withColumn("paths", F.array("question_id"))
    return paired.run_metrics(rows, known)


@query
def paired_deltas_all(spark, d):
    """All fifteen deltas of complete pairs, with less without; null where either has no value."""
    deltas, _ = paired.pair_runs(_all_metrics(spark, d))
    return deltas.select("question_id", *(F.round(F.col(m).cast("double"), 3).alias(m) for m in paired.METRICS))


_oracle("run_metric_rows", """WITH m AS (
  SELECT event_type AS question_id, CASE WHEN user_id % 2 = 0 THEN 'with' ELSE 'without' END AS mode, count(*) AS n, sum(round(value, 2)) AS chars, count(*) FILTER (value > 50) AS cites, count(*) FILTER (value > 100) AS good, min(user_id) AS low
  FROM events GROUP BY 1, 2 HAVING NOT (event_type = 'purchase' AND mode = 'with')
), c AS (SELECT *, CASE WHEN length(question_id) > 5 THEN cites ELSE good END AS fit FROM m)
SELECT question_id, mode, n::DOUBLE AS tool_calls, round(chars, 3) AS tool_output_chars, n::DOUBLE AS file_reads, round(2 * chars, 3) AS file_chars, least(2, n)::DOUBLE AS text_searches, least(3, n)::DOUBLE AS graph_calls, 7.0 * least(3, n)::DOUBLE AS graph_chars,
  cites::DOUBLE AS citations, fit::DOUBLE AS correct_citations, cites::DOUBLE AS known_citations, round(round(fit / nullif(cites, 0), 4), 3) AS citation_rate, CASE mode WHEN 'without' THEN 1.0 ELSE 0.0 END AS fallback, NULL::DOUBLE AS token_estimate, NULL::DOUBLE AS character_budget, low::DOUBLE AS latency_ms FROM c""")


_oracle("paired_deltas_all", f"""WITH r AS ({ORACLES["run_metric_rows"].replace("round(round(fit / nullif(cites, 0), 4), 3) AS citation_rate", "round(fit / nullif(cites, 0), 4) AS citation_rate")}), w AS (SELECT * FROM r WHERE mode = 'with'), o AS (SELECT * FROM r WHERE mode = 'without')
SELECT w.question_id, {", ".join(f"round(w.{m} - o.{m}, 3) AS {m}" for m in paired.METRICS)} FROM w JOIN o USING (question_id)""")


@query
def delta_totals(spark, d):
    """Sums of paired deltas and means of rates, null where no pair has a value."""
    deltas, _ = paired.pair_runs(paired.run_metrics(_runs(spark, d)))
    return paired.aggregate_deltas(deltas).select("pairs", "tool_calls", F.round("tool_output_chars", 2).alias("tool_output_chars"), "citations", F.round("citation_rate", 3).alias("citation_rate"), "latency_ms", "token_estimate")


_oracle("delta_totals", f"""WITH d AS ({ORACLES["paired_delta"]}) SELECT count(*) AS pairs, sum(tool_calls) AS tool_calls, round(sum(tool_output_chars), 2) AS tool_output_chars, sum(citations) AS citations, round(avg(citation_rate), 3) AS citation_rate, sum(latency_ms) AS latency_ms, sum(token_estimate) AS token_estimate FROM d""")


@query
def latest_index_time(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderdate").alias("indexed_at"))
    none = spark.createDataFrame([], "id string")
    return stats.latest_index_time(graphs.Graph(rows, *[none] * 6)).select(F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))


_oracle("latest_index_time", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS indexed_at FROM orders")


@query
def artifact_files(spark, d):
    """Files and symbols of a code artifact, read back from JSON; a file without a path doesn't count."""
    import json
    import uuid

    storage.cut(spark.range(1))
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/artifact-{uuid.uuid4().hex}.json"
    files = [{"path": f"src/{r.n_name}.ts" if r.n_nationkey % 4 else None, "symbols": [{"name": r.n_name, "kind": "class"}] * (r.n_nationkey % 3), "more": 1} for r in _t(spark, d, "nation").collect()]  # 25 rows
    storage.write_text(spark, at, json.dumps({"files": files}))
    return sources.read_artifact(spark, at).select("path", F.concat_ws(",", "symbols.name").alias("symbols"))


_oracle("artifact_files", "SELECT 'src/' || n_name || '.ts' AS path, array_to_string(list_transform(range(n_nationkey % 3), lambda i: n_name), ',') AS symbols FROM nation WHERE n_nationkey % 4 > 0")


# Files: a tree of its own, one file for each nation, scanned and indexed as a project is.


def _tree(spark: SparkSession, d: str) -> str:
    """A project under the checkpoint folder: files that count, and files that must not."""
    import uuid

    storage.cut(spark.range(1))
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tree-{uuid.uuid4().hex}"
    for r in _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # a fixed table of 25 rows
        folder = ("docs", "node_modules/x", "docs/.hidden", "skip", "docs/deep/skip")[r.n_nationkey % 5] if r.n_nationkey >= 10 else "docs"
        name = f"n{r.n_nationkey}." + ("mdx" if r.n_nationkey == 3 else "txt" if r.n_nationkey == 4 else "MD" if r.n_nationkey == 5 else "md")
        text = f"# {r.n_name}\n\nSee [region](r{r.n_regionkey}.md).\n" + ("x" * 600_000 if r.n_nationkey == 6 else "")
        storage.write_text(spark, f"{root}/{folder}/{name}", text)
    for k in range(5):
        storage.write_text(spark, f"{root}/docs/r{k}.md", f"# Region {k}\n")
    storage.write_text(spark, f"{root}/.gitignore", "# rules\nskip/\n!skip/n13.md\n")
    return root


_TREE = """nat AS (SELECT n_nationkey AS k, n_name, n_regionkey, 'docs/n' || n_nationkey || CASE n_nationkey WHEN 5 THEN '.MD' ELSE '.md' END AS path FROM nation WHERE n_nationkey NOT IN (3, 4, 6) AND (n_nationkey < 10 OR n_nationkey % 5 = 0))"""


@query
def scanned_files(spark, d):
    """Markdown files that a scan takes: globs, ignore rules, hidden folders, extensions and sizes decide."""
    found = sources.scan_markdown(spark, _tree(spark, d), Config(include=("**/*",)))
    return found.select("path", content_hash(F.col("text")).alias("hash"), F.col("length").cast("long").alias("length"))


_oracle("scanned_files", f"""WITH {_TREE}, t AS (SELECT path, '# ' || n_name || chr(10) || chr(10) || 'See [region](r' || n_regionkey || '.md).' || chr(10) AS text FROM nat
  UNION ALL SELECT 'docs/r' || r_regionkey || '.md', '# Region ' || r_regionkey || chr(10) FROM region)
SELECT path, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS length FROM t""")


@query
def indexed_tree(spark, d):
    """The same tree through a whole index run, stored and read back: edges by kind, and rows of relations."""
    import uuid

    root = _tree(spark, d)
    engine = Engine(spark, root, f"{root}-store-{uuid.uuid4().hex}", Config(include=("**/*",)))
    engine.index()
    g = engine.graph()
    kinds = g.edges.groupBy(F.concat(F.lit("edges "), "kind").alias("what")).agg(F.count("*").alias("n"))
    return stats.table_counts(g).select(F.col("relation").alias("what"), "n").unionByName(kinds)


_oracle("indexed_tree", f"""WITH {_TREE}, c AS (SELECT count(*) AS nations FROM nat), d AS (SELECT nations + 5 AS n FROM c),
caps AS (SELECT k, unnest(list_distinct(regexp_extract_all(n_name, '\\b[A-Z][A-Z0-9_]{{2,}}\\b'))) AS name FROM nat),
heads AS (SELECT k, n_name AS name FROM nat WHERE regexp_matches(n_name, '^[A-Z][A-Za-z0-9]+$|^[A-Z][A-Z0-9_]{{2,}}$')),
kinds AS (SELECT DISTINCT lower(name) AS name FROM caps UNION SELECT DISTINCT lower(name) FROM heads)
SELECT 'documents' AS what, n FROM d UNION ALL SELECT 'sections', n FROM d UNION ALL SELECT 'chunks', n FROM d UNION ALL SELECT 'vectors', 0 UNION ALL SELECT 'source_refs', 0 UNION ALL SELECT 'entities', count(*) FROM kinds
UNION ALL SELECT 'edges', (SELECT 2 * n FROM d) + (SELECT count(*) FROM caps) + (SELECT count(*) FROM heads) + (SELECT nations FROM c)
UNION ALL SELECT 'edges CONTAINS', 2 * n FROM d UNION ALL SELECT 'edges REFERENCES', count(*) FROM caps UNION ALL SELECT 'edges DEFINES', count(*) FROM heads UNION ALL SELECT 'edges LINKS_TO', nations FROM c""")


def _tree_engine(spark: SparkSession, d: str) -> Engine:
    import uuid

    root = _tree(spark, d)
    return Engine(spark, root, f"{root}-store-{uuid.uuid4().hex}", Config(include=("**/*",)))


@query
def tree_report(spark, d):
    """The health report of the tree: what it counts, and how many issues that makes."""
    engine = _tree_engine(spark, d)
    engine.index()
    report = engine.report()
    later = engine.report(report)
    rows = [*report["summary"].items(), ("issues", report["issues"]), (f"trend {later['trend']}", later["issues"]), (f"semantic {report['semantic']}", 0)]
    return spark.createDataFrame(rows, "what string, n long")


_oracle("tree_report", f"""WITH {_TREE}, reg AS (SELECT r_regionkey AS k, (SELECT count(*) FROM nat WHERE n_regionkey = r_regionkey) AS links FROM region),
c AS (SELECT count(*) FILTER (links = 0) AS orphans, count(*) FILTER (links = 1) AS weak, (SELECT count(*) FROM nat) AS nations FROM reg)
SELECT 'documents' AS what, nations + 5 AS n FROM c UNION ALL SELECT 'stale_index', 0 UNION ALL SELECT 'orphan_documents', orphans FROM c UNION ALL SELECT 'dead_links', 0 UNION ALL SELECT 'missing_sources', 0 UNION ALL SELECT 'missing_definitions', 0
UNION ALL SELECT 'weakly_linked', weak FROM c UNION ALL SELECT 'contradictions', 0 UNION ALL SELECT 'content_risks', 0 UNION ALL SELECT 'issues', orphans + weak FROM c UNION ALL SELECT 'trend unchanged', orphans + weak FROM c UNION ALL SELECT 'semantic disabled', 0""")


@query
def tree_exchange(spark, d):
    """The tree as a bundle and as exported tables, each verified; then the bundle against a tree that has moved on."""
    engine = _tree_engine(spark, d)
    engine.index()
    bundle, tables = f"{engine.store.path}-bundle", f"{engine.store.path}-tables"
    engine.bundle(bundle)
    manifest = engine.export_tables(tables)
    whole, read = engine.verify_bundle(bundle, against_root=True), engine.verify_tables(tables)
    storage.write_text(spark, f"{engine.root}/docs/r1.md", "# Region 1\nchanged\n")
    moved = engine.verify_bundle(bundle, against_root=True)
    rows = [("bundle valid", int(whole["valid"] and not whole["warnings"])), ("tables valid", int(read["valid"])), ("bundle older than the files", len(moved["warnings"]))]
    rows += [(f"exported {k}", n) for k, n in manifest["exportedCounts"].items()]
    return spark.createDataFrame(rows, "what string, n long")


_oracle("tree_exchange", f"""WITH {_TREE}, caps AS (SELECT k, unnest(list_distinct(regexp_extract_all(n_name, '\\b[A-Z][A-Z0-9_]{{2,}}\\b'))) AS name FROM nat), heads AS (SELECT k, n_name AS name FROM nat WHERE regexp_matches(n_name, '^[A-Z][A-Za-z0-9]+$|^[A-Z][A-Z0-9_]{{2,}}$')),
kinds AS (SELECT DISTINCT lower(name) AS name FROM caps UNION SELECT DISTINCT lower(name) FROM heads), d AS (SELECT count(*) AS nations, count(*) + 5 AS n FROM nat)
SELECT 'bundle valid' AS what, 1 AS n UNION ALL SELECT 'tables valid', 1 UNION ALL SELECT 'bundle older than the files', 1 UNION ALL SELECT 'exported document', n FROM d UNION ALL SELECT 'exported section', n FROM d UNION ALL SELECT 'exported entity', count(*) FROM kinds
UNION ALL SELECT 'exported edges', n + (SELECT count(*) FROM caps) + (SELECT count(*) FROM heads) + nations FROM d""")


@query
def tree_watched(spark, d):
    """The tree under watch: an added, a changed and a deleted file are one incremental run; nothing is left for the next."""
    from .streaming.watch import watch

    engine = _tree_engine(spark, d)
    engine.index()
    storage.write_text(spark, f"{engine.root}/docs/late.md", "# Late\n")
    storage.write_text(spark, f"{engine.root}/docs/r1.md", "# Region 1\nSee [late](late.md).\n")
    storage.delete(spark, f"{engine.root}/docs/r0.md")
    seen: list[dict] = []
    watch(engine, f"{engine.store.path}-checkpoint", on_indexed=seen.append, once=True).awaitTermination()
    rows = [(i, what, n) for i, run in enumerate(seen) for what, n in [*run["changes"].items(), ("documents", run["documents"])]]
    return spark.createDataFrame(rows, "run long, what string, n long")


_oracle("tree_watched", f"""WITH {_TREE}, d AS (SELECT count(*) + 5 AS n FROM nat) SELECT 0 AS run, what, n FROM (VALUES ('added', 1), ('modified', 1), ('deleted', 1)) v(what, n) UNION ALL SELECT 0, 'documents', n FROM d UNION ALL SELECT 1, 'documents', n FROM d""")


@query
def tree_storage(spark, d):
    """Stored relations of the tree with their rows, and whether they take space."""
    engine = _tree_engine(spark, d)
    engine.index()
    found = engine.status(with_storage=True)["storage"]["objects"]
    return spark.createDataFrame([(x["relation"], x["rows"], x["bytes"] > 0) for x in found if x["relation"] in ("documents", "sections", "chunks", "source_refs")], "relation string, n long, stored boolean")


_oracle("tree_storage", f"""WITH {_TREE}, d AS (SELECT count(*) + 5 AS n FROM nat) SELECT relation, CASE relation WHEN 'source_refs' THEN 0 ELSE n END AS n, true AS stored FROM d, (VALUES ('documents'), ('sections'), ('chunks'), ('source_refs')) v(relation)""")


@query
def tree_compacted(spark, d):
    """The tree's relations before and after compaction: rows stay, files are one each (edges one for each kind)."""
    engine = _tree_engine(spark, d)
    engine.index()
    before = {r.relation: r.n for r in stats.table_counts(engine.graph()).collect()}
    engine.compact()
    at = f"{engine.store.path}/{engine.store.meta()['version']}"
    after = {r.relation: r.n for r in stats.table_counts(engine.graph()).collect()}
    rows = [(name, n, after[name] == n, sum(f.startswith("part-") for f in storage.children(spark, f"{at}/{name}")) <= 1) for name, n in before.items() if name in ("documents", "sections", "chunks", "entities", "edges")]
    return spark.createDataFrame(rows, "relation string, n long, same boolean, one_file boolean")


_oracle("tree_compacted", """SELECT what AS relation, n, true AS same, true AS one_file FROM (""" + ORACLES["indexed_tree"] + """) WHERE what IN ('documents', 'sections', 'chunks', 'entities', 'edges')""")


@query
def migrated_vectors(spark, d):
    """Vectors of a store of the first schema, which held them as JSON, as the present one reads them."""
    import json
    import uuid

    storage.cut(spark.range(1))
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/old-store-{uuid.uuid4().hex}"
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.to_json("embedding").alias("vector"))
    none = spark.createDataFrame([], "id string")
    for name in graphs.KEYS:
        (rows if name == "vectors" else none).write.parquet(f"{at}/v000001/{name}")
    storage.write_text(spark, f"{at}/_current.json", json.dumps({"schema_version": 1, "version": "v000001"}))
    found = store.Store(spark, at).read().vectors
    return found.select("chunk_id", F.size("vector").cast("long").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


_oracle("migrated_vectors", "SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::BIGINT AS dimensions, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS total FROM embeddings")


@query
def bounded_json(spark, d):
    """Nesting that a JSON reader takes: 128 levels, and no more."""
    rows = []
    for r in _t(spark, d, "region").collect():  # five rows
        depth = 126 + r.r_regionkey
        try:
            sources.parse_json("[" * depth + "]" * depth)
            rows.append((depth, True))
        except sources.BoundsError:
            rows.append((depth, False))
    return spark.createDataFrame(rows, "depth long, taken boolean")


_oracle("bounded_json", "SELECT (126 + r_regionkey)::BIGINT AS depth, 126 + r_regionkey <= 128 AS taken FROM region")

__all__ = ["QUERIES"]
