"""Expressions and operators against small Python models."""

from __future__ import annotations

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.config import Config, ConfigError, merge
from vellum.functions import entities as E
from vellum.functions.text import cjk_ngrams, exploded_terms, fnv1a, fnv1a_of, fold, index_content, index_terms, normalize_entity, prefix_terms, query_tokens, query_tokens_of, slugify, stable_id, token_estimate
from vellum.operators import context, paired, search, stats, traverse, vectors
from vellum.operators.risks import risk_lines, risks_of
from vellum.plans import resolve, storage, store
from vellum.sources import files, frontmatter, markdown

TEXTS = ["Hello snake_case WORLD and or x", "", "会话管理 SessionStore 設計", "カタカナ", "한국어 검색", "éÉ École naïve", "a_b__c 12 near", "😀 emoji_token", "The the THE"]


def one(spark, column_of, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", column_of(F.col("v")).alias("out")).orderBy("i").collect()]


def test_tokens_agree_with_the_driver(spark):
    assert one(spark, query_tokens, TEXTS) == [query_tokens_of(t) for t in TEXTS]
    assert query_tokens_of("Session") == ["session", "session"]
    assert query_tokens_of("会话管") == ["会话", "话管", "会话管"]
    assert one(spark, cjk_ngrams, ["会话 a 管理者"]) == [["会话", "管理", "理者", "管理者"]]
    assert one(spark, index_content, ["会话", "plain"]) == ["会话\n会话", "plain"]
    long = " ".join(f"word{i}" for i in range(30))
    assert prefix_terms(long) == [f"word{i}" for i in range(12)]
    assert prefix_terms("and or !") == []


def test_hashes(spark):
    assert one(spark, fnv1a, TEXTS) == [fnv1a_of(t) for t in TEXTS]
    assert fnv1a_of("") == 2166136261 and fnv1a_of("a") == 0xE40C292C
    assert one(spark, lambda c: stable_id("document", c), ["x"])[0] == "document:" + __import__("hashlib").sha1(b"document:x").hexdigest()[:20]
    assert one(spark, token_estimate, ["", "abcd", "abcde", "😀😀😀"]) == [1, 1, 2, 2]


def test_slugs_and_names(spark):
    assert one(spark, slugify, ["Hello, World!", "  A -- b ", "`code` x", "中文 标题", "カナ", "---"]) == ["hello-world", "a-b", "code-x", "中文-标题", "section", "section"]
    assert one(spark, normalize_entity, [" `Abc` ", "``x``"]) == ["abc", "`x`"]
    assert one(spark, fold, ["École Ünï"]) == ["ecole uni"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "e\u0301a \u0301 x\u0301\u0301y İi ﬁn Å9_z"])], "i int, t string")
    by_row = {r.i: sorted(r.x) for r in texts.select("i", index_terms(F.col("t")).alias("x")).collect()}
    exploded = {}
    for r in exploded_terms(texts, F.col("t"), "i").collect():
        exploded.setdefault(r.i, []).append(r.term)
    assert {i: sorted(x) for i, x in exploded.items()} == {i: x for i, x in by_row.items() if x}


def test_entity_kinds(spark):
    names = {"GET /a": "api_route", "/a/b": "api_route", "src/a.ts": "file_path", "npm run x": "command", "AuthError": "error_code", "ERR_X": "error_code", "AB_123": "error_code", "API_KEY": "config_key", "a.b.c": "config_key", "scope/name": "package", "adr-12": "decision", "Session": "symbol"}
    assert one(spark, E.infer_kind, list(names)) == list(names.values())
    text = "éABC ÉCOLE x.y.z src/auth/session.ts GET /v1/{id} MY_ERROR_X"
    assert one(spark, E.high_confidence_names, [text])[0] == ["/auth/session.ts", "GET /v1/{id}", "MY_ERROR_X", "ABC", "COLE", "x.y.z", "GET"]
    assert "src/a.py" in one(spark, lambda c: E.structured_names(c, False), ["see src/a.py and run()"])[0]
    assert one(spark, E.declared_names, ["- `A b`\n* `C`\n- name: x\n- other"])[0] == ["A b", "C", "name"]
    assert one(spark, E.looks_like_entity, ["Overview", "two words", "/x", "a.b", "a.b.c", "ABC.", ""]) == [True, False, True, False, True, True, False]


def test_embedding_agrees_with_the_driver(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: list(r.vector) for r in vectors.embed_rows(rows, "i", "t", 16).collect()}
    whole = {r.i: list(r.v) for r in rows.select("i", vectors.embed(F.col("t"), 16).alias("v")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == pytest.approx(vectors.embed_text(t, 16), abs=2e-6) and whole[i] == pytest.approx(got[i], abs=2e-6)
    near = vectors.similar_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 9.0, 3.0]), (3, [-1.0, 0.0])], "chunk_id int, vector array<float>"), [1.0, 0.1], 5)
    assert [(r.chunk_id, round(r.similarity, 6)) for r in near.collect()] == [(2, 1.4), (1, 1.0)]


def test_bm25(spark):
    texts = {"a": "red red fox", "b": "red foxes run far away", "c": "blue bird", "d": "会话 red"}
    chunks = spark.createDataFrame(list(texts.items()), "id string, content string")
    index = search.postings(chunks)
    lengths = search.chunk_lengths(chunks, index)
    got = {r.chunk_id: r["rank"] for r in search.bm25(index, lengths, ["red", "fox", "会话"]).collect()}
    words = {"a": ["red", "red", "fox"], "b": ["red", "foxes", "run", "far", "away"], "c": ["blue", "bird"], "d": ["会话", "red", "会话"]}
    mean = sum(map(len, words.values())) / 4
    want = {}
    for p in ("red", "fox", "会话"):
        tf = {k: sum(w.startswith(p) for w in ws) for k, ws in words.items()}
        tf["d"] = 1 if p == "会话" else tf["d"]
        n = sum(v > 0 for v in tf.values())
        idf = math.log((4 - n + 0.5) / (n + 0.5))
        for k, f in tf.items():
            if f:
                want[k] = want.get(k, 0) - max(idf, 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[k]) / mean))
    assert got == pytest.approx(want)
    assert search.full_text(index, lengths, "!", 5).collect() == []


def test_copies_score_the_same(spark):
    """Parts are added in one order: equal texts tie exactly, in however many partitions, and the smaller id is first."""
    copies = [(f"c{i:04d}", "the license of apache the license the notice") for i in range(400)]
    others = [(f"o{i:04d}", "the word" if i < 700 else "license word two" if i < 900 else "words") for i in range(2000)]
    chunks = spark.createDataFrame(copies + others, "id string, content string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for parts in (3, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for index in (search.term_rows(chunks), search.postings(chunks)):
                lengths = storage.cut(search.chunk_lengths(chunks, index))
                rows = search.bm25(index, lengths, ["the", "license", "apache"]).where("chunk_id < 'd'").collect()
                assert len(rows) == 400
                seen |= {r["rank"] for r in rows}
                first = search.full_text(index, lengths, "the license apache", 20).collect()
                assert [r.chunk_id for r in first] == [k for k, _ in copies[:20]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_texts_of_the_document_graph_are_not_shuffled(spark):
    graph = catalog._document_graph(spark, "/root/testdata/sf0.001")
    for table in (graph.chunks, graph.sections):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    ids = {r.id for r in graph.documents.select("id").collect()}
    assert len(ids) == graph.chunks.count() == graph.sections.count() and ids == {r.document_id for r in graph.chunks.select("document_id").collect()}


def test_bm25_reads_matching_words_once(spark):
    graph = catalog._document_graph(spark, "/root/testdata/sf0.001")
    index = search.term_rows(graph.chunks)
    ranked = search.bm25(index, storage.cut(search.chunk_lengths(graph.chunks, index)), ["the", "license", "apache"])
    assert ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Scan parquet") == 2  # words, and n-grams of CJK


def test_scores(spark):
    rows = spark.createDataFrame([("validated", "active"), ("untrusted", "deprecated"), ("authored", "draft"), ("other", "x")], "t string, s string")
    assert [r.x for r in rows.select(search.adjust(F.lit(10.0), F.col("t"), F.col("s")).alias("x")).collect()] == [18.0, -40.0, 7.0, 10.0]
    assert one(spark, lambda c: search.frequency_penalty(c, 2), [[], [3], [3, 9, 5, 7]], "array<int>") == [0.0, -20.0, -60.0]
    fused = search.fuse(spark.createDataFrame([("fts", 1, "k", 5.0), ("fts", 3, "k", 4.0), ("semantic", 2, "k", 1.0), ("fts", 2, "j", 1.0)], "channel string, rank int, key string, score double"))
    boosts = {(r.key, r.channels): r.boost for r in fused.collect()}
    assert boosts == {("k", "fts#1, semantic#2"): round(1000 / 61 + 1000 / 62, 4), ("j", "fts#2"): round(1000 / 62, 4)}
    assert search.agent_mode("short", 10, Config()) == {"limit": 8, "max_depth": 2, "max_chars": 16000}
    assert search.agent_mode("one two three four five six seven", 1000, Config()) == {"limit": 20, "max_depth": 3, "max_chars": 28_000}
    assert search.agent_mode("short", 10, Config(), max_chars=77)["max_chars"] == 77 and search.agent_mode("short", 10, Config(), 1)["max_chars"] == 28_000
    assert search.query_entity_candidates("use `a b` with SessionStore.get and API_KEY at /v1/x") == ["a b", "SessionStore.get", "API_KEY", "/v1/x"]


def test_fan_out_counts_are_those_of_the_or_join(spark):
    owner = [("d", "d", "document"), *((f"s{i}", "d", "section") for i in range(3)), *((f"c{i}", "d", "chunk") for i in range(3)), ("e", "e", "document")]
    edges = [("1", "d", "x", "REFERENCES"), ("2", "s0", "x", "DEFINES"), ("3", "s1", "s2", "LINKS_TO"), ("4", "c0", "s0", "LINKS_TO"), ("5", "s0", "c0", "CONTAINS")]
    want = {"e": (0, 0)}
    rows = [e for _, _, e in itertools.product(range(3), range(3), [0])]
    cells = list(itertools.product(["s0", "s1", "s2"], ["c0", "c1", "c2"]))
    hit = [(s, c, e) for s, c in cells for e in edges if e[3] != "CONTAINS" and {"d", s, c} & {e[1], e[2]}]
    want["d"] = (len(hit), sum(e[3] == "DEFINES" for _, _, e in hit))
    assert rows
    got = stats.link_stats(spark.createDataFrame(edges, "id string, from_id string, to_id string, kind string"), spark.createDataFrame(owner, "node_id string, document_id string, node_type string"), spark.createDataFrame([("d",), ("e",)], "id string"))
    assert {r.document_id: (r.links, r.definitions) for r in got.collect()} == want


def test_resolution(spark):
    docs = spark.createDataFrame([("A", "docs/a.md", "Alpha", "id-a"), ("B", "docs/sub/b.md", "Beta", None), ("C", "other/b.md", "Gamma", None)], "id string, path string, title string, front_id string")
    sections = spark.createDataFrame([("s1", "A", "top", "Top", 0), ("s2", "A", "top-2", "Top", 1)], "id string, document_id string, anchor string, heading string, ord int")
    aliases, anchors = resolve.document_aliases(docs), resolve.section_anchors(sections)
    assert {r.alias for r in resolve.ambiguous_aliases(docs).collect()} == {"b"}
    cases = [("alpha", None, "A"), ("ID-A", None, "A"), ("./sub/b.md", None, "B"), ("../other/b.md#x", None, None), ("sub/../a.md", None, "A"), ("b", None, None), ("Alpha#Top", None, "s1"), ("Alpha", "top 2", "s2"), ("Alpha", "none", None), ("", "top", "s1"), ("docs\\sub\\b", None, "B"), ("", None, None)]
    asked = spark.createDataFrame([(i, "A", "docs/a.md", r, a) for i, (r, a, _) in enumerate(cases)], "i int, from_id string, from_path string, reference string, anchor string")
    got = {r.i: r.node_id for r in resolve.resolve(asked, aliases, anchors).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_front_matter():
    block = frontmatter.split("---\nid: 3\ntitle: ' x '\ntype: Design\ntags: a\ndepends_on: [b, 4, ' ']\ncreated: 2024-01-01\n---\nbody\n")
    assert block.body == "body\n" and block.line_offset == 8
    front = frontmatter.normalise(block.data)
    assert (front["id"], front["title"], front["type"], front["tags"], front["depends_on"]) == (None, "x", "design", ["a"], ["b"])
    assert [(d["field"], d["line"]) for d in block.diagnostics] == [("id", 2), ("depends_on", 6)]
    assert frontmatter.split("---\nno end").diagnostics[0]["code"] == "front_matter.unclosed"
    assert frontmatter.split("---\n- a\n---\n").diagnostics[0]["code"] == "front_matter.not_mapping"
    assert frontmatter.split("---\na: [\n---\n").diagnostics[0]["code"] == "front_matter.invalid_yaml"
    assert frontmatter.split("﻿---\n\n---\nx").body == "x"


def test_markdown():
    text = "intro\n# A `b` *c*\n\n[x](y.md 't') ![i](z.md) [[W#h|al]] `[[no]]`\n\n````\n# no\n```\n[[no]]\n````\n\nTwo\n===\n\n> - # Quoted\n\n    # code\n\n##### deep\n"
    p = markdown.parse(text)
    assert [(s["heading"], s["level"], s["start_line"], s["end_line"]) for s in p["sections"]] == [("A b c", 1, 2, 11), ("Two", 1, 12, 14), ("Quoted", 1, 15, 20)]
    assert [(x["text"], x["url"], x["title"]) for x in p["md_links"]] == [("x", "y.md", "t")]
    assert [(w["target"], w["anchor"], w["alias"]) for w in p["wiki_links"]] == [("W", "h", "al")]
    assert [(c["value"], c["inline"]) for c in p["code"]] == [("b", True), ("[[no]]", True), ("# no\n```\n[[no]]", False), ("# code", False)]
    with pytest.raises(markdown.BudgetError):
        markdown.parse("# h\n" * 10_001)
    assert markdown.parse("")["sections"][0]["heading"] is None


def test_links():
    text = """See [one][a], [a], mail me@x-y.org or <you@z.de>, www.e.com/x_(y). (https://f.org/q).

[a]: https://defined.example/x 'Title'
[b]: <other>
===

[c]: third
[inline](d.md) user@host is no mail, a.b@c.de.
[^1]: note with [link](n.md)

| t | u |
|---|---|
| [cell](t.md) | `code` |
"""
    p = markdown.parse(text)
    assert {x["url"] for x in p["md_links"]} == {"mailto:you@z.de", "http://www.e.com/x_(y)", "https://f.org/q", "mailto:me@x-y.org", "d.md", "n.md", "mailto:a.b@c.de", "t.md"}
    assert [s["heading"] for s in p["sections"]] == [None]
    assert [c["value"] for c in p["code"]] == ["code"]


def test_files(spark, corpus):
    root = corpus({"a.md": "x", "node_modules/b.md": "x", "docs/.hidden/c.md": "x", "docs/d.MD": "x", "docs/e.mdx": "x", "docs/f.txt": "x", "skip/g.md": "x", "deep/skip/h.md": "x", "big.md": "y" * 600_000, ".gitignore": "# c\nskip/\n!skip/g.md\n"})
    found = lambda c: sorted(r.path for r in files.scan_markdown(spark, str(root), c).collect())
    assert found(Config(include=("**/*",))) == ["a.md", "docs/d.MD"]
    assert found(Config(include=("**/*",), parse_mdx=True, follow_gitignore=False)) == ["a.md", "deep/skip/h.md", "docs/d.MD", "docs/e.mdx", "skip/g.md"]
    assert files.ignore_globs(["/a/b", "c/", "*.x"]) == ["a/b", "c/**", "**/c/**", "*.x", "**/*.x"]
    matches = lambda g, p: bool(re.fullmatch(files.glob_regex(g)[1:-2], p))
    assert matches("**/*.md", "a.md") and matches("**/*.md", "x/y/a.md") and not matches("*.md", "x/a.md") and matches("{a,b}/?.md", "b/c.md")
    assert files.inside_root("a/../b") and not files.inside_root("../b") and not files.inside_root("/b")
    with pytest.raises(files.BoundsError):
        files.parse_json("[" * 200 + "]" * 200)
    with pytest.raises(files.BoundsError):
        files.parse_json("[1,2,3]", longest=2)
    with pytest.raises(files.BoundsError):
        files.check_bounds([0] * 1_000_001, nodes=2_000_000)
    assert files.ignore_store(str(root)) and not files.ignore_store(str(root))
    assert (root / ".gitignore").read_text().endswith("\n# local graph\n.vellum/*\n!.vellum/config.json\n")


def test_config():
    assert merge(Config(), {"search_limit": 5, "include": [], "stop_entities": ["x", " ", 3]}) == Config(search_limit=5, stop_entities=("x",))
    for bad in (0, 101, "5", True, 2.5):
        with pytest.raises(ConfigError):
            merge(Config(), {"search_limit": bad})
    assert "decision" not in Config().enabled_kinds


def test_risks(spark):
    text = "ok\nSYSTEM PROMPT <  IFRAME x\r\nsee data:text/html,x\na​b"
    want = risks_of(text)
    assert [n for n, _ in want] == [2, 2, 3, 4]
    got = risk_lines(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").collect()
    assert [(r.line, r.reason) for r in got] == want


def test_packing_order():
    rows = [{"path": p, "score": s, "direct": d, "nodeId": i} for i, (p, s, d) in enumerate([("a", 9, True), ("a", 8, True), ("b", 7, True), ("a", 99, False), ("c", 1, True)])]
    assert [r["nodeId"] for r in context.order_candidates(rows)] == [0, 2, 4, 1, 3]
    assert context.trim_to_budget("abcdef   gh", 9) == "abcdef..." and context.trim_to_budget("abcd", 3) == "abc" and context.trim_to_budget("ab", 5) == "ab"


def plain_trace(edges, start, target, depth):
    """Breadth first by hand: nodes in the order in which they are found, best edges first."""
    found, order = {start: None}, [start]
    for _ in range(depth):
        new = []
        for node in order:
            ends = [(e, e[2] if e[1] == node else e[1]) for e in edges if node in e[1:3]]
            for e, other in sorted(ends, key=lambda x: (-x[0][4], -x[0][5], x[0][0])):
                if other not in found:
                    found[other] = (node, e)
                    new.append(other)
        order = new
        if target in found:
            break
    steps = []
    while target in found and found[target]:
        target, edge = found[target]
        steps.append(edge[0])
    return steps[::-1]


def random_graph(seed, nodes=40, n=70):
    rng = random.Random(seed)
    kinds = ["DEFINES", "REFERENCES", "LINKS_TO", "CONTAINS", "DEPENDS_ON"]
    return [(f"e{i:03}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice(kinds), rng.choice([4.0, 7.0, 9.0]), rng.choice([0.6, 1.0]), "x") for i in range(n)]


EDGE = "id string, from_id string, to_id string, kind string, weight double, confidence double, provenance string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trace_is_that_of_a_plain_program(spark, seed):
    edges = random_graph(seed)
    table = spark.createDataFrame(edges, EDGE).cache()
    lengths = set()
    for target in ("n1", "n2", "n3", "n4", "gone"):
        got = traverse.trace(table, "n0", target, 5).collect()
        assert [r.edge_id for r in got] == plain_trace(edges, "n0", target, 5)
        assert all((r.direction == "forward") == (r.edge_from == r.from_id) for r in got)
        lengths.add(len(got))
    assert len(lengths) > 1 and traverse.trace(table, "n0", "n0", 5).collect() == []


def plain_walk(edges, seeds, max_depth, room):
    """Best first by hand, one edge at a time."""
    queue = [(node, 0, score) for node, score in seeds]
    visited, out = {s for s, _ in seeds}, []
    counts = dict.fromkeys(context.COUNTERS, 0) | {"seedNodes": len(seeds)}
    while queue:
        queue.sort(key=lambda q: -q[2])
        node, depth, score = queue.pop(0)
        if depth >= max_depth:
            counts["skippedByDepth"] += 1
            continue
        ends = [(e, e[2] if e[1] == node else e[1]) for e in edges if node in e[1:3] and e[3] != "CONTAINS"]
        for e, other in sorted(ends, key=lambda x: (-x[0][4] * x[0][5], -x[0][4], -x[0][5], x[0][0])):
            if other in visited:
                counts["skippedVisitedNodes"] += 1
            elif len(out) >= room:
                counts["skippedByNodeLimit"] += 1
            else:
                counts["expandedEdges"] += 1
                visited.add(other)
                item = (other, depth + 1, score + e[4] * e[5] - 2 * (depth + 1))
                out.append(item)
                queue.append(item)
    return out, counts | {"visitedNodes": len(visited)}


@pytest.mark.parametrize(("seed", "depth", "room"), [(4, 2, 12), (5, 3, 60), (6, 1, 3)])
def test_walk_is_that_of_a_plain_program(spark, seed, depth, room):
    edges = random_graph(seed)
    seeds = [("n0", 50.0), ("n5", 50.0), ("n7", 41.0)]
    graph = type("Graph", (), {"edges": spark.createDataFrame(edges, EDGE).cache()})()
    labels = spark.createDataFrame([(f"n{i}", f"label {i}") for i in range(40)], "id string, label string")
    reached, counts = context._walk(graph, labels, [context._Walk(n, s) for n, s in seeds], depth, room)
    want, totals = plain_walk(edges, seeds, depth, room)
    assert [(w.node, w.depth, pytest.approx(w.score)) for w in reached] == want
    assert {k: counts[k] for k in context.COUNTERS} == totals
    assert all(w.path[-1]["toId"] == w.node and len(w.path) == w.depth for w in reached)


def test_names_and_headings_are_not_cut(spark):
    """More sections of one heading, and more entities of one query, than any listing shows."""
    documents = spark.range(1500).select(F.concat(F.lit("d"), "id").alias("id"), F.format_string("p/%05d.md", "id").alias("path"), F.concat(F.lit("T"), "id").alias("title"))
    sections = spark.range(1500).select(F.concat(F.lit("s"), "id").alias("id"), F.concat(F.lit("d"), "id").alias("document_id"), F.lit("overview").alias("anchor"), F.lit("Overview").alias("heading"), F.lit(1).alias("start_line"))
    entities = spark.createDataFrame([("x", "X", "x", "symbol")], "id string, name string, normalized_name string, kind string")
    refs = spark.createDataFrame([], "id string, path string, normalized_path string")
    chunks = spark.createDataFrame([], "id string")
    graph = type("Graph", (), {"documents": documents, "sections": sections, "entities": entities, "source_refs": refs, "chunks": chunks})()
    found = traverse.resolve_node(graph, "OVERVIEW")
    assert found.count() == 1500 and found.where("ambiguous").count() == 1500
    assert [r.id for r in found.orderBy("at", "id").limit(3).collect()] == ["s0", "s1", "s2"]
    assert [r.id for r in traverse.resolve_node(graph, "t7").collect()] == ["d7"] and traverse.resolve_node(graph, " ").collect() == []


def test_numbered(spark):
    rows = spark.range(5000).withColumn("v", F.col("id") * 7919 % 5003).repartition(7)
    got = storage.numbered(rows, [F.col("v").desc()], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == sorted((r.v for r in got), reverse=True)


def test_pointer_survives_a_broken_write(spark, tmp_path):
    at = f"{tmp_path}/_current.json"
    storage.write_text(spark, at, "one")
    storage.write_text(spark, at, "two")
    assert storage.read_text(spark, at) == "two"
    (tmp_path / "_current.json").rename(tmp_path / "_current.json.next")
    storage.recover(spark, at)
    assert storage.read_text(spark, at) == "two"


def record(i, question, mode, **more):
    base = {"id": i, "question_id": question, "question": f"about {question} ", "mode": mode, "tool_calls": [], "direct_file_reads": [], "final_citations": []}
    return base | more


def test_paired_runs(spark, tmp_path):
    runs = [
        record("1", "q", "without", direct_file_reads=[{"path": "a", "chars": 1000}] * 5, token_estimate=5000, latency_ms=10, final_citations=[{"path": "x", "correct": "false"}]),
        record("2", "q", "with", graph_calls=[{"tool": "context", "query": "q", "chars": 700}], token_estimate=700, final_citations=[{"path": "d.md", "correct": "true"}, {"path": "y", "correct": "unknown"}]),
        record("3", "lonely", "with"),
        record("4", "twice", "with"),
        record("5", "twice", "with"),
        record("6", "twice", "without"),
        record("7", "known", "with", final_citations=[{"path": "d.md"}]),
        record("8", "known", "without", final_citations=[{"path": "e.md"}, {"path": "d.md"}]),
        record("", "bad", "maybe", latency_ms=-1),
    ]
    (tmp_path / "runs.json").write_text(json.dumps(runs))
    table = paired.read_runs(spark, str(tmp_path / "runs.json"))
    assert {r.problem for r in paired.invalid_runs(table).collect()} == {"id is missing", "mode must be with or without", "latency_ms is negative"}
    expected = spark.createDataFrame([("known", ["d.md"])], "question_id string, paths array<string>")
    deltas, skipped = paired.pair_runs(paired.run_metrics(table.where("id <> ''"), expected))
    rows = {r.question_id: r for r in deltas.collect()}
    assert (rows["q"].file_reads, rows["q"].file_chars, rows["q"].graph_calls, rows["q"].token_estimate, rows["q"].citation_rate, rows["q"].latency_ms) == (-5, -5000, 1, -4300, 1.0, None)
    assert rows["known"].citation_rate == 0.5
    total = paired.aggregate_deltas(deltas).first()
    assert (total.pairs, total.file_reads, total.citation_rate, total.latency_ms) == (2, -5, 0.75, None)
    assert {r.question_id: r.reason for r in skipped.collect()} == {"lonely": "missing run without the graph", "twice": "more than one run of a mode"}


def test_insert_modes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(store.keep_one(old, new, ["k"], newest=False)) == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(store.keep_one(old, new, ["k"], newest=True)) == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(ValueError, match="b is already stored"):
        store.insert_strict(old, new, "k")
