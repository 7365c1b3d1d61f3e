"""Archives round-trip; graph search against brute force."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import ann, warc
from vellum.llm.scratch import Scratch

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "two\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (3, "http://a/3\r\nX: y", "<p>one</p>"),
    (4, None, ""),
    (5, "http://ü/5", "é 😀 \x00"),
    (6, "", None),
    (0, "http://a/0", "<p>one</p>"),
    (7, "http://a/7", "x" * 300_000),
    (7, "http://a/7", "x" * 300_000),
    (8, "u", "last"),
    (None, "n", "last"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, type string")


def expected(rows, least):
    first, count = {}, {}
    for i, _, h in rows:
        h = h or ""
        count[h] = count.get(h, 0) + 1
        if i is not None and (h not in first or i < first[h]):
            first[h] = i
    out, done = [], set()
    for i, _, h in rows:
        h = h or ""
        revisit = len(h.encode()) >= least and count[h] > 1 and (i != first[h] or h in done)
        if i == first[h]:
            done.add(h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((i, len(h.encode()), digest, "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, least=0):
    path = Scratch(spark, "t").path("warc")
    warc.write_archives(frame(spark, rows), path, least_bytes=least)
    return path, warc.resolve_revisits(warc.captures(warc.read_records(spark, path)))


def test_round_trip(spark):
    path, found = run(spark, PAGES)
    rows = found.collect()
    got = [(r.metadata.page_id, r.full_bytes, r.capture.digest, r.capture.type, r.response_page if r.capture.type == "revisit" else None) for r in rows]
    assert sorted(got, key=str) == expected(PAGES, 0)
    payloads = {r.metadata.page_id: bytes(r.capture.payload).decode() for r in rows if r.capture.type == "response"}
    assert payloads[2] == PAGES[1][2] and payloads[5] == PAGES[4][2] and len(payloads[7]) == 300_000
    assert all(r.request.record_id and r.request.target_uri == r.capture.target_uri for r in rows)
    raw = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{path.removeprefix('file://')}/part-*"))
    assert raw.count(b"WARC-Type: request") == len(PAGES) and raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_small_payloads_are_all_responses(spark):
    _, found = run(spark, PAGES, least=11)
    got = [(r.metadata.page_id, r.full_bytes, r.capture.digest, r.capture.type, r.response_page if r.capture.type == "revisit" else None) for r in found.collect()]
    assert sorted(got, key=str) == expected(PAGES, 11)


def test_empty_archive(spark):
    assert run(spark, [])[1].collect() == []


def vectors(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 24)) * 0.6).astype(np.float32).tolist()


def brute(rows, asks, k):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    out = {}
    for q in good:
        if asks(q):
            near = sorted((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out, unit


def search(spark, rows, asks, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    return ann.nearest(df, asks, k).collect()


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_POINTS", 700)
    rows = [(i, v) for i, v in enumerate(vectors(2000))]
    got = search(spark, rows, F.col("vec_id") % 50 == 0)
    want, _ = brute(rows, lambda q: q % 50 == 0, 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        exact = {i: -s for s, i in want[q]}
        hits += sum(r.vec_id in exact for r in found)
        for r in found:
            if r.vec_id in exact:
                assert abs(r.score - exact[r.vec_id]) < 1e-9
    assert hits / (5 * len(by)) >= 0.9


def plain_prune(points, p, candidates, degree, alpha):
    kept = []
    left = sorted({c for c in candidates if c >= 0 and c != p}, key=lambda c: (float(((points[c] - points[p]) ** 2).sum()), c))
    while left and len(kept) < degree:
        best = left.pop(0)
        kept.append(best)
        left = [c for c in left if alpha**2 * float(((points[c] - points[best]) ** 2).sum()) > float(((points[c] - points[p]) ** 2).sum())]
    return kept


def test_pruning_is_that_of_a_plain_program():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 12)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    owners = np.arange(60)
    candidates = rng.integers(-1, 200, (60, 40)).astype(np.int32)
    for degree, alpha in ((8, 1.2), (32, 1.0), (3, 2.0)):
        got = ann.robust_prune(points, owners, candidates, degree, alpha)
        for p in owners.tolist():
            assert got[p][got[p] >= 0].tolist() == plain_prune(points, p, candidates[p].tolist(), degree, alpha)


def test_graph_has_no_wide_or_broken_rows():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3000, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    edges, starts = ann.build_graph(points)
    assert edges.shape == (3000, ann.DEGREE) and edges.max() < 3000 and (edges != np.arange(3000)[:, None]).all()
    assert all(len(set(e[e >= 0].tolist())) == (e >= 0).sum() > 0 for e in edges) and len(starts) <= 9
    found, sims = ann.beam_search(points, edges, starts, points[:100], 40)
    assert (found[:, 0] == np.arange(100)).mean() > 0.97 and (np.diff(sims, axis=1) <= 0).all()
    whole, _ = ann.beam_search(points[:5], *ann.build_graph(points[:5]), points[:3], 5)
    assert sorted(whole[0].tolist()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("least", [10_000, 400])
def test_recall_on_driver_table(spark, monkeypatch, least):
    """Random vectors, the hardest case: one shard and several."""
    folder = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(folder):
        pytest.skip("driver tables")
    monkeypatch.setattr(ann, "LEAST_POINTS", least)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(folder).collect()]
    want, _ = brute(rows, lambda q: q % 50 == 0, 5)
    got = {}
    for r in ann.nearest(spark.read.parquet(folder), F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in want.items())
    assert set(got) == set(want) and hits / sum(map(len, want.values())) >= 0.95


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(50 * i, v) for i in range(4)] + [(i, v) for i in range(1, 40)] + [(900, None), (901, [0.0, 0.0, 0.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0]), (905, [1.0, 2.0]), (950, [2.0, 1.0]), (None, v), (3, v), (1000, [-1.0, -2.0, -3.0])]
    got = search(spark, rows, F.col("vec_id") % 50 == 0)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(by) == [0, 50, 100, 150, 950, 1000]
    assert sorted(by[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(by[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert by[950] == [(1, 905)]
    assert search(spark, [], F.col("vec_id") % 50 == 0) == []
    assert search(spark, [(0, v)], F.col("vec_id") % 50 == 0) == []
