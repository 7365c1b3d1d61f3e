"""Exact, near and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import exact_dedup, line_dedup, minhash
from vellum.llm.components import components
from vellum.llm.cuckoo import CuckooIndex
from vellum.llm.scratch import Scratch

WHITE = r"[\x20\x09-\x0D]"


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def near(base: list[str], edits: int, seed: int) -> str:
    rng = random.Random(seed)
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base = words(300, 1)
    texts: list[str | None] = [" ".join(base)]
    texts += [near(base, 2, s) for s in range(20)] + [near(base, 7, s) for s in range(40)] + [near(base, 30, s) for s in range(10)]
    texts += [" ".join(words(50, s)) for s in range(30)]
    texts += [" ".join(base).upper(), "  ".join(base), "\n".join(base), "one two", "ONE two", "one  two ", "three", "", " \t\n", None, None, "é è", " x", "a b c d e", "a b c d e f"]
    texts += [" ".join(words(20_000, 99))] * 2
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, " ".join(base)), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, uid string")


def shingles(text: str | None) -> frozenset:
    w = [x for x in re.split(WHITE + "+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, similarity):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= similarity * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in sets}


def test_near_components(spark, rows):
    want = brute_components(rows, 85)
    got = minhash.near_components(frame(spark, rows), 85).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(len(shingles(t)))
    for r in got:
        assert r.n_shingles in texts[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is not None and r.component_id == r.doc_id)


def test_drop_near(spark, rows):
    few = [*rows[:4], *rows[-3:], (400, "one two"), (401, "ONE  two")]
    docs = clashing(spark, few)
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *brute_components(few, 80).values()}
    assert minhash.near_components(frame(spark, [])).collect() == [] and minhash.drop_near(frame(spark, [])).collect() == []


#: Names that operators use themselves, or that need quotes.
CLASHES = ["__id", "__thash", "__thash_own", "__copy", "__gone", "gone", "row", "id", "hash", "thash", "uid", "my col", "a.b", "a-b", "q`t", "score"]


def clashing(spark, rows):
    """doc_id and text with many more columns; the added ones hold the place of the row."""
    schema = ", ".join(f"`{c.replace('`', '``')}` long" for c in CLASHES)
    return spark.createDataFrame([(i, t, *[k] * len(CLASHES)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {schema}")


@pytest.mark.parametrize(("blocks", "large"), [(0, 4096), (100, 4096), (0, 3)])
def test_blocks_lose_no_link(spark, monkeypatch, blocks, large):
    """Tiny blocks: texts of a family meet across many of them. large: buckets whose nodes are all taken as having a partner."""
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "LOAD", 1000)
    monkeypatch.setattr(minhash, "BLOCKS", blocks)
    base = words(200, 5)
    chain = [(0, " ".join(base))]
    for i in range(1, 40):
        base = list(base)
        base[(i * 5) % 200] = f"y{i}"
        chain.append((i, " ".join(base)))
    got = {r.doc_id: r.component_id for r in minhash.near_components(frame(spark, chain), 85).collect()}
    assert got == brute_components(chain, 85)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    one, two = minhash.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((one == two).mean() - 0.6) < 0.18


def test_lower_similarity_keeps_its_pairs(spark):
    """Pairs of Jaccard 0.80 that 18 bands, enough for 0.85, let go."""
    rows = []
    for k, seed in enumerate([969, 3402, 3550, 5845, 8083, 8196, 8282, 9266]):
        base = [f"w{seed}x{i}" for i in range(49)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:24], "changed", *base[25:]]))]
    kept = {r.doc_id for r in minhash.drop_near(frame(spark, rows), 80).collect()}
    assert kept == set(brute_components(rows, 80).values()) == {0, 2, 4, 6, 8, 10, 12, 14}


def test_bands_follow_similarity():
    assert (minhash.bands_of(85), minhash.most_different(85)) == (18, 26)
    for similarity in (80, 85, 90):
        bands = minhash.bands_of(similarity)
        assert (1 - (similarity / 100) ** minhash.ROWS) ** bands <= minhash.MOST_MISSED
        n, p = min(minhash.ROWS * bands, minhash.SKETCHED), 0.75 * (1 - similarity / 100)
        assert minhash.most_different(similarity) >= n * p + 5 * (n * p * (1 - p)) ** 0.5


def test_bits_and_bands_lose_few_pairs():
    """Pairs at the similarity itself: how many share no band, and how many differ in too many bits."""
    rng = np.random.default_rng(4)
    for similarity in (80, 85):
        n, size = 4000, 180
        shared = round(2 * size * similarity / (100 + similarity))
        ids = rng.integers(0, 1 << 63, (n, 2 * size - shared)).astype(np.uint64)
        one, two = ids[:, :size], np.concatenate([ids[:, :shared], ids[:, size:]], 1)
        offsets = np.arange(2 * n + 1) * size
        signed = minhash.signatures(np.concatenate([one, two]).ravel(), offsets, minhash.bands_of(similarity))
        keys, bits = minhash.band_keys(signed), minhash._sketch(signed).view(np.uint64)
        apart = ~(keys[:n] == keys[n:]).any(1)
        x = bits[:n] ^ bits[n:]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
        assert apart.sum() <= 2 and (differ > minhash.most_different(similarity)).sum() == 0


def test_counts_are_exact_beyond_single_precision():
    flat = np.arange(3_000_000, dtype=np.uint64)
    assert minhash.intersections([flat], [flat[1:]]).tolist() == [[2_999_999]]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 3), (20, 5), (5, 2), (30, 31), (31, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 20: 1, 10: 10, 11: 10, 12: 10, 30: 30, 31: 30}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).collect() == []


def brute_exact(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(WHITE, "", t or ""), []).append((-len(t or ""), i is None, i or 0, n, i))
    return {k: (min(v), len(v)) for k, v in groups.items()}


def test_exact_groups(spark, rows):
    want = brute_exact(rows)
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        best, n = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[4], n)
    assert sum(r.kept for r in got) == len(want)
    docs = clashing(spark, rows)
    left = exact_dedup.drop_exact(docs)
    assert left.columns == docs.columns
    assert sorted(re.sub(WHITE, "", r.text or "") for r in left.collect()) == sorted(want)
    keepers = {(k, best[4]) for k, (best, _) in want.items()}
    assert {(re.sub(WHITE, "", r.text or ""), r.doc_id) for r in left.collect()} == keepers
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == [] and exact_dedup.drop_exact(frame(spark, [])).collect() == []


def test_equal_rows_leave_one(spark):
    """Many rows of one id and text: the least by all its columns stays, however the rows are dealt."""
    rows = [(5, "a b", 9 - k % 7) for k in range(500)] + [(None, " ", 3), (None, "", 2), (None, "", 4), (8, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long").repartition(6)
    got = sorted((r["doc_id"] or 0, r["text"], r["a.b"]) for r in exact_dedup.drop_exact(docs).collect())
    assert got == [(0, " ", 3), (5, "a b", 3), (8, "c", 1)]


def test_cuckoo_grows_and_deletes():
    index = CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(index.put(k, i) for i, k in enumerate(keys))
    assert not index.put(keys[7], "new") and index.get(keys[7]) == "new"
    assert all(index.get(k) is not None for k in keys) and len(index) == 5000
    assert all(index.remove(k) for k in keys[:2500]) and not index.remove(keys[0])
    assert index.get(keys[0]) is None and index.get(keys[4000]) == 4000 and len(index) == 2500
    same_print = [b"\x01\x00" + bytes(8) + bytes([i]) for i in range(20)]
    assert all(index.put(k, k) for k in same_print) and all(index.get(k) == k for k in same_print)


def test_update_index(spark):
    d = [bytes([i]) * 32 for i in range(4)]
    make = lambda xs: spark.createDataFrame([(bytearray(x),) for x in xs], "digest binary")
    index = spark.createDataFrame([], "digest binary, live long")
    index = exact_dedup.update_index(index, make([d[0], d[0], d[1]]), make([]), 3)
    index = exact_dedup.update_index(index, make([d[2]]), make([d[0], d[1], d[3]]), 3)
    assert {bytes(r.digest): r.live for r in index.collect()} == {d[0]: 1, d[2]: 1}


def brute_lines(rows, least):
    """Lines that stay in each (doc_id, text): a line goes if distinct ids, null not counted, make it frequent."""
    documents = {}
    for i, t in rows:
        documents.setdefault((i, t), (t or "").split("\n"))
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(f"^{WHITE}+|{WHITE}+\\Z", "", line))
    seen = {}
    for k, lines in documents.items():
        for line in lines:
            seen.setdefault(key(line), set()).update({k[0]} - {None})
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    return {k: [line for line in lines if key(line) not in gone] for k, lines in documents.items()}


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(3)
    common = ["Cookie notice", " cookie NOTICE\t", "Álvaro", "x", "~~"]
    out = [(i, "\n".join(rng.choice([*common, f"line {rng.randrange(60)}", f"own {i} {k}", "", "  "]) for k in range(rng.randrange(1, 12)))) for i in range(300)]
    repeated = [(2000, f"same id {k}\none id only\nnearly\nalmost") for k in range(40)] + [(None, f"null {k}\nno id\nnearly\nalmost") for k in range(40)]
    few = [(2100 + k, "nearly\nalmost" if k < 9 else "nearly") for k in range(8, 16)] + [(2100 + k, "nearly\nalmost") for k in range(1, 8)]
    return [*out, (1000, None), (1001, ""), (1002, "\n"), (1003, "a\r\nb\r"), (5, out[5][1]), (None, "x\nzz"), (None, "x\nzz"), *repeated, *few]


@pytest.mark.parametrize(("parts", "held"), [(1, 2000), (1, 11), (7, 30), (60, 2000)])
def test_lines(spark, line_rows, parts, held, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", held)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = frame(spark, line_rows)
        maps = line_dedup.keep_bitmaps(docs, min_docs=10)
        got = line_dedup.kept_digests(docs, maps).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = brute_lines(line_rows, 10)
    expect = sorted((i is None, i or 0, len((t or "").split("\n")), len((t or "").split("\n")) - len(want[i, t]), hashlib.sha256("\n".join(want[i, t]).encode()).hexdigest()) for i, t in line_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == expect
    assert sum(r.n_dropped for r in got) > 100


@pytest.mark.parametrize("parts", [1, 50])
def test_first_occurrences_stay(spark, line_rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = frame(spark, line_rows)
        maps = line_dedup.keep_bitmaps(docs, min_docs=1, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    texts = {(r.doc_id, r.thash): r.text for r in docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").collect()}
    left = []
    for r in maps:
        lines = (texts[r.doc_id, r.thash] or "").split("\n")
        left += [line_dedup.line_key(x.encode()) for x, k in zip(lines, line_dedup.kept_flags(r.keep, r.n_lines), strict=True) if k and line_dedup.line_key(x.encode())]
    every = {line_dedup.line_key(x.encode()) for t in texts.values() for x in (t or "").split("\n")} - {b""}
    counted = {line_dedup.line_key(x.encode()) for (i, _), t in texts.items() if i is not None for x in (t or "").split("\n")} - {b""}
    assert sorted(x for x in left if x in counted) == sorted(counted) and set(left) == every
