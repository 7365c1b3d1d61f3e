"""Mixing and packing: targets, whole copies, reruns; sizes, coverage and cost of bins."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import mixing, packing
from vellum.llm.scratch import Scratch

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["a", "b", "é", "z", None, "Z"])
        n = rng.choice([1, 5, 30, 100]) if rng.random() < 0.995 else 4000
        out.append((i, " ".join(["w"] * n), source, "clash"))
    return [*out, (9000, None, "a", ""), (9001, "", "b", ""), (9002, " ", "only", ""), (9003, "", "void", ""), (None, "x y", "a", ""), (7, out[7][1], out[7][2], "")]


def brute_targets(sizes: dict, share: float, most: float) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(order, itertools.cycle(WEIGHTS)))
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark, rows):
    got = mixing.mix(frame(spark, rows), WEIGHTS, SHARE, MOST).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes, SHARE, MOST)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        biggest = max(r.size for r in got if r.source == s)
        assert abs(t - want[s]) <= biggest
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7), WEIGHTS, SHARE, MOST).collect()
    key = lambda r: (r.doc_id or -1, r.thash, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def plain_mix(rows, targets: dict, most: float) -> dict:
    """Words that each (doc_id, hash) gives, by one sort of each source. rows: doc_id, thash, source, size, propensity, u."""
    out = {}
    for source, target in targets.items():
        own = [r for r in rows if r.source == source]
        low, high = 0.0, 1e12
        for _ in range(300):
            scale = (low + high) / 2
            low, high = (scale, high) if sum(min(most, scale * r.propensity) * r.size for r in own) < target else (low, scale)
        ranked, rest = [], target
        for r in own:
            expected = min(most, high * r.propensity)
            expected = round(expected) if abs(expected - round(expected)) < 1e-9 else expected
            whole, p = int(expected), expected - int(expected)
            out[r.doc_id, r.thash] = whole * r.size
            rest -= whole * r.size
            if p > 0 and r.size:
                odds = (r.u / (1 - r.u)) / (p / (1 - p))
                ranked.append((odds, r.doc_id or 0, r.thash, r))
        ranked.sort(key=lambda x: x[:3])
        before, fits = 0, -1
        for k, (*_, r) in enumerate(ranked):
            if before + r.size / 2 <= rest:
                fits = k
            before += r.size
            if before > rest and k > fits + 20:
                break
        for *_, r in ranked[: fits + 1]:
            out[r.doc_id, r.thash] += r.size
    return out


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_draw_is_that_of_a_plain_program(spark, rows, share):
    """Unequal propensities within each source; only hashes are taken from Spark."""
    docs = frame(spark, [r for r in rows if r[0] is not None and r[0] != 7])
    length = F.coalesce(F.length("text"), F.lit(0))
    propensity = F.when(length > 100, 1.0).when(length > 20, 0.5).otherwise(0.125)
    got = mixing.mix(docs, WEIGHTS, share, MOST, propensity=propensity)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "thash", F.lit(7)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    table = mixing.word_counts(docs, propensity=propensity).withColumn("u", u).collect()
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    want = plain_mix(table, targets, MOST)
    wrong = sum(r.taken != want[r.doc_id, r.thash] for r in got.collect())
    assert wrong <= len(targets), "a document at the very edge of a source's histogram part may differ"
    for source, target in targets.items():
        own = [r for r in table if r.source == source]
        assert abs(sum(want[r.doc_id, r.thash] for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6


def test_full_sources_take_all_whatever_the_propensity(spark):
    docs = spark.createDataFrame([(i, "a b c" * (1 + i % 9), s) for i in range(60) for s in ["x"]] + [(100 + i, "word " * 200, "y") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs, (50.0, 1.0), 1.0, 2.0, propensity=F.col("doc_id") + 1).collect()
    assert all(r.taken == 2 * r.size for r in got if r.source == "x")


def test_mixed_documents_repeat_rows(spark, rows):
    docs = frame(spark, rows)
    out = mixing.mixed_documents(docs, WEIGHTS, SHARE, MOST)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    want = {}
    for r in mixing.mix(docs, WEIGHTS, SHARE, MOST).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    texts = {}
    for (i, _), n in counts.items():
        texts[i] = texts.get(i, 0) + n
    assert texts == {i: n for i, n in want.items() if n}
    assert mixing.mix(frame(spark, []), WEIGHTS, SHARE, MOST).collect() == []


def test_inclusion_follows_propensity(spark):
    """Documents of twice the propensity are taken about twice as often."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"))
    rich = F.col("doc_id") % 2 == 0
    out = mixing.mix(docs, (1.0,), 0.3, 2.0, propensity=F.when(rich, 2.0).otherwise(1.0))
    n = {r.k: r.n for r in out.groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("copies").alias("n")).collect()}
    assert n[0] + n[1] == pytest.approx(1200, abs=2) and 1.7 < n[0] / n[1] < 2.3


def test_plan_has_no_row_per_document(spark, rows):
    sizes = mixing.word_counts(frame(spark, rows))
    plan = mixing.mixing_plan(sizes, WEIGHTS, SHARE, MOST, 7, Scratch(spark, "t"))
    assert plan.count() == len({r[2] for r in rows})


def test_pack_is_valid_and_cheap():
    rng = random.Random(4)
    lengths = [rng.choice([3, 40, 300, 700, 1500, 5000, 8192]) + rng.randrange(20) for _ in range(2000)]
    lengths = [min(n, 8192) for n in lengths]
    bin_of, capacity, used = packing.pack(lengths)
    total = [0] * len(used)
    for n, b in zip(lengths, bin_of, strict=True):
        total[b] += n
    assert total == used and all(u <= c for u, c in zip(used, capacity, strict=True))
    assert all(c == packing.smallest(sorted(packing.SIZES), u) for u, c in zip(used, capacity, strict=True))
    cost = sum(packing.SIZES[c] for c in capacity)
    assert cost <= 1.1 * sum(lengths)


def plain_pack(lengths: list[int], cost: dict[int, float]) -> tuple[float, list[list[int]]]:
    """Least cost over the limits, and the bins' lengths, by looking at every open bin for every piece."""
    best = None
    for limit in sorted(cost):
        bins: list[list[int]] = []
        room: list[int] = []
        for need in sorted(lengths, reverse=True):
            fits = [k for k, r in enumerate(room) if r >= need]
            if fits:
                at = min(fits, key=lambda k: (room[k], k))
            else:
                sizes = [c for c in cost if need <= c <= limit] or [min(c for c in cost if c >= need)]
                at = len(bins)
                bins.append([])
                room.append(min(sizes, key=lambda c: (cost[c] / c, c)))
            bins[at].append(need)
            room[at] -= need
        total = sum(cost[min(c for c in cost if c >= sum(b))] for b in bins)
        if best is None or total < best[0]:
            best = (total, bins)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_pack_is_that_of_a_plain_program(seed):
    rng = random.Random(seed)
    cost = packing.SIZES if seed % 2 else {10: 12.0, 20: 21.0, 35: 40.0}
    lengths = [rng.randrange(1, max(cost) + 1) if rng.random() < 0.4 else rng.randrange(1, max(cost) // 6 + 1) for _ in range(400)]
    bin_of, capacity, used = packing.pack(lengths, cost)
    total, bins = plain_pack(lengths, cost)
    assert sum(cost[c] for c in capacity) == pytest.approx(total)
    own = [[] for _ in used]
    for n, b in zip(lengths, bin_of, strict=True):
        own[b].append(n)
    assert sorted(sorted(b) for b in own) == sorted(sorted(b) for b in bins)


def test_packing_is_the_plain_one_in_each_block(spark):
    """Whatever the input's split, a block holds the same pieces, packed as a plain program packs them."""
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 40, 700, 2000, 9000])), "s", "") for i in range(300)] + [(7000, "a b c", "s", "")] * 200
    one = packing.pack_documents(frame(spark, rows).repartition(1), block=60).collect()
    two = packing.pack_documents(frame(spark, rows[::-1]).repartition(9), block=60).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) > 500
    bins, blocks = {}, {}
    for r in one:
        bins.setdefault(r.bin_id, []).append(r.length)
        blocks.setdefault(r.bin_id >> 24, []).append(r.length)
    assert max(map(len, blocks.values())) < 120, "copies of one row are spread"
    for block, lengths in blocks.items():
        assert sorted(sorted(b) for i, b in bins.items() if i >> 24 == block) == sorted(sorted(b) for b in plain_pack(lengths, packing.SIZES)[1])


def test_many_copies_are_written_out_in_lots(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 7)
    got = packing.pack_documents(frame(spark, [(1, "a b", "s", "")] * 100 + [(2, None, "s", "")] * 20 + [(None, "c", "s", "")] * 3), block=10).collect()
    assert sum(r.doc_id == 1 for r in got) == 100 and sum(r.doc_id == 2 and r.bin_id is None for r in got) == 20 and sum(r.doc_id is None for r in got) == 3


def test_pack_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 10, 600, 3000, 20_000])), "s", "") for i in range(200)] + [(500, None, None, None), (None, "a b", "s", ""), (3, "x", "s", ""), (3, "x", "s", "")]
    got = packing.pack_documents(frame(spark, rows), block=50).collect()
    covered, spans, used = {}, {}, {}
    for r in got:
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        if r.bin_id is None:
            assert r.length == 0
        else:
            spans.setdefault(r.bin_id, []).append((r.offset, r.length))
            used[r.bin_id] = (r.used, r.capacity)
    for b, pieces in spans.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == used[b][0] <= used[b][1] and used[b][1] in packing.SIZES
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert {i: sum(n for _, n in v) for i, v in covered.items()} == want
    assert packing.pack_documents(frame(spark, [])).collect() == []
