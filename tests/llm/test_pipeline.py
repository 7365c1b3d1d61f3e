"""The pipeline, stage by stage, against plain programs."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from test_dedup import CLASHES, WHITE, brute_components
from test_sampling import brute_targets, plain_mix, plain_pack
from test_scans import plain_score, toxic_rows

import corpus_pipeline
from vellum.llm import mixing, packing, toxicity
from vellum.llm.queries import MIX_MOST, MIX_SHARE, mix_propensity

FOLDER = "/root/testdata/sf0.001"


def fixture_rows():
    """(doc_id, text, source): toxic ones, exact and near copies, repeated rows, nulls, blanks and a long text."""
    rng = random.Random(11)
    base = [(i, t, rng.choice(["a", "b", "b", "b", None])) for i, t, _ in toxic_rows(260)]
    rows = list(base)
    for k in range(40):
        words = (base[k][1] + " " + " ".join(f"own{k}x{j}" for j in range(60))).split(" ")
        rows.append((1000 + k, " ".join(words), "c"))
        rows.append((1100 + k, "  ".join(words), "a"))
        changed = list(words)
        changed[rng.randrange(len(words))] = "changed"
        rows.append((1200 + k, " ".join(changed), "c"))
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \n", None), (None, "no id here", "a"), (None, "no id here", "a"), (None, None, None)]
    rows += [(3000, rows[3][1], "z")] * 3 + [(3001, " ".join(f"long{i % 5000}" for i in range(20_000)), "z")]
    return rows


def tables(spark, folder, rows):
    """documents with many clashing columns, and labels."""
    names = [c for c in CLASHES if c != "score"]
    schema = ", ".join(f"`{c.replace('`', '``')}` long" for c in names)
    documents = spark.createDataFrame([(i, t, "en", s, len(t or ""), *[k] * len(names)) for k, (i, t, s) in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {schema}")
    documents.write.parquet(f"{folder}/documents.parquet")
    truth = {i: y for i, _, y in toxic_rows(260)}
    labels = [(i, 0, truth[i]) for i, _, _ in rows if i in truth] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def states_of(spark, folder, out):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], str(folder)).write.parquet(str(out / name))
        states.append(spark.read.parquet(str(out / name)))
    assert all(s.columns == docs.columns for s in states[:-1])
    return states


def pairs(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.select("doc_id", "text").collect())


def check_stages(spark, folder, states):
    """Each stage on what its predecessor kept, against a plain program."""
    docs, clean, exact, near, mixed, packed = states
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert pairs(clean) == [x for x in pairs(docs) if plain_score(x[1], model) < 0.5]
    best = {}
    for i, t in pairs(clean):
        key = re.sub(WHITE, "", t)
        rank = (-len(t), i < 0, i)
        best[key] = min(best.get(key, (rank, (i, t))), (rank, (i, t)))
    assert pairs(exact) == sorted(x for _, x in best.values())
    rows = pairs(exact)
    group = brute_components([x for x in rows if x[0] >= 0], 80)
    assert pairs(near) == [x for x in rows if x[0] < 0 or group[x[0]] == x[0]]
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "thash", F.lit(7)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = mixing.word_counts(near, propensity=mix_propensity()).withColumn("u", u).collect()
    totals = {}
    for r in sized:
        totals[r.source] = totals.get(r.source, 0) + r.size
    want = plain_mix(sized, brute_targets(totals, MIX_SHARE, MIX_MOST), MIX_MOST)
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", WHITE + "+"), lambda w: w != ""))).alias("n")).collect()}
    wanted = {}
    for (i, _), n in want.items():
        wanted[i] = wanted.get(i, 0) + n
    assert sum(words.get(i, 0) != n for i, n in wanted.items()) <= len(totals)
    blocks = {}
    for r in packed.where("bin_id is not null").collect():
        blocks.setdefault(r.bin_id >> 24, {}).setdefault(r.bin_id, []).append(r.length)
    for bins in blocks.values():
        assert sorted(map(sorted, bins.values())) == sorted(map(sorted, plain_pack([n for b in bins.values() for n in b], packing.SIZES)[1]))
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == words


def test_stages_are_those_of_plain_programs(spark, tmp_path):
    rows = fixture_rows()
    tables(spark, tmp_path, rows)
    states = states_of(spark, tmp_path, tmp_path)
    counts = [s.count() for s in states]
    assert counts[0] == len(rows) and counts[1] < counts[0] - 20 and counts[2] < counts[1] - 30 and counts[3] < counts[2] - 25
    check_stages(spark, tmp_path, states)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables")
def test_stages_on_driver_tables(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    check_stages(spark, FOLDER, states_of(spark, FOLDER, tmp_path))


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
