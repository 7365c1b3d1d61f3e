"""MinHash near-dedup with circulant signatures, banding and exact Jaccard verification.

Signatures take two permutations of 32-bit shingle ids: the first scatters the ids, the second
is shifted circularly by one more step for each coordinate. Texts with equal shingle sets are
one node from the start. Nodes that share a band are compared by two bits of each coordinate;
pairs that may reach the similarity are verified on their full sets.

No bucket is expanded into all its pairs. First each node is verified against one node that
opens a bucket of its; copies then hang together, and only pairs across components matter, as
pairs within one can't change the result. Buckets of up to `SMALL` nodes give what is left as
pairs, a bounded number for each node. Nodes of larger buckets that still have a possible
partner are gathered in families, which share buckets; a family's texts meet in blocks of
bounded size, where one matrix product counts all intersections and only links that join
components leave the task. So every possible pair of every bucket is decided on full sets.

Bounds: a task holds two blocks, of `LOAD` shingles or one text each. A bucket of L shingles
gives (L / LOAD) ** 2 / 2 pairs of blocks at most, and that only for its nodes which still have
a possible partner in another component; copies and chains of copies have none by then.
A pair at the similarity is lost with a chance of `MOST_MISSED` by its bands, and of less than
one in a million by its bits.

Cases: a null, empty or blank text has an empty set and is linked with nothing. A text of fewer
than five words has its whole sequence as its one shingle. Very long texts are sets like others,
held one at a time where they exceed a block. Rows with the same doc_id count as one document.
Rows of null doc_id take no part: they have a null component and stay in `drop_near`. An empty
table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, unused_name
from .tokens import mix64, shingle_sets, slices

#: Links need 100 * intersection >= similarity * union.
SIMILARITY = 80
#: Coordinates of a band, and the most likely a pair at the similarity may share no band.
ROWS, MOST_MISSED = 5, 3e-5
#: Coordinates whose bits fit in a sketch.
SKETCHED = 96
#: Nodes of a bucket whose pairs are written out, and of one whose nodes are all taken as having a partner.
SMALL, LARGE = 8, 4096
#: Shingles of a block of texts, and blocks of a family beyond which its blocks follow buckets.
LOAD, BLOCKS = 600_000, 8
#: Columns of the incidence matrix that are held at once.
COLUMNS = 8192

_SIGNED = "doc_id long, n int, h1 long, h2 long, bands array<long>, s0 long, s1 long, s2 long"


def bands_of(similarity: int) -> int:
    """Bands by which a pair at the similarity is missed with a chance of MOST_MISSED at most: 18 at 85, 27 at 80."""
    apart = 1 - (similarity / 100) ** ROWS
    return 1 if apart <= 0 else math.ceil(math.log(MOST_MISSED) / math.log(apart))


def most_different(similarity: int) -> int:
    """Of the sketched pairs of bits, as many may differ: five deviations above what a pair at the similarity shows."""
    n, p = min(bands_of(similarity) * ROWS, SKETCHED), 0.75 * (1 - similarity / 100)
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit ids."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, offsets: np.ndarray, bands: int = bands_of(SIMILARITY)) -> np.ndarray:
    """Coordinate k of a set is the least value of the second permutation, shifted by k, on its scattered ids."""
    has = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands * ROWS), np.uint32)
    if not len(has):
        return out
    ids = _scatter((sets >> np.uint64(32)).astype(np.uint32))
    at = offsets[:-1][has]
    x, y = np.empty_like(ids), np.empty_like(ids)
    for k in range(bands * ROWS):
        np.subtract(ids, np.uint32(k), out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[has, k] = np.minimum.reduceat(x, at)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = signed.shape[1] // ROWS
    rows = signed.reshape(len(signed), bands, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def _sketch(signed: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SKETCHED coordinates in three 64-bit integers."""
    bits = np.zeros((len(signed), SKETCHED), np.uint64)
    kept = signed[:, :SKETCHED]
    bits[:, : kept.shape[1]] = kept & np.uint32(3)
    shifts = 2 * np.arange(32, dtype=np.uint64)
    return np.bitwise_or.reduce(bits.reshape(-1, 3, 32) << shifts, axis=2).view(np.int64)


def _sign(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, offsets = shingle_sets(part.column("text"))
                signed = signatures(sets, offsets, n_bands)
                totals = np.zeros((2, len(sets) + 1), np.uint64)
                np.cumsum(sets, out=totals[0, 1:])
                np.cumsum(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), out=totals[1, 1:])
                sums = (totals[:, offsets[1:]] - totals[:, offsets[:-1]]).view(np.int64)
                keys, bits = band_keys(signed), _sketch(signed)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n_bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int32()), pa.array(sums[0]), pa.array(sums[1]), bands, *(pa.array(bits[:, k].copy()) for k in range(3))], names=["doc_id", "n", "h1", "h2", "bands", "s0", "s1", "s2"])

    return run


def _verify(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            row = 0
            for part in slices(batch, "text_b"):
                sets, offsets = shingle_sets(part.column("text_b"))
                for k, (a, text) in enumerate(zip(part.column("a").to_pylist(), part.column("text_a"), strict=True)):
                    if a != last[0]:
                        last = (a, shingle_sets(pa.array([text.as_py()], pa.large_string()))[0])
                    one, two = last[1], sets[offsets[k] : offsets[k + 1]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    linked[row] = both > 0 and 100 * both >= similarity * (len(one) + len(two) - both)
                    row += 1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _different(a: str, b: str) -> Column:
    """Coordinates whose two bits differ between columns a0..a2 and b0..b2."""
    total = F.lit(0)
    for k in range(3):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def _possible(a: str, b: str, similarity: int) -> Column:
    """Whether two nodes may reach the similarity, by their set sizes and bits."""
    small, large = F.least(f"{a}n", f"{b}n").cast("long"), F.greatest(f"{a}n", f"{b}n").cast("long")
    return (100 * small >= similarity * large) & (_different(f"{a}s", f"{b}s") <= most_different(similarity))


def _as(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(c if c in ("key", "block", "chunk") else prefix + c) for c in nodes.columns))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """a, b, linked. The text of b travels to a, where a hot a is split by Spark; its own text is there once a split."""
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    found = joined.mapInArrow(_verify(similarity), "a long, b long, linked boolean")
    return found


def _members(nodes: DataFrame) -> DataFrame:
    """A row for each node in each bucket of two or more: its own and the bucket's first node's size and bits, and the bucket's size and load."""
    slim = nodes.select("rep", "n", "s0", "s1", "s2")
    keyed = nodes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("first_rep"), F.sum("n").alias("load")).where("size > 1")
    buckets = buckets.join(_as(slim, "first_"), "first_rep")
    return keyed.select("rep", "key").join(buckets, "key").join(slim, "rep")


def _first_pairs(members: DataFrame, similarity: int) -> DataFrame:
    """For each node, the bucket opener that shares most bands with it and may be similar."""
    open_to = members.where("rep <> first_rep").where(_possible("", "first_", similarity))
    shared = open_to.groupBy("rep", "first_rep").agg(F.count("*").alias("shared"), F.first(_different("s", "first_s")).alias("different"))
    best = shared.groupBy("rep").agg(F.max(F.struct("shared", -F.col("different"), -F.col("first_rep"), "first_rep")).alias("best"))
    return best.select(F.col("best.first_rep").alias("a"), F.col("rep").alias("b"))


def _active(members: DataFrame, similarity: int, across: bool = False) -> DataFrame:
    """Rows of members with a possible partner in their bucket; of buckets beyond LARGE nodes, all.

    across: only partners of another component (column comp) count.
    """
    side = members.where(F.col("size") <= LARGE)
    other = _as(side.select("key", "rep", "n", "s0", "s1", "s2", *(["comp"] if across else [])).withColumnRenamed("key", "o_key"), "o_").withColumnRenamed("o_o_key", "o_key")
    differ = F.col("comp") != F.col("o_comp") if across else F.col("rep") != F.col("o_rep")
    paired = side.join(other, (F.col("key") == F.col("o_key")) & differ & _possible("", "o_", similarity), "left_semi")
    return paired.unionByName(members.where(F.col("size") > LARGE))


def _in_components(members: DataFrame, belongs: DataFrame) -> DataFrame:
    """members of buckets that hold more than one component, with comp."""
    own = members.join(belongs, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    mixed = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return own.join(mixed, "key", "left_semi")


def _written_pairs(members: DataFrame, decided: DataFrame, similarity: int) -> DataFrame:
    """Undecided possible pairs (a, b) across components in small buckets: SMALL - 1 per node and bucket at most."""
    side = members.select("key", "rep", "n", "s0", "s1", "s2", "comp")
    other = _as(side.withColumnRenamed("key", "o_key"), "o_").withColumnRenamed("o_o_key", "o_key")
    meet = (F.col("key") == F.col("o_key")) & (F.col("rep") < F.col("o_rep")) & (F.col("comp") != F.col("o_comp")) & _possible("", "o_", similarity)
    pairs = side.join(other, meet).select(F.col("rep").alias("a"), F.col("o_rep").alias("b")).distinct()
    done = decided.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets of one with those of two."""
    out = np.zeros((len(one), len(two)), np.int64)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(shared):
        return out
    placed = []
    for codes, rows in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(shared, codes), len(shared) - 1)
        hit = shared[at] == codes
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        parts = []
        for (at, rows), n in zip(placed, (len(one), len(two)), strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            dense = np.zeros((n, width), np.float32)
            dense[rows[a:b], at[a:b] - low] = 1
            parts.append(dense)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _block_links(similarity: int):
    """Links that join components between the two sides of a pair of blocks, or within one block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == k] for k in (0, 1)]
        same = not len(sides[1])
        if same:
            sides[1] = sides[0]
        sets = []
        for side in sides[: 1 if same else 2]:
            flat, offsets = shingle_sets(pa.array(side["text"], pa.large_string()))
            sets.append([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        sets = sets * 2 if same else sets
        sizes = [np.array([len(x) for x in s]) for s in sets]
        both = intersections(*sets)
        reps, comps = ([side[c].to_numpy() for side in sides] for c in ("rep", "comp"))
        linked = (both > 0) & (100 * both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both)) & (comps[0][:, None] != comps[1][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(linked):
            x, y = root(comps[0][i]), root(comps[1][j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((reps[0][i], reps[1][j]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _family_links(members: DataFrame, texts: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """u, v of links across components among nodes of large buckets. members: rows with a partner, and comp.

    A bucket's first node stands for it, so that no step needs all rows of a bucket in one task
    but the joins by key, which Spark splits.
    """
    families = components(members.select(F.col("rep").alias("u"), F.col("first_rep").alias("v")), scratch, "families")
    homes = members.groupBy("rep", "comp", "n").agg(F.max(F.struct("load", "key")).alias("home"))
    nodes = homes.join(families.withColumnRenamed("node", "rep"), "rep", "left").withColumn("family", F.coalesce("component", "rep")).drop("component")
    nodes = scratch.cut(nodes, "family-nodes")
    loads = nodes.groupBy("family").agg(F.sum("n").alias("family_load"))
    placed = nodes.join(loads, "family")
    compact = F.col("family_load") <= LOAD * BLOCKS
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.when(compact, F.col("family_load")).otherwise(F.col("home.load")) / LOAD))
    block = F.xxhash64(compact, F.when(compact, F.col("family")).otherwise(F.col("home.key")), part)
    placed = scratch.cut(placed.select("rep", "comp", block.alias("block")), "blocks")
    met = members.select("key", "rep").join(placed, "rep").select("key", "block").distinct()
    pairs = met.join(met.select("key", F.col("block").alias("other")), "key").where("block <= other").select("block", "other").distinct()
    full = placed.join(texts, F.col("rep") == F.col("doc_id")).select("rep", "comp", "block", "text")
    one = pairs.join(full, "block").select("block", "other", F.lit(0).alias("side"), "rep", "comp", "text")
    two = pairs.where("block < other").join(full.withColumnRenamed("block", "other"), "other").select("block", "other", F.lit(1).alias("side"), "rep", "comp", "text")
    return one.unionByName(two).groupBy("block", "other").applyInPandas(_block_links(similarity), "u long, v long")


def near_components(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.cut(rows.mapInArrow(_sign(bands_of(similarity)), _SIGNED), "signed")
    nodes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands", "s0", "s1", "s2")))
    nodes = scratch.cut(nodes, "nodes")
    members = scratch.cut(_members(nodes), "members")
    active = _active(members, similarity).select("rep").distinct()
    texts = scratch.cut(rows.join(active, F.col("doc_id") == F.col("rep"), "left_semi"), "texts")

    first = scratch.cut(_verified(_first_pairs(members, similarity), texts, similarity), "first")
    links = first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    belongs = scratch.cut(components(links, scratch, "stars-0"), "belongs-0")
    # Written first, so that the next join by key has nothing else to keep in place and Spark may split its hot keys.
    mixed = scratch.cut(_in_components(members.where(F.col("size") > SMALL), belongs), "mixed-0")
    large = _active(mixed, similarity, across=True)
    large = scratch.cut(large.select("key", "rep", "comp", "n", "first_rep", "load"), "large")
    if not large.isEmpty():
        links = links.unionByName(scratch.cut(_family_links(large, texts, similarity, scratch), "family-links"))
        belongs = scratch.cut(components(links, scratch, "stars-1"), "belongs-1")
    mixed = scratch.cut(_in_components(members.where(F.col("size") <= SMALL), belongs), "mixed-1")
    written = scratch.cut(_written_pairs(mixed, first, similarity), "written")
    if not written.isEmpty():
        last = scratch.cut(_verified(written, texts, similarity), "last")
        links = links.unionByName(last.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        belongs = scratch.cut(components(links, scratch, "stars-2"), "belongs-2")
    scratch.drop("texts", "members", "mixed-0", "mixed-1")

    sets = nodes.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "rep").join(belongs, F.col("rep") == F.col("node"), "left").select("x1", "x2", F.coalesce("component", "rep").alias("component_id"))
    placed = signed.select("doc_id", "n", "h1", "h2").join(sets, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of smallest id; columns unchanged."""
    name = unused_name(docs, "gone")
    gone = near_components(docs, similarity, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
