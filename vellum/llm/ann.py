"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Equal vectors are one point with its few smallest ids, so a vector that a third of all rows
share is indexed once. Points are dealt into shards of bounded size by hash. A shard's graph is
built in batches: a greedy beam search from the medoid proposes neighbours, pruning keeps a
neighbour only if no kept one is closer to it by the factor `ALPHA`, and edges are added back
and pruned again when a point has too many. Searches run the same beam search in lock-step for a
block of queries, on every shard; candidates are scored again in double precision on the
original vectors.

A shard's task holds its vectors, `DEGREE` edges a point, and one mark for each of `LOCKSTEP`
queries and each point. How much a graph saves depends on the shard: README has measurements.

Cases: null vectors, vectors with null or non-finite components and zero vectors take no part,
as rows or as queries; so do null ids, and vectors of another length than the query's aren't
compared with it. Rows with the same id and vector are one row. Ties in score go to the smaller
id. With fewer candidates than k, all of them come back. Vectors of many components are held
whole. Columns other than id, vector and what `query` reads are never read, whatever their names.
Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions

#: Most points of a shard, and fewest while there are more tasks than shards.
SHARD_POINTS, LEAST_POINTS = 100_000, 10_000
#: Queries that meet a copy of a shard's graph, and those of them that are searched at once.
QUERY_BLOCK, LOCKSTEP = 20_000, 256
#: Edges of a point; as many more may wait for the next pruning.
DEGREE, SLACK = 32, 16
BEAM, SEARCH_BEAM = 64, 160
#: Points of a beam that are expanded in one step.
WIDTH = 4
ALPHA = 1.2
BATCH = 256


def beam_search(points: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the `beam` best points that each query's greedy search found, best first (-1: none).

    points and queries are unit vectors; edges has -1 where a point has fewer neighbours. All
    queries go in lock-step, each expanding its best points that are still open; a point is
    compared with a query once.
    """
    n, degree, width = len(queries), edges.shape[1], min(width, beam)
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    waits = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points)), bool)
    first = starts[:beam]
    ids[:, : len(first)] = first
    sims[:, : len(first)] = queries @ points[first].T
    waits[:, : len(first)] = True
    seen[:, first] = True
    live = np.arange(n)
    while len(live):
        waiting = np.where(waits[live], sims[live], -np.inf)
        at = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        going = np.take_along_axis(waiting, at, 1) > -np.inf
        some = going.any(1)
        live, at, going = live[some], at[some], going[some]
        near = np.full((len(live), width * degree), -1, np.int32)
        for j in range(width):
            rows = np.flatnonzero(going[:, j])
            own, spot = live[rows], at[rows, j]
            waits[own, spot] = False
            out = edges[ids[own, spot]]
            r, c = np.nonzero((out >= 0) & ~seen[own[:, None], out])
            fresh = out[r, c]
            seen[own[r], fresh] = True
            near[rows[r], j * degree + c] = fresh
        r, c = np.nonzero(near >= 0)
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[r, c] = np.einsum("ij,ij->i", points[near[r, c]], queries[live[r]])
        all_sims = np.concatenate([sims[live], sim], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        waits[live] = np.take_along_axis(np.concatenate([waits[live], near >= 0], 1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse near neighbours of each owner, nearest first (-1: none).

    candidates: a row for each owner, -1 where there are fewer; repeats and the owner itself
    don't count. A candidate goes once a kept one is alpha times closer to it than the owner is.
    """
    candidates = np.sort(candidates, 1)
    never = (candidates < 0) | (candidates == owners[:, None])
    never[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    near = points[np.where(never, 0, candidates)]
    far = 2 - 2 * np.einsum("bcd,bd->bc", near, points[owners])
    far[never] = np.inf
    order = np.argsort(far, 1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = alpha * alpha * (2 - 2 * np.matmul(near, near.transpose(0, 2, 1)))
    open_ = far < np.inf
    rows = np.arange(len(owners))
    kept = np.full((len(owners), degree), -1, np.int32)
    for place in range(degree):
        best = open_.argmax(1)
        some = open_[rows, best]
        if not some.any():
            break
        kept[some, place] = candidates[rows, best][some]
        open_ &= between[rows, best] > far
        open_[rows, best] = False
    return kept


def _add_back(points: np.ndarray, edges: np.ndarray, sources: np.ndarray, targets: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from targets to sources; a point whose edges no longer fit is pruned to `degree`."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    at, first, counts = np.unique(targets, return_index=True, return_counts=True)
    room = edges.shape[1]
    wide = np.full((len(at), room + int(counts.max(initial=0))), -1, np.int32)
    wide[:, :room] = edges[at]
    wide[np.repeat(np.arange(len(at)), counts), room + np.arange(len(targets)) - np.repeat(first, counts)] = sources
    wide = np.sort(wide, 1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    wide = -np.sort(-wide, 1)
    over = (wide >= 0).sum(1) > room
    edges[at[~over]] = wide[~over, :room]
    if over.any():
        edges[at[over]] = -1
        edges[at[over], :degree] = robust_prune(points, at[over], wide[over], degree, alpha)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each point (-1: none) and the points that searches start from."""
    n = len(points)
    random = np.random.default_rng(seed)
    edges = np.full((n, degree + SLACK), -1, np.int32)
    starts = np.unique(np.append(random.choice(n, min(n, 8), replace=False), np.argmax(points @ points.mean(0)))).astype(np.int32)
    order = random.permutation(n)
    done, size = 0, 16
    while done < n:
        part = order[done : done + min(size, batch)]
        done += len(part)
        size *= 2
        found, _ = beam_search(points, edges, starts, points[part], beam)
        mates = part[np.argsort(-(points[part] @ points[part].T), axis=1)[:, :9]]
        kept = robust_prune(points, part, np.concatenate([found, edges[part], mates], 1).astype(np.int32), degree, alpha)
        edges[part] = -1
        edges[part, :degree] = kept
        source, place = np.nonzero(kept >= 0)
        _add_back(points, edges, part[source], kept[source, place], degree, alpha)
    for low in range(0, n, 1024):
        over = low + np.flatnonzero((edges[low : low + 1024] >= 0).sum(1) > degree)
        if len(over):
            pruned = robust_prune(points, over, edges[over], degree, alpha)
            edges[over] = -1
            edges[over, :degree] = pruned
    return -np.sort(-edges, 1)[:, :degree], starts


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.iloc[np.argsort([ids[0] for ids in pdf["ids"]], kind="stable")]
    edges, starts = build_graph(_unit(pdf["vector"].tolist()))
    local = np.arange(len(pdf), dtype=np.int32)
    return pd.DataFrame({"shard": pdf["shard"], "dim": pdf["dim"], "local": local, "ids": pdf["ids"], "vector": pdf["vector"], "edges": list(edges), "start": np.isin(local, starts)})


def _search(k: int):
    def run(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(queries):
            graph = graph.sort_values("local")
            vectors = np.stack(graph["vector"].tolist()).astype(np.float64)
            edges = np.stack(graph["edges"].tolist()).astype(np.int32)
            ids = graph["ids"].tolist()
            points, asked = _unit(graph["vector"].tolist()), _unit(queries["vector"].tolist())
            starts = np.flatnonzero(graph["start"].to_numpy()).astype(np.int32)
            found = np.concatenate([beam_search(points, edges, starts, asked[low : low + LOCKSTEP], min(SEARCH_BEAM, len(points)))[0] for low in range(0, len(asked), LOCKSTEP)])
            norms = _norms(vectors)
            for q, vector, near in zip(queries["vec_id"].tolist(), queries["vector"].tolist(), found, strict=True):
                near = near[near >= 0]
                v = np.asarray(vector, np.float64)
                score = (vectors[near] * v).sum(1) / (norms[near] * _norms(v[None])[0])
                hits = sorted((-s, i) for s, p in zip(score.tolist(), near.tolist(), strict=True) for i in ids[p] if i != q)[:k]
                for s, i in hits:
                    out["query_id"].append(q)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _usable(vector: str) -> Column:
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(value, lambda x: x != 0)


def nearest(rows: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each row that `query` picks, itself excluded."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    usable = rows.where(query.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), query.alias("asks"))
    usable = usable.where(_usable("vector") & F.col("vec_id").isNotNull())
    # A map task passes on one row per id and vector; k + 1 ids of a vector are all that any answer can name.
    same = usable.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    few = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    points = same.groupBy("dim", "vector", "salt").agg(few.alias("ids")).groupBy("dim", "vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    points = scratch.cut(points, "points")
    # As many shards as tasks until they would be too small to be worth a graph; never one that is too large for a task.
    full, spread = F.ceil(F.count("*") / SHARD_POINTS), F.ceil(F.count("*") / LEAST_POINTS)
    sizes = points.groupBy("dim").agg(F.greatest(full, F.least(spread, F.lit(shuffle_partitions(spark)))).alias("shards"))
    sharded = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))
    # Shards are few and costly, so their number of tasks is fixed and not merged by size.
    tasks = max(1, sizes.agg(F.sum("shards")).first()[0] or 0)
    graph = sharded.select("shard", "dim", "ids", "vector").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, "shard long, dim int, local int, ids array<long>, vector array<double>, edges array<int>, start boolean")
    graph = scratch.cut(graph, "graph")
    asked = usable.where("asks").select("vec_id", "vector", F.size("vector").alias("dim")).distinct()
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))
    asked = asked.join(blocks.join(sizes, "dim"), "dim").withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select("dim", "shard", "block", "vec_id", "vector")
    served = graph.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    served, asked = (side.repartition(tasks, "dim", "shard", "block") for side in (served, asked))
    found = served.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
