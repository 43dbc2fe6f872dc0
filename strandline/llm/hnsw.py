"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Each shard's task builds its graph and audits it: a sample of its vectors is searched with a beam
that widens until the links found agree with brute force. Then every vector queries every shard's
graph, many queries in step. A query whose whole beam is above the threshold may have more links
than the beam holds; it is held against the shard's vectors exactly. Cosines are checked in double
precision and links are united into components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.graph import components, forest
from strandline.llm.work import Scope, saved, small_batches

THRESHOLD = 0.9
#: Shards at least, and vectors and their bytes of a shard at most (a shard's graph must fit in a task).
SHARDS = 6
SHARD_ROWS = 200_000
SHARD_BYTES = 192 << 20
#: Links of a node on upper layers; the ground layer has twice as many.
DEGREE = 12
BUILD_BEAM = 48
FIRST_BEAM = 32
#: Recall of links that the audit asks for, and its queries per shard.
AUDIT_RECALL = 0.98
AUDIT_QUERIES = 256
#: How far the audit's queries are moved from stored vectors: to a cosine of 0.98, and to one just above the threshold of 0.9.
AUDIT_NOISE = (0.2, 0.46)
#: Vectors of a block of queries.
BLOCK = 2048
#: Tasks of a search at most, unless there are more shards: a task then lets more blocks pass by its graph.
MOST_TASKS = 20_000
#: Bytes of linked vectors that are broadcast at most; more are joined.
BROADCAST_BYTES = 32 << 20


@dataclass
class Graph:
    vectors: np.ndarray
    layers: list[np.ndarray]
    order: np.ndarray
    beam: int = FIRST_BEAM
    recall: float = 1.0


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step from their entries (queries x e): node numbers (-1: none) and cosines, best first.

    limit: nodes from this number on aren't in the graph yet.
    """
    n_q, n = len(queries), len(vectors) if limit is None else limit
    seen = np.full((n_q, n), -1, np.int32)
    rows = np.arange(n_q)
    ids = np.full((n_q, beam), -1, np.int32)
    sims = np.full((n_q, beam), -2.0, np.float32)
    done = np.ones((n_q, beam), bool)
    e = entries.shape[1]
    ids[:, :e] = entries
    sims[:, :e] = np.einsum("qd,qed->qe", queries, vectors[entries])
    done[:, :e] = False
    seen[rows[:, None], entries] = 0
    by = np.argsort(-sims, axis=1, kind="stable")
    ids, sims, done = (np.take_along_axis(v, by, 1) for v in (ids, sims, done))
    active = rows
    take = 3
    while len(active):
        open_ = ~done[active]
        order = np.argsort(~open_, axis=1, kind="stable")[:, :take]
        chosen = np.take_along_axis(open_, order, 1)
        keep = chosen.any(axis=1)
        active, order, chosen = active[keep], order[keep], chosen[keep]
        if not len(active):
            break
        nodes = np.where(chosen, ids[active[:, None], order], -1)
        done[active[:, None], order] = True
        near = links[np.maximum(nodes, 0)]
        near[nodes < 0] = -1
        near = near.reshape(len(active), -1)
        row = np.broadcast_to(active[:, None], near.shape)
        valid = near >= 0
        at = np.maximum(near, 0)
        valid &= seen[row, at] < 0
        column = np.broadcast_to(np.arange(near.shape[1], dtype=np.int32), near.shape)
        seen[row[valid], at[valid]] = column[valid]
        valid &= seen[row, at] == column  # of a node met twice in a step, one
        found = np.full(near.shape, -2.0, np.float32)
        r, c = np.nonzero(valid)
        found[r, c] = np.einsum("nd,nd->n", queries[active[r]], vectors[near[r, c]])
        worst = sims[active, -1]
        found[found <= worst[:, None]] = -2.0
        best = min(beam, found.shape[1])
        top = np.argpartition(-found, best - 1, axis=1)[:, :best]
        found, near = np.take_along_axis(found, top, 1), np.take_along_axis(near, top, 1)
        all_sims = np.concatenate((sims[active], found), axis=1)
        all_ids = np.concatenate((ids[active], np.where(found > -2.0, near, -1)), axis=1)
        all_done = np.concatenate((done[active], found <= -2.0), axis=1)
        by = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(v, by, 1) for v in (all_sims, all_ids, all_done))
    return ids, sims


def _diverse(vectors: np.ndarray, node: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates (best first), up to degree that are nearer to it than to those already chosen; then the nearest others."""
    n, k = ids.shape
    valid = (ids >= 0) & (ids != node[:, None])
    v = vectors[np.maximum(ids, 0)]
    between = np.einsum("nid,njd->nij", v, v)
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        close = (between[:, j] * chosen).max(axis=1, initial=-2.0, where=chosen)
        chosen[:, j] = valid[:, j] & (close < sims[:, j]) & (chosen.sum(axis=1) < degree)
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    by = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.full((n, degree), -1, np.int64)
    out[:, : by.shape[1]] = np.where(np.take_along_axis(valid, by, 1), np.take_along_axis(ids, by, 1), -1)
    return out


def _connect(vectors: np.ndarray, links: np.ndarray, target: np.ndarray, source: np.ndarray) -> None:
    """Adds links target -> source; a node with too many keeps a diverse choice."""
    real = target >= 0
    target, source = target[real], source[real]
    by = np.argsort(target, kind="stable")
    target, source = target[by], source[by]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    degree = links.shape[1]
    for size in np.unique(np.minimum(count, 64)):  # equal shapes together
        pick = np.flatnonzero(np.minimum(count, 64) == size)
        # at most 64 newcomers at once; of more, the nearest
        new = np.full((len(pick), size), -1, np.int64)
        for row, p in enumerate(pick):
            s = source[first[p] : first[p] + count[p]]
            if count[p] > size:
                s = s[np.argsort(-(vectors[s] @ vectors[nodes[p]]), kind="stable")[:size]]
            new[row] = s
        own = nodes[pick]
        both = np.concatenate((links[own], new), axis=1)
        sims = np.einsum("nd,nkd->nk", vectors[own], vectors[np.maximum(both, 0)])
        sims[both < 0] = -2.0
        order = np.argsort(-sims, axis=1, kind="stable")
        links[own] = _diverse(vectors, own, np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1), degree)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """A graph over unit vectors (float32). Nodes come in batches that search the graph before them and, within a batch, each other."""
    n = len(vectors)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(DEGREE)).astype(int), 8)
    order = np.argsort(-level, kind="stable")  # upper layers first, so that every layer is a prefix
    vectors, level = vectors[order], level[order]
    layers: list[np.ndarray] = []
    for height in range(int(level.max(initial=0)), -1, -1):
        size = int((level >= height).sum())
        degree = DEGREE if height else 2 * DEGREE
        links = np.full((size, degree), -1, np.int64)
        done = 0
        while done < size:
            batch = np.arange(done, min(size, done + max(64, min(done, 512))))
            q = vectors[batch]
            inside = q @ q.T
            np.fill_diagonal(inside, -2.0)
            k = min(degree, len(batch))
            top = np.argpartition(-inside, k - 1, axis=1)[:, :k]
            ids, sims = batch[top], np.take_along_axis(inside, top, 1)
            if done:
                entry = _descend(vectors, [x for x in layers if len(x) <= done], q)
                found, near = _search(vectors, links, q, entry, BUILD_BEAM, limit=done)
                ids, sims = np.concatenate((found, ids), axis=1), np.concatenate((near, sims), axis=1)
            by = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
            links[batch] = _diverse(vectors, batch, ids, sims, degree)
            _connect(vectors, links, links[batch].ravel(), np.repeat(batch, degree))
            done += len(batch)
        layers.append(links)
    return Graph(vectors, layers, order)


def _descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The entries that a greedy search through the upper layers gives."""
    entry = np.zeros((len(queries), 1), np.int64)
    for links in layers:
        entry = _search(vectors, links, queries, entry, 4, limit=len(links))[0][:, :1].astype(np.int64)
    return entry


def query(graph: Graph, queries: np.ndarray, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Each query's nodes of (nearly) at least the threshold; exact where the whole beam is above it."""
    floor = threshold - 1e-4
    out: list[np.ndarray] = []
    width = max(16, min(1024, (64 << 20) // (4 * max(len(graph.vectors), 1))))
    for at in range(0, len(queries), width):
        q = queries[at : at + width]
        beam = min(graph.beam, len(graph.vectors))
        if beam < len(graph.vectors):
            ids, sims = _search(graph.vectors, graph.layers[-1], q, _descend(graph.vectors, graph.layers[:-1], q), beam)
            found = [i[s >= floor] for i, s in zip(ids, sims, strict=True)]
            full = np.flatnonzero(sims[:, -1] >= floor)
        else:
            found, full = [None] * len(q), np.arange(len(q))
        for part in np.array_split(full, -(-len(full) // 64)) if len(full) else []:
            hits = q[part] @ graph.vectors.T >= floor
            for row, hit in zip(part, hits, strict=True):
                found[row] = np.flatnonzero(hit)
        out += found
    return out


def audited(graph: Graph, threshold: float = THRESHOLD, recall: float = AUDIT_RECALL, queries: int = AUDIT_QUERIES, seed: int = 7) -> Graph:
    """Widens the graph's beam until a sample's links agree with brute force; a beam of all nodes is brute force itself."""
    n = len(graph.vectors)
    pick = np.sort(np.random.default_rng(seed).permutation(n)[:queries])
    noise = np.random.default_rng(seed + 1).normal(size=(len(pick), graph.vectors.shape[1])).astype(np.float32)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    scale = np.resize(np.array(AUDIT_NOISE, np.float32), len(pick))
    probes = graph.vectors[pick] + scale[:, None] * noise  # as near copies and the farthest links would ask
    probes /= np.linalg.norm(probes, axis=1, keepdims=True)
    truth = [np.flatnonzero(h) for h in probes @ graph.vectors.T >= threshold]
    total = sum(map(len, truth))
    while graph.beam < n:
        found = query(graph, probes, threshold)
        hit = sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True))
        graph.recall = hit / total if total else 1.0
        if hit >= recall * total:
            break
        graph.beam *= 2
    else:
        graph.recall = 1.0
    return graph


def classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct usable vectors: id (smallest key), copies, the vector as doubles and a hash of it."""
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good &= F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    usable = vectors.where(F.col(key).isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return usable.groupBy(F.xxhash64("vector").alias("hash"), "vector").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


GRAPH_SCHEMA = "shard int, width int, ids binary, copies binary, vectors binary, layers array<binary>, degrees array<int>, beam int, recall double"


def build_shards(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard and vector length: the audited graph with its vectors."""

    def run(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("vector")))
        graph = audited(build(x.astype(np.float32)))
        order = graph.order
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "ids": [table.column("id").to_numpy()[order].tobytes()], "copies": [table.column("copies").to_numpy()[order].tobytes()], "vectors": [x[order].tobytes()], "layers": [[v.astype(np.int32).tobytes() for v in graph.layers]], "degrees": pa.array([[v.shape[1] for v in graph.layers]], pa.list_(pa.int32())), "beam": pa.array([graph.beam], pa.int32()), "recall": pa.array([graph.recall], pa.float64())}).cast(pa.schema([("shard", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("degrees", pa.list_(pa.int32())), ("beam", pa.int32()), ("recall", pa.float64())]))

    dealt = distinct.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "width": F.size("vector")})
    return dealt.groupBy("shard", "width").applyInArrow(run, GRAPH_SCHEMA)


def links(distinct: DataFrame, scope: Scope, threshold: float = THRESHOLD, shards: int | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Of distinct vectors: (id, n: other rows linked directly in other classes), edges (a, b) that span the links found, and the least recall of the shards' audits.

    Every vector asks every shard's graph. Queries are dealt to parts of about a shard's size, or larger ones if that made over MOST_TASKS tasks; a task holds one graph and lets the blocks of
    one part pass, so a graph moves once for every part and a query once for every shard. It gives the links as counts and as forests.
    """
    spark = distinct.sparkSession
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    size = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (width or 1))))
    shards = shards or max(SHARDS, -(-n // size))
    parts = max(1, -(-n // size), -(-2 * spark.sparkContext.defaultParallelism // shards))
    parts = min(parts, max(1, MOST_TASKS // shards))
    graphs = scope.saved(build_shards(distinct, shards), "graphs")
    recall = graphs.agg(F.min("recall")).first()[0]
    blocks = max(parts, -(-n // BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("vector")))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()), "q_ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "q_vectors": pa.array([x.tobytes()], pa.binary())})

    dealt = distinct.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"), "width": F.size("vector")})
    queries = scope.saved(dealt.groupBy("block", "width").applyInArrow(pack, "block int, width int, q_ids binary, q_vectors binary"), "query-blocks")

    def run(batches):
        cell = lambda batch, name, row: batch.column(name)[row]
        held, exact, graph = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                at = tuple(cell(batch, c, row).as_py() for c in ("shard", "part", "width"))
                if cell(batch, "block", row).as_py() < 0:
                    ids, copies = (np.frombuffer(cell(batch, c, row).as_buffer(), np.int64) for c in ("ids", "copies"))
                    exact = np.frombuffer(cell(batch, "vectors", row).as_buffer(), np.float64).reshape(-1, at[2])
                    layers = [np.frombuffer(v, np.int32).reshape(-1, d) for v, d in zip(cell(batch, "layers", row).as_py(), cell(batch, "degrees", row).as_py(), strict=True)]
                    held, graph = at, Graph(exact.astype(np.float32), layers, np.arange(len(exact)), cell(batch, "beam", row).as_py())
                    continue
                if at != held:  # no stored vector of this length in the shard
                    continue
                q_ids = np.frombuffer(cell(batch, "q_ids", row).as_buffer(), np.int64)
                q = np.frombuffer(cell(batch, "q_vectors", row).as_buffer(), np.float64).reshape(-1, at[2])
                found = query(graph, q.astype(np.float32), threshold)
                counts = np.zeros(len(q), np.int64)
                edges: list[np.ndarray] = []
                for k, hit in enumerate(found):
                    hit = hit[ids[hit] != q_ids[k]]
                    hit = hit[exact[hit] @ q[k] >= threshold]
                    counts[k] = copies[hit].sum()
                    if len(hit):
                        edges.append(np.stack((np.full(len(hit), q_ids[k]), ids[hit])))
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(counts[some]), pa.nulls(int(some.sum()), pa.int64())], names=["a", "n", "b"])
                if edges:
                    a, b = np.concatenate(edges, axis=1)
                    for tree in forest([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]):
                        yield pa.RecordBatch.from_arrays([tree.column("a"), pa.nulls(tree.num_rows, pa.int64()), tree.column("b")], names=["a", "n", "b"])

    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    stored = graphs.select("shard", every(parts).alias("part"), "width", F.lit(-1).alias("block"), "ids", "copies", "vectors", "layers", "degrees", "beam")
    asked = queries.select(every(shards).alias("shard"), (F.col("block") % parts).alias("part"), "width", "block", "q_ids", "q_vectors")
    both = stored.unionByName(asked, allowMissingColumns=True).repartitionById(shards * parts, (F.col("shard") * parts + F.col("part")).cast("int")).sortWithinPartitions("shard", "part", "width", "block")
    found = scope.saved(both.mapInArrow(run, "a bigint, n bigint, b bigint"), "vector-links")
    return found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("b is not null").select("a", "b"), recall


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: key (an integer), n_links (other rows linked directly), component (smallest key reachable), kept, and
    audit_recall, the least recall of links that a shard's audit measured.

    Rows with equal vectors are one class. A row whose vector is null, empty, all zero or holds a null or
    non-finite component links with nothing, as does one with a null key; vectors of different length never link.
    """
    small_batches(vectors.sparkSession)
    with Scope(vectors.sparkSession) as scope:
        distinct = scope.saved(classes(vectors, key, vector), "vectors")
        counts, edges, recall = links(distinct, scope, threshold)
        labels = components(edges).withColumnRenamed("node", "id").withColumnRenamed("component", "label")
        found = distinct.select("hash", "vector", "id", "copies").join(counts, "id", "left").join(labels, "id", "left")
        least = found.select("hash", "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component"))
        # vectors without copies or links are their own component; the others are few, or joined by a hash of the vector
        linked = saved(least.where("n_links > 0"), "linked-vectors")
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("own")).withColumn("own_hash", F.xxhash64("own"))
    small = F.broadcast(linked) if linked.count() * 8 * _width(linked) <= BROADCAST_BYTES else linked
    out = rows.join(small, (F.col("own_hash") == F.col("hash")) & (F.col("own") == F.col("vector")), "left")
    known = F.col("key").isNotNull() & F.col("component").isNotNull()
    out = out.select(F.col("key").alias(key), F.when(known, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(known, F.col("component")).otherwise(F.col("key")).alias("component"))
    return out.withColumns({"kept": F.coalesce(F.col(key) == F.col("component"), F.lit(True)), "audit_recall": F.lit(recall).cast("double")})


def _width(linked: DataFrame) -> int:
    """Components of the longest vector."""
    return linked.agg(F.max(F.size("vector"))).first()[0] or 1
