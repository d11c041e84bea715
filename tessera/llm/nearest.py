"""Approximate nearest neighbours by a navigable small-world graph per shard.

Equal vectors are first joined: only the least ``k + 1`` ids of each distinct
vector can be among any row's ``k`` nearest, so a vector that a third of the
rows share is one node, and the window that finds those ids is limited before it
shuffles. Distinct vectors are dealt by hash to shards of about ``shard_size``,
each shard's graph is built in one task, and is stored as a row of flat arrays:
neighbours of the bottom layer, neighbours of the upper layers, and where each
node's part of the latter begins.

Nearness is the inner product. For the graph, vectors get one more component
that makes their norms equal, so that nearest by angle and by inner product
agree. What a search finds is scored again in double precision on the original
vectors; shard results are merged by a limited window per query.

Every query is asked of every shard, which is what sharded search costs: queries x
shards searches. So shards are as large as a task can build in a minute and hold
in some 20 MB (of little data smaller, down to ``LEAST_SHARD``, so that all cores
build), and it is the queries, the smaller part, that are sent to the
shards, in blocks: a task first gets its shard's graph, once, and then one block
after another. A task holds one shard and one block, both of bounded size. Where
there are more cores than shards, a shard is sent to several tasks that share the
blocks.

Defined results
- vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id.
- vectors of different lengths are kept in different shards and aren't compared.
- repeated rows (equal id and vector) count once. Ties go to the smaller vec_id.
- an empty table: empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, small_batches, written

K = 20
SHARD_SIZE, LEAST_SHARD = 16384, 4096
QUERY_BLOCK = 1024
SPREAD = 4
LINKS = 16
BUILD_WIDTH = 80
SEARCH_WIDTH = 160
INDEX = "shard int, dim int, ids array<long>, starts array<int>, vectors array<double>, bottom array<int>, upper array<int>, upper_at array<int>, entry int, top int"


@dataclass
class Graph:
    """Flat arrays. bottom: 2 * LINKS neighbours a node, -1 for none; upper: LINKS a node and layer from 1 on."""

    unit: np.ndarray
    bottom: np.ndarray
    upper: np.ndarray
    upper_at: np.ndarray
    entry: int
    top: int

    def around(self, node: int, layer: int) -> np.ndarray:
        if layer == 0:
            out = self.bottom[node * 2 * LINKS : (node + 1) * 2 * LINKS]
        else:
            at = self.upper_at[node] + (layer - 1) * LINKS
            out = self.upper[at : at + LINKS]
        return out


def evened(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that gives all the same norm."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    most = squares.max() or 1.0
    return (np.hstack([vectors, np.sqrt(np.maximum(most - squares, 0))[:, None]]) / np.sqrt(most)).astype(np.float32)


def search_layer(g: Graph, q: np.ndarray, begin: list[tuple[float, int]], width: int, layer: int, seen: np.ndarray, turn: int) -> list[tuple[float, int]]:
    """The best ``width`` nodes found from ``begin``, as (nearness, node), unordered."""
    best = list(begin)
    heapq.heapify(best)
    front = [(-s, n) for s, n in begin]
    heapq.heapify(front)
    for _, n in begin:
        seen[n] = turn
    while front:
        s, node = heapq.heappop(front)
        if len(best) >= width and -s < best[0][0]:
            break
        near = g.around(node, layer)
        near = near[near >= 0]
        near = near[seen[near] != turn]
        if not len(near):
            continue
        seen[near] = turn
        scores = g.unit[near] @ q
        if len(best) >= width:
            good = scores > best[0][0]
            near, scores = near[good], scores[good]
        for x, n in zip(scores.tolist(), near.tolist(), strict=True):
            if len(best) < width:
                heapq.heappush(best, (x, n))
            elif x > best[0][0]:
                heapq.heapreplace(best, (x, n))
            else:
                continue
            heapq.heappush(front, (-x, n))
    return best


def chosen(g: Graph, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those nearer to the node than to any already chosen; then the nearest others."""
    order = np.argsort(-scores, kind="stable")
    candidates, scores = candidates[order], scores[order]
    if len(candidates) <= most:
        return candidates
    each = g.unit[candidates] @ g.unit[candidates].T
    closest = np.full(len(candidates), -np.inf, np.float32)
    picked: list[int] = []
    for i in range(len(candidates)):
        if scores[i] > closest[i]:
            picked.append(i)
            if len(picked) == most:
                break
            np.maximum(closest, each[i], out=closest)
    if len(picked) < most:
        rest = np.setdiff1d(np.arange(len(candidates)), picked)
        picked += rest[: most - len(picked)].tolist()
    return candidates[picked]


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """Inserts the vectors one by one."""
    n = len(vectors)
    levels = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)), 8).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(levels * LINKS)]).astype(np.int32)
    g = Graph(evened(vectors), np.full(n * 2 * LINKS, -1, np.int32), np.full(at[-1], -1, np.int32), at[:-1], 0, int(levels[0]) if n else 0)
    seen = np.zeros(n, np.int64)
    turn = 0
    for node in range(1, n):
        q, level = g.unit[node], int(levels[node])
        begin = [(float(g.unit[g.entry] @ q), g.entry)]
        for layer in range(g.top, -1, -1):
            turn += 1
            begin = search_layer(g, q, begin, BUILD_WIDTH if layer <= level else 1, layer, seen, turn)
            if layer > level:
                continue
            scores, found = (np.array(x) for x in zip(*begin, strict=True))
            picked = chosen(g, found.astype(np.int32), scores.astype(np.float32), LINKS)
            g.around(node, layer)[: len(picked)] = picked
            for other in picked.tolist():
                theirs = g.around(other, layer)
                free = np.flatnonzero(theirs < 0)
                if len(free):
                    theirs[free[0]] = node
                else:
                    all_of = np.append(theirs, np.int32(node))
                    theirs[:] = chosen(g, all_of, g.unit[all_of] @ g.unit[other], len(theirs))
        if level > g.top:
            g.entry, g.top = node, level
    return g


def search(g: Graph, q: np.ndarray, width: int, seen: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
    """The nodes found for a query, and the next turn."""
    begin = [(float(g.unit[g.entry] @ q), g.entry)]
    for layer in range(g.top, -1, -1):
        turn += 1
        begin = search_layer(g, q, begin, width if layer == 0 else 1, layer, seen, turn)
    return np.array([n for _, n in begin]), turn


def floats(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


def indexed(rows: pa.Table) -> pa.Table:
    """A shard's graph from its rows (shard, dim, vec_id, v), vectors repeated for each of their ids."""
    rows = rows.combine_chunks()
    dim = rows["dim"][0].as_py()
    vectors = np.array(rows["v"].to_pylist(), dtype=np.float64).reshape(-1, dim)
    ids = rows["vec_id"].to_numpy()
    order = np.lexsort((ids, *vectors.T[::-1]))
    vectors, ids = vectors[order], ids[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    starts = np.append(np.flatnonzero(new), len(ids)).astype(np.int32)
    own = vectors[new]
    shuffled = np.random.default_rng(1).permutation(len(own))  # insertion in sorted order would make a poor graph
    g = build(own[shuffled])
    members = np.concatenate([ids[starts[i] : starts[i + 1]] for i in shuffled])
    sizes = np.concatenate([[0], np.cumsum(np.diff(starts)[shuffled])]).astype(np.int32)
    row = {
        "shard": rows["shard"][0].as_py(), "dim": dim, "ids": members, "starts": sizes, "vectors": own[shuffled].ravel(),
        "bottom": g.bottom, "upper": g.upper, "upper_at": g.upper_at, "entry": g.entry, "top": g.top,
    }
    types = {"shard": pa.int32(), "dim": pa.int32(), "ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "vectors": pa.list_(pa.float64()), "entry": pa.int32(), "top": pa.int32()}
    return pa.table({n: pa.array([x], types.get(n, pa.list_(pa.int32()))) for n, x in row.items()})


def usable(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, v of rows that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.size(v).alias("dim"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def index(embeddings: DataFrame, k: int = K, shard_size: int = SHARD_SIZE) -> DataFrame:
    """A row a shard, as INDEX says, for the output of usable()."""
    spark = embeddings.sparkSession
    one, two = F.xxhash64("v"), F.xxhash64(F.lit(1), "v")
    hashed = embeddings.select("vec_id", "dim", "v", one.alias("h1"), two.alias("h2"))
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    least = written(hashed.withColumn("rank", rank).where(F.col("rank") <= k + 1).dropDuplicates(["vec_id", "h1", "h2"]), "ann-rows")
    n = least.where("rank = 1").count()
    # shards of the given size, or smaller ones where cores would have nothing to build
    shards = max(1, -(-n // shard_size), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD)))
    dealt = least.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "dim", "vec_id", "v")
    with small_batches(spark):
        # more partitions than shards, a given number, so that few shards meet in a task by their hash or their small size
        out = written(dealt.repartition(SPREAD * shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(indexed, INDEX), "ann-index")
    forget(least)
    return out


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        of = lambda n: floats(row[n])
        self.vectors = of("vectors").reshape(-1, row["dim"].as_py())
        self.graph = Graph(evened(self.vectors), of("bottom"), of("upper"), of("upper_at"), row["entry"].as_py(), row["top"].as_py())
        self.ids, self.starts = of("ids"), of("starts")
        self.seen, self.turn = np.zeros(len(self.vectors), np.int64), 0

    def nearest(self, qid: int, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest rows of the shard but the query's own."""
        unit = np.append(q / np.sqrt(q @ q), 0).astype(np.float32)
        nodes, self.turn = search(self.graph, unit, width, self.seen, self.turn)
        scores = (self.vectors[nodes] * q).sum(axis=1)  # the same for equal vectors, wherever they stand
        members = np.concatenate([self.ids[self.starts[x] : self.starts[x + 1]] for x in nodes])
        each = np.repeat(scores, self.starts[nodes + 1] - self.starts[nodes])
        other = members != qid
        members, each = members[other], each[other]
        order = np.lexsort((members, -each))[:k]
        return members[order], each[order]


def searched(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (dim, shard): first the shard's, without qids, then blocks of queries; out come the k nearest of the shard for each query."""
    of, shard = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            if not row["qids"].is_valid:
                of, shard = (row["dim"], row["shard"]), Shard(row)
            elif of == (row["dim"], row["shard"]):  # else no row of the index has as many components
                qids = floats(row["qids"])
                queries = floats(row["qv"]).reshape(-1, row["dim"].as_py())
                found = [shard.nearest(qid, q, k, width) for qid, q in zip(qids.tolist(), queries, strict=True)]
                sizes = [len(ids) for ids, _ in found]
                columns = [np.repeat(qids, sizes), np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def nearest(index_rows: DataFrame, queries: DataFrame, k: int = K, width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of the index for each row of ``queries``, an output of usable()."""
    spark = queries.sparkSession
    queries = written(queries.dropDuplicates(["vec_id", "v"]), "ann-queries")
    blocks = max(1, -(-queries.count() // block))
    shards = (index_rows.agg(F.max("shard").alias("s")).first()["s"] or 0) + 1
    copies = max(1, min(blocks, -(-spark.sparkContext.defaultParallelism // shards)))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    dealt = dealt.groupBy("block", "dim").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    dealt = dealt.select("dim", (F.col("block") % copies).alias("copy"), F.col("block").alias("turn"), F.col("q.vec_id").alias("qids"), F.flatten(F.col("q.v")).alias("qv"))
    blocked = written(dealt, "ann-blocks")
    dealt = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index_rows.withColumns({"copy": F.explode(F.sequence(F.lit(0), F.lit(copies - 1))), "turn": F.lit(-1)})
    both = graphs.unionByName(dealt, allowMissingColumns=True)
    with small_batches(spark):
        sent = both.repartition(SPREAD * shards * copies, "dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "turn")
        found = written(sent.mapInArrow(lambda b: searched(b, k, width), "query_id long, vec_id long, score double"), "ann-found")
    forget(queries, blocked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The k nearest other rows of each row whose vec_id ``every`` divides."""
    rows = usable(embeddings)
    graphs = index(rows, k)
    found = nearest(graphs, rows.where(F.col("vec_id") % every == 0), k)
    forget(graphs)  # what was found is in a table of its own
    return found
