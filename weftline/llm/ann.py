"""Approximate nearest neighbours: robust-pruned directed graphs, searched by beams in the shards a query is routed to.

Rows are dealt to cells by their nearest centroid; cells of more than SHARD rows are
split by hash into several shards. Each shard's graph grows by batches: greedy searches
from the medoid propose neighbours, robust pruning with relaxed distances (ALPHA) keeps
at most DEGREE diverse edges, and reverse edges are pruned alike. A query searches with a
beam every shard of its nearest cells. How many cells that takes is measured when the
index is made: true neighbours within the sample must lie in them for COVERED of all pairs.

Centroids (CENTROIDS at most) are fitted on a sample of SAMPLE vectors, the first by hash;
all rows are indexed. Vectors that are equal in all components stand once in the graph
with their smallest ids, of which a search can return no more than it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, table

SHARD, QUERY_BLOCK = 5_000, 2_000
DEGREE, BUILD_BEAM, BEAM, ALPHA, BATCH = 32, 64, 96, 1.2, 256
#: Edges beyond DEGREE that a node may gather while the graph grows, before it is pruned again.
SLACK = 8
#: Vectors that centroids are fitted on, centroids at most, sampled queries whose neighbours are looked for, share of these to be covered.
SAMPLE, CENTROIDS, MEASURED, COVERED = 20_000, 1_024, 200, 0.98
INDEX = "size int, cell int, shard int, node int, ids array<long>, vector array<double>, edges array<int>, entry int"


def distances(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[rows[i, j]], in single precision."""
    d = x[rows] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first; all queries step together. Missing ones are -1."""
    n, m = len(x), len(q)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], dist[:, 0], done[:, 0], seen[:, entry] = entry, distances(x, np.full((m, 1), entry), q)[:, 0], False, True
    live = np.arange(m)
    while len(live):
        first = np.argmin(done[live], axis=1)
        open_ = ~done[live, first]
        live, first = live[open_], first[open_]
        if not len(live):
            break
        done[live, first] = True
        near = graph[ids[live, first]]
        safe = np.maximum(near, 0)
        fresh = (near >= 0) & ~seen[live[:, None], safe]
        seen[live[:, None], safe] |= fresh
        d = np.where(fresh, distances(x, safe, q[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        o = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, o, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), o, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), o, 1)
    return ids, dist


def robust_prune(x: np.ndarray, node: int, found: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """At most ``degree`` of the candidates: the nearest one stays, and those it is ``alpha`` times nearer to than the node go."""
    found = np.unique(found[(found >= 0) & (found != node)])
    if not len(found):
        return found
    v = x[found]
    d = ((v - x[node]) ** 2).sum(1)
    o = np.argsort(d, kind="stable")
    found, v, d = found[o], v[o], d[o]
    sq = (v * v).sum(1)
    between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    alive = np.ones(len(found), bool)
    kept = []
    for i in range(len(found)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > d
    return found[kept]


def build(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (-1 where fewer) and entry node of the graph of a shard's vectors."""
    n = len(x)
    x = np.ascontiguousarray(x, np.float32)
    graph = np.full((n, DEGREE + SLACK), -1, np.int64)
    have = np.zeros(n, np.int64)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(n)

    def connect(node: int, edges: np.ndarray) -> None:
        graph[node] = -1
        graph[node, : len(edges)] = edges
        have[node] = len(edges)

    for turn in range(2):
        at, step = 0, BATCH if turn else 1
        while at < n:
            batch = order[at : at + step]
            at += step
            step = BATCH if turn else min(BATCH, 2 * step)
            ids, _ = beam_search(x, graph, entry, x[batch], BUILD_BEAM)
            back: dict[int, list[int]] = {}
            for node, found in zip(batch.tolist(), ids, strict=True):
                edges = robust_prune(x, node, np.concatenate([found, graph[node]]))
                connect(node, edges)
                for e in edges.tolist():
                    back.setdefault(e, []).append(node)
            for node, more in back.items():
                both = np.unique(np.concatenate([graph[node, : have[node]], more]))
                connect(node, both if len(both) <= DEGREE + SLACK else robust_prune(x, node, both))
    for node in np.flatnonzero(have > DEGREE).tolist():
        connect(node, robust_prune(x, node, graph[node]))
    return graph[:, :DEGREE], entry


def scaled(x: np.ndarray) -> np.ndarray:
    """Single precision, with the largest component 1, so that no square overflows."""
    return (x / max(np.abs(x).max(initial=0), 1e-300)).astype(np.float32)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: no null id or vector, no null or non-finite component, not all zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda c: c != 0))


@dataclass
class Router:
    """Centroids by vector length, rows by cell, and how many cells to search. Lengths that the sample lacks have one cell."""

    centroids: dict[int, np.ndarray] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    probes: dict[int, int] = field(default_factory=dict)

    def far(self, x: np.ndarray) -> np.ndarray | None:
        c = self.centroids.get(x.shape[1])
        return None if c is None else (c * c).sum(1)[None, :] - 2 * (x @ c.T)

    def cells(self, x: np.ndarray) -> np.ndarray:
        d = self.far(x)
        return np.zeros(len(x), np.int64) if d is None else d.argmin(1)

    def routes(self, x: np.ndarray, k: int) -> list[list[int]]:
        """Cells to search for each row of x: the nearest ``probes``, and more until they hold over k vectors."""
        d = self.far(x)
        if d is None:
            return [[0]] * len(x)
        n = x.shape[1]
        order = np.argsort(d, axis=1, kind="stable")
        have = np.cumsum(self.rows[n][order], axis=1)
        return [o[: max(self.probes[n], int(np.searchsorted(h, k, "right")) + 1)].tolist() for o, h in zip(order, have, strict=True)]


def centroids_of(x: np.ndarray, n: int) -> np.ndarray:
    """n means by Lloyd steps from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(8):
        near = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
        for j in range(n):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def probes_of(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Cells that must be searched for COVERED of the k neighbours of MEASURED rows of the sample."""
    q = x[np.linspace(0, len(x) - 1, min(MEASURED, len(x))).astype(int)]
    d = (x * x).sum(1)[None, :] - 2 * (q @ x.T)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    far = lambda v: (c * c).sum(1)[None, :] - 2 * (v @ c.T)
    place = np.argsort(np.argsort(far(q), axis=1, kind="stable"), axis=1, kind="stable")  # of each cell in a query's order
    ranks = np.sort(np.take_along_axis(place, far(x).argmin(1)[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(COVERED * len(ranks)))]) + 1 if len(ranks) else 1


def router_of(distinct: DataFrame, rows: int, k: int, shard: int, sample: int = SAMPLE) -> Router:
    """A router fitted on the first ``sample`` vectors by hash, the only ones that reach the driver."""
    out = Router()
    some = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).toArrow()["vector"].to_pylist()
    by_size: dict[int, list] = {}
    for v in some:
        by_size.setdefault(len(v), []).append(v)
    for size, own in by_size.items():
        x = scaled(np.array(own))
        n = max(1, min(CENTROIDS, len(own) // 8, -(-rows * len(own) // (len(some) * shard))))
        scale = max(np.abs(np.array(own)).max(), 1e-300)
        c = centroids_of(x, n)
        out.probes[size] = probes_of(x, c, k)
        out.centroids[size] = c.astype(np.float64) * scale
    return out


def _routed(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            cell = np.zeros(len(vectors), np.int64)
            sizes = np.array([len(v) for v in vectors])
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                cell[at] = router.cells(np.array([vectors[i] for i in at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell, pa.int32())], names=["ids", "vector", "size", "cell"])

    return run


def _asked(router: Router, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                own = router.routes(np.array([v]), k)[0]
                at += [i] * len(own)
                cells += own
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], names=["query_id", "vector", "size", "cell"])

    return run


def index(vectors: DataFrame, k: int = 10, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Router]:
    """The graph of every row, one row a distinct vector, and its router.

    Columns: size (of the vectors), cell, shard (of the cell), node, its k + 1 smallest ids,
    vector, edges (nodes of its shard), entry. Repeated ids of a vector count once; vectors
    of different lengths never share a cell; null ids and vectors, zero vectors and those with
    null or non-finite components take no part; other columns, whatever their names, aren't
    read; an empty table gives no rows.
    """
    own = Window.partitionBy("vector").orderBy("vec_id")
    rows = valid(vectors, id_col, vector_col).dropDuplicates(["vec_id", "vector"]).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    distinct = stored(rows.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    router = router_of(distinct, distinct.count(), k, shard)
    placed = stored(map_batches(distinct.select("ids", "vector"), _routed(router), "ids array<long>, vector array<double>, size int, cell int"))
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("n"))
    for r in cells.collect():  # CENTROIDS rows a length at most
        if r["size"] in router.centroids:
            router.rows.setdefault(r["size"], np.zeros(len(router.centroids[r["size"]]), np.int64))[r["cell"]] = r["n"]
    placed = placed.join(cells, ["size", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(17)), F.ceil(F.col("n") / shard)).cast("int"))

    def grow(rows: pa.Table) -> pa.Table:
        graph, entry = build(scaled(np.array(rows["vector"].to_pylist())))
        n = len(graph)
        edges = [g[g >= 0].tolist() for g in graph]
        return pa.table({**{c: rows[c] for c in ("size", "cell", "shard")}, "node": pa.array(range(n), pa.int32()), "ids": rows["ids"].cast(pa.list_(pa.int64())), "vector": rows["vector"].cast(pa.list_(pa.float64())), "edges": pa.array(edges, pa.list_(pa.int32())), "entry": pa.array([entry] * n, pa.int32())})

    # Dealt by shard, not by cell, and to many tasks: a graph is much work for few bytes.
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.select("size", "cell", "shard", "ids", "vector").repartition(parts, "size", "cell", "shard")
    return stored(dealt.groupBy("size", "cell", "shard").applyInArrow(grow, INDEX)), router


def search(graph: DataFrame, router: Router, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query (query_id, vector).

    The score is the Euclidean distance in double precision; ties go to the smaller id; a
    query's own id never counts, and repeated queries count once. Queries without candidates
    and an empty table give no rows.
    """
    queries = stored(queries.select("query_id", "vector").dropDuplicates(["query_id", "vector"]).withColumn("size", F.size("vector")))
    routed = stored(map_batches(queries, _asked(router, k), "query_id long, vector array<double>, size int, cell int"))
    cells = routed.groupBy("size", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    shards = graph.select("size", "cell", "shard").distinct().toDF("size", "cell", "shard")
    left = routed.join(cells, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), "blocks").cast("int")).join(shards, ["size", "cell"])
    right = graph.join(cells, ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def find(asked: pa.Table, own: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(asked) and len(own):
            own = own.sort_by("node")
            exact = np.array(own["vector"].to_pylist(), np.float64)
            edges = np.full((len(own), DEGREE), -1, np.int64)
            for i, e in enumerate(own["edges"].to_pylist()):
                edges[i, : len(e)] = e
            ids = own["ids"].to_pylist()
            entry = own["entry"][0].as_py()
            scale = max(np.abs(exact).max(), 1e-300)
            x = (exact / scale).astype(np.float32)
            qs, names = np.array(asked["vector"].to_pylist(), np.float64), asked["query_id"].to_pylist()
            for i in range(0, len(qs), BATCH):
                q32 = np.clip(qs[i : i + BATCH] / scale, -1e15, 1e15).astype(np.float32)
                found = beam_search(x, edges, entry, q32, beam)[0] if len(x) > beam else np.tile(np.arange(len(x)), (len(q32), 1))
                for name, q, nodes in zip(names[i : i + BATCH], qs[i : i + BATCH], found, strict=True):
                    nodes = nodes[nodes >= 0]
                    d = np.sqrt(((exact[nodes] - q) ** 2).sum(1))
                    hits = sorted((s, v) for s, n in zip(d.tolist(), nodes.tolist(), strict=True) for v in ids[n] if v != name)[:k]
                    out[0] += [name] * len(hits)
                    out[1] += [v for _, v in hits]
                    out[2] += [s for s, _ in hits]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["size", "cell", "shard", "block"]
    left = left.select(*[F.col(c).alias(f"of_{c}") for c in keys], "query_id", "vector")
    right = right.select(*keys, "node", "ids", "vector", "edges", "entry")
    hits = left.groupBy(*[f"of_{c}" for c in keys]).cogroup(right.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may have several vectors
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of embeddings for every row whose vec_id is divisible by 100: query_id, rank, vec_id, score; edge cases are those of :func:`index` and :func:`search`."""
    rows = table(spark, sf_dir, "embeddings")
    asked = valid(rows, "vec_id", "embedding").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return search(*index(rows), asked)
