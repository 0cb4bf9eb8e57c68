"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the halves of a vector; a cell is a pair of centroids.
A query visits cells in the order of their summed nearness, by a heap over
centroid pairs, until they hold a share of all entries that reaches the wanted
recall on a bounded sample; what the cells hold is reranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import settle, table

#: Vectors that codebooks and the visited share are fitted on, queries of these that recall is measured with, and the recall aimed at there.
SAMPLE, PROBES, RECALL = 20_000, 256, 0.96
#: Entries and queries of one block.
BLOCK = 20_000


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks (centroids, half dimension) of both halves, entries of each cell, and the entries a query has to see."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    visit: int

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _nearest(vectors[:, :half], self.left), _nearest(vectors[:, half:], self.right)

    def cells(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """All cells, nearest first: a heap over pairs of the two sorted centroid lists."""
        half = self.left.shape[1]
        a, b = self.left @ query[:half], self.right @ query[half:]
        ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        da, db = (-a[ia]).tolist(), (-b[ib]).tolist()
        heap = [(da[0] + db[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(ia[i]), int(ib[j])
            if j + 1 < len(db):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))

    def probe(self, query: np.ndarray) -> np.ndarray:
        """The cells that a query visits, as a mask over centroid pairs."""
        mask, seen = np.zeros(self.counts.shape, bool), 0
        for i, j in self.cells(query):
            mask[i, j] = True
            seen += self.counts[i, j]
            if seen >= self.visit:
                break
        return mask


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centroids**2).sum(1) - 2 * x[i : i + 4096] @ centroids.T, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x[:, d], len(centroids)) for d in range(x.shape[1])], 1)
        centroids[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centroids


def fit_index(vectors: DataFrame, total: int, k: int, sample: int = SAMPLE, recall: float = RECALL) -> MultiIndex:
    """Codebooks from at most `sample` vectors, and the share of entries at which sampled queries find enough of their nearest."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], float)
    half = x.shape[1] // 2
    made = MultiIndex(_codebook(x[:, :half], min(len(x), int(np.clip(np.sqrt(total / 12), 2, 128))), 1), _codebook(x[:, half:], min(len(x), int(np.clip(np.sqrt(total / 12), 2, 128))), 2), np.zeros((0, 0), np.int64), 0)
    a, b = made.assign(x)
    counts = np.zeros((len(made.left), len(made.right)), np.int64)
    np.add.at(counts, (a, b), 1)
    index = MultiIndex(made.left, made.right, counts, 0)
    near = max(1, min(k, round(k * len(x) / max(total, 1))))
    need = []
    for i in range(min(PROBES, len(x))):
        scores = x @ x[i]
        scores[i] = -np.inf
        found = np.argpartition(-scores, min(near, len(x) - 1))[:near]
        order = np.full(counts.shape, 0, np.int64)
        seen = 0
        for cell in index.cells(x[i]):
            seen += counts[cell]
            order[cell] = seen
        need += (order[a[found], b[found]] / len(x)).tolist()
    share = float(np.quantile(need, recall)) if need else 1.0
    return MultiIndex(index.left, index.right, counts, int(np.ceil(share * total)))


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed the same way wherever its vector stands."""
    return (np.ascontiguousarray(vectors) * query).sum(1)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found (largest inner product; ties to the smaller id) of each vector whose id is divisible by `every`.

    Null ids, and vectors that are null, empty, zero, of another size than
    most, or hold null or non-finite components take no part. Rows with the
    query's own id are not candidates. Repeated rows count once; an id with
    several vectors is one candidate by the best of them, and one query by all.
    An index is fitted on a bounded sample and holds every vector; a query that
    has fewer than k candidates gets all. Empty tables give no rows.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = settle(rows.distinct())
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    total, dimension = sizes[0]["n"], sizes[0]["d"]
    rows = rows.where(F.size("v") == dimension)
    if dimension == 1:  # both halves need a component
        rows, dimension = rows.withColumn("v", F.concat("v", F.array(F.lit(0.0)))), 2
    index = fit_index(rows, total, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column("v").flatten().to_numpy().reshape(-1, dimension)
                a, b = index.assign(x)
                yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["vec_id", "v", "a", "b"])

    entries = settle(rows.mapInArrow(assign, "vec_id long, v array<double>, a int, b int"))
    counts = np.zeros(index.counts.shape, np.int64)
    for r in entries.groupBy("a", "b").agg(F.count("*").alias("n")).collect():  # as many rows as cells
        counts[r["a"], r["b"]] = r["n"]
    most = entries.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]  # vectors of one id
    index = MultiIndex(index.left, index.right, counts, max(index.visit, (k + 1) * most + int(counts.max())))
    splits = np.maximum(1, -(-counts.sum(1) // BLOCK)).tolist()  # of each left centroid's entries, however many it holds
    parts = max(1, -(-total // (BLOCK * every)))  # of the queries

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(-1, dimension)
            for i, key in enumerate(batch.column("vec_id").to_pylist()):
                mask = index.probe(x[i])
                hit = np.flatnonzero(mask.any(1))
                spots = [(int(a), s) for a in hit for s in range(splits[a])]
                n = len(spots)
                yield pa.record_batch(
                    [pa.array([key] * n, pa.int64()), pa.array([x[i]] * n, pa.list_(pa.float64())), pa.array([np.packbits(mask[a]).tobytes() for a, _ in spots], pa.binary()), pa.array([a for a, _ in spots], pa.int32()), pa.array([s for _, s in spots], pa.int32()), pa.array([key // every % parts] * n, pa.int32())],
                    ["query_id", "q", "mask", "a", "split", "part"],
                )

    asked = entries.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(route, "query_id long, q array<double>, mask binary, a int, split int, part int")
    of_centroid = F.get(F.array(*[F.lit(n) for n in splits]), F.col("a"))
    held = entries.withColumn("split", F.pmod(F.xxhash64("vec_id"), of_centroid).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    width = len(index.right)

    def rerank(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(held):
            held = held.sort_values("b", kind="stable")
            x, ids = np.stack(held["v"].to_numpy()), held["vec_id"].to_numpy()
            bounds = np.searchsorted(held["b"].to_numpy(), np.arange(width + 1))
            for at in range(0, len(queries), 512):
                some = queries.iloc[at : at + 512]
                q, own = np.stack(some["q"].to_numpy()), some["query_id"].to_numpy()
                masks = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in some["mask"]]), axis=1)[:, :width].astype(bool)
                scores = np.full((len(q), len(x)), -np.inf)
                for b in np.flatnonzero(masks.any(0) & (np.diff(bounds) > 0)):
                    to = np.flatnonzero(masks[:, b])
                    scores[to, bounds[b] : bounds[b + 1]] = q[to] @ x[bounds[b] : bounds[b + 1]].T
                scores[own[:, None] == ids[None, :]] = -np.inf
                for i in range(len(q)):
                    s = scores[i]
                    wide = k * most  # so many entries hold the best k ids
                    cut = np.partition(s, len(s) - wide)[len(s) - wide] - 1e-9 if len(s) > wide else -np.inf
                    found = np.flatnonzero((s >= cut) & (s > -np.inf))
                    exact = exact_scores(q[i], x[found])
                    best = np.lexsort((ids[found], -exact))
                    best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]
                    out += zip([int(own[i])] * len(best), ids[found][best].tolist(), exact[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["a", "split", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
