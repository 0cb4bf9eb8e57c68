"""Connected components of a table of links: local contraction, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import fan_join, settle

#: Links that one task contracts in its memory, at most about.
CONTRACT_ROWS = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's links by a star around the least node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != x:
            parent[x] = top
            x = up
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    for at in range(0, len(pairs), 50_000):
        yield pa.record_batch([pa.array([p[i] for p in pairs[at : at + 50_000]], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame, contract_rows: int = CONTRACT_ROWS, limit: int = 60) -> DataFrame:
    """(node, label) of each node of links (a, b): label is the least node that links reach. Raises if `limit` steps don't settle it.

    Links of a node with itself are ignored; repeated links count once; no
    links give no rows. Links that one task holds anyway are contracted there.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    parts = 1 + edges.count() // contract_rows
    edges = settle((edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(_contract, "a long, b long"))
    before = None
    for _ in range(limit if parts > 1 else 0):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n")))
        large = fan_join(both.where("b > a"), least, "a", "n", "b").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = settle(large.where("a > b").distinct())
        least = settle(down.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")))
        small = fan_join(down, least, "a", "n", "b").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").union(least.drop("n"))
        edges = settle(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now["n"] == now["d"] and now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError("links did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
