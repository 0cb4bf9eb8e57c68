"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over the training run t in [0, 1]. Its
integral is the source's token demand up to t; the inverse of that demand
turns a document's place in its source's token stream into the training
position at which the document is due. Documents are range-sorted by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import settle, table

#: Weights and schedule slopes, given to the sources in turn; share of all words; most passes over a document.
WEIGHTS, SLOPES, SHARE, PASSES = (3, 1, 2), (0.5, 0.0, -0.5), 1.5, 2
#: Documents whose order within a source one task decides, about.
ROWS_PER_BUCKET = 50_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> list[tuple[str | None, int, float, float]]:
    """(source, size, target, slope) of each source: share of all sizes by weight, none above passes times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    left, goal = {i: float(weights[i % len(weights)]) for i in range(len(order))}, share * sum(n for _, n in order)
    target = [0.0] * len(order)
    while left:
        per = max(goal, 0.0) / sum(left.values())
        full = [i for i, w in left.items() if w * per > passes * order[i][1]]
        for i in full or list(left):
            target[i] = float(passes * order[i][1]) if full else left[i] * per
            goal -= target[i] if full else 0
            del left[i]
    return [(s, n, t, SLOPES[i % len(SLOPES)]) for i, ((s, n), t) in enumerate(zip(order, target, strict=True))]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def due(share: Column, slope: Column) -> Column:
    """The t at which demand reaches a share u: (1 + slope) t - slope t^2 = u, for the density 1 + slope (1 - 2 t)."""
    u = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * u, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, u).otherwise((1 + slope - root) / (2 * F.when(F.abs(slope) < 1e-9, F.lit(1.0)).otherwise(slope)))


def place(doc_id: Column) -> Column:
    """The order of a source's documents: an MD5 of the id, as text, which other engines have too; a null id's is the empty text's."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, size: Column | None = None) -> DataFrame:
    """docs with mix (size, source_size, target, taken, copies, positions): what the mix takes of each row, and when.

    A source's documents go by an MD5 of doc_id; all are taken floor(target /
    size) times and, of one more pass, those whose middle lies before what is
    then left, so a source misses its target by half a document at most. Null
    and empty texts have size 0 and are not taken, null sources are one source,
    the last; repeated rows and rows of one id are documents of their own, by
    size; an empty table gives none. `size` is a column that has the words
    counted already. One row for each source goes to the driver. A column named
    mix is replaced, any other stays as it is.
    """
    own = [c for c in docs.columns if c != "mix"]
    # what docs has travels as one column, so that no name of its can clash
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("source").cast("string").alias("source"), (words(F.col("text").cast("string")) if size is None else size).alias("size"), place(F.col("doc_id")).alias("place"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    buckets = max(1, -(-sum(r["n"] for r in totals) // ROWS_PER_BUCKET)) * 4
    # an Arrow table, which the driver's JVM reads without Python workers
    made = targets([(r["source"], r["size"]) for r in totals], weights, share, passes)
    columns = [pa.array([t[i] for t in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))]
    plan = docs.sparkSession.createDataFrame(pa.table(columns, names=["of", "source_size", "target", "slope"]))
    bucketed = sized.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * buckets))
    # where each bucket of a source begins in that source's stream: a running sum over sums, not over documents
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    begins = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b"), (F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("sum")).alias("begin"))
    begins = begins.join(F.broadcast(plan) if len(totals) <= 100_000 else plan, F.col("b_source").eqNullSafe(F.col("of"))).drop("of")
    joined = bucketed.join(begins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b")))
    window = Window.partitionBy("b_source", "b").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("at", F.col("begin") + F.coalesce(F.sum("size").over(window), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.col("target") - whole * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(whole + F.when(F.col("at") + F.col("size") / 2 < rest, 1).otherwise(0), F.lit(passes)))
    positions = F.transform(F.slice(F.sequence(F.lit(0), F.lit(passes)), F.lit(1), F.col("copies")), lambda i: due((i * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target"), F.col("slope")))
    mix = F.struct("size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", positions.alias("positions"))
    return placed.withColumn("copies", copies.cast("int")).select(*[F.col(f"row.`{c}`").alias(c) for c in own], mix.alias("mix"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's share of the mix, in the order of its first training position; positions has all of them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    counted = settle(docs.select("doc_id", "source", words(F.col("text").cast("string")).alias("n_words")))  # the one pass over texts
    mixed = mix_sources(counted, size=F.col("n_words"))
    position = F.get("mix.positions", F.lit(0)).alias("position")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", position, "mix.positions").orderBy(F.col("position").asc_nulls_last(), "doc_id")
