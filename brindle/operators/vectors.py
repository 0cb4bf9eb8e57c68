"""Vectors as arrays: distances, normalisation, exact nearest rows, hybrid scores and quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter one's length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector has cosine 0."""
    n = norm(a) * norm(b)
    return 1 - F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.least(F.try_divide(dot(a, b), n), F.lit(1.0)), F.lit(-1.0)))


def l2_distance(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(_sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    return 1 - cosine_distance(a, b) if metric == "cosine" else 1 / (1 + l2_distance(a, b))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(x.cast("double"), n)))


def parse(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def top_k(df: DataFrame, column: str, query: list[float], k: int, id_column: str, metric: str = "cosine") -> DataFrame:
    """The k rows nearest to one query, exactly: a map-side top k in each task and one merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(id_column, similarity(F.col(column), q, metric).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def hybrid(distances: DataFrame, keywords: DataFrame, key: str, alpha: float) -> DataFrame:
    """alpha (1 - d / max(d, 1)) + (1 - alpha) keyword score; what one side lacks counts 0."""
    both = distances.join(keywords, key, "full")
    near = F.coalesce(1 - F.col("distance") / F.greatest(F.col("distance"), F.lit(1.0)), F.lit(0.0))
    return both.select(key, (alpha * near + (1 - alpha) * F.coalesce("keyword", F.lit(0.0))).alias("score"))


def quantize8(df: DataFrame, column: str, dimensions: int, name: str = "codes") -> DataFrame:
    """Each component on the scale of its dimension's least and greatest value, times 255, truncated."""
    bounds = df.agg(*[f(F.get(column, F.lit(i)).cast("double")).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("lo", F.min), ("hi", F.max))])
    bounds = bounds.select(F.array(*[f"lo{i}" for i in range(dimensions)]).alias("lo"), F.array(*[f"hi{i}" for i in range(dimensions)]).alias("hi"))
    scaled = F.zip_with(F.zip_with(column, "lo", lambda v, lo: v.cast("double") - lo), F.zip_with("hi", "lo", lambda hi, lo: hi - lo), lambda v, w: F.when(w == 0, 0).otherwise(F.floor(F.try_divide(v, w) * 255)).cast("int"))
    return df.join(F.broadcast(bounds)).withColumn(name, scaled).drop("lo", "hi")  # bounds is one row


def quantize4(df: DataFrame, column: str, dimensions: int, name: str = "codes") -> DataFrame:
    """As quantize8, times 15, and two codes to a byte (the first in the lower half; an odd last one alone)."""
    held = df.select("*", F.col(column).alias("__v"))
    bounds = df.agg(*[f(F.get(column, F.lit(i)).cast("double")).alias(f"{n}{i}") for i in range(dimensions) for n, f in (("lo", F.min), ("hi", F.max))])

    def code(i: int) -> Column:
        v, lo, hi = F.get("__v", F.lit(i)).cast("double"), F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(hi == lo, 0).otherwise(F.floor(F.try_divide(v - lo, hi - lo) * 15)).cast("int")

    pairs = [code(i) + (code(i + 1) * 16 if i + 1 < dimensions else F.lit(0)) for i in range(0, dimensions, 2)]
    return held.join(F.broadcast(bounds)).select(*df.columns, F.array(*pairs).alias(name))  # bounds is one row


def search_many(df: DataFrame, column: str, queries: DataFrame, k: int, id_column: str, metric: str = "cosine", blocks: int = 8) -> DataFrame:
    """(query_id, id, score, rank) of the k rows nearest to each of a stated set of queries (query_id, query), exactly.

    Rows are dealt to blocks, each keeps its own k for a query, and those of all blocks are ranked.
    """
    held = df.select(id_column, F.col(column).alias("__v"), F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias("__block"))
    asked = queries.select("query_id", "query", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    scored = held.join(asked, "__block").select("__block", "query_id", id_column, similarity(F.col("__v"), F.col("query"), metric).alias("score"))
    order = [F.desc("score"), F.asc(id_column)]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "__block").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("__block")
