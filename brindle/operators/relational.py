"""Joins, rewrites and frames that have no direct spelling, merges of tables, and checks of constraints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def right_semi(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of right that have a partner in left."""
    return right.join(left, on, "left_semi")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on all common columns, which appear once; nulls don't match."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def compare_any(df: DataFrame, column: str, op: str, values: DataFrame, value: str) -> DataFrame:
    """Rows with column op ANY (values): for the order operators one bound of the values decides."""
    if op in ("=", "<>"):
        if op == "=":
            return df.join(values.select(F.col(value).alias("__v")).distinct(), F.col(column) == F.col("__v"), "left_semi")
        bounds = values.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        return df.join(F.broadcast(bounds), (F.col(column) != F.col("__lo")) | (F.col(column) != F.col("__hi")), "left_semi")
    bound = values.agg((F.min if op in (">", ">=") else F.max)(value).alias("__b"))
    return df.join(F.broadcast(bound), F.expr(f"`{column}` {op} __b"), "left_semi")


def compare_all(df: DataFrame, column: str, op: str, values: DataFrame, value: str) -> DataFrame:
    """Rows with column op ALL (values): true without values, never with a null among them (but where op fails anyway)."""
    facts = values.agg(F.count("*").alias("__n"), F.count(value).alias("__k"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    test = {">": "`{c}` > __hi", ">=": "`{c}` >= __hi", "<": "`{c}` < __lo", "<=": "`{c}` <= __lo", "=": "`{c}` = __lo and `{c}` = __hi"}
    if op == "<>":
        bad = df.join(values.select(F.col(value).alias("__v")).distinct(), F.col(column).eqNullSafe(F.col("__v")), "left_anti")
        return bad.join(F.broadcast(facts), F.expr(f"__n = 0 or (__n = __k and `{column}` is not null)"), "left_semi")
    return df.join(F.broadcast(facts), F.expr("__n = 0 or (__n = __k and " + test[op].format(c=column) + ")"), "left_semi")


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, rank: str = "__group") -> tuple[DataFrame, WindowSpec]:
    """A GROUPS frame: peers are numbered densely, and a RANGE frame over the numbers holds the same rows."""
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked, Window.partitionBy(*partition).orderBy(rank).rangeBetween(start, end)


def group_top_n(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    by = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)


def recursive_distinct(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """The fixpoint of anchor UNION step: rows count once. Raises where `limit` rounds don't reach it."""
    context = anchor.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        from brindle.sources.tables import shared_folder

        context.setCheckpointDir(shared_folder(anchor.sparkSession))
    found = anchor.distinct().checkpoint()
    new = found
    for _ in range(limit):
        new = step(new).distinct().subtract(found)
        new = new.checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new).checkpoint()
    raise RuntimeError(f"no fixpoint in {limit} rounds")


# --- merges


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their keys."""
    return old.join(new, keys, "left_anti").select(*old.columns).unionByName(new)


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only new rows with new keys come in."""
    return old.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def upsert_update(old: DataFrame, new: DataFrame, keys: list[str], changed: list[str]) -> DataFrame:
    """Where keys meet, `changed` columns are the new ones; other new rows come in."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys], F.lit(True).alias("__in"))
    joined = old.withColumn("__old", F.lit(True)).join(fresh, keys, "full")
    pick = [F.col(c) if c in keys else F.when(F.col("__old").isNull() | (F.col("__in").isNotNull() & F.lit(c in changed)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in old.columns]
    return joined.select(*pick)


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None, delete: Column | None = None, insert: bool = True) -> DataFrame:
    """MERGE: source columns are src_<name>; matched rows that `delete` names go, others get `update`; unmatched source rows come in."""
    src = source.select(*[F.col(c).alias(f"src_{c}") for c in source.columns], F.lit(True).alias("__src"))
    on = [F.col(k) == F.col(f"src_{k}") for k in keys]
    both = target.withColumn("__tgt", F.lit(True)).join(src, on, "full" if insert else "left")
    matched = F.col("__tgt").isNotNull() & F.col("__src").isNotNull()
    if delete is not None:
        both = both.where(~(matched & F.coalesce(delete, F.lit(False))))
    out = [F.when(F.col("__tgt").isNull(), F.col(f"src_{c}")).when(matched, (update or {}).get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in target.columns]
    return both.select(*out)


def update_rows(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


# --- constraints: rows that break them


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; unknown passes."""
    return df.where(~check)


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    filled = df
    for c in columns:
        filled = filled.where(F.col(c).isNotNull())
    return filled.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, nulls, exact distinct values, least and greatest value as text. One pass over the table."""
    facts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"k{i}"), F.count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"))]
    one = df.agg(F.count("*").alias("n"), *facts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total"), (F.col("n") - F.col(f"k{i}")).alias("nulls"), F.col(f"d{i}").alias("ndv"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """Equi-depth: (bucket, upper, cumulative_count, ndv_in_bucket). Bounds are quantiles by approximate percentiles; the counts
    are exact: rows up to the bound, and distinct values over the last bound. Nulls are in no bucket."""
    cuts = [i / buckets for i in range(buckets + 1)]
    bounds = df.agg(F.percentile_approx(column, cuts, 10_000).alias("cuts"))
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    bucket = F.least(F.size(F.filter("cuts", lambda c: c < F.col("value"))), F.lit(buckets))
    held = values.crossJoin(F.broadcast(bounds)).groupBy(bucket.alias("bucket")).agg(F.sum("rows").alias("rows"), F.count("*").alias("ndv"))
    by = Window.orderBy("bucket")  # as many rows as buckets
    made = bounds.select(F.posexplode("cuts").alias("bucket", "upper")).join(held, "bucket", "left")
    return made.select("bucket", "upper", F.sum(F.coalesce("rows", F.lit(0))).over(by).alias("cumulative_count"), F.coalesce("ndv", F.lit(0)).alias("ndv_in_bucket"))


def running(df: DataFrame, partition: list[str], order: list[Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sql_rows(spark: SparkSession, sql: str, *args: object) -> DataFrame:
    """A statement with ? placeholders."""
    return spark.sql(sql, args=list(args))


def keyset_page(df: DataFrame, key: str, after: object, n: int) -> DataFrame:
    """The n rows that follow a key; the filter reaches the scan, so pages cost the same however far in they are."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(n)


def delete_returning(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows left, the rows that went)."""
    return delete_rows(df, where), df.where(where)


def insert_returning(df: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with the new rows, the rows that came)."""
    return df.unionByName(new), new


def update_returning(df: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(the table after the update, the changed rows as they are now)."""
    return update_rows(df, where, values), update_rows(df.where(where), F.lit(True), values)


def not_null_violations(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in one of the columns."""
    return df.where(" or ".join(f"`{c}` is null" for c in columns))


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many new rows meet a key that is there (replaced), and how many don't (inserted)."""
    both = new.select(*keys).join(old.select(*keys).distinct().withColumn("__had", F.lit(True)), keys, "left")
    return both.agg(F.count_if(F.col("__had").isNotNull()).alias("replaced"), F.count_if(F.col("__had").isNull()).alias("inserted"))


def upsert_error(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the new rows, or an error when a row is read whose key is there already."""
    met = new.join(old.select(*keys).distinct().withColumn("__had", F.lit(True)), keys, "left")
    checked = F.assert_true(F.col("__had").isNull(), F.lit("a key is there already"))
    return old.unionByName(met.where(checked.isNull()).select(*old.columns))


def cascade_delete(child: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows of child without those that refer to a deleted parent row."""
    return child.join(gone.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def set_null_on_delete(child: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """child, where references to deleted parent rows are null."""
    lost = gone.select(F.col(key).alias("__key")).distinct()
    kept = F.when(F.col("__key").isNull(), F.col(column)).alias(column)
    return child.join(lost, F.col(column) == F.col("__key"), "left").select(*[kept if c == column else F.col(c) for c in child.columns])


def partial_aggregate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable states of count, sum, least and greatest value."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def merge_partials(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of several shards as one, with the average."""
    made = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return made.withColumn("mean", F.try_divide("total", "n"))
