"""Tables in and out: Parquet, CSV, generated series, text lists, secured views and change logs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Makes the tables that a statement names temporary views."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", sql):
            load(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: the session's spark.checkpoint.dir. Only a local master may have none, which gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return folder or tempfile.mkdtemp()


def current_setting(spark: SparkSession, key: str) -> str | None:
    """A value of the session, null where it is unset."""
    return spark.conf.get(f"brindle.{key}", None)


def auth_uid(spark: SparkSession) -> str | None:
    """Who the session works for, for policies: its setting auth.uid."""
    return current_setting(spark, "auth.uid")


def generate_series(spark: SparkSession, first: int, last: int, step: int = 1, name: str = "value") -> DataFrame:
    """Integers from first to last, both included. A step of 0 is an error."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def text_items(text: Column) -> Column:
    """The items of a JSON array text, or else of a comma-separated list, trimmed; null gives no items."""
    listed = F.transform(F.split(text, ","), lambda item: F.trim(item))
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(listed)


def unnest(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """A row for each item of a list column; rows without items go."""
    return df.withColumn(name, F.explode(text_items(F.col(column))))


def write_csv(df: DataFrame, path: str) -> None:
    """A header, doubled quotes, empty nulls; binary columns as X'hex'."""
    shown = [F.concat(F.lit("X'"), F.hex(f.name), F.lit("'")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema]
    df.select(*shown).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What write_csv wrote, by position; a header is skipped, empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("multiLine", True).csv(path)


def dump(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """A copy of a table as Parquet, JSON or ORC, in one folder for each value of `by`, which filters on these columns then prune."""
    df.write.mode("overwrite").partitionBy(*by).format(kind).save(path)


def restore(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """What dump() wrote."""
    return spark.read.schema(schema).format(kind).load(path)


def secured(df: DataFrame, policies: list[tuple[str | None, Column]], role: str) -> DataFrame:
    """Rows that every policy admits whose role is `role` or that has none."""
    for of, admits in policies:
        if of is None or of == role:
            df = df.where(admits)
    return df


def masked(column: Column, kind: str) -> Column:
    """Full, partial (last four characters stay), email (first character and domain stay), phone (last four digits stay) or hash."""
    text = column.cast("string")
    if kind == "full":
        return F.when(text.isNotNull(), F.lit("****"))
    if kind == "partial":
        return F.when(F.length(text) <= 4, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(text) - 4), F.substring(text, -4, 4)))
    if kind == "email":
        return F.regexp_replace(text, r"^(.)[^@]*(@.*)$", "$1***$2")
    if kind == "phone":
        return F.regexp_replace(text, r"\d(?=(?:\D*\d){4})", "*")
    if kind == "hash":
        return F.sha2(text, 256)
    raise ValueError(f"unknown mask {kind}")
