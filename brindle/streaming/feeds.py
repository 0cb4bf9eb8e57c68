"""Change feeds and incremental tables with Structured Streaming; every stream here ends when its input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import shared_folder


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def follow(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream of its files; the checkpoint of what reads it is the position."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def _updates(made: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last state of each group of an aggregated stream: batches append what they changed to a table in the shared folder,
    under their number, so that a batch that runs again takes its own place. Nothing passes through the driver."""
    spark, place = made.sparkSession, _place(made.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/at").trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{place}/rows"):
        return spark.createDataFrame([], made.schema)
    rows = spark.read.parquet(f"{place}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in made.columns if c not in keys]), "batch").alias("s"))
    return last.select(*keys, "s.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _latest(spark: SparkSession, place: str, below: int | None = None) -> str | None:
    """The newest whole version in a place, before a batch's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    names = [s.getPath().getName() for s in files.listStatus(at)]
    done = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and _exists(spark, f"{place}/{n}/_SUCCESS")]
    done = [n for n in done if below is None or n < below]
    return f"{place}/v{max(done)}" if done else None


def running_totals(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum, count and average by key so far, of all batches."""
    made = stream.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))
    return _updates(made, "totals", keys)


def windowed_totals(stream: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """An extension: sums by event-time window under a watermark, with all windows that were touched; state older than it is freed."""
    made = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    made = made.select(F.col("window.start").alias("window_start"), *keys, "total", "n")
    return _updates(made, "windows", ["window_start", *keys])


def apply_changes(state: DataFrame | None, changes: DataFrame, key: str, order: str, op: str) -> DataFrame:
    """A table after a batch of changes: of each key the last one counts; 'delete' takes the row away."""
    values = [c for c in changes.columns if c not in (key, order, op)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(op, *values), order).alias("c"), F.max(order).alias(order))
    fresh = last.select(key, order, "c.*")
    if state is not None:
        old = state.join(fresh.select(key, F.col(order).alias("__at")), key, "left").where(F.col("__at").isNull() | (F.col("__at") < F.col(order)))
        newer = fresh.join(state.select(key, F.col(order).alias("__had")), key, "left").where(F.col("__had").isNull() | (F.col("__had") <= F.col(order))).drop("__had")
        return old.drop("__at").unionByName(newer)
    return fresh


def _versions(stream: DataFrame, place: str, step) -> str | None:
    """Runs a stream whose every batch makes the next version of a table. Batch n writes version n from the newest one before it,
    and the checkpoint lies beside, so a restart with the same place goes on where it stopped and a repeated batch changes nothing."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = _latest(spark, place, number)
        step(spark.read.parquet(before) if before else None, batch).write.mode("overwrite").parquet(f"{place}/v{number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{place}/at").trigger(availableNow=True).start().awaitTermination()
    return _latest(spark, place)


def replicate(stream: DataFrame, key: str, order: str, op: str, place: str | None = None) -> DataFrame:
    """The table that a feed of changes leaves: each batch is merged into a new version in the shared folder, or in `place`, from
    which a later call with more changes goes on. An empty feed leaves an empty table."""
    spark = stream.sparkSession
    last = _versions(stream, place or _place(spark, "replica"), lambda state, batch: apply_changes(state, batch, key, order, op))
    state = spark.read.parquet(last) if last else spark.createDataFrame([], stream.schema)
    return state.where(F.col(op) != "delete").drop(op)


def refresh_view(stream: DataFrame, keys: list[str], value: str, place: str | None = None) -> DataFrame:
    """A materialised aggregate that each batch's partial sums are added to; `place` as in replicate. An empty stream has no groups."""
    spark = stream.sparkSession

    def add(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        part = batch.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        return part if state is None else state.unionByName(part).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    last = _versions(stream, place or _place(spark, "view"), add)
    empty = stream.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return spark.read.parquet(last) if last else spark.createDataFrame([], empty.schema)


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds a batch of changes to a log: a folder that follow() reads from a position, file by file."""
    changes.write.mode("append").parquet(path)


def changes_after(spark: SparkSession, path: str, order: str, position: object) -> DataFrame:
    """The changes of a log behind a position; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(order) > F.lit(position))


def appended(stream: DataFrame) -> DataFrame:
    """What a stateless stream (filters, projections, maps) gives, as a table in the shared folder."""
    spark = stream.sparkSession
    place = _place(spark, "rows")
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
