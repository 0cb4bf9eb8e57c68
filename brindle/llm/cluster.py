"""Small helpers about the cluster: lineage cuts, tables in the shared folder, size-checked broadcasts and joins of hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count has shown that it has at most so many narrow rows.
BROADCAST_ROWS = 500_000
#: The same for single numbers that choose among rows of many kilobytes, as a shuffle of those takes more disk than their table.
IDS = 1_000_000
#: Facts about keys are broadcast up to so many, so that joins of large tables have one plan at nearly every size.
FACTS = 20_000
#: Rows of one key that one task of a join takes, and the most keys that are split for having more.
HOT_ROWS, HOT_KEYS = 2_000, 10_000
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1500, 8 << 20

_local: dict[str, str] = {}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local master may have none, which gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp()
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, in the shared folder. forget() deletes what is kept there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    made = df.checkpoint()
    kept = made._jdf.logicalPlan().rdd().getCheckpointFile()
    if kept.isDefined():
        _written.append(kept.get())
    return made


def stored(df: DataFrame) -> DataFrame:
    """As settle, as a Parquet table, of which later steps read single columns."""
    at = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append(at)
    made = df.sparkSession.read.schema(df.schema).parquet(at)
    made.stored_at = at
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() of which nothing is left to be read."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)
        _written.remove(df.stored_at)


def forget(spark: SparkSession) -> None:
    """Deletes all that settle() and stored() have kept; call it when what was made of it has been written elsewhere or read."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows; call it on settled data, as it counts. Beyond that Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def fan_join(big: DataFrame, facts: DataFrame, on: str | list[str], size: str, spread: str) -> DataFrame:
    """big left-joined with facts (settled, one row a key), of which `size` says how many rows of big have the key.

    Few facts are broadcast. Beyond that rows of a key that has over HOT_ROWS
    (or, at large sizes, a ten-thousandth of all) are dealt out by a hash of
    the column `spread` and meet a copy of the key's facts each.
    """
    on = [on] if isinstance(on, str) else on
    counts = facts.agg(F.count("*").alias("n"), F.sum(size).alias("rows")).first()
    if counts["n"] <= FACTS:
        return big.join(F.broadcast(facts.drop(size)), on, "left")
    rows = max(HOT_ROWS, (counts["rows"] or 0) // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col(size) > rows).select(*on, F.ceil(F.col(size) / rows).cast("int").alias("__fan")))  # HOT_KEYS rows at most
    dealt = big.join(hot, on, "left").withColumn("__at", F.coalesce(F.pmod(F.xxhash64(spread), "__fan"), F.lit(0)).cast("int")).drop("__fan")
    copied = facts.drop(size).join(hot, on, "left").withColumn("__at", F.explode(F.sequence(F.lit(0), F.coalesce("__fan", F.lit(1)) - 1))).drop("__fan")
    return dealt.join(copied.hint("merge"), [*on, "__at"], "left").drop("__at")


def short_batches(spark: SparkSession) -> None:
    """Readies the session for Python workers: they find this package beside the driver's path, use one thread each (a worker has
    one core), and texts go to them in small Arrow batches, so that what waits on either side stays a few megabytes, and at most
    BATCH_BYTES."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    environment["OPENBLAS_NUM_THREADS"] = environment["OMP_NUM_THREADS"] = "1"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
