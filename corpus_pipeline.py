"""The corpus pipeline: quality, near copies, repeated spans, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from brindle.llm.cluster import forget, settle, shared_folder, short_batches, small_side
from brindle.llm.jaccard import jaccard_groups
from brindle.llm.mixing import mix_sources
from brindle.llm.packing import pack_documents
from brindle.llm.quality import fit_quality, quality_scores
from brindle.llm.substrings import remove_repeats
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _begin(spark: SparkSession) -> None:
    short_batches(spark)
    forget(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject (score of 0.3 at least)."""
    _begin(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group that five-word shingles link at 0.8 or more; of repeated rows, one.

    Rows with a null id stay where no other row of their group has one; texts
    without words are groups of their own; an empty table gives none.
    """
    _begin(spark)
    groups = jaccard_groups(docs)
    dropped = settle(groups.where("not first").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    key = F.xxhash64(F.col("text").cast("string"))
    kept = docs.select(*COLUMNS).join(small_side(dropped), F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__th")), "left_anti")
    # rows that are the same in id and text: all but one of each go, which few documents are looked up for
    twice = settle(docs.groupBy(F.col("doc_id").alias("__id"), key.alias("__th")).agg(F.count("*").alias("n")).where("n > 1"))
    if twice.isEmpty():
        return kept
    both = kept.join(small_side(twice), F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__th")), "left")
    return both.where("n is null").select(*COLUMNS).union(both.where("n is not null").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of 50 words or more that an earlier document has; texts with nothing left go."""
    _begin(spark)
    cut = remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.where("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    _begin(spark)
    mixed = mix_sources(docs.select(*COLUMNS)).select(*COLUMNS, F.explode("mix.positions").alias("position"))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    _begin(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_spans", repeated_spans), ("mixing", mixing), ("packing", packing)]

#: The classifier, the mix's hash and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is a table in the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
