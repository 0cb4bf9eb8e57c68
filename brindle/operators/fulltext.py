"""Full-text search: tokens, postings, BM25, substring matching, fuzzy terms, synonyms and facets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.tables import shared_folder

#: Everything between words.
SEPARATOR = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"
#: Folders that an index deals its postings to, by a hash of the token.
PARTS = 64
#: Ids that go to the broadcast side of a join, at most.
NARROW_ROWS = 500_000
#: Scripts that are written without blanks, whose tokens are pairs of characters.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", query.lower()) if t))


def postings(docs: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """(doc, token, tf, field_len): the tokens of all columns of a row are one bag, rows of one id one document."""
    alone, met = _by_id(docs, id_column, *columns)
    return _row_postings(alone) if met is None else _row_postings(alone).unionByName(_met_postings(met))


def vocabulary(docs: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """(token, df, total): how many documents have a token and how often, as postings() counts them, without a row for each of its counts."""
    alone, met = _by_id(docs, id_column, *columns)
    bag = alone.select(tokens(F.col("text")).alias("bag")).select("bag", F.array_distinct("bag").alias("kinds"))
    seen = bag.select(F.size("kinds").alias("n"), F.posexplode(F.concat("kinds", "bag")).alias("at", "token"))
    counts = seen.select("token", (F.col("at") < F.col("n")).cast("long").alias("df"), (F.col("at") >= F.col("n")).cast("long").alias("total"))
    if met is not None:
        counts = counts.unionByName(_met_postings(met).select("token", F.lit(1).cast("long").alias("df"), F.col("tf").alias("total")))
    return counts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _by_id(docs: DataFrame, id_column: str, *columns: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of the rows whose id no other has, which count for themselves, and of all others, which have to meet. Ids are read first."""
    rows = docs.select(F.col(id_column).alias("doc"), F.concat_ws(" ", *columns).alias("text"))
    shared = rows.groupBy("doc").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc").alias("shared"))
    n = shared.count()
    if n == 0:
        return rows, None
    same, shared = F.col("doc").eqNullSafe(F.col("shared")), F.broadcast(shared) if n <= NARROW_ROWS else shared
    return rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")


def _met_postings(rows: DataFrame) -> DataFrame:
    return _row_postings(rows).groupBy("doc", "token").agg(F.sum("tf").alias("tf"), F.first("field_len").alias("field_len"))


def _row_postings(rows: DataFrame) -> DataFrame:
    """postings() of (doc, text), each row by itself: equal tokens are neighbours in a sorted bag, and from one start to the next they are counted."""
    n = F.size("bag")
    bag = rows.select("doc", F.sort_array(tokens(F.col("text"))).alias("bag"))
    starts = F.filter(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), lambda i: ~F.get("bag", i).eqNullSafe(F.get("bag", i - 1)))  # 0 to n - 1; none of an empty bag
    ends = F.slice(F.concat("at", F.array(n)), F.lit(2), F.size("at"))
    runs = F.arrays_zip(F.array_distinct("bag").alias("token"), F.col("at").alias("start"), ends.alias("end"))
    words = bag.select("doc", "bag", starts.alias("at")).select("doc", n.cast("long").alias("field_len"), F.inline(runs))
    return words.select("doc", "token", (F.col("end") - F.col("start")).cast("long").alias("tf"), "field_len")


def bm25(docs: DataFrame, id_column: str, query: str, *columns: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) of the rows that have a token of the query; without tokens in it, none.

    Texts are read once: their length in tokens and the counts of the query's
    tokens are kept in the shared folder, as the statistics come from all of them.
    """
    wanted, text = query_tokens(query), F.lower(F.concat_ws(" ", *columns))
    rows = docs.select(F.col(id_column).alias("doc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("dl"), *[_times(text, w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    if not wanted:
        return rows.select("doc", F.lit(0.0).alias("score")).limit(0)
    counted = settled(rows)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score = sum((_term(F.col(f"tf{i}"), F.col(f"df{i}"), k1, b) for i in range(len(wanted))), F.lit(0.0))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0
    return counted.where(hit).join(F.broadcast(stats)).select("doc", score.alias("score"))  # stats is one row


def settled(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _times(text: Column, word: str) -> Column:
    """How often a token stands in lower-cased text."""
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{word}\E(?![\p{{L}}\p{{N}}])")).cast("long")


def _term(tf: Column, df: Column, k1: float, b: float) -> Column:
    idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def match_against(docs: DataFrame, query: str, *columns: str) -> DataFrame:
    """docs with score: the share of the query's tokens that stand in the columns' joined text, if any does."""
    wanted = [t for t in re.split(r"[^\w]+|_", query.lower()) if t]
    hay = F.lower(F.concat_ws(" ", *columns))
    hits = sum((F.when(hay.contains(w), 1).otherwise(0) for w in wanted), F.lit(0))
    return docs.withColumn("score", hits / float(max(len(wanted), 1))).where("score > 0")


def match_all(docs: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which all tokens of the query stand; without tokens in it, none."""
    if not query_tokens(query):
        return docs.limit(0)
    hay = F.lower(F.concat_ws(" ", *columns))
    for w in query_tokens(query):
        docs = docs.where(hay.contains(w))
    return docs


def fuzzy_terms(terms: DataFrame, column: str, word: str, distance: int) -> DataFrame:
    """Terms within an edit distance; lengths that can't be are left out first."""
    near = F.length(column).between(len(word) - distance, len(word) + distance)
    return terms.where(near).withColumn("distance", F.levenshtein(column, F.lit(word))).where(F.col("distance") <= distance)


def expand_synonyms(words: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(x for w in words for x in (w, *synonyms.get(w, []))))


def facets(df: DataFrame, field: str, n: int) -> DataFrame:
    return df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def without_stop_words(bag: Column, stop_words: list[str]) -> Column:
    """The tokens that are no stop words, repeats kept."""
    return F.filter(bag, lambda t: ~t.isin(*stop_words))


def reindex(index: DataFrame, changed: DataFrame, gone: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """postings() after changes: those of changed and deleted rows leave, those of changed rows come anew."""
    stale = changed.select(F.col(id_column).alias("doc")).union(gone.select(F.col(id_column).alias("doc"))).distinct()
    return index.join(stale, "doc", "left_anti").unionByName(postings(changed, id_column, *columns))


def pair_tokens(text: Column) -> Column:
    """Tokens of text that may be written without blanks: runs of such characters give each pair of neighbours (one alone, itself)."""
    spread = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"({UNSPACED}+)", " $1 ")
    words = F.array_remove(F.split(spread, SEPARATOR), "")
    pairs = F.transform(words, lambda w: F.when(w.rlike(f"^{UNSPACED}{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w)))
    return F.flatten(pairs)


def write_index(docs: DataFrame, id_column: str, path: str, *columns: str) -> None:
    """Postings of all columns of docs as a table in `path`, a folder for each part of the tokens, so that a search reads few of them."""
    slices = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS)
    part = F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")
    dealt = postings(docs, id_column, *columns).repartitionById(PARTS * slices, part * slices + F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int"))
    dealt.withColumn("part", part).sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{path}/postings")
    docs.select(F.col(id_column).alias("doc"), F.regexp_count(F.lower(F.concat_ws(" ", *columns)), F.lit(WORD)).cast("long").alias("dl")).write.parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) as bm25() gives it, from a kept index: no text is read, and of the postings only the parts of the query's tokens."""
    wanted = query_tokens(query)
    parts = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int")).collect()]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts) & F.col("token").isin(wanted)).select("doc", "token", "tf", F.col("field_len").alias("dl"))
    stats = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    rare = hits.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
    scored = hits.join(F.broadcast(rare), "token").join(F.broadcast(stats)).select("doc", _term(F.col("tf"), F.col("df"), k1, b).alias("score"))
    return scored.groupBy("doc").agg(F.sum("score").alias("score"))
