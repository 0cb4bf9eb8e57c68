"""Removal of long repeated word spans by De Bruijn compaction.

Edges of the graph are k-mers of WINDOW consecutive words, nodes the runs of
one word less at their ends.

1. Consecutive edges of a document with one minimizer (the least hash of the
   short grams in the window, which depends on the window's words alone) travel
   together, so equal edges of different documents meet under one minimizer.
   Joins drop what one document alone has and compact equal runs of edges to
   the first document (the source) that has them.
2. Where runs with one minimizer differ, their edges become rows. Joins count
   the edges into and out of each node; edges that meet in a node with one edge
   each way and follow each other in their source are one path: stretches of
   edges are brought together, and joins compact those that go on from each
   other (pointer doubling, a join a round).
3. Every place of a path names the place in the source where its words stand.
   Places on one diagonal merge to spans, and a digest (blake2b) of the words
   at both places verifies each span before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import discard, fan_join, settle, stored, table
from .textkit import SPACED, Words, buffers, chunks, mix, runs, sliding_min, task

#: Words of an edge, and of the grams that minimizers are chosen among.
WINDOW, GRAM = 50, 10
SEEDS = (11, 13)
#: Places in texts that are broadcast at most: two numbers each, and two for each text.
PLACES = 2_000_000
#: Places of a stretch whose edges are brought together first, and rounds of pointer doubling at most: paths of 2^ROUNDS stretches.
SEGMENT, ROUNDS = 64, 40
PATH = "m long, h1 long, h2 long, n int, doc_id long, th long, start int"
PLACE = ["doc_id", "th", "start"]


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _windows(hashes: list[np.ndarray], window: int) -> list[np.ndarray]:
    return [runs(h, window, s) for h, s in zip(hashes, SEEDS, strict=True)]


def _paths(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Row, first edge's word (in all words), number of edges, minimizer and two hashes of each run of edges with one minimizer."""
    start, row = words.grams(window)
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    hashes = [words.hashes(s) for s in SEEDS]
    gram = min(GRAM, window)
    least = sliding_min(runs(hashes[0], gram, SEEDS[0]), window - gram + 1)[start]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (least[1:] != least[:-1])])
    n = np.diff(np.r_[first, len(start)])
    begin = start[first]
    # a run's first and last window and its length say all of its words, where it is at most two windows long; others are cut
    full = np.repeat(np.arange(len(n)), -(-n // window))
    part = np.arange(len(full)) - np.repeat(np.cumsum(-(-n // window)) - -(-n // window), -(-n // window))
    begin, n, first = begin[full] + part * window, np.minimum(n[full] - part * window, window), first[full]
    spans = [mix(mix(w[begin]) + w[begin + n - 1] ^ n.astype(np.uint64)).view(np.int64) for w in _windows(hashes, window)]
    return row[first], begin, n, least[first].view(np.int64), *spans


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).where("doc_id is not null and text is not null")


def document_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    @task("substrings")
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*buffers(part.column("text")), SPACED)
                row, begin, n, least, h1, h2 = _paths(words, window)
                ids, th = np.asarray(part.column("doc_id")), np.asarray(part.column("th"))
                columns = [least, h1, h2, n.astype(np.int32), ids[row], th[row], (begin - words.first[row]).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], _names(PATH))

    return _keyed(docs).mapInArrow(walk, PATH)


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that settled places (doc_id, th, start, n) lie in, with a column `places` of them."""
    return _keyed(docs).join(sized(places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("places")), places), ["doc_id", "th"])


def sized(grouped: DataFrame, flat: DataFrame) -> DataFrame:
    """grouped with a broadcast hint if the flat rows in it, counted, are at most PLACES (some 20 bytes each); they must be settled.
    Beyond that texts are shuffled to them."""
    return F.broadcast(grouped) if flat.count() <= PLACES else grouped


def _edges(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The edges of some places as rows: two hashes, the nodes they lead from and to, and where they start."""

    @task("substrings")
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*buffers(part.column("text")), SPACED)
                at, row = [], []
                for i, spans in enumerate(part.column("places").to_pylist()):
                    at += [np.arange(r["start"], r["start"] + r["n"]) for r in spans]
                    row += [np.full(r["n"], i) for r in spans]
                at, row = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(row or [np.zeros(0, np.int64)])
                begin = at + words.first[row]
                hashes = [words.hashes(s) for s in SEEDS]
                w1, w2 = (w[begin].view(np.int64) for w in _windows(hashes, window))
                nodes = runs(hashes[0], window - 1, SEEDS[0]) if window > 1 else np.zeros(len(hashes[0]) + 1, np.uint64)
                columns = [w1, w2, nodes[begin].view(np.int64), nodes[begin + 1].view(np.int64), np.asarray(part.column("doc_id"))[row], np.asarray(part.column("th"))[row], at.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], _names(EDGE))

    EDGE = "w1 long, w2 long, from long, to long, doc_id long, th long, start int"
    return _texts(docs, places).select("doc_id", "th", "text", "places").mapInArrow(walk, EDGE)


def compact(edges: DataFrame) -> DataFrame:
    """Edges (w1, w2, from, to, doc_id, th, start, size), one row each, with `head`: where the non-branching path that an edge is
    in begins in its source. Edges of one stretch of SEGMENT places come together first; the segments that may go on from the
    stretch before are joined to it, and pointer doubling over them (a join a round) finds where paths begin."""
    into = edges.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("ins"))
    out = edges.groupBy(F.col("from").alias("node")).agg(F.count("*").alias("outs"))
    straight = into.join(out, "node").where("ins = 1 and outs = 1").select(F.col("node").alias("from"), F.lit(True).alias("straight"))
    linked = edges.drop("to").join(straight, "from", "left").drop("from").withColumn("straight", F.coalesce("straight", F.lit(False)))
    stretch = Window.partitionBy("doc_id", "th", F.floor(F.col("start") / SEGMENT)).orderBy("start")
    # consecutive places of one text share the node between them
    begins = ~(F.col("straight") & F.coalesce(F.lag("start").over(stretch) == F.col("start") - 1, F.lit(False)))
    headed = linked.withColumn("begin", F.when(begins, F.col("start"))).withColumn("at", F.max("begin").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
    headed = settle(headed.drop("begin"))
    last = headed.groupBy("doc_id", "th", "at").agg(F.max("start").alias("last"))
    ends = last.where((F.col("last") + 1) % SEGMENT == 0).select("doc_id", "th", (F.col("last") + 1).alias("at"), F.col("at").alias("head"))
    now = settle(headed.where((F.col("start") % SEGMENT == 0) & F.col("straight")).select("doc_id", "th", F.col("start").alias("at")).join(ends, ["doc_id", "th", "at"]))
    for _ in range(ROUNDS):
        ahead = now.select("doc_id", "th", F.col("at").alias("head"), F.col("head").alias("to_head"))
        new = settle(now.join(ahead, ["doc_id", "th", "head"], "left").select("doc_id", "th", "at", F.coalesce("to_head", "head").alias("head"), F.col("to_head").isNotNull().alias("moved")))
        moved, now = not new.where("moved").isEmpty(), new.drop("moved")
        if not moved:
            return headed.join(now, ["doc_id", "th", "at"], "left").withColumn("head", F.coalesce("head", "at")).drop("at", "straight")
    raise RuntimeError("paths did not settle")


def repeated_edges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs (doc_id, th, start, n) of edges whose words start in a document with a smaller id too, at the source (s_id, s_th, s_start)."""
    paths = stored(document_paths(docs, window))
    shared = settle(paths.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("m", "size", F.lit(True).alias("shared")))
    kept = stored(fan_join(paths, shared, "m", "size", "doc_id").where("shared").drop("shared"))
    discard(paths)
    same = ["m", "h1", "h2", "n"]
    contents = settle(kept.groupBy(*same).agg(F.min(F.struct(*PLACE)).alias("source"), F.count("*").alias("size")))
    branching = settle(contents.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("branching", F.lit(True)))
    known = settle(fan_join(contents, branching, "m", "kinds", "h1"))
    placed = fan_join(kept, known, same, "size", "doc_id")
    # a run that a smaller document has as well is repeated as a whole; of branching ones the edges at all places in the source document are open
    places = stored(placed.where("doc_id > source.doc_id or (branching and doc_id = source.doc_id)"))
    discard(kept)
    at_source = [F.col("source.doc_id").alias("s_id"), F.col("source.th").alias("s_th"), F.col("source.start").alias("s_start")]
    whole = places.where("doc_id > source.doc_id").select(*PLACE, "n", *at_source)

    single = stored(_edges(docs, settle(places.where("doc_id = source.doc_id").select(*PLACE, "n")), window))
    distinct = single.groupBy("w1", "w2").agg(F.min(F.struct(*PLACE)).alias("source"), F.max("doc_id").alias("last"), F.first("from").alias("from"), F.first("to").alias("to"), F.count("*").alias("size"))
    edges = settle(distinct.where("source.doc_id < last").select("w1", "w2", "from", "to", "source.*", "size"))
    path = compact(edges).select("w1", "w2", F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), F.col("start").alias("s_start"), "head", "size")
    hits = fan_join(single.select("w1", "w2", *PLACE), settle(path), ["w1", "w2"], "size", "start").where("doc_id > s_id")
    # all edges of one path that stand on one diagonal are one row
    apart = hits.groupBy("doc_id", "th", "s_id", "s_th", "head", (F.col("start") - F.col("s_start")).alias("diagonal")).agg(F.min("start").alias("start"), F.min("s_start").alias("s_start"), F.array_sort(F.collect_set("start")).alias("starts"))
    split = apart.select("doc_id", "th", "s_id", "s_th", F.explode(_islands("starts")).alias("i"), "diagonal")
    return whole.unionByName(split.select("doc_id", "th", "i.start", "i.n", "s_id", "s_th", (F.col("i.start") - F.col("diagonal")).cast("int").alias("s_start")))


def _islands(starts: str):
    """An array of sorted numbers as runs (start, n) of consecutive ones."""
    empty = F.array().cast("array<struct<start:int,n:int>>")
    begins = F.filter(starts, lambda s: ~F.array_contains(starts, s - 1))
    ends = F.filter(starts, lambda s: ~F.array_contains(starts, s + 1))
    whole = F.array(F.struct(F.array_min(starts).alias("start"), F.size(starts).alias("n")))
    apart = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).cast("int").alias("n")))
    return F.coalesce(F.when(F.array_max(starts) - F.array_min(starts) + 1 == F.size(starts), whole).otherwise(apart), empty)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word spans [start, end) to remove, merged to longest ones: one row (doc_id, th, spans) for each text that has some."""
    columns = ["start", "n", "s_id", "s_th", "s_start"]
    grouped = repeated_edges(docs, window).groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("runs"))

    @task("substrings")
    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges that follow or overlap each other on one diagonal of one source, as one claim."""
        for batch in batches:
            runs_ = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(runs_.offsets.to_numpy()))
            start, n, s_id, s_th, s_start = (np.asarray(runs_.flatten().field(c)).astype(np.int64) for c in columns)
            order = np.lexsort((start, start - s_start, s_th, s_id, row))
            row, start, n, s_id, s_th, s_start = (x[order] for x in (row, start, n, s_id, s_th, s_start))
            if not len(row):
                continue
            key = np.stack([row, s_id, s_th, start - s_start])
            apart = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0) | (start[1:] > start[:-1] + n[:-1])]  # runs of one document and source don't overlap
            first = np.flatnonzero(apart)
            reach = np.maximum.reduceat(start + n, first)
            made = [np.asarray(batch.column("doc_id"))[row[first]], np.asarray(batch.column("th"))[row[first]], start[first].astype(np.int32), (reach - start[first]).astype(np.int32), s_id[first], s_th[first], s_start[first].astype(np.int32)]
            yield pa.record_batch([pa.array(x) for x in made], _names(CLAIM))

    CLAIM = "doc_id long, th long, start int, n int, s_id long, s_th long, s_start int"
    claims = stored(grouped.mapInArrow(claim, CLAIM))
    at_source = claims.select(F.col("s_id").alias("doc_id"), F.col("s_th").alias("th"), F.col("s_start").alias("start"), "n")

    @task("substrings")
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = []
                for key, th, text, places in zip(*(part.column(c).to_pylist() for c in ("doc_id", "th", "text", "places")), strict=True):
                    words = text.encode().split()
                    out += [(key, th, p["start"], p["n"], blake2b(b" ".join(words[p["start"] : p["start"] + p["n"] + window - 1]), digest_size=16).digest()) for p in places]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=[*PLACE, "n", "digest"])

    # how often a place is asked for says which places are hot
    asked = settle(claims.select(*PLACE, "n").union(at_source).groupBy(*PLACE, "n").agg(F.count("*").alias("size")))
    read = _texts(docs, asked).select("doc_id", "th", "text", "places").mapInArrow(digest, "doc_id long, th long, start int, n int, digest binary").distinct()
    digests = settle(read.join(asked, [*PLACE, "n"]))
    own = fan_join(claims, digests, [*PLACE, "n"], "size", "s_id")
    of_source = digests.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), F.col("start").alias("s_start"), "n", F.col("digest").alias("s_digest"), "size")
    verified = fan_join(own, of_source, ["s_id", "s_th", "s_start", "n"], "size", "doc_id").where("digest = s_digest")

    @task("substrings")
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for places in batch.column("places").to_pylist():
                s = np.array(sorted((r["start"], r["start"] + r["n"] - 1 + window) for r in places))
                reach = np.maximum.accumulate(s[:, 1])
                first = np.flatnonzero(np.r_[True, s[1:, 0] > reach[:-1]])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s[first, 0], reach[np.r_[first[1:] - 1, len(s) - 1]], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(spans, kind)], ["doc_id", "th", "spans"])

    return verified.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("places")).mapInArrow(merge, "doc_id long, th long, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with columns n_words, n_removed and kept (the words left, joined by a blank).

    A word goes if a window of `window` words that covers it starts in a
    document with a smaller doc_id too; windows are judged on the input. Null
    texts have no words. Rows with a null doc_id keep all words and are no
    source; rows with equal ids are no sources of each other; texts of fewer
    words than a window stay whole, and long ones are read to their end.
    Repeated rows get equal results; an empty table gives none. Columns named
    n_words, n_removed and kept are replaced; any other column stays as it is.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    spans = settle(repeated_spans(docs.select("doc_id", "text"), window))
    side = sized(spans, spans.select(F.explode("spans")))
    # what docs has travels as one column, so that no name of its can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    joined = held.join(side, ["doc_id", "th"], "left").select("row", F.col("row.text").cast("string").alias("text"), "spans")

    @task("substrings")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                total, gone, kept = [], [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    total.append(len(words))
                    for s in reversed(spans or []):
                        del words[s["start"] : s["end"]]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    made = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(cut, made).select(*[F.col(f"row.`{c}`").alias(c) for c in own], "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
