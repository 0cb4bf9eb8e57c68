"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix, under size-derived bounds.

Equal shingle sets are one class (a row of the matrix); the sets are hashed
once and kept as a table. Columns are ordered by rising frequency: those that
repeat within some thousand documents by their counts, behind all others, and
these by the length of their words, the longest first, as what texts share by
chance is made of the shortest words. That needs no table that grows with the
input, and a document's prefix stays rare at any size. Two classes
that link share at least e columns among the first n - ceil(t n) + e of either
(the prefix), where e is 1 and one more for each EXTRA of the smaller size, so
only prefix columns with two or more classes say where the product can have
entries:

1. A narrow column gives its pairs of classes, under bounds from both sizes and
   places; pairs need e of them, unless a wide column is one. Each class of wide columns lies in one block (its widest column, its
   size level, a tile of BLOCK classes); two blocks with a wide column in common
   are a block of the product, once, however many columns they share.
2. Bitmaps of the sets bound each pair's overlap.
3. What is left is multiplied out: blocks of whole rows, where shared columns
   add up to overlap counts, and pairs leave as soon as the columns to come
   can't bring them to the overlap that their sizes ask for.

All links between classes are found and counted. In a group of near copies
they are as many as its pairs, so a block gives each class's number of links
and a spanning part of the links, unless a caller wants every one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import IDS, fan_join, settle, small_side, stored, table
from .components import components
from .textkit import LOWER, SPACED, Words, buffers, chunks, runs, task

#: Words of a shingle and the least similarity, unless a caller has others.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)
#: Columns of at most so many classes give pairs; classes of a block.
NARROW, BLOCK = 48, 500
#: Shingles of the rows of a block.
BLOCK_GRAMS = 1 << 20
#: Rows for each partition of the tables of pairs.
PART_ROWS = 20_000
#: Frequent columns that get a place of their own at the end of the order, shingles counted at once, and the count from which
#: rows of a column are dealt out over many tasks before they are grouped.
FREQUENT, COUNTED, HOT = 1 << 18, 1 << 22, 2_000
#: Leading bits of a shingle's hash that say how short its words are.
LEVEL = 6
#: Columns that are multiplied at once, and the most classes of a column whose pairs are added up one by one.
COLUMNS, FEW = 4096, 12
SEED = 23
#: For each so many shingles a pair has to share one more column of the prefix.
EXTRA = 100
#: Bits of the bitmaps that pairs are first tried on.
BITS = 4096


def shingle_sets(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; of fewer than n words, the whole sequence is one. Shingles of long words come first."""
    data, offsets = buffers(part.column("text"))
    words = Words(LOWER[data], offsets, SPACED)
    hashes = words.hashes(SEED)
    ends = np.r_[0, np.cumsum(words.end - words.start)]

    def hashed(start: np.ndarray, k: int) -> np.ndarray:
        # quarters of a byte of the mean word, as a level before the hash's other bits
        level = np.minimum(4 * (ends[start + k] - ends[start]) // k, (1 << LEVEL) - 1)
        top = np.int64((1 << (LEVEL - 1)) - 1) - level
        return (top << np.int64(64 - LEVEL)) | (runs(hashes, k, SEED)[start] >> np.uint64(LEVEL)).view(np.int64)

    start, row = words.grams(n)
    grams = hashed(start, n)
    for k in range(1, n):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            grams = np.r_[grams, hashed(words.first[short], k)]
            row = np.r_[row, short]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    if len(grams):
        keep = np.r_[True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])]
        grams, row = grams[keep], row[keep]
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    return [grams[a:b] for a, b in zip(bounds, bounds[1:])]


def needed(n_a: Column, n_b: Column, t: Fraction) -> Column:
    """The least overlap with which sets of these sizes link: o >= t (a + b - o)."""
    p, q = t.numerator, t.denominator
    return F.ceil(F.lit(p) * (n_a + n_b) / F.lit(float(p + q)) - 1e-9)


def _links(o: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, t: Fraction) -> np.ndarray | bool:
    return t.denominator * o >= t.numerator * (a + b - o)


def _shared(n: np.ndarray, m: np.ndarray, t: Fraction, extra: int) -> np.ndarray:
    """How many prefix columns sets of these sizes that link share at least: at most the overlap that the larger one asks for."""
    return np.minimum(1 + np.minimum(n, m) // extra, -(-t.numerator * np.maximum(n, m) // t.denominator))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """The one pass over texts: rid (a number of its own), doc_id, th, key (128 bits of the set), n, grams (its sorted hashes)."""

    @task("jaccard")
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part, n)
                grams = [s.tobytes() for s in sets]
                columns = [part.column(c) for c in ("rid", "doc_id", "th")]
                columns += [pa.array([blake2b(g, digest_size=16).digest() for g in grams], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(grams, pa.binary())]
                yield pa.record_batch(columns, ["rid", "doc_id", "th", "key", "n", "grams"])

    return docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(hashed, "rid long, doc_id long, th long, key binary, n long, grams binary")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles and their counts, for the order of columns and the spread of hot ones only: any order that all tasks share is right.

    Shingles are counted COUNTED at a time, and those that come once in such a
    stretch aren't passed on; a column with a fixed share of all rows is found
    at any size.
    """

    @task("jaccard")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            gram, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array(gram[times > 1]), pa.array(times[times > 1].astype(np.int64))], ["gram", "times"])
            held.clear()

        for batch in batches:
            for part in chunks(batch, "grams", 2 << 20):
                held.append(buffers(part.column("grams"))[0].view(np.int64).copy())
                if sum(map(len, held)) > COUNTED:
                    yield from flush()
        yield from flush()

    stretches = 1 + (sets.agg(F.sum("n").alias("n")).first()["n"] or 0) // COUNTED
    found = settle(sets.select("grams").coalesce(stretches).mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")))
    # the least count of which all fit, rather than a sort of all
    least, held = 3, 0
    for x in found.groupBy(F.least("times", F.lit(HOT)).alias("times")).count().orderBy(F.desc("times")).toLocalIterator():
        held += x["count"]
        if held > FREQUENT:
            least = max(least, x["times"] + 1)
            break
    rows = found.where(F.col("times") >= least).orderBy(F.desc("times"), "gram").limit(FREQUENT).toArrow()
    gram, times = rows["gram"].to_numpy(), rows["times"].to_numpy()
    order = np.argsort(gram)
    return gram[order], times[order]


def _postings(sets: DataFrame, t: Fraction, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, c, n, place, hot) of every class's prefix. hot: the column is known to be wide."""

    @task("jaccard")
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "grams", 2 << 20):
                data, bounds = buffers(part.column("grams"))
                s, n = data.view(np.int64), np.diff(bounds) // 8
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(s), np.int64)
                if len(frequent[0]):
                    at = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
                    rank = np.where(frequent[0][at] == s, frequent[1][at], 0)
                order = np.lexsort((s, rank, row))
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                prefix = n + (-t.numerator * n) // t.denominator + 1 + n // EXTRA
                keep = place < prefix[row]
                order, row, place = order[keep], row[keep], place[keep]
                yield pa.record_batch([pa.array(s[order]), pa.array(np.asarray(part.column("c"))[row]), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(rank[order] > HOT)], POSTING)

    POSTING = ["gram", "c", "n", "place", "hot"]
    return sets.select("c", "grams").mapInArrow(emit, "gram long, c long, n int, place int, hot boolean")


def _columns(postings: DataFrame, t: Fraction) -> DataFrame:
    """Postings in the order of columns as rows of two kinds: pairs (a, b) of each narrow column, with how many such n the pair has
    to share, and of wide ones (gram, c, n)."""
    p, q = t.numerator, t.denominator

    @task("jaccard")
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide_gram = None, None

        def out(cols: list[np.ndarray], kind: str) -> pa.RecordBatch:
            none = pa.nulls(len(cols[0]), pa.int64())
            made = [pa.array(x.astype(np.int64)) for x in cols]
            return pa.record_batch([*made[:2], none, none, made[2]] if kind == "pairs" else [none, none, *made], ["a", "b", "gram", "c", "n"])

        def done(g: np.ndarray, c: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[first, len(g)])
            width = np.repeat(size, size)
            wide = (width > NARROW) | (g == wide_gram if wide_gram is not None else False)
            if wide.any():
                yield out([g[wide], c[wide], n[wide]], "wide")
            keep = ~wide & (width > 1)
            g, c, n, place = g[keep], c[keep], n[keep], place[keep]
            for apart in range(1, min(NARROW, len(g))):
                x = np.flatnonzero(g[apart:] == g[:-apart])
                if not len(x):
                    break
                y = x + apart
                need = -(-p * (n[x] + n[y]) // (p + q))
                shared = _shared(n[x], n[y], t, EXTRA)
                # the first columns that a pair shares have at most shared - 1 of its overlap before them
                x, y, shared = (v[(np.minimum(n[x] - place[x], n[y] - place[y]) >= need - (shared - 1)) & (c[x] != c[y])] for v in (x, y, shared))
                if len(x):
                    yield out([np.minimum(c[x], c[y]), np.maximum(c[x], c[y]), shared], "pairs")

        for batch in batches:
            now = [np.asarray(batch.column(k)).astype(np.int64) for k in ("gram", "c", "n", "place")]
            held = now if held is None else [np.r_[a, b] for a, b in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last column may go on in the next batch
            if cut:
                yield from done(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            if len(held[0]) > NARROW:  # and once it is known to be wide, its rows needn't wait
                wide_gram = int(held[0][0])
                yield from done(*held)
                held = None
        if held is not None and len(held[0]):
            yield from done(*held)

    ordered = postings.where("not hot").select("gram", "c", "n", "place").repartition("gram").sortWithinPartitions("gram")
    hot = postings.where("hot").select(*[F.lit(None).cast("long").alias(x) for x in "ab"], "gram", "c", F.col("n").cast("long"))
    return ordered.mapInArrow(multiply, "a long, b long, gram long, c long, n long").union(hot)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(c, bits): the set's size and a bit for each hash; the bits in which two sets differ come from shingles in one of them."""

    @task("jaccard")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "grams", 1 << 20):
                data, bounds = buffers(part.column("grams"))
                n = np.diff(bounds) // 8
                bits = np.zeros((len(n), BITS), bool)
                bits[np.repeat(np.arange(len(n)), n), data.view(np.uint64) % np.uint64(BITS)] = True
                packed = np.concatenate([n.astype("<u4").view(np.uint8).reshape(-1, 4), np.packbits(bits, axis=1)], 1)
                yield pa.record_batch([part.column("c"), pa.array([r.tobytes() for r in packed], pa.binary())], ["c", "bits"])

    return sets.select("c", "grams").mapInArrow(make, "c long, bits binary")


def _bitmap(grams: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[grams.view(np.uint64) % np.uint64(BITS)] = True
    return np.uint32(len(grams)).tobytes() + np.packbits(bits).tobytes()


def _unpacked(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), 4 + BITS // 8)
    return np.ascontiguousarray(rows[:, :4]).view("<u4").ravel().astype(np.int64), rows[:, 4:]


def _may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, t: Fraction) -> np.ndarray:
    return _links(np.minimum(np.minimum(n, m), (n + m - apart) // 2), n, m, t)


RESULT = "a long, b long, links long"


def _result(c: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, every: bool) -> pd.DataFrame:
    """What a block says of its links between rows a and b: all of them, or a star for each component, as (a, b); and as (a, links)
    with how many rows of docs each class links."""
    links = np.bincount(a, m[b], len(c)) + np.bincount(b, m[a], len(c))
    root = np.arange(len(c))
    if not every:
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        a, b = np.flatnonzero(root != np.arange(len(c))), root[root != np.arange(len(c))]
    of = np.flatnonzero(links)
    first, second = np.r_[np.minimum(c[a], c[b]), c[of]], np.r_[np.maximum(c[a], c[b]), np.zeros(len(of), np.int64)]
    counts = np.r_[np.zeros(len(a)), links[of]].astype(np.int64)
    return pd.DataFrame({"a": first, "b": pd.array(second, "Int64"), "links": pd.array(counts, "Int64")}).assign(b=lambda d: d["b"].mask(d["links"] > 0), links=lambda d: d["links"].mask(d["links"] == 0))


def jaccard_links(docs: DataFrame, n: int, t: Fraction, every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, sizes, links, degrees, labels): rid, doc_id, th, n and class c of each row of docs; the rows m of classes of more than
    one; the links (a, b), a < b, between different classes, each once, or only a spanning part of them; the rows of docs that each
    class links with; and components (node, label) of the links."""
    text = F.col("text").cast("string")
    sets = stored(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")), n))
    # a class is named by one of its rows; a key that a large part of all rows have is counted where they are
    many = settle(sets.where("n > 0").groupBy("key").agg(F.min("rid").alias("c"), F.count("*").alias("m")).where("m > 1"))
    rows = fan_join(sets.select("rid", "doc_id", "th", "n", "key"), many, "key", "m", "rid").select("rid", "doc_id", "th", "n", F.coalesce("c", "rid").alias("c"))
    again = settle(rows.where("rid <> c and n > 0").select("rid"))
    single = sets.where("n > 0").join(small_side(again, IDS), "rid", "left_anti").select(F.col("rid").alias("c"), "n", "grams")
    distinct = single.join(small_side(many.select("c", "m")), "c", "left").withColumn("m", F.coalesce("m", F.lit(1)))

    columns = settle(_columns(_postings(single, t, _frequent(single)), t))
    parts = 1 + columns.count() // PART_ROWS  # of the small tables that are made of them

    def small(df: DataFrame) -> DataFrame:
        return settle(df.coalesce(parts))

    def described(nodes: DataFrame) -> DataFrame:
        return distinct.join(small_side(small(nodes.distinct()), IDS), "c", "left_semi")

    pairs = small(columns.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("times"), F.first("n").alias("n")).where("times >= n").select("a", "b"))
    wide = columns.where("gram is not null").select("gram", "c", "n")
    found = None
    if not wide.isEmpty():
        blocks = small(_blocks(wide, t))
        met = settle(_met(wide, blocks))
        found = _block_links(blocks, met, described(blocks.select("c")), t, every)
        # pairs that have a block don't need to be tried on their own
        one, other = (blocks.select(F.col("c").alias(k), F.col("block").alias(f"{k}_block")) for k in "ab")
        at = [F.least("a_block", "b_block").alias("i"), F.greatest("a_block", "b_block").alias("j")]
        placed = pairs.join(small_side(one), "a", "left").join(small_side(other), "b", "left").withColumn("both", F.col("a_block").isNotNull() & F.col("b_block").isNotNull()).select("a", "b", *[F.when(F.col("both"), x).alias(k) for x, k in zip(at, "ij", strict=True)])
        pairs = placed.join(small_side(met), ["i", "j"], "left_anti").select("a", "b")
    found_alone = _verified(small(_tried(pairs, described, t)), described, t, every)
    found = settle((found_alone if found is None else found_alone.union(found)).coalesce(parts))
    links = found.where("b is not null").select("a", "b")
    degrees = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    return rows, many.select("c", "m"), links, degrees, components(links)


def _tried(pairs: DataFrame, described, t: Fraction) -> DataFrame:
    """The pairs whose bitmaps may link."""
    pairs = settle(pairs)
    bits = settle(_bitmaps(described(pairs.select(F.col("a").alias("c")).union(pairs.select("b")))))
    one, other = (bits.select(F.col("c").alias(k), F.col("bits").alias(f"d{k}")) for k in "ab")

    @task("jaccard")
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (size_a, on_a), (size_b, on_b) = (_unpacked(batch.column(k).to_pylist()) for k in ("da", "db"))
                apart = np.bitwise_count(on_a ^ on_b).sum(1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(_may_link(size_a, size_b, apart, t)))

    return pairs.join(other.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "da", "db").mapInArrow(keep, "a long, b long")


def _blocks(wide: DataFrame, t: Fraction) -> DataFrame:
    """(c, block, level) of each class of wide columns: its widest one, its size level and a tile of about BLOCK classes."""
    widths = settle(wide.groupBy("gram").agg(F.count("*").alias("width")))
    home = fan_join(wide, widths.withColumn("size", F.col("width")), "gram", "size", "c").groupBy("c").agg(F.max(F.struct("width", "gram")).alias("home"), F.first("n").alias("n"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(t.denominator / t.numerator)))).cast("int")
    members = settle(home.select("c", "n", F.col("home.gram").alias("home"), level.alias("level")))
    tiles = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int")
    sizes = members.groupBy("home", "level").agg(tiles.alias("tiles"), F.count("*").alias("size"))
    named = fan_join(members, settle(sizes), ["home", "level"], "size", "c")
    return named.select("c", F.xxhash64("home", "level", F.pmod(F.xxhash64("c"), "tiles")).alias("block"), "level")


def _met(wide: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks (i, j), i <= j, of the product that wide columns make non-zero. Levels of sizes that can't link don't meet."""
    held = settle(wide.select("gram", "c").join(small_side(blocks), "c").select("gram", "block", "level").distinct())
    x, y = held.alias("x"), held.alias("y")
    return x.join(y, F.expr("x.gram = y.gram and x.block <= y.block and abs(x.level - y.level) <= 1")).select(F.col("x.block").alias("i"), F.col("y.block").alias("j")).distinct()


def _block_links(blocks: DataFrame, met: DataFrame, sets: DataFrame, t: Fraction, every: bool) -> DataFrame:
    """The links in the blocks of the product, each pair of classes in one block only. Bitmaps come to a block first; whole rows only
    of classes for which they leave a partner there."""
    members = blocks.select("c", "block")
    sides = met.join(members, F.col("i") == F.col("block")).select("i", "j", "c", F.lit(0).alias("side")).union(met.where("i <> j").join(members, F.col("j") == F.col("block")).select("i", "j", "c", F.lit(1)))

    def possible(rows: pd.DataFrame, bits: list[bytes], same: bool) -> tuple[np.ndarray, np.ndarray]:
        split = int((rows["side"] == 0).sum())
        (n, on) = _unpacked(bits)
        on = np.unpackbits(on, axis=1).astype(np.float32)
        x, y = (slice(0, split), slice(0, split) if same else slice(split, len(rows)))
        held = on.sum(1)
        apart = np.rint(held[x, None] + held[None, y] - 2 * (on[x] @ on[y].T)).astype(np.int64)
        ok = _may_link(n[x, None], n[None, y], apart, t)
        a, b = np.nonzero(np.triu(ok, 1) if same else ok)
        return a, b if same else b + split

    def keep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "c"])
        a, b = possible(rows, list(rows["bits"]), key[0] == key[1])
        return rows.iloc[np.union1d(a, b)][["i", "j", "c", "side"]]

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "c"])
        same, split = key[0] == key[1], int((rows["side"] == 0).sum())
        grams = [np.frombuffer(g, np.int64) for g in rows["grams"]]
        a, b = possible(rows, [_bitmap(g) for g in grams], same)
        hit = _overlaps(grams, a, b, t, None if same else split)
        return _result(rows["c"].to_numpy(), rows["m"].to_numpy(), a[hit], b[hit], every)

    # what is wide goes to its blocks and isn't shuffled to be joined first, as long as the narrow side is small
    tried = _bitmaps(sets).join(small_side(settle(sides)), "c").select("i", "j", "c", "side", "bits")
    left = settle(tried.groupBy("i", "j").applyInPandas(keep, "i long, j long, c long, side int"))
    return sets.join(small_side(left), "c").select("i", "j", "c", "side", "m", "grams").groupBy("i", "j").applyInPandas(block, RESULT)


def _overlaps(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, t: Fraction, split: int | None = None) -> np.ndarray:
    """Which pairs of rows (a, b) link: overlap counts added up over blocks of columns, rare columns pair by pair and others as
    products, until no pair can link any more. With a split, a lies before it in rows and b behind."""
    if not len(a):
        return np.zeros(0, bool)
    size = np.array([len(r) for r in rows], np.int64)
    flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(flat)])
    shared = np.repeat(times > 1, times)
    flat, row, times = flat[shared], row[shared], times[times > 1]
    width = np.repeat(times, times)
    wanted = np.unique(a * len(rows) + b)
    total = np.zeros(len(wanted), np.int64)
    n, m = size[wanted // len(rows)], size[wanted % len(rows)]
    # what each row still has in columns to come
    to_come = np.bincount(row, minlength=len(rows))

    def add(x: np.ndarray, y: np.ndarray) -> None:
        key = np.r_[x * len(rows) + y, y * len(rows) + x]
        at = np.searchsorted(wanted, key)
        hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == key)
        np.add.at(total, at[hit], 1)

    rare = width <= FEW
    g, r = flat[rare], row[rare]
    for apart in range(1, FEW):
        x = np.flatnonzero(g[apart:] == g[:-apart])
        if not len(x):
            break
        add(r[x], r[x + apart])
    to_come -= np.bincount(r, minlength=len(rows))
    g, r, w = flat[~rare], row[~rare], times[times > FEW]
    column = np.repeat(np.arange(len(w)), w)
    live = np.arange(len(wanted))
    for lo in range(0, len(w), COLUMNS):
        x, y = wanted[live] // len(rows), wanted[live] % len(rows)
        reach = total[live] + np.minimum(to_come[x], to_come[y])
        live = live[_links(np.minimum(reach, np.minimum(n[live], m[live])), n[live], m[live], t)]
        if not len(live):
            break
        from_, to = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(rows), min(COLUMNS, len(w) - lo)), np.float32)
        part[r[from_:to], column[from_:to] - lo] = 1
        x, y = wanted[live] // len(rows), wanted[live] % len(rows)
        if 8 * len(live) < len(rows) ** 2:  # few pairs: their entries only
            for at in range(0, len(live), 256):
                total[live[at : at + 256]] += np.einsum("ij,ij->i", part[x[at : at + 256]], part[y[at : at + 256]]).astype(np.int64)
        else:
            product = part @ part.T if split is None else part[:split] @ part[split:].T
            total[live] += np.rint(product[x, y if split is None else y - split]).astype(np.int64)
        to_come -= np.bincount(r[from_:to], minlength=len(rows))
    return _links(total, n, m, t)[np.searchsorted(wanted, a * len(rows) + b)]


def _tiled(df: DataFrame, tiles: str) -> DataFrame:
    """Rows with a tile t, once for each block i <= j of two tiles that t is one of."""
    spread = df.select("*", F.explode(F.sequence(F.lit(0), F.col(tiles) - 1)).alias("k"))
    return spread.select("*", F.least("t", "k").alias("i"), F.greatest("t", "k").alias("j")).drop("k")


def _verified(candidates: DataFrame, described, t: Fraction, every: bool) -> DataFrame:
    """The candidates that link. Components of candidates are met in blocks: small ones several at a time, large ones by tiles,
    so that a row travels once for each block and not for each pair."""
    near = components(candidates)
    sizes = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tiles"), F.count("*").alias("size"))
    held = 1 + near.count() // BLOCK
    of = F.when(F.col("tiles") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(held)))
    tile = F.pmod(F.xxhash64("c"), "tiles").cast("int")
    nodes = fan_join(near.withColumnRenamed("node", "c"), settle(sizes), "label", "size", "c").select("c", (F.col("tiles") > 1).alias("large"), of.alias("part"), "tiles").withColumn("t", tile)
    nodes = settle(nodes)
    side = small_side(nodes)
    one = side.select(F.col("c").alias("a"), "large", "part", F.col("t").alias("ta"))
    other = side.select(F.col("c").alias("b"), F.col("t").alias("tb"))
    keys = ["large", "part", "i", "j"]
    asked = candidates.join(one, "a").join(other, "b").select("a", "b", "large", "part", F.least("ta", "tb").alias("i"), F.greatest("ta", "tb").alias("j"))
    facing = described(nodes.select("c")).select("c", "m", "grams").join(small_side(settle(_tiled(nodes, "tiles"))), "c").select(*[F.col(k).alias(f"y_{k}") for k in keys], "c", "m", "grams")

    def verify(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        place = pd.Index(rows["c"])
        grams = [np.frombuffer(g, np.int64) for g in rows["grams"]]
        a, b = place.get_indexer(pairs["a"]), place.get_indexer(pairs["b"])
        hit = _overlaps(grams, a, b, t)
        return _result(rows["c"].to_numpy(), rows["m"].to_numpy(), a[hit], b[hit], every)

    return asked.groupBy(*keys).cogroup(facing.groupBy(*[f"y_{k}" for k in keys])).applyInPandas(verify, RESULT)


def jaccard_groups(docs: DataFrame, n: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, th (the text's xxhash64), n_shingles, component_id (the least doc_id that links
    reach), n_links (the other rows it links with, those of equal sets included) and first (whether its doc_id and th are those
    of the group's first row, by doc_id and th, null ids last).

    Words are lower-cased (A-Z) and separated by ASCII white space; a text of
    fewer than n words has its whole sequence as one shingle; texts of any
    length count as a whole. Null, empty and blank texts have no shingles, link
    with nothing, are their own component and first. Rows of equal sets
    (copies, repeated rows) are linked. A null doc_id links like others but is
    no component_id unless all of a component are null. Empty tables give none;
    other columns are ignored.
    """
    rows, many, _, degrees, labels = jaccard_links(docs, n, similarity, every=False)
    # what is said of classes: those that have links or copies; all others are themselves
    known = degrees.join(labels.withColumnRenamed("node", "c"), "c", "full").join(many, "c", "full").withColumn("m", F.coalesce("m", F.lit(1)))
    known = settle(known.select("c", F.coalesce("label", "c").alias("label"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "m"))
    named = fan_join(rows, known, "c", "m", "rid").withColumn("label", F.coalesce("label", "c"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")
    groups = fan_join(rows, known, "c", "m", "rid").where("label is not null").groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    joined = fan_join(named, settle(groups), "label", "size", "rid")
    first = F.col("best").isNull() | F.struct("doc_id", "th").eqNullSafe(F.struct("best.doc_id", "best.th"))
    least = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text"), 4, Fraction(85, 100))
    return groups.select("doc_id", "n_shingles", "component_id", "n_links")
