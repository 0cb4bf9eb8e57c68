"""The corpus operators against brute force, and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from brindle.llm import chat, jaccard, licenses, media, mixing, neighbours, packing, quality, substrings, token_counts
from brindle.llm.components import components
from brindle.llm.queries import ORACLE_SQL, QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, copies, near copies, repeated rows and ids, a long text, and columns that operators use names of."""
    rng = random.Random(5)
    words = ["the", "of", "And", "über", "mit", "license", "under", "日本", "x1", "tion", "a.b", "ering", "CC", "BY-NC", "naïve"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 160))) for _ in range(12)]
    texts = [None, "", " \t\n ", "one", "two words", "<|endoftext|> x </s>[INST] \\b", "\x1c\x85 odd\xa0spaces", "  Under  the MIT License! under the mit license", "z" * 3000]
    for b in base:
        w = b.split(" ")
        texts += [b, b, " ".join(w[:40] + ["changed"] + w[40:]), b.upper(), "head " * 3 + b + " tail"]
    texts += [" ".join(rng.choices(words, k=9000)), base[0] + " " + base[1]]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1.0, 2, "k", 3) for i, t in enumerate(texts)]
    rows += [rows[9], rows[10], (None, base[2], "en", "s1", 1.0, 2, "k", 3), (None, None, None, None, None, None, None, None), (9, "another text of nine", "en", "s0", 1.0, 2, "k", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n int, kept string, c int").repartition(3)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def bag(items):
    return sorted(items, key=repr)


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = bag((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in rows_of(docs))
    assert bag(map(tuple, token_counts.token_counts(docs, BYTE).collect())) == want


def test_rank_merging_is_the_librarys():
    from tokenizers import Tokenizer

    t, m, rng = Tokenizer.from_file(BYTE), token_counts.RankMerger(BYTE), random.Random(1)
    alphabet = [*"abcde  \n\t'sré日１२٣!?.\x1c\x85 　ßſ̀😀", "'ll", "<|endoftext|>", "the ", "aaaa"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a" * 5000, "ab" * 2000, ""]
    assert m.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    t, w, rng = Tokenizer.from_file(WORD), packing.WordIds(WORD, 500), random.Random(2)
    alphabet = [*"abcde  \n\t'srÉ日１٣!?.,\x1c\x85　ßΣς̀İ", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "The. "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + [""]
    got = [i.tolist() for at in range(0, len(texts), 200) for i in w.encode(texts[at : at + 200])]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def read_gif(data):
    """A decoder of its own, bit by bit and pixel by pixel: the canvases (index of no colour: None) and delays of a GIF."""
    wide, high, flags = data[6] | data[7] << 8, data[8] | data[9] << 8, data[10]
    at, shared, out, control = 13, None, [], (0, 0, None)

    def colours(flags):
        nonlocal at
        n = 2 << (flags & 7)
        made = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
        at += 3 * n
        return made

    def body():
        nonlocal at
        held = b""
        while data[at]:
            held += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        return held

    if flags & 128:
        shared = colours(flags)
    canvas = [None] * (wide * high)
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            b = body()
            if label == 0xF9:
                control = (b[0] >> 2 & 7, b[1] | b[2] << 8, b[3] if b[0] & 1 else None)
            continue
        left, top, w, h = (data[at + i] | data[at + i + 1] << 8 for i in (0, 2, 4, 6))
        local, at = data[at + 8], at + 9
        palette = colours(local) if local & 128 else shared
        bits, at = data[at], at + 1
        stream = body()
        place, width, table, last, pixels = 0, bits + 1, None, None, []
        while True:
            code = sum((stream[(place + i) >> 3] >> ((place + i) & 7) & 1) << i for i in range(width))
            place += width
            if code == 1 << bits:
                table, width, last = [[i] for i in range(1 << bits)] + [None, None], bits + 1, None
                continue
            if code == (1 << bits) + 1:
                break
            entry = table[code] if code < len(table) else last + last[:1]
            pixels += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
        disposal, delay, clear = control
        before = list(canvas)
        for i, p in enumerate(pixels[: w * h]):
            if p != clear:
                canvas[(top + i // w) * wide + left + i % w] = palette[p]
        out.append((list(canvas), delay, (left, top, w, h)))
        for i in range(w * h):
            if disposal == 2:
                canvas[(top + i // w) * wide + left + i % w] = None
        if disposal == 3:
            canvas = before
        control = (0, 0, None)
    return out


def test_gif_round_trip():
    rng = np.random.default_rng(3)
    text = ("The quick brown fox jumps over the lazy dog. " * 400).encode()
    for payload in (bytes(64), rng.integers(0, 256, 64 * 10, dtype=np.uint8).tobytes(), rng.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes(), rng.integers(0, 3, 64 * 200, dtype=np.uint8).tobytes(), text[: 64 * 250], text[: 64 * 32] * 5):
        for rows in (32, 4, 1024):
            gif = media.encode_gif(payload, rows=rows)
            frames, own = list(media.decode_gif(gif)), read_gif(gif)
            assert b"".join(f.block[..., 0].tobytes() for f in frames) == payload
            assert [f.start_ms for f in frames] == [100 * i for i in range(len(frames))] and len(own) == len(frames)
            for f, (canvas, delay, place) in zip(frames, own, strict=True):
                assert (f.delay_ms, (f.left, f.top, f.width, f.height)) == (10 * delay, place)
                assert [tuple(c[:3]) if c[3] else None for c in f.canvas.reshape(-1, 4).tolist()] == canvas
                assert f.histogram().sum() == len(canvas) and f.histogram()[64] == canvas.count(None)
    full = rng.integers(0, 256, 64 * 1024, dtype=np.uint8).tobytes()  # a code table that fills up
    assert next(media.decode_gif(media.encode_gif(full, rows=1024))).block[..., 0].tobytes() == full
    kinds = {gif[i + 3] for gif in (media.encode_gif(b"aabacab " * 8 * 100, rows=4),) for i in range(len(gif) - 4) if gif[i : i + 3] == b"\x21\xf9\x04"}
    assert {4 | 1, 12 | 1, 8 | 1} <= kinds  # transparent pixels occur under each disposal


def test_broken_gifs(spark):
    good = media.encode_gif(b"abcd" * 1000 + bytes(96))
    for n in (0, 5, 12, 300, 800, len(good) - 1):
        with pytest.raises(ValueError):
            list(media.decode_gif(good[:n]))
    df = spark.createDataFrame([(1, 4000, good), (2, 4000, good[:-1]), (3, 0, None), (4, 4, b"nope"), (5, 4000, good)], "doc_id long, n_bytes long, media binary").repartition(1)
    got = {r["doc_id"]: r for r in media.media_digests(df).collect()}
    assert {d: r["payload_bytes"] for d, r in got.items()} == {1: 4096, 2: None, 3: None, 4: None, 5: 4096}
    assert got[1]["payload_sha256"] == got[5]["payload_sha256"] == hashlib.sha256(b"abcd" * 1000 + bytes(96)).hexdigest()
    assert media.media_digests(df.limit(0)).count() == 0 and media.text_media(df.limit(0).withColumn("text", F.lit("x"))).count() == 0


def test_gif_transparency_and_disposal():
    import struct

    def frame(pixels, disposal, clear, left):
        return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, 0, len(pixels), 1, 0) + b"\x02" + media._blocks(media.lzw_compress(bytes(pixels), 2))

    head = b"GIF89a" + struct.pack("<HHBBB", 3, 1, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    gif = head + frame([1, 1, 1], 1, None, 0) + frame([2, 3], 3, 3, 1) + frame([3], 2, None, 0) + frame([2], 0, None, 2) + b"\x3b"
    shown = [f.canvas[0].tolist() for f in media.decode_gif(gif)]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert shown == [[red] * 3, [red, green, red], [blue, red, red], [none, red, green]]
    with pytest.raises(ValueError):
        list(media.decode_gif(b"no"))


def test_media(docs):
    got = media.media_digests(media.text_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()

    def want(d, t):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        return d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    assert bag(map(tuple, got)) == bag(want(*r) for r in rows_of(docs))
    assert media.media_frames(media.text_media(docs)).where("size(histogram) = 65").count() >= docs.count()


def removed(rows, window):
    first = {}
    for d, t in rows:
        w = spaced(t)
        for s in range(len(w) - window + 1 if d is not None else 0):
            k = b" ".join(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = spaced(t)
        gone = set()
        for s in range(len(w) - window + 1 if d is not None else 0):
            if first[b" ".join(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return bag(out)


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substrings(docs, window):
    got = substrings.remove_repeats(docs, window)
    assert bag(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == removed(rows_of(docs), window)


def test_paths_over_stretches(docs, monkeypatch):
    """Paths over many stretches of edges, whose joins take several rounds."""
    monkeypatch.setattr(substrings, "SEGMENT", 2)
    got = substrings.remove_repeats(docs, 5)
    assert bag(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == removed(rows_of(docs), 5)


@pytest.mark.parametrize("window", [50, 5])
def test_runs_twice_in_their_source(spark, window):
    """Runs that stand several times in the first document that has them, with edges that a smaller document has in other runs."""
    w = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(w[:150])), (2, " ".join(["x", *w[20:200], "y", *w[20:200], "z", *w[100:220]])), (3, " ".join(w[90:200])), (4, "q " + "on off " * 40), (5, "r " + "on off " * 300), (6, "on " * 70), (7, "s " + "on " * 400)]
    rows += [(5, "t " + "on off " * 300), (2, " ".join(["v", *w[20:200]]))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window)
    assert bag(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect())) == removed(rows, window)


def test_licenses(docs):
    def want(d, t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
        hits = [(s, label) for label, p in licenses.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.encode().split()]
        at = [h[0] for h in hits]
        return d, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({h[1] for h in hits}))

    got = licenses.license_scan(docs)
    assert bag(map(tuple, got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())) == bag(want(*r) for r in rows_of(docs))


def test_license_passages(spark):
    lines = [(1, "This work is licensed under the GNU General Public License, version 3."), (2, "This fine work is licensed under the GNU General Public License, version 3"), (3, "the work of the public is general")]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.license_scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {1: ("gpl-3", ""), 2: ("gpl-3", ""), 3: ("", "")}


def test_license_near_misses(spark):
    """Notices that differ from a template in the deciding word only, or have a word more before it."""
    gnu, cc = "This work is licensed under the GNU {}General Public License{}.", "This work is licensed under a Creative Commons Attribution{} International License."
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    mozilla = "This Source Code Form is subject to the terms of the Mozilla Public License, v. {}."
    want = [
        (gnu.format("", ", version 3"), "gpl-3"), (gnu.format("", ", version 2"), "gpl-2"), (gnu.format("", " (GPL), version 3"), "gpl-3"), (gnu.format("", ""), "gpl"), (gnu.format("", " v2, of 3 May"), "gpl-2"),
        (gnu.format("Lesser ", ", version 3"), "lgpl-3"), (gnu.format("Lesser ", ", version 2.1"), "lgpl-2"), (gnu.format("Affero ", ", version 3"), "agpl-3"),
        (free.format("", 3), "gpl-3"), (free.format("", 2), "gpl-2"), (free.format("Lesser ", 3), "lgpl-3"),
        (cc.format(" 4.0"), "cc-by"), (cc.format("-ShareAlike 4.0"), "cc-by-sa"), (cc.format("-NonCommercial 4.0"), "cc-by-nc"), (cc.format("-NoDerivatives 4.0"), "cc-by-nd"), (cc.format("-NonCommercial-ShareAlike 4.0"), "cc-by-nc-sa"), (cc.format(" Share Alike 4.0"), "cc-by-sa"),
        (mozilla.format("2.0"), "mpl-2"), (mozilla.format("1.1"), "mpl-1"),
        (cc.format(" 4.0") + " " + cc.format("-ShareAlike 4.0"), "cc-by,cc-by-sa"), ("so " * 9 + gnu.format("", ", version 2") + " and so on " * 9 + gnu.format("", ", version 3"), "gpl-2,gpl-3"),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(want)] == want


def groups(rows, n, t):
    sets = []
    for _, text in rows:
        w = spaced((text or "").encode().translate(LOWER).decode())
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and o >= t * (len(sets[i]) + len(sets[j]) - o):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return bag((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("narrow, block", [(48, 500), (1, 3), (2, 500)])
def test_jaccard(docs, monkeypatch, narrow, block):
    monkeypatch.setattr(jaccard, "NARROW", narrow)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    for n, t in ((4, Fraction(85, 100)), (5, Fraction(4, 5)), (1, Fraction(1, 2))):
        got = jaccard.jaccard_groups(docs, n, t).select("doc_id", "n_shingles", "component_id").collect()
        assert bag(map(tuple, got)) == groups(rows_of(docs), n, t)


@pytest.mark.parametrize("narrow, extra", [(4, 100), (12, 5), (200, 4)])
def test_jaccard_of_a_large_group(spark, monkeypatch, narrow, extra):
    """Copies with some words changed, whose similarities lie on both sides of the bound, through wide columns and blocks, and
    through narrow ones of which a pair has to share several."""
    monkeypatch.setattr(jaccard, "NARROW", narrow)
    monkeypatch.setattr(jaccard, "EXTRA", extra)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(90)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, Fraction(85, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert bag(map(tuple, got)) == groups(rows, 4, Fraction(85, 100))


@pytest.mark.parametrize("few, columns", [(12, 4096), (1, 7), (3, 5)])
def test_jaccard_products(monkeypatch, few, columns):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(-30, 30, rng.integers(1, 40))) for _ in range(20)] + [np.array([99])]
    every = np.array([(i, j) for i in range(21) for j in range(21) if i != j])
    for t in (Fraction(1, 3), Fraction(1, 2), Fraction(9, 10)):
        for pairs in (every, every[::17], every[:1]):
            sets = [(set(rows[i].tolist()), set(rows[j].tolist())) for i, j in pairs]
            assert jaccard._overlaps(rows, pairs[:, 0], pairs[:, 1], t).tolist() == [len(x & y) >= t * len(x | y) for x, y in sets]


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_jaccard_columns_that_texts_share_by_chance(spark, monkeypatch, frequent):
    """What texts share by chance (frequent = 0: short words, no counts) or as passages that come twice in a stretch stays out of prefixes."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "COUNTED", 1)
    rng = np.random.default_rng(8)
    if frequent:
        passages = [" ".join(f"passage{p:02d}x{i:03d}" for i in range(60)) for p in range(20)]
        texts = [" ".join(f"{d:03d}{i:02d}" for i in range(100)) + " " + passages[d % 20] for d in range(300)]
    else:
        texts = [" ".join(f"ownword{d:03d}x{i:02d}" for i in range(60)) + " " + " ".join(rng.choice(list("abcdefghijkl"), 140)) for d in range(300)]
    t, conf = Fraction(85, 100), "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(d, x, d) for d, x in enumerate(texts)], "doc_id long, text string, th long").coalesce(1)
    before = spark.conf.get(conf)
    spark.conf.set(conf, 40)
    try:
        sets = jaccard.settle(jaccard._sets(docs, 4)).withColumnRenamed("rid", "c")
        assert jaccard._columns(jaccard._postings(sets, t, jaccard._frequent(sets)), t).count() < 30
    finally:
        spark.conf.set(conf, before)


def test_near_copies_multiply_no_chance_columns(spark, monkeypatch):
    """The pipeline's stage keeps few pairs on disk where texts share but short words, and drops the copies all the same."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    columns, made = jaccard._columns, []
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    monkeypatch.setattr(jaccard, "_columns", lambda *a: made.append(columns(*a).count()) or columns(*a))
    rng = np.random.default_rng(9)
    texts = [" ".join(f"ownword{d:03d}x{i:02d}" for i in range(60)) + " " + " ".join(rng.choice(list("abcdef"), 140)) for d in range(300)]
    rows = [(d, x, "en", "s", len(x)) for d, x in enumerate([*texts, texts[0], texts[1] + " end"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == list(range(300))
    assert made[0] < 100


@pytest.mark.parametrize("narrow, block", [(48, 500), (4, 16), (2, 7)])
def test_jaccard_links_are_all(spark, monkeypatch, narrow, block):
    """Every link of groups of near copies, and each row's number of links, whatever column or block finds it."""
    monkeypatch.setattr(jaccard, "NARROW", narrow)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for base in ([f"b{i}" for i in range(90)], [f"c{i}" for i in range(50)], [f"b{i}" for i in range(45)] + [f"d{i}" for i in range(45)]):
        for _ in range(30):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, x) for i, x in enumerate((None, "", "two words", "two words"))]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)} - {()} for w in ((x or "").split() for _, x in rows)]

    def linked(a, b):
        return bool(a) and len(a & b) / len(a | b) >= 0.85

    t = Fraction(85, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_groups(df, 4, t).collect()}
    assert got == {i: sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    classes, _, links, _, _ = jaccard.jaccard_links(df, 4, t)
    one = {r["c"]: sets[r["doc_id"]] for r in classes.where("n > 0").collect()}
    want = {(a, b) for a in one for b in one if a < b and linked(one[a], one[b])}
    found = [tuple(r) for r in links.select("a", "b").collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("rows", [3, 1000])
def test_components(spark, rows):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), contract_rows=rows).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat(spark):
    hard = "</s>[INST] ok [/INST]"
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", hard), (2, 0, "user", None), (2, 1, "assistant", "<|im_end|>\n\\b\\\\l <|im_start|>user"), (2, 1, "assistant", ""), (3, 0, None, "x"), (3, None, "ro\nle", "日本"), (4, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "assistant", "only"), (5, 0, "system", "s"), (5, 1, "user", "q"), (5, 2, "assistant", "r"), (5, 3, "tool", "t"), (5, 4, "assistant", "u" * 5000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, segments int")
    got = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_chats(F.col("formatted"))).collect()}
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    for c, rows in by.items():
        want = [(r, t) for _, _, r, t in sorted(rows)]
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == want
        inner = "".join(s["text"] for s in got[c]["segments"] if s["loss"])
        assert all(x not in inner for x in chat.Template().control)
    assert {c: (r["valid"], r["fault_at"]) for c, r in got.items()} == {1: (True, None), 2: (False, 2), 3: (False, 0), 4: (False, 1), None: (False, 0), 5: (True, None)}
    assert chat.format_chats(df.limit(0)).count() == 0


def check_packing(spark, rows, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), WORD, length).collect()
    pieces = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(d, i, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for i, s in enumerate(range(0, len(ids), length))]
    assert bag(tuple(r)[:5] for r in got) == bag(pieces)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    assert len(held) <= max(1, 1.1 * sum(p[3] for p in pieces) / length + 1)


def test_packing(spark, docs):
    rows = rows_of(docs)
    check_packing(spark, rows, 2048)
    check_packing(spark, rows, 100)
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    for most in (60, 700, 2048):
        counts = np.bincount(rng.integers(1, most + 1, 5000), minlength=2049)
        made, check = packing.plan(counts), np.zeros(2049, int)
        for pattern, n in made:
            assert sum(pattern) <= 2048
            np.add.at(check, list(pattern), n)
        assert (check == counts).all()
        if most < 2048:
            assert sum(n for _, n in made) <= 1.01 * (counts * np.arange(2049)).sum() / 2048 + 1


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[10:60] = x[5]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (20, x[20].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    recall = []
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = sorted(range(900), key=lambda i: (-round(s[i], 9), i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], atol=1e-12)
        recall.append(len(set(best) & {f[1] for f in found}) / 20)
    assert np.mean(recall) >= 0.9
    few = neighbours.search(df.where("vec_id < 5"))
    assert few.count() == 4
    assert neighbours.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["rows", "row", "vectors"])
def test_neighbours_of_repeated_ids(spark, kind):
    """Every row twice, the rows of some ids 30 times, or ids with 30 vectors: 20 ids each, as without repeats or nearer."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    near = [int(np.argsort(-(x @ x[q]))[1]) for q in range(0, 400, 20)]
    if kind == "rows":
        more = rows
    elif kind == "row":
        more = [rows[i] for i in near for _ in range(29)]
    else:
        more = [(i, (x[i] * (1 + j / 1000)).tolist()) for i in near if i % 20 for j in range(1, 30)]

    def found(rows):
        out = defaultdict(list)
        for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).orderBy("query_id", "rank").collect():
            out[r["query_id"]].append((r["vec_id"], r["score"]))
        return out

    got = found(rows + more)
    assert sorted(got) == list(range(0, 400, 20))
    vectors = defaultdict(list)
    for i, v in rows + more:
        vectors[i].append(v)
    recall = []
    for q, pairs in got.items():
        best = {i: max(float((np.array(v) * w).sum()) for v in vs for w in vectors[q]) for i, vs in vectors.items() if i != q}
        assert len(pairs) == len({i for i, _ in pairs}) == 20
        assert np.allclose([s for _, s in pairs], [best[i] for i, _ in pairs])
        recall.append(len({i for i, _ in pairs} & set(sorted(best, key=lambda i: (-best[i], i))[:20])) / 20)
    assert np.mean(recall) >= 0.9
    if kind != "vectors":
        assert got == found(rows)
    few = found([(i, x[i].tolist()) for i in range(25)] + [(3, (x[3] * (1 + j / 100)).tolist()) for j in range(60)])
    assert {q: len(pairs) for q, pairs in few.items()} == {0: 20, 20: 20}
    few = found([(i, x[i].tolist()) for i in range(15)] * 2 + [(3, (x[3] * (1 + j / 100)).tolist()) for j in range(60)])
    assert len(few[0]) == 14


def test_mixing_targets():
    got = {s: t for s, _, t, _ in mixing.targets([(None, 100), ("b", 1000), ("a", 10), ("c", 0)])}
    assert got["a"] == 20 and got["c"] == 0 and got[None] == 200 and got["b"] == pytest.approx(1.5 * 1110 - 220)


def test_mixing(docs):
    mixed = mixing.mix_sources(docs).select("source", "doc_id", "mix.*").collect()
    assert len(mixed) == docs.count()
    by = defaultdict(list)
    for r in mixed:
        assert r["taken"] <= 2 * r["size"] and r["copies"] == len(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"]) and sorted(r["positions"]) == r["positions"]
        by[r["source"]].append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
    again = mixing.mix_sources(docs.repartition(5)).select("source", "doc_id", "mix.*").collect()
    assert bag(map(tuple, again)) == bag(map(tuple, mixed))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_of_each_row(spark, docs):
    """Targets, copies and positions of every row, recomputed one by one."""
    rows = [(r["doc_id"], r["source"], len(spaced(r["text"]))) for r in docs.collect()]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, goal = {}, set(names), 1.5 * sum(size.values())
    while left:
        per = goal / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * per > 2 * size[s]}
        for s in full or set(left):
            target[s] = 2.0 * size[s] if full else weight[s] * per
        goal -= sum(target[s] for s in full)
        left -= full or left
    want = []
    for i, s in enumerate(names):
        at, slope = 0, mixing.SLOPES[i % 3]
        for d, n in sorted(((d, n) for d, t, n in rows if t == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[1])):
            whole = int(target[s] // size[s]) if size[s] else 0
            copies = min(2, whole + (at + n / 2 < target[s] - whole * size[s])) if n else 0
            want.append((d, n, size[s], copies * n, [(k * size[s] + at + n / 2) / target[s] for k in range(copies)], slope, target[s]))
            at += n
    got = [(r["doc_id"], *r["mix"]) for r in mixing.mix_sources(docs).select("doc_id", "mix").collect()]
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for (d, n, total, goal, taken, copies, positions), (wd, wn, wtotal, wtaken, shares, slope, wgoal) in zip(sorted(got, key=lambda r: (*order(r), r[6])), sorted(want, key=lambda r: (*order(r), r[4])), strict=True):
        assert (d, n, total, taken, copies) == (wd, wn, wtotal, wtaken, len(shares)) and goal == pytest.approx(wgoal)
        assert [(1 + slope) * t - slope * t * t for t in positions] == pytest.approx(shares, abs=1e-9)


def test_clashing_columns(spark):
    """Extra columns with names that operators use inside stay as they are."""
    names = ["target", "source_size", "slope", "size", "bucket", "place", "begin", "at", "row", "copies", "th", "spans", "__id", "__th", "places", "c", "m", "n", "key", "rid", "grams", "label", "first", "score", "m.x"]
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, t, "s", *range(len(names))) for i, t in enumerate([text, text, None, "a"])], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` long" for n in names]]))
    quoted = [f"`{n}`" for n in names]
    for made in (mixing.mix_sources(df), substrings.remove_repeats(df)):
        assert {tuple(r) for r in made.select(*quoted).collect()} == {tuple(range(len(names)))} and made.count() == 4
    assert bag(map(tuple, jaccard.jaccard_groups(df).select("doc_id", "component_id", "n_links", "first").collect())) == [(0, 0, 1, True), (1, 0, 1, False), (2, 2, 0, True), (3, 3, 0, True)]
    assert token_counts.token_counts(df, BYTE).count() == licenses.license_scan(df).count() == media.media_digests(media.text_media(df)).count() == packing.pack_documents(df, WORD).count() == 4


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    model = quality.fit_quality(none, spark.createDataFrame([], "doc_id long, quality int"))
    for made in (token_counts.token_counts(none, BYTE), substrings.remove_repeats(none), licenses.license_scan(none), jaccard.jaccard_groups(none), mixing.mix_sources(none), quality.quality_scores(none, model), packing.pack_documents(none, WORD)):
        assert made.count() == 0


def test_words_that_polynomials_confuse(spark):
    """A Thue-Morse pattern and its complement, as words and as runs of words, are not the same."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    df = spark.createDataFrame([(1, one), (2, other), (3, " ".join(["q"] * 49 + [one])), (4, " ".join(["q"] * 49 + [other])), (5, " ".join(("a b".split())[b] for b in bits)), (6, " ".join(("a b".split())[1 - b] for b in bits))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(df.where("doc_id <= 2"), 4, Fraction(85, 100)).collect()}
    assert got == {1: 1, 2: 2}
    assert bag(map(tuple, substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect())) == removed(rows_of(df), 50)


def test_mixing_positions_invert_the_schedule(spark):
    df = spark.createDataFrame([(u / 10, s) for u in range(11) for s in (0.5, 0.0, -0.5)], "u double, s double")
    for r in df.select("u", "s", mixing.due(F.col("u"), F.col("s")).alias("t")).collect():
        assert (1 + r["s"]) * r["t"] - r["s"] * r["t"] ** 2 == pytest.approx(r["u"], abs=1e-9)


def test_quality(spark, docs, sf_dir):
    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(d, labels)
    again = quality.fit_quality(d.repartition(3), labels.repartition(2))
    assert model == again
    scored = quality.quality_scores(d, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) >= 0.85
    odd = quality.quality_scores(docs, model)
    assert odd.count() == docs.count() and odd.where("score between 0 and 1 and predicted = if(score >= 0.3, 1, 0)").count() == docs.count()
    assert quality.quality_scores(d, quality.fit_quality(d, labels.limit(0))).where("predicted = 1").count() == d.count()


def test_queries_run(spark, sf_dir):
    for name, query in QUERIES.items():
        assert query(spark, sf_dir).count() > 0, name
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > 0
    assert corpus_pipeline.run(spark, sf_dir).where("offset + length > 2048").count() == 0
