"""License scans by diagonal voting.

Rolling word k-gram hashes of all texts are joined with the places where they
stand in license templates. A template that stands in a text puts its hits on
one diagonal (text place minus template place); diagonals collect votes,
neighbouring ones (a word more or less inside the passage) merge to spans, and
a span counts if enough of its template agrees in a second, independent hash,
the words that tell it from similar licenses are there, and no better passage
overlaps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import table
from .textkit import ALNUM, LOWER, Words, buffers, chunks, runs, task

#: Words of a rolling gram.
GRAM = 3
#: Exact phrases, which count wherever they stand (fixed values).
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Longer passages, which count if COVERAGE of their grams stand on neighbouring diagonals.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
#: Passages that differ from those above in a deciding word, or leave it out. The SQL doesn't have them.
_GNU, _CC = "this work is licensed under the gnu {} license{}", "this work is licensed under a creative commons attribution {} 4 0 international license"
_FREE, _MPL = PASSAGES[3][1], PASSAGES[5][1]
RIVALS = (
    *((label, _GNU.format(kind, f" version {number}" if number else "")) for kind, label in (("general public", "gpl"), ("lesser general public", "lgpl"), ("affero general public", "agpl")) for number, label in (("", label), ("2", f"{label}-2"), ("3", f"{label}-3")) if label != "gpl-3"),
    *((label, _FREE.replace("gnu general", f"gnu {kind}general")) for kind, label in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl")) for label in (label, f"{label}-2", f"{label}-3") if label != "gpl-3"),
    ("mpl", _MPL.removesuffix(" v 2 0")), ("mpl-1", _MPL.replace("v 2 0", "version 1 1")), ("apache", PASSAGES[1][1].replace("version 2 0 ", "")),
    *((label, _CC.format(words)) for label, words in (("cc-by-nc", "noncommercial"), ("cc-by-nd", "noderivatives"), ("cc-by-nc-sa", "noncommercial sharealike"), ("cc-by-nc-nd", "noncommercial noderivatives"))),
)
#: Words that decide between passages, as they stand in texts; numbers count as versions only.
DECIDING = {
    **{k: tuple(f"{w} {k}" for w in ("version", "versions", "v", "license", "gpl", "lgpl", "agpl")) + (f"v{k}", f"gplv{k}", f"lgplv{k}", f"agplv{k}") for k in "123"},
    "lesser": ("lesser", "library general"), "affero": ("affero",), "sa": ("sharealike", "share alike"), "nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "noderivs", "no derivatives", "no derivs"),
}
#: The deciding words that a passage of a label must have and mustn't have; a span reaches AROUND words beyond its grams.
RULES = {
    "gpl": ("", "2 3 lesser affero"), "gpl-2": ("2", "lesser affero"), "gpl-3": ("3", "lesser affero"), "lgpl": ("lesser", "2 3"), "lgpl-2": ("2 lesser", ""), "lgpl-3": ("3 lesser", ""),
    "agpl": ("affero", "2 3"), "agpl-2": ("2 affero", ""), "agpl-3": ("3 affero", ""), "mpl": ("", "1 2"), "mpl-1": ("1", ""), "mpl-2": ("2", ""), "apache": ("", "2"), "apache-2": ("2", ""),
    "cc-by": ("", "sa nc nd"), "cc-by-sa": ("sa", "nc nd"), "cc-by-nc": ("nc", "sa nd"), "cc-by-nd": ("nd", "sa nc"), "cc-by-nc-sa": ("nc sa", "nd"), "cc-by-nc-nd": ("nc nd", "sa"),
}
AROUND = 4
COVERAGE = 0.7
#: Diagonals at most so far apart are one span.
NEAR = 2
SEEDS = (41, 43)


@dataclass(frozen=True)
class TemplateSet:
    """Templates as (label, words, whether exact); the table of their grams is as small as the list."""

    items: tuple[tuple[str, str, bool], ...] = tuple((a, b, True) for a, b in PHRASES) + tuple((a, b, False) for a, b in PASSAGES)
    rivals: tuple[tuple[str, str], ...] = RIVALS

    def grams(self, spark: SparkSession) -> DataFrame:
        rows = []
        for i, (label, text, exact) in enumerate((*self.items, *((*x, False) for x in self.rivals))):
            must, mustnt = (0, 0) if exact else (_mask(x) for x in RULES.get(label, ("", "")))
            data, offsets = buffers(pa.array([text]))
            gram, check = gram_hashes(Words(data, offsets, ALNUM))[2:]
            rows += [(i, label, exact, must, mustnt, len(gram), t, g, c) for t, (g, c) in enumerate(zip(gram.view(np.int64).tolist(), check.view(np.int64).tolist(), strict=True))]
        kinds = {"template": pa.int32(), "label": pa.string(), "exact": pa.bool_(), "must": pa.int32(), "mustnt": pa.int32(), "n_grams": pa.int32(), "at": pa.int32(), "gram": pa.int64(), "check": pa.int64()}
        return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds)))


def gram_hashes(words: Words) -> tuple[np.ndarray, ...]:
    """Row, place in the row, and two hashes of each run of GRAM words."""
    start, row = words.grams(GRAM)
    return (row, start - words.first[row], *(runs(words.hashes(seed), GRAM, seed)[start] for seed in SEEDS))


def _mask(names: str) -> int:
    return sum(1 << list(DECIDING).index(k) for k in names.split())


def deciding_words(words: Words, start: np.ndarray) -> np.ndarray:
    """For each gram, the DECIDING words of its row that stand in it or at most AROUND words from it, as bits."""
    hashes, row = words.hashes(SEEDS[0]), np.repeat(np.arange(len(words.counts)), words.counts)
    forms = [(form.split(), 1 << i) for i, spellings in enumerate(DECIDING.values()) for form in spellings]
    known = sorted({w for form, _ in forms for w in form})
    data, offsets = buffers(pa.array(known))
    of = dict(zip(known, Words(data, offsets, ALNUM).hashes(SEEDS[0]), strict=True))
    near = np.zeros(len(hashes), np.int32)
    at = np.flatnonzero(np.isin(hashes, np.array(list(of.values()))))
    for form, bit in forms:
        first = at[hashes[at] == of[form[0]]]
        if len(form) == 2:
            first = first[first + 1 < len(hashes)]
            first = first[(hashes[first + 1] == of[form[1]]) & (row[first + 1] == row[first])]
        for shift in range(-(GRAM - 1) - AROUND, len(form) + AROUND):
            to = first + shift
            inside = (to >= 0) & (to < len(hashes))
            to, own = to[inside], first[inside]
            near[to[row[to] == row[own]]] |= bit
    return near[start]


def license_spans(docs: DataFrame, templates: TemplateSet = TemplateSet()) -> DataFrame:
    """Rows of two kinds by the key of a row of docs: one head (template null) with doc_id and n_words, and the spans found.

    Spans have label, exact, first and last (the words where the template
    begins by its lowest and highest diagonal), n_places and coverage.
    """

    @task("licenses")
    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = buffers(part.column("text"))
                words = Words(LOWER[data], offsets, ALNUM)
                row, place, gram, check = gram_hashes(words)
                near = deciding_words(words, place + words.first[row])
                key = np.asarray(part.column("key"))
                n, none = len(key), np.zeros(len(row), bool)
                yield pa.record_batch([pa.array(key), part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], HEADS)
                yield pa.record_batch([pa.array(key[row]), pa.nulls(len(none), pa.int64()), pa.nulls(len(none), pa.int64()), pa.array(place.astype(np.int32)), pa.array(near), pa.array(gram.view(np.int64)), pa.array(check.view(np.int64))], HEADS)

    HEADS = ["key", "doc_id", "n_words", "place", "near", "gram", "check"]
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rolled = keyed.mapInArrow(roll, "key long, doc_id long, n_words long, place int, near int, gram long, check long")
    # the template table's size is fixed by the list above, so the texts' grams meet it where they are
    grams = F.broadcast(templates.grams(docs.sparkSession))
    hits = rolled.join(grams, ["gram", "check"], "left").where("place is null or template is not null")
    votes = hits.groupBy("key", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("n_grams").alias("n_grams"), F.collect_set("at").alias("hit"),
        F.first("must").alias("must"), F.first("mustnt").alias("mustnt"), F.bit_or("near").alias("near"),
    )
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("exact") | F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR), 1).otherwise(0)
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by))
    spans = merged.groupBy("key", "template", "span").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.min("diagonal").cast("long").alias("first"), F.max("diagonal").cast("long").alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("hit")))) / F.first("n_grams")).alias("coverage"),
        (F.max("diagonal") + F.first("n_grams") + (GRAM - 1)).cast("long").alias("end"), F.first("must").alias("must"), F.first("mustnt").alias("mustnt"), F.bit_or("near").alias("near"),
    )
    # verification: all of a phrase; COVERAGE of a passage and its deciding words, unless a better one overlaps it
    decided = (F.col("near").bitwiseAND(F.col("must")) == F.col("must")) & (F.col("near").bitwiseAND(F.col("mustnt")) == 0)
    kept = spans.where(F.col("template").isNull() | F.when(F.col("exact"), F.col("coverage") >= 1).otherwise((F.col("coverage") >= COVERAGE) & decided))
    passages = F.collect_list(F.when(~F.col("exact"), F.struct("first", "end", "coverage"))).over(Window.partitionBy("key"))
    beaten = F.exists("passages", lambda x: (x["coverage"] > F.col("coverage")) & (x["first"] < F.col("end")) & (F.col("first") < x["end"]))
    best = kept.withColumn("passages", passages).where(F.col("template").isNull() | F.col("exact") | ~beaten)
    return best.drop("passages", "end", "must", "mustnt", "near")


def license_scan(docs: DataFrame, templates: TemplateSet = TemplateSet()) -> DataFrame:
    """A row per row of docs: n_words, exact phrases' places (n_base, first_word, last_word), labels and score.

    Null and empty texts have no words and no places: labels are empty
    strings, first_word and last_word null and score 0. Repeated rows get
    equal results; an empty table gives none; other columns are ignored.
    """
    spans = license_spans(docs, templates)
    base, found = F.col("exact") & F.col("template").isNotNull(), F.col("template").isNotNull()
    listed = spans.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return listed.drop("key")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))
