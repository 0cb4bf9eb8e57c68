"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import table
from .textkit import chunks, task

#: The fit uses at most so many labelled rows of each class, half for the dictionary and half for calibration; the dictionaries'
#: size; the compression level; bytes that are compressed at once, so that a dictionary counts as much in a long text as in a short one.
ROWS_PER_CLASS, DICTIONARY_BYTES, LEVEL, BLOCK = 3000, 112_640, 3, 512
THRESHOLD = 0.3


@lru_cache(4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    made = []
    for d in (good, bad):
        held = zstandard.ZstdCompressionDict(d)
        if d:
            held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL))
    return tuple(made)


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration (slope, offset) of what they say of a text."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]

    def differences(self, texts: list[str]) -> np.ndarray:
        """How many bytes more a byte of each text takes with the bad dictionary than with the good one, in blocks of BLOCK bytes."""
        good, bad = (c.compress for c in _compressors(self.good, self.bad))
        out = []
        for text in texts:
            raw = text.encode()
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            out.append((sum(map(len, map(bad, blocks))) - sum(map(len, map(good, blocks)))) / (len(raw) + 20))
        return np.array(out, float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.differences(texts) * self.weights[0] + self.weights[1], -30, 30)))


def _dictionary(samples: list[str]) -> bytes:
    raw = [t.encode() for t in samples if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples to train on
        return b"\n".join(raw)[:DICTIONARY_BYTES]


def _calibrate(x: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, ...]:
    """Logistic regression by Newton's method, its classes weighted to the share of positive labels."""
    scale = np.r_[x[:, :-1].std(0) + 1e-9, 1]
    a, w = x / scale, np.zeros(x.shape[1])
    weight = np.where(y == 1, positive / max((y == 1).mean(), 1e-9), (1 - positive) / max((y == 0).mean(), 1e-9))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-9))
    return tuple((w / scale).tolist())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> QualityModel:
    """Fits on a bounded sample: at most `rows` labelled rows of each class, chosen by a hash of their id, none held out; the driver
    holds their whole texts.

    Null labels, ids and texts and empty texts are not learnt from; repeated
    rows count as often as they stand there; an id with both labels is learnt
    from as both. With one class or none, or empty tables, the score is a
    constant.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    chosen = known.where("quality = 1").orderBy(*order).limit(rows).union(known.where("quality = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    found = texts.join(F.broadcast(chosen), "doc_id")
    sample = [r for q in (0, 1) for r in found.where(F.col("quality") == q).orderBy(*order, "text").limit(rows).collect()]
    parts: dict[int, list[str]] = {}
    for quality in (0, 1):
        parts[quality] = [r["text"] for r in sorted((r for r in sample if r["quality"] == quality), key=lambda r: (r["doc_id"] * 0x9E3779B1 % (1 << 32), r["doc_id"], r["text"]))]
    if not parts[0] or not parts[1]:
        return QualityModel(b"", b"", (0.0, 5.0 if parts[1] or not parts[0] else -5.0))
    half = {q: (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :] or p) for q, p in parts.items()}
    model = QualityModel(_dictionary(half[1][0]), _dictionary(half[0][0]), (0.0, 0.0))
    y = np.r_[np.ones(len(half[1][1])), np.zeros(len(half[0][1]))]
    x = model.differences(half[1][1] + half[0][1])
    weights = _calibrate(np.stack([x, np.ones(len(x))], 1), y, share[1] / (share[0] + share[1]))
    return QualityModel(model.good, model.bad, weights)


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 if score >= threshold).

    Null texts are scored as empty ones, long ones to their end; repeated rows
    get equal scores; an empty table gives none. Columns named score or
    predicted are replaced, others stay as they are.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema

    @task("quality", _compressors.cache_clear)
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = model.scores([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    made = T.StructType([*schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*kept).mapInArrow(score, made)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
