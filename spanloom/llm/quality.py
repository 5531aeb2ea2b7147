"""Quality scores from compressed sizes under zstandard dictionaries of good and of bad text.

A text is cut into blocks; each is compressed with the dictionary built from good texts and with the one
built from bad texts.  The difference of the summed sizes, normalised by the text's length, and the size
itself, which tells repetition, go through a logistic curve fitted on labelled texts that neither
dictionary has seen, which makes the score a probability that a text is good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.shared import bounded_batches, lean, written

ROWS_PER_CLASS = 2000  #: labelled rows of each class that training reads, those with the smallest hash of doc_id
BYTES_PER_CLASS = 16 << 20  #: text of these rows that is read: whole rows in that order, as long as their bytes are no more in all
BLOCK = 2048  #: bytes compressed at once
DICTIONARY = 64 << 10  #: bytes of a dictionary
LEVEL = 3
KEEP_FROM = 0.3  #: a text with this score or more is predicted good


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes:
    """Bytes of a trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.compress = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            if own is not None:
                own.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False).compress)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(normalised size difference, smaller size by length, 1 / sqrt of the length in blocks); zeros for an empty text."""
        raw = (text or "").encode()
        if not raw:
            return 0.0, 0.0, 1.0
        cut = blocks(raw)
        good, bad = (sum(len(f(b)) for b in cut) - 9 * len(cut) for f in self.compress)
        return (bad - good) / len(raw), min(good, bad) / len(raw), 1 / math.sqrt(1 + len(raw) / 256)


def _design(x: np.ndarray) -> np.ndarray:
    """Difference, size and length with their products and hinges: sharp rises at both ends of the size."""
    d, r, s = np.clip(x[:, 0], -0.3, 0.3) * 10, x[:, 1] * 4, x[:, 2]
    hinges = [np.maximum(0, k - r) for k in (0.3, 0.6, 0.9)] + [np.maximum(0, d - k) for k in (-0.6, -0.3, 0.0, 0.3)]
    return np.column_stack([np.ones(len(d)), d, r, s, d * r, d * s, r * s, d * d, r * r, *hinges])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    a, beta = _design(x), np.zeros(_design(x[:1]).shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta)), gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass(frozen=True)
class CompressionClassifier:
    """Both dictionaries and the curve; a few hundred KB whatever the corpus."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def score_batch(self, texts: list[str | None], sizes: Sizes) -> np.ndarray:
        x = np.array([sizes.features(t) for t in texts], float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(self.curve), -30, 30)))


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that training may see: crc32 of the id's digits mod 5 isn't 0. One row an id, the worst label wins."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), 5) != 0")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))


def train(documents: DataFrame, labels: DataFrame) -> CompressionClassifier:
    """Fit on at most ``ROWS_PER_CLASS`` whole labelled rows of each class, of at most ``BYTES_PER_CLASS`` bytes in all.

    One half of the rows builds the dictionaries, the other fits the curve, weighted back to the shares of the
    classes among all learnable labels.  Without rows of one class the score is the share of good labels, 0.5
    without any.
    """
    rows = learnable(labels)
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    picked = None
    for label in (0, 1):
        own = rows.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS)
        picked = own if picked is None else picked.unionByName(own)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text != ''")
    read = texts.join(F.broadcast(picked), "doc_id").withColumn("read", F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text")))
    sample = written(read.where(F.col("read") <= BYTES_PER_CLASS).select("text", "quality", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)) == 0).alias("builds")), "labelled-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"quality": [], "block": []}
            for text, quality in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                own = blocks(text.encode())
                out["quality"] += [quality] * len(own)
                out["block"] += own
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("quality", pa.int32()), ("block", pa.binary())]))

    built = sample.where("builds").mapInArrow(lean(cut), "quality int, block binary").collect()
    ordered = sorted((bytes(r["block"]), r["quality"]) for r in built)
    rng = np.random.default_rng(5)
    rng.shuffle(ordered)
    good, bad = (_dictionary([b for b, q in ordered if q == label]) for label in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            x = np.array([sizes.features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(x[:, k]) for k in range(3))], names=["quality", "d", "r", "s"])

    seen = sample.where("NOT builds").select("text", "quality").mapInArrow(lean(measure), "quality int, d double, r double, s double").collect()
    y = np.array([r["quality"] for r in seen], float)
    flat = [0.0] * len(_design(np.zeros((1, 3)))[0])
    if len(set(y.tolist())) < 2:
        share = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionClassifier(good, bad, (math.log(share / (1 - share)), *flat[1:]))
    x = np.array(sorted((r["d"], r["r"], r["s"], r["quality"]) for r in seen))
    x, y = x[:, :3], x[:, 3]
    weight = np.where(y == 1, n_good / max(1, y.sum()), n_bad / max(1, (1 - y).sum()))
    return CompressionClassifier(good, bad, tuple(_logistic(x, y, weight * len(y) / weight.sum()).tolist()))


def score(documents: DataFrame, model: CompressionClassifier) -> DataFrame:
    """``documents`` with ``quality_score`` (0 to 1) and ``predicted`` (1 from ``KEEP_FROM``); columns of these names are replaced.

    Null and empty texts get the score of a text with neither difference nor size.
    """
    bounded_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in ("quality_score", "predicted")]
    rows = documents.select(*(F.col(f"`{c}`") for c in kept))
    out = T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            p = model.score_batch(batch.column("text").to_pylist(), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= KEEP_FROM).astype(np.int32))], names=[*batch.schema.names, "quality_score", "predicted"])

    return rows.mapInArrow(lean(scored), out)
