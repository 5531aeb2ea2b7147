"""Near-duplicate chunks: exact copies by digest, then a greedy pass over vectors in corpus order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.functions.vectors import hashed_terms
from spanloom.shared import bounded_batches, lean

THRESHOLD = 0.95
SCOPES = ("document", "corpus")


def _bucket(scope: str, document: str):
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    return F.col(document) if scope == "document" else F.lit("")


def exact_duplicates(chunks: DataFrame, order: list[str], scope: str = "document", document: str = "relative_path") -> DataFrame:
    """(chunk_id, duplicate_of): rows whose text's digest came before in their bucket. The first in order is kept.

    Aggregates to the first row of each digest before anything is joined, so a text with many copies costs a row.
    """
    rows = chunks.select("chunk_id", _bucket(scope, document).alias("bucket"), F.sha1("text").alias("digest"), F.struct(*order).alias("place"))
    first = rows.groupBy("bucket", "digest").agg(F.min(F.struct("place", "chunk_id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(first, ["bucket", "digest"])
    return joined.where(F.col("place") > F.col("first.place")).select("chunk_id", F.col("first.chunk_id").alias("duplicate_of"))


def with_vectors(chunks: DataFrame, order: list[str], dimension: int = 64, document: str = "relative_path") -> DataFrame:
    """Chunks with terms as :func:`near_duplicates` takes them: vector and digest are made where the text lies, without a join."""
    key = F.struct("chunk_id", document, *(c for c in order if c not in ("chunk_id", document)), F.sha1("text").alias("digest"))
    return hashed_terms(chunks.select(key.alias("key"), "text"), "key", dimension).select("key.*", "vector")


def near_duplicates(chunks: DataFrame, order: list[str], threshold: float = THRESHOLD, document: str = "relative_path") -> DataFrame:
    """(chunk_id, duplicate_of, similarity, exact) of one bucket a document, greedily in order.

    A chunk is removed if its digest or a cosine of ``threshold`` or more ties it to a chunk that was *kept*; one that
    only resembles a removed chunk stays.  chunks: chunk_id, ``document``, text or its digest, vector (unit length).
    Documents are sorted into a task one after the other; it holds the kept chunks of one at a time.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")

    kind = chunks.schema["chunk_id"].dataType
    out = T.StructType([T.StructField("chunk_id", kind), T.StructField("duplicate_of", kind), T.StructField("similarity", T.DoubleType()), T.StructField("exact", T.BooleanType())])

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0  # the kept chunks of the bucket so far
        first: dict[str, object] = {}
        held: list = []
        sides = np.zeros((0, 0))
        for batch in batches:
            found: list[tuple] = []
            ids, buckets, same = (batch.column(c).to_pylist() for c in range(3))
            matrix = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for k in range(batch.num_rows):
                if k == 0 and sides.shape[1] != matrix.shape[1]:
                    sides = np.zeros((16, matrix.shape[1]))
                if not at or buckets[k] != bucket:
                    bucket, at, first, held = buckets[k], 0, {}, []
                if same[k] in first:
                    found.append((ids[k], first[same[k]], 1.0, True))
                    continue
                if at:
                    cosines = sides[:at] @ matrix[k]
                    best = int(cosines.argmax())
                    if cosines[best] >= threshold:
                        found.append((ids[k], held[best], float(cosines[best]), False))
                        continue
                if at == len(sides):
                    sides = np.concatenate([sides, np.zeros_like(sides)])
                sides[at], first[same[k]] = matrix[k], ids[k]
                held.append(ids[k])
                at += 1
            columns = zip(*found, strict=True) if found else ((),) * 4
            schema = to_arrow_schema(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    bounded_batches(chunks.sparkSession)
    digest = F.col("digest") if "digest" in chunks.columns else F.sha1("text")
    rows = chunks.select("chunk_id", F.col(document).alias("_bucket"), digest.alias("digest"), "vector", F.struct(*order).alias("_place"))
    placed = rows.repartition("_bucket").sortWithinPartitions("_bucket", "_place")
    return placed.select("chunk_id", "_bucket", "digest", "vector").mapInArrow(lean(greedy), out)


def kept(chunks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The chunks that no duplicate row names; ids stay as they are."""
    return chunks.join(duplicates.select("chunk_id"), "chunk_id", "left_anti")


def summary(chunks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: examined, exact, near, kept, share removed."""
    found = duplicates.agg(F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("near"))
    rows = chunks.agg(F.count("*").alias("examined")).crossJoin(found)  # one row by one row
    removed = F.col("exact") + F.col("near")
    return rows.select("examined", "exact", "near", (F.col("examined") - removed).alias("kept"), F.round(F.coalesce(removed / F.nullif("examined", F.lit(0)), F.lit(0.0)), 6).alias("share"))
