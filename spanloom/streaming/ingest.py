"""Incremental ingest: files as a stream, re-ingested documents replace their old chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.chunking import fixed_chunks
from spanloom.operators.dedup import THRESHOLD, exact_duplicates, kept, near_duplicates, with_vectors
from spanloom.shared import discard, written
from spanloom.sources.store import ChunkStore, LexicalStore


def ingest_batch(store: ChunkStore, documents: DataFrame, max_tokens: int, overlap: int, lexical: LexicalStore | None = None, threshold: float | None = THRESHOLD) -> None:
    """Chunk a batch, drop duplicates inside a document, and put it in place of what the store holds of those documents.

    documents: relative_path, text; of several rows of one path the last by ``position`` counts.  Copies go, and chunks
    near a kept one of their document unless ``threshold`` is None.  A lexical store gets the term lists of the same
    documents; its statistics follow when it is next loaded.  Only the buckets of the batch's documents are written, and
    writing the same batch twice leaves the same rows, so a retried batch does no harm.
    """
    newest = documents.groupBy("relative_path").agg(F.max_by("text", "position").alias("text"))
    chunks = written(fixed_chunks(newest, max_tokens, overlap), "batch-chunks")
    near = exact_duplicates(chunks, ["chunk_index"]) if threshold is None else near_duplicates(with_vectors(chunks, ["chunk_index"]), ["chunk_index"], threshold)
    rows = written(kept(chunks, near), "batch-rows")
    store.replace_documents("fixed", newest, rows)
    if lexical is not None:
        lexical.index_documents("fixed", newest, rows)
    discard(chunks, rows)


def stream_ingest(spark: SparkSession, folder: str, store_root: str, checkpoint: str, schema: str, to_documents, max_tokens: int = 512, overlap: int = 64, files_per_trigger: int | None = None, pause: str | None = None, lexical_root: str | None = None, threshold: float | None = THRESHOLD) -> StreamingQuery:
    """Take in what lies in ``folder`` now, batch by batch; a later run takes in what has come since.

    to_documents: DataFrame of the files' rows -> relative_path, text, position.  With ``pause`` (``12 seconds``) the
    query goes on and starts a batch that often.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    store, lexical = ChunkStore(spark, store_root), None if lexical_root is None else LexicalStore(spark, lexical_root)
    rows = to_documents(reader.parquet(folder))
    writer = rows.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch, max_tokens, overlap, lexical, threshold)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=pause) if pause else writer.trigger(availableNow=True)).start()


def windowed_costs(events: DataFrame, minutes: int = 1440, lateness: str = "1 hour") -> DataFrame:
    """Events, total and largest value in tumbling windows: an addition for request logs, for batches and streams alike."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total", "largest")
