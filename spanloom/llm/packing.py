"""Hierarchical residual packing of token pieces into sequences of a fixed length.

Every input partition packs its own pieces by best fit, longest first, and emits bins that are nearly full.
Underfull bins travel on as items of their fill: rounds of tasks merge them by best fit again, each round over
fewer tasks but none of more than about ``BINS_PER_TASK`` bins, until one task has seen all that is left or a round
merges hardly anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.tokens import encoder
from spanloom.shared import bounded_batches, give_back, sparing, written

NEARLY_FULL = 0.995  #: a bin with this share of its room taken is emitted
BINS_PER_TASK = 100_000  #: underfull bins that one task of a later round merges
FAN_IN = 8  #: a round has at most so many times fewer tasks than the one before
LEAST_MERGED = 0.002  #: the rounds end when one leaves all but this share of its bins

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean, fill int"


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its place there, fill of each bin) by best fit, longest first, ties in the given order.

    The residuals of open bins are bits of one integer, so the tightest bin that takes an item is its lowest set bit.
    """
    bins, places, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    at: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = mask >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            own = at[residual].pop()
            if not at[residual]:
                mask ^= 1 << residual
        else:
            residual, own = room, len(fills)
            fills.append(0)
        bins[i], places[i] = own, fills[own]
        fills[own] += size
        left = residual - size
        if left:
            at[left].append(own)
            mask |= 1 << left
    return bins, places, np.array(fills, np.int64)


def piece_lengths(n_ids: int, length: int) -> list[int]:
    """A document of at most ``length`` ids is one piece; a longer one is cut from its end, so the first may be shorter."""
    first = n_ids % length
    return [first] * (first > 0) + [length] * (n_ids // length)


def local_bins(documents: DataFrame, tokenizer_path: str, end_id: int, length: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, packed partition by partition.

    documents: ``doc_id`` and ``text``; further columns are ignored.  A null text is one piece with the end id alone;
    repeated rows are packed each, a null ``doc_id`` is kept; an empty table has no pieces.
    """
    bounded_batches(documents.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("fill", pa.int32())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, own = encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        kept: list[np.ndarray] = []
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, ids, offsets in encode.encode_batch(batch.column("text")):
                raw = ids.astype("<u4", copy=False).view(np.uint8)
                tail = int(end_id).to_bytes(4, "little")
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    start, total = 0, b - a + 1
                    for number, size in enumerate(piece_lengths(total, length)):
                        stop = start + size
                        crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + stop, b)])
                        if stop == total:
                            crc = zlib.crc32(tail, crc)
                        rows.append((names[first + k], number, start, size, crc))
                        if with_ids:
                            kept.append(np.append(ids[a + start : min(a + stop, b)], [end_id] * (stop == total)).astype(np.int32))
                        start = stop
                del ids, offsets, raw
                give_back()  # else what a slice has freed stays, in pieces, and the next one comes on top
        encode.forget()
        if not rows:
            return
        doc_ids, *numbers = zip(*rows, strict=True)
        piece, start, size, crc = (np.array(x, np.int64) for x in numbers)
        bins, places, fills = best_fit(size, length)
        fill = fills[bins]
        columns = [pa.array(doc_ids, pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc), pa.array(own + bins), pa.array(places), pa.array(fill < NEARLY_FULL * length), pa.array(fill.astype(np.int32))]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
        whole = pa.RecordBatch.from_arrays(columns, schema=schema)
        for at in range(0, len(rows), 20_000):
            yield whole.slice(at, 20_000)

    return documents.select("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sparing(pack), PIECES + ", ids array<int>" * with_ids)


def _merge_round(bins: DataFrame, tasks: int, length: int, number: int) -> DataFrame:
    """One round: (bin, root, shift, fill) of the bins that each task has merged by best fit; each round deals them anew."""
    schema = pa.schema([("bin", pa.int64()), ("root", pa.int64()), ("shift", pa.int64()), ("fill", pa.int32())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        names, fill = table["bin"].to_numpy(), table["fill"].to_numpy()
        by_name = np.argsort(names)  # rows come in any order
        names, fill = names[by_name], fill[by_name]
        into, places, fills = best_fit(fill.astype(np.int64), length)
        root = np.zeros(len(fills), np.int64)
        at_head = places == 0
        root[into[at_head]] = names[at_head]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(root[into]), pa.array(places), pa.array(fills[into].astype(np.int32))], schema=schema)

    return bins.select("bin", "fill").repartition(tasks, F.xxhash64("bin", F.lit(number))).mapInArrow(sparing(merge), "bin long, root long, shift long, fill int")


def merged_bins(spark: SparkSession, open_bins: DataFrame, length: int) -> DataFrame:
    """(bin, root, shift): into which bin each underfull bin has gone, and where in it."""
    current = open_bins.groupBy("bin").agg(F.max("fill").alias("fill"))
    mapping = current.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    waiting = current.count()
    tasks = -(-waiting // BINS_PER_TASK)
    number = 0
    while waiting > 1:
        step, number = written(_merge_round(current, tasks, length, number), "merged-bins"), number + 1
        moved = step.select(F.col("bin").alias("root"), F.col("root").alias("to"), F.col("shift").alias("more"))
        mapping = mapping.join(moved, "root", "left").select("bin", F.coalesce("to", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        mapping = written(mapping, "bin-roots")  # a short plan however many rounds
        current = step.where((F.col("bin") == F.col("root")) & (F.col("fill") < NEARLY_FULL * length)).select("bin", "fill")
        left = current.count()
        if tasks == 1 or waiting - left <= LEAST_MERGED * waiting:
            break
        waiting, tasks = left, max(-(-tasks // FAN_IN), -(-left // BINS_PER_TASK))
    return mapping


def pack(documents: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """All pieces with their sequence and their place in it: gapless from 0 in each sequence.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if wanted.
    """
    placed = written(local_bins(documents, tokenizer_path, end_id, length, with_ids), "packed-pieces")
    kept = [c for c in placed.columns if c not in ("bin", "offset", "open", "fill")]
    closed = placed.where(~F.col("open")).select(*kept, F.col("bin").alias("sequence_id"), "offset")
    under = placed.where("open")
    mapping = merged_bins(documents.sparkSession, under, length)
    moved = under.join(mapping, "bin").select(*kept, F.col("root").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return closed.unionByName(moved)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents and pieces in order of their offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.piece").alias("pieces"), F.col("parts.offset").alias("offsets"))
