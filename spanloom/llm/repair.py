"""Token ids in a binary file format, compressed by Re-Pair grammars with random-access decoding.

Documents are put in ascending ``doc_id`` order, tokenised, and cut into shards.  In each shard frequent
pairs of neighbouring symbols inside a document are replaced by nonterminals, round after round; a shard
stores its rules, the expansion length of each rule, the symbols of each document and where they begin,
so any range of a document's ids decodes without the rest.  Rounds end when no pair is left that is worth a rule,
or when the codes of two-byte symbols are used up (2^20 rules where ids alone take more than two bytes).

Layout of a shard (little-endian): magic ``RPG1``; uint32 documents, rules, symbols, first nonterminal and
bytes a symbol; uint32 left and right symbol and expansion length of each rule; uint32 first symbol of each
document and the end; uint64 first id of each document and the end; the symbols (uint16 or uint32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import encoder, ragged
from spanloom.shared import bounded_batches, lean, written

MAGIC = b"RPG1"
SHARD_IDS = 1 << 20  #: a shard is closed once it holds so many ids; one document is never split
MIN_COUNT = 12  #: a pair must occur so often in a shard to be worth a rule of 12 bytes
_SLOT_BITS = 16  # of the table that finds the pairs to replace
_NONE = np.int32(2**31 - 1)


def _frequent(keys: np.ndarray, most: int) -> np.ndarray:
    """The pairs worth a rule, most frequent first."""
    ordered = np.sort(keys)
    if not len(ordered):
        return ordered
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(begins, len(ordered)))
    frequent = counts >= MIN_COUNT
    pairs, counts = ordered[begins[frequent]], counts[frequent]
    return pairs[np.argsort(-counts, kind="stable")[:most]]


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


def _replaceable(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places ``at``, in order, are replaced: none that overlaps one of better rank, and of a a a every second."""
    beside = np.diff(at) == 1
    again = np.concatenate(([False], beside & (rank[1:] == rank[:-1])))
    begins = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
    rank = np.where((np.arange(len(at)) - begins) % 2 == 1, _NONE, rank)
    left = np.concatenate(([_NONE], np.where(beside, rank[:-1], _NONE)))
    right = np.concatenate((np.where(beside, rank[1:], _NONE), [_NONE]))
    return (rank != _NONE) & (rank < left) & (rank < right)


def compress(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """One shard: ids of documents in a row, ``offsets`` has each document's first id and the end."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    last[ends - 1] = True
    base = int(seq.max()) + 1 if len(seq) else 0
    room = (1 << 16) - base if base < (1 << 16) else (1 << 20)
    rules: list[np.ndarray] = []
    n_rules = 0
    whole, fresh = True, 0
    while len(seq) > 1 and n_rules < room:
        if whole:
            where = np.flatnonzero(~last[:-1])
        else:  # a pair can only have become frequent with a symbol of the round before
            new = seq >= base + fresh
            where = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
        keys = (seq[where].astype(np.uint64) << np.uint64(32)) | seq[where + 1]
        pairs = _frequent(keys, min(room - n_rules, 1 << (_SLOT_BITS - 3)))
        pairs = pairs[np.sort(np.unique(_slot(pairs), return_index=True)[1])]  # one pair a slot; the others wait for the next whole round
        if not len(pairs):
            if whole:
                break
            whole = True
            continue
        held, rank = np.full(1 << _SLOT_BITS, np.uint64(2**64 - 1)), np.full(1 << _SLOT_BITS, _NONE)
        slots = _slot(pairs)
        held[slots], rank[slots] = pairs, np.arange(len(pairs), dtype=np.int32)
        at = _slot(keys)
        met = np.flatnonzero(held[at] == keys)
        ranks = rank[at[met]]
        chosen = _replaceable(where[met], ranks)
        used, which = np.unique(ranks[chosen], return_inverse=True)
        chosen = where[met[chosen]]
        rules.append(pairs[used])
        seq[chosen] = (base + n_rules + which).astype(np.uint32)
        last[chosen] = last[chosen + 1]
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq, last = seq[keep], last[keep]
        whole, fresh, n_rules = False, n_rules, n_rules + len(used)
    pairs = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
    lengths = _expansion_lengths(left, right, base)
    filled = np.diff(offsets) > 0
    per_doc = np.zeros(len(filled), np.int64)
    per_doc[filled] = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    begins = np.concatenate(([0], np.cumsum(per_doc)))
    width = 2 if base + n_rules <= (1 << 16) else 4
    head = struct.pack("<4s5I", MAGIC, len(filled), n_rules, len(seq), base, width)
    parts = (left, right, lengths, begins.astype(np.uint32), offsets.astype(np.uint64), seq.astype(f"<u{width}"))
    return head + b"".join(x.tobytes() for x in parts)


def _expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule only names rules before it."""
    lengths = np.zeros(len(left), np.int64)
    of = lambda s: np.where(s < base, 1, lengths[np.maximum(s.astype(np.int64) - base, 0)])
    while len(left) and not lengths.all():
        a, b = of(left), of(right)
        lengths = np.where((a > 0) & (b > 0), a + b, 0)
    return lengths.astype(np.uint32)


class Shard:
    """A shard read back."""

    def __init__(self, blob: bytes):
        magic, self.n_docs, n_rules, n_symbols, self.base, width = struct.unpack_from("<4s5I", blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<4s5I")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = (take("<u4", n_rules) for _ in range(3))
        self.begins, self.offsets = take("<u4", self.n_docs + 1), take("<u8", self.n_docs + 1)
        self.symbols = take(f"<u{width}", n_symbols)
        self._table = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules in a row, and where each rule's begin; filled in order of rule length."""
        if self._table is None:
            lengths = self.lengths.astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            flat = np.zeros(int(lengths.sum()), np.uint32)
            depth = np.zeros(len(lengths), np.int64)
            sides = [s.astype(np.int64) - self.base for s in (self.left, self.right)]
            while True:
                of = [np.where(s < 0, 0, depth[np.maximum(s, 0)]) for s in sides]
                deeper = np.maximum(*of) + 1
                if (deeper == depth).all():
                    break
                depth = deeper
            for d in range(1, int(depth.max(initial=0)) + 1):
                own = np.flatnonzero(depth == d)
                shift = np.zeros(len(own), np.int64)
                for side, symbol in zip(sides, (self.left, self.right), strict=True):
                    plain = side[own] < 0
                    flat[(starts[own] + shift)[plain]] = symbol[own][plain]
                    rule = np.maximum(side[own], 0)
                    size = np.where(plain, 0, lengths[rule])
                    flat[ragged(starts[own] + shift, size)] = flat[ragged(starts[rule], size)]
                    shift += np.where(plain, 1, size)
            self._table = flat, starts
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._expansions()
        ids = np.arange(self.base, dtype=np.uint32)  # a terminal stands for itself
        rule = symbols.astype(np.int64) - self.base
        terminal = rule < 0
        at = np.where(terminal, symbols, self.base + starts[np.maximum(rule, 0)] if len(starts) else 0).astype(np.int64)
        size = np.where(terminal, 1, self.lengths[np.maximum(rule, 0)] if len(starts) else 1).astype(np.int64)
        return np.concatenate((ids, flat))[ragged(at, size)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of document ``k``: only the symbols that cover them are expanded."""
        symbols = self.symbols[self.begins[k] : self.begins[k + 1]]
        rule = symbols.astype(np.int64) - self.base
        size = np.where(rule < 0, 1, self.lengths[np.maximum(rule, 0)] if len(self.lengths) else 1).astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        start, stop, _ = slice(start, stop).indices(total)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = int(ends[a] - size[a])
        return self.expand(symbols[a:b])[start - skip : stop - skip]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)


SHARDS = "part int, shard int, start_in_part long, n_ids long, doc_ids array<long>, blob binary"


def token_shards(documents: DataFrame, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Shards of the ids of all texts in ascending ``doc_id`` order (null ids first, ties by text).

    documents: ``doc_id`` and ``text``; further columns are ignored.  A null text counts as empty and yields the
    end id alone; repeated rows are kept as they are; an empty table yields no shard.  One row a shard: the
    range partition it belongs to, its number there, the ids before it in that partition, and the blob.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list = []
        done, n_ids, number = 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids, counts = np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])
            blob = compress(ids, np.concatenate(([0], np.cumsum(counts))))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "start_in_part": done, "n_ids": len(ids), "doc_ids": names, "blob": blob}], schema=schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, offsets in encode.encode_batch(batch.column("text")):
                counts = np.diff(offsets) + 1
                ended = np.empty(len(ids) + len(counts), np.uint32)
                at_end = np.cumsum(counts) - 1
                inner = np.ones(len(ended), bool)
                inner[at_end] = False
                ended[at_end], ended[inner] = end_id, ids
                begin, before = 0, 0
                for k in range(len(counts)):
                    if n_ids + int(at_end[k]) + 1 - before >= SHARD_IDS or k == len(counts) - 1:
                        held.append((ended[before : at_end[k] + 1], counts[begin : k + 1]))
                        names += doc_ids[first + begin : first + k + 1]
                        n_ids += int(at_end[k]) + 1 - before
                        begin, before = k + 1, int(at_end[k]) + 1
                        if n_ids >= SHARD_IDS:
                            yield closed()
                            done, number, n_ids, held, names = done + n_ids, number + 1, 0, [], []
        if held:
            yield closed()

    return rows.mapInArrow(lean(shards), SHARDS)


def write_token_shards(documents: DataFrame, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """The shards as a table in the shared folder, read back."""
    return written(token_shards(documents, tokenizer_path, end_id, partitions), "token-shards", codec="none")


def read_documents(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the ids.

    Each range partition's total, a row a partition of the writer, places the partitions one after another.
    """
    from pyspark.sql import Window

    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["blob"])
                ids, offsets = shard.all_ids(), shard.offsets.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + row["start_in_part"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.join(F.broadcast(before), "part").select("doc_ids", "blob", "start_in_part", "before").mapInArrow(lean(decode), out)
