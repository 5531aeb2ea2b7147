"""Exact substring deduplication over windows of words, by super-k-mers.

A window is ``window`` consecutive words of one document.  Its minimiser is the least hash among its runs of
``MER`` words; consecutive windows with one minimiser share most of their words and travel as one packed
string, their words joined by blanks, to the bucket of the minimiser.  Equal windows have equal minimisers, so
a bucket sees every occurrence of its windows: there all windows are sorted by hash and those with equal
hashes compared word for word, which counts them exactly.

A string that one flush of a task holds twice repeats for certain: its places are reported at once and one
copy travels on, so copies of a passage, however many, reach a bucket once a flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import ragged
from spanloom.shared import bounded_batches, give_back, lean

MER = 4  #: words of a minimiser's run
FLUSH_BYTES = 16 << 20  #: packed strings that a task gathers before it sends them to their buckets
FLUSH_PLACES = 50_000  #: places known to repeat that it gathers at most
STEP_BYTES = 1 << 20  #: text hashed at once; a longer document is a step of its own
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_NO_ID = -(1 << 63)
_BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] for each run: differences of one weighted prefix sum, shifted to the run's start."""
    room = 1 << max(16, int(len(values)).bit_length())
    weighted = np.concatenate(([np.uint64(0)], np.cumsum(values * _powers(int(_ODD), room)[: len(values)], dtype=np.uint64)))
    return _mixed((weighted[stops] - weighted[starts]) * _powers(int(_ODD_INVERSE), room)[starts])


class Words:
    """Texts as words joined by single blanks: ``data``, the bytes where words start and stop, and each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        blank = _BLANKS[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets[:-1]] = True
        before = np.concatenate(([True], blank[:-1])) if len(raw) else blank
        keep = ~(blank & (before | first[:-1]))
        kept = np.concatenate(([0], np.cumsum(keep)))
        self.data = np.where(blank, np.uint8(0x20), raw)[keep]
        at_text = kept[offsets]
        space = self.data == 0x20
        begins = np.concatenate(([True], space[:-1])) if len(self.data) else space
        begins[at_text[:-1][at_text[:-1] < len(self.data)]] = True
        begins &= ~space
        ends = np.concatenate((space[1:], [True])) if len(self.data) else space
        inner = at_text[1:-1]
        ends[inner[inner > 0] - 1] = True
        ends &= ~space
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at_text)
        self.hashes = _run_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.stops)


def _super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window's word in the text, windows, minimiser) of each maximal run of windows with one minimiser."""
    counts = np.maximum(0, np.diff(words.first) - window + 1)
    n = len(words.hashes)
    if not counts.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    mers = words.hashes[: n - MER + 1].copy()
    for k in range(1, MER):
        mers = mers * _ODD + words.hashes[k : n - MER + 1 + k]
    least, span, width = _mixed(mers), 1, window - MER + 1
    while span < width:
        more = min(span, width - span)
        least = np.minimum(least[: len(least) - more], least[more:])
        span += more
    at = ragged(words.first[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    value = least[at]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(value)))
    return text[begin], at[begin] - words.first[text[begin]], size, value[begin]


def _steps(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of portions of a batch's texts; null counts as empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + STEP_BYTES, "right")) - 1)
        yield begin, data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin]
        begin = stop


_BLOCKS = "bucket int, strings binary, sizes binary, repeats binary, place binary, n int"
_PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _stored(places: np.ndarray, zip_) -> bytes:
    """Places column by column, with the number of words for the stop: short once compressed."""
    columns = (places["doc"], places["key"], places["start"], places["stop"] - places["start"])
    return zip_(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _places(raw: bytes, n: int) -> np.ndarray:
    columns = np.frombuffer(raw, "<i8").reshape(4, n)
    out = np.empty(n, _PLACE)
    out["doc"], out["key"], out["start"], out["stop"] = columns[0], columns[1], columns[2], columns[2] + columns[3]
    return out


def _packed(documents: DataFrame, window: int, buckets: int) -> DataFrame:
    """Blocks of packed strings for each bucket, and blocks of places known to repeat (no strings)."""
    schema = pa.schema([("bucket", pa.int32()), ("strings", pa.binary()), ("sizes", pa.binary()), ("repeats", pa.binary()), ("place", pa.binary()), ("n", pa.int32())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        held: dict[bytes, int] = {}
        many: list[int] = []
        bucket_of: list[int] = []
        places: list[tuple] = []
        known: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            strings = list(held)
            by_bucket = np.argsort(np.array(bucket_of, np.int64), kind="stable")
            place = np.array(places, _PLACE)
            ordered = np.array(bucket_of, np.int64)[by_bucket]
            cuts = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else []
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(ordered)], strict=True):
                own = by_bucket[a:b]
                mine = [strings[k] for k in own]
                rows.append({"bucket": int(ordered[a]), "strings": zip_(b" ".join(mine)), "sizes": np.array([len(s) for s in mine], "<u4").tobytes(), "repeats": np.array(many, np.uint8)[own].tobytes(), "place": _stored(place[own], zip_), "n": len(own)})
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            for k in range(0, len(known), FLUSH_PLACES):
                sure = np.array(known[k : k + FLUSH_PLACES], _PLACE)
                rows.append({"bucket": int(_mixed(sure["key"].astype(np.uint64))[0] % np.uint64(buckets)), "place": _stored(sure, zip_), "n": len(sure)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            docs, keys = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for begin, raw, offsets in _steps(batch.column("text")):
                words = Words(raw, offsets)
                text, start, windows, value = _super_kmers(words, window)
                first = words.first[text] + start
                lo, hi = words.starts[first].tolist(), words.stops[first + windows + window - 2].tolist()
                data, bucket = words.data.tobytes(), (_mixed(value) % np.uint64(buckets)).tolist()
                row = zip(docs[begin + text].tolist(), keys[begin + text].tolist(), start.tolist(), (start + windows + window - 1).tolist(), strict=True)
                for a, b, target, place in zip(lo, hi, bucket, row, strict=True):
                    string = data[a:b]
                    at = held.setdefault(string, len(many))
                    if at == len(many):
                        many.append(0)
                        bucket_of.append(target)
                        places.append(place)
                        size += b - a
                    else:
                        if not many[at]:
                            many[at] = 1
                            known.append(places[at])
                        known.append(place)
                if size > FLUSH_BYTES or len(known) > FLUSH_PLACES:
                    yield from flush()
                    held, many, bucket_of, places, known, size = {}, [], [], [], [], 0
        if many:
            yield from flush()

    return documents.mapInArrow(lean(pack), _BLOCKS)


def _repeating(strings: list[bytes], repeats: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct packed strings: whether each of their windows occurs again, and the first window of each string.

    Windows are sorted by hash; those with equal hashes are grouped by their very words.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    stops = np.cumsum(sizes)
    words = Words(np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], stops)))
    counts = np.diff(words.first) - window + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    at = ragged(words.first[:-1], counts)
    hashes = _run_hashes(words.hashes, at, at + window)
    again = np.repeat(repeats.astype(bool), counts)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(ordered)))
    data = words.data.tobytes()
    lo, hi = words.starts[at], words.stops[at + window - 1]
    for a, n in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        own = order[a : a + n]
        seen: dict[bytes, list[int]] = {}
        for k, x, y in zip(own.tolist(), lo[own].tolist(), hi[own].tolist(), strict=True):
            seen.setdefault(data[x:y], []).append(k)
        for same in seen.values():
            if len(same) > 1:
                again[same] = True
    return again, first


def _count_bucket(key: tuple, table: pa.Table, window: int, schema: pa.Schema) -> pa.Table:
    """Places of repeating windows of one bucket, as word ranges."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    held: dict[bytes, int] = {}
    many: list[int] = []
    places, owner = [], []
    out = []
    for row in table.select(["strings", "sizes", "repeats", "place", "n"]).to_pylist():
        place = _places(unzip(row["place"]), row["n"])
        if row["strings"] is None:
            out.append(place)
            continue
        sizes, repeats = np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["repeats"], np.uint8)
        data = unzip(row["strings"])
        at = np.cumsum(sizes + 1) - sizes - 1
        own = []
        for a, n, r in zip(at.tolist(), sizes.tolist(), repeats.tolist(), strict=True):
            k = held.setdefault(data[a : a + n], len(many))
            if k == len(many):
                many.append(r)
            else:
                many[k] = 1
            own.append(k)
        once = repeats == 0
        places.append(place[once])
        owner.append(np.array(own, np.int64)[once])
    if held:
        again, first = _repeating(list(held), np.array(many, np.uint8), window)
        edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0) | np.isin(np.arange(len(again) + 1), first) & np.concatenate((again, [False])))
        run_begin = edge[np.concatenate((again, [False]))[edge]]
        run_stop = np.minimum(edge[np.minimum(np.searchsorted(edge, run_begin, "right"), len(edge) - 1)], len(again)) if len(edge) else run_begin
        run_owner = np.searchsorted(first, run_begin, "right") - 1
        per = np.concatenate(([0], np.cumsum(np.bincount(run_owner, minlength=len(held)))))
        place, own = np.concatenate(places), np.concatenate(owner)
        n = per[own + 1] - per[own]
        run = ragged(per[own], n)
        found = np.repeat(place, n)
        base = found["start"] - first[np.repeat(own, n)]
        found["start"], found["stop"] = base + run_begin[run], base + run_stop[run] + window - 1
        out.append(found)
    found = np.concatenate(out) if out else np.zeros(0, _PLACE)
    give_back()
    return pa.table([pa.array(found[c]) for c in ("doc", "key", "start", "stop")], schema=schema)


def repeated_ranges(documents: DataFrame, window: int = 35, buckets: int | None = None) -> DataFrame:
    """(d, k, start, stop): words [start, stop) of the document with this key that repeating windows cover."""
    spark = documents.sparkSession
    bounded_batches(spark)
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    blocks = _packed(keyed(documents).select("d", "k", "text"), window, buckets)
    return blocks.groupBy("bucket").applyInArrow(lambda key, table: _count_bucket(key, table, window, schema), "d long, k long, start long, stop long")


def keyed(documents: DataFrame) -> DataFrame:
    """The documents with a key of two longs, equal only for rows with equal id and text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text", "doc_id").alias("k"))


def remove_repeats(documents: DataFrame, window: int = 35, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """Every document without the words that repeating windows cover: doc_id, n_words, n_removed, kept_sha256 and the kept text.

    documents: ``doc_id`` and ``text``; further columns are ignored.  Words are runs of bytes other than blank and
    tab to carriage return; kept words are joined by single blanks.  A null text has no words; a repeated row counts
    as another document, so all its windows repeat; an empty table gives none.
    """
    ranges = repeated_ranges(documents, window, buckets).groupBy("d", "k").agg(F.array_distinct(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
    rows = keyed(documents).join(ranges, ["d", "k"], "left").select("doc_id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.stop").alias("stops"))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    schema = pa.schema(fields)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "stops")), strict=True):
                words = (text or "").encode().split()
                n, left, at = len(words), words, 0
                if starts:
                    left = []
                    for a, b in sorted(zip(starts, stops, strict=True)):
                        if a > at:
                            left += words[at:a]
                        at = max(at, b)
                    left += words[at:]
                joined = b" ".join(left)
                for column, value in zip(out, (doc_id, n, n - len(left), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], schema=schema)

    return rows.mapInArrow(lean(kept), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
