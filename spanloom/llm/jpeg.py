"""Progressive JPEG: scans accumulated into coefficient arrays, pixels as full-resolution RGB tensors.

The decoder takes baseline-sampled or subsampled images of one or three components coded by SOF2: DC and AC
scans, first passes and refinements, restart intervals, runs of end-of-band.  A stretch of a first AC scan or
of a DC scan in which every symbol is the same, and a refinement scan of blocks without zeros, is decoded in
one array step once every code in it has been seen to be that symbol; anything else goes symbol by symbol.

``pack_payload`` stores bytes losslessly: the format's unit is the quantised coefficient, and each byte is one
coefficient of 256 to 511 (DC of every second block negated), spread over 4:2:0 blocks in spectral bands and
two bit planes.  A comment segment keeps the number of payload bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.shared import bounded_batches, lean, written

UNIT = 576  #: payloads are a positive multiple of this many bytes, nine blocks
PAD = 255
_NOTE = b"payload\0"


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient: diagonals of an 8 x 8 block, alternately down and up."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64 matrix from coefficients in zigzag order to the pixels of a block."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


_TO_PIXELS = _inverse_transform()


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    blocks: np.ndarray = field(default=None)  # rows x columns x 64, zigzag order, whole MCUs
    rows: int = 0  # blocks that a scan of this component alone codes
    columns: int = 0


class _Bits:
    """Bits of an entropy-coded segment, most significant first; zeros beyond its end."""

    def __init__(self, data: bytes):
        self.total, self.at, self.data = 8 * len(data), 0, data

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.data, np.uint8))

    def peek(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        chunk = self.data[first:last].ljust(last - first, b"\0")
        return (int.from_bytes(chunk, "big") >> (8 * last - self.at - n)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        return out


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.code: dict[int, tuple[int, int]] = {}
        self.look: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                self.code[symbols[k]] = code, size
                self.look[size, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.sizes = [size for size, n in enumerate(counts, 1) if n]

    def next(self, bits: _Bits) -> int:
        for size in self.sizes:
            symbol = self.look.get((size, bits.peek(size)))
            if symbol is not None:
                bits.at += size
                return symbol
        raise ValueError("broken Huffman code")


@lru_cache(64)
def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(counts, symbols)


@lru_cache(64)
def _coding_order(shapes: tuple[tuple[int, int, int], ...], across: int, down: int) -> np.ndarray:
    """(component of the scan, block) MCU by MCU, for components of (h, v, blocks in a row)."""
    mcu_row, mcu_column = np.divmod(np.arange(across * down), across)
    parts = []
    for k, (h, v, wide) in enumerate(shapes):
        for y in range(v):
            for x in range(h):
                parts.append(np.column_stack([np.full(len(mcu_row), k), (mcu_row * v + y) * wide + mcu_column * h + x]))
    return np.stack(parts, 1).reshape(-1, 2)


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _same_run(bits: _Bits, symbol: int, code: tuple[int, int], most: int) -> np.ndarray | None:
    """Magnitude bits of the longest prefix, at least 16 long, of ``most`` symbols that are all ``symbol``; leaves ``bits`` after it."""
    value, size = code
    extra = symbol & 15
    step = size + extra
    n = min(most, (bits.total - bits.at) // step)
    if n < 16:
        return None
    if step % 8 == 0 and bits.at % 8 == 0 and step <= 16:
        raw = np.frombuffer(bits.data, np.uint8, n * step // 8, bits.at // 8)
        words = raw if step == 8 else raw.view(">u2")
        same = (words >> extra) == value
        run = n if same.all() else int(np.argmin(same))
        out = (words[:run] & ((1 << extra) - 1)).astype(np.int64)
    else:
        table = bits.bits[bits.at : bits.at + n * step].reshape(n, step)
        wanted = np.array([(value >> (size - 1 - k)) & 1 for k in range(size)], np.uint8)
        same = (table[:, :size] == wanted).all(1)
        run = n if same.all() else int(np.argmin(same))
        out = table[:run, size:] @ (1 << np.arange(extra - 1, -1, -1))
    if run < 16:
        return None
    bits.at += run * step
    return out


class Decoder:
    """One progressive image; ``coefficients`` after construction, ``rgb()`` on demand."""

    def __init__(self, raw: bytes):
        self.comments: list[bytes] = []
        self.components: list[Component] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], _Huffman] = {}
        self.restart = self.height = self.width = self.scans = 0
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at + 1 < len(raw):
            marker = raw[at + 1]
            if raw[at] != 0xFF:
                raise ValueError("a marker is missing")
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC2:
                self._frame(body, 8 * len(raw))
            elif marker in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
                raise ValueError("only progressive Huffman-coded images")
            elif marker == 0xC4:
                self._tables(body)
            elif marker == 0xDB:
                self._quantiser(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                end = _AFTER_SCAN.search(raw, at)
                stop = end.start() if end else len(raw)
                self._scan(body, raw[at:stop])
                at = stop
        else:
            raise ValueError("the image ends early")
        if not self.scans:
            raise ValueError("the image has no scan")

    def _frame(self, body: bytes, bits: int) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if n not in (1, 3) or self.components or not self.height or not self.width:
            raise ValueError("one frame of one or three components")
        if -(-self.height // 8) * -(-self.width // 8) > bits:  # a block takes a bit at least
            raise ValueError("the image is too short for its size")
        for k in range(n):
            name, sampling, table = body[6 + 3 * k : 9 + 3 * k]
            self.components.append(Component(name, sampling >> 4, sampling & 15, table))
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.blocks = np.zeros((self.down * c.v, self.across * c.h, 64), np.int32)
            c.columns, c.rows = -(-self.width * c.h // (8 * self.h)), -(-self.height * c.v // (8 * self.v))

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.huffman[body[at] >> 4, body[at] & 15] = _huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _quantiser(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide = body[at] >> 4
            self.quantisers[body[at] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
            at += 65 + 64 * wide

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [next(c for c in self.components if c.name == body[1 + 2 * k]) for k in range(n)]
        tables = [body[2 + 2 * k] for k in range(n)]
        first, last, planes = body[1 + 2 * n : 4 + 2 * n]
        high, low = planes >> 4, planes & 15
        order = self._order(chosen)
        parts = _RESTART.split(data) if self.restart else [data]
        per = self.restart * (len(order) // (self.across * self.down) if n > 1 else 1) if self.restart else len(order)
        self.scans += 1
        flat = [c.blocks.reshape(-1, 64) for c in chosen]
        for k, part in enumerate(parts):
            own = order[k * per : (k + 1) * per]
            bits = _Bits(part.replace(b"\xff\0", b"\xff"))
            if not len(own):
                continue
            if first == 0 and high:
                for which in range(n):
                    mine = own[:, 0] == which
                    flat[which][own[mine, 1], 0] |= bits.bits[: len(own)][mine].astype(np.int32) << low
            elif first == 0:
                self._dc_first(bits, own, flat, [self.huffman[0, t >> 4] for t in tables], low)
            elif high:
                self._ac_refine(bits, own[:, 1], flat[0], self.huffman[1, tables[0] & 15], first, last, low)
            else:
                self._ac_first(bits, own[:, 1], flat[0], self.huffman[1, tables[0] & 15], first, last, low)

    def _order(self, chosen: list[Component]) -> np.ndarray:
        """(component of the scan, block) in coding order: MCU by MCU, or the component's own blocks row by row."""
        if len(chosen) == 1:
            c = chosen[0]
            wide = c.blocks.shape[1]
            own = (np.arange(c.rows)[:, None] * wide + np.arange(c.columns)).ravel()
            return np.column_stack([np.zeros(len(own), np.int64), own])
        return _coding_order(tuple((c.h, c.v, c.blocks.shape[1]) for c in chosen), self.across, self.down)

    @staticmethod
    def _dc_first(bits: _Bits, own: np.ndarray, flat: list, tables: list[_Huffman], low: int) -> None:
        sizes, which = np.zeros(len(own), np.int64), own[:, 0]
        values, at, one_table = np.zeros(len(own), np.int64), 0, all(t is tables[0] for t in tables)
        while at < len(own):
            table = tables[which[at]]
            symbol = table.next(bits)
            values[at], sizes[at] = bits.take(symbol), symbol
            at += 1
            if one_table and symbol and at < len(own) and sizes[max(0, at - 2)] == symbol:
                run = _same_run(bits, symbol, table.code[symbol], len(own) - at)
                if run is not None:
                    values[at : at + len(run)], sizes[at : at + len(run)] = run, symbol
                    at += len(run)
        half = np.where(sizes > 0, 1 << np.maximum(sizes - 1, 0), 0)
        steps = np.where((sizes > 0) & (values < half), values - (1 << sizes) + 1, values)
        for k in range(len(flat)):
            mine = which == k
            flat[k][own[mine, 1], 0] = np.cumsum(steps[mine]).astype(np.int32) << low

    @staticmethod
    def _ac_first(bits: _Bits, own: np.ndarray, blocks: np.ndarray, table: _Huffman, first: int, last: int, low: int) -> None:
        width, total = last - first + 1, (last - first + 1) * len(own)
        out = np.zeros(total, np.int32)
        at = 0  # place among all coefficients of the scan
        while at < total:
            symbol = table.next(bits)
            run, size = symbol >> 4, symbol & 15
            if size:
                at += run
                value = _extend(bits.take(size), size)
                out[at] = value << low if value >= 0 else -(-value << low)
                at += 1
                if not run and at < total:
                    more = _same_run(bits, symbol, table.code[symbol], total - at)
                    if more is not None:
                        values = np.where(more >> (size - 1) != 0, more, more - (1 << size) + 1)
                        out[at : at + len(more)] = values * (1 << low)
                        at += len(more)
            elif run == 15:
                at += 16
            else:
                ended = (1 << run) + bits.take(run)
                at = (at // width + ended) * width
        blocks[own, first : last + 1] = out.reshape(len(own), width)

    @staticmethod
    def _ac_refine(bits: _Bits, own: np.ndarray, blocks: np.ndarray, table: _Huffman, first: int, last: int, low: int) -> None:
        band = blocks[own, first : last + 1]
        width, bit = last - first + 1, 1 << low
        k = ended = 0
        full = (band != 0).all(1)
        end = table.code.get(0)
        if end is not None and full.all():  # every block: end of band, then a bit for each coefficient
            step = end[1] + width
            if bits.total >= step * len(band):
                rows = bits.bits[: step * len(band)].reshape(len(band), step)
                wanted = np.array([(end[0] >> (end[1] - 1 - j)) & 1 for j in range(end[1])], np.uint8)
                if (rows[:, : end[1]] == wanted).all():
                    grown = rows[:, end[1] :].astype(np.int32) * bit
                    blocks[own, first : last + 1] = band + np.where(band > 0, grown, -grown)
                    return
        for k in range(len(own)):
            row = band[k]
            at = 0
            while at < width:
                if ended:
                    break
                symbol = table.next(bits)
                run, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = bit if bits.take(1) else -bit
                elif run < 15:
                    ended = (1 << run) + bits.take(run)
                    break
                while at < width:
                    if row[at]:
                        if bits.take(1):
                            row[at] += bit if row[at] > 0 else -bit
                    elif run == 0:
                        if size:
                            row[at] = value
                        at += 1
                        break
                    else:
                        run -= 1
                    at += 1
            if ended:
                for j in range(at, width):
                    if row[j] and bits.take(1):
                        row[j] += bit if row[j] > 0 else -bit
                ended -= 1
        blocks[own, first : last + 1] = band

    def rgb(self) -> np.ndarray:
        """height x width x 3 pixels: inverse transform, chroma repeated to full resolution, colour turned."""
        planes = []
        for c in self.components:
            scaled = (c.blocks * self.quantisers[c.table]).reshape(-1, 64).astype(np.float32)
            pixels = (scaled @ _TO_PIXELS).reshape(*c.blocks.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, -1)
            pixels = np.clip(np.rint(pixels + 128), 0, 255)
            rows, columns = np.arange(self.height) * c.v // self.v, np.arange(self.width) * c.h // self.h  # any ratio of factors
            planes.append(pixels[rows][:, columns])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that ``pack_payload`` stored."""
        note = next(c for c in self.comments if c.startswith(_NOTE))
        n = int.from_bytes(note[len(_NOTE) :], "big")
        stored = np.concatenate([c.blocks.reshape(-1, 64) for c in self.components])
        return ((np.abs(stored) - 256 - 2) & 255).astype(np.uint8).tobytes()[:n]


_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _huffman_spec(kind: int, number: int, symbols: dict[int, int]) -> bytes:
    """A table of symbol -> code length, shorter codes first."""
    counts = [0] * 16
    for size in symbols.values():
        counts[size - 1] += 1
    return bytes((kind << 4 | number, *counts, *(s for s, _ in sorted(symbols.items(), key=lambda x: x[1]))))


def _scan_head(components: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes((len(components), *(x for c in components for x in c), first, last, high << 4 | low)))


#: Code lengths that make a symbol and its magnitude two bytes: DC sizes 8 and 9, AC size 8, end of band one bit.
_TABLES = _segment(0xC4, _huffman_spec(0, 0, {9: 7, 8: 8}) + _huffman_spec(1, 0, {0: 1, 8: 8}))
_DC9, _DC8, _AC8 = (_Huffman(bytes(s[1:17]), s[17:]).code[k] for s, k in ((_huffman_spec(0, 0, {9: 7, 8: 8}), 9), (_huffman_spec(0, 0, {9: 7, 8: 8}), 8), (_huffman_spec(1, 0, {0: 1, 8: 8}), 8)))
_QUANTISER = _segment(0xDB, bytes([0] + [1] * 64))
_FULL = 0x00


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\0") if b"\xff" in data else data


def _bands(name: int, rows: np.ndarray, bands: list[tuple[int, int]]) -> bytes:
    """First passes of a component's AC bands, then one refinement: each first pass is two bytes a coefficient."""
    half = (rows >> 1).astype(np.uint16)
    out = []
    for a, b in bands:
        words = (half[:, a : b + 1] & 0xFF) | (_AC8[0] << 8)
        out += [_scan_head([(name, _FULL)], a, b, 0, 1), _stuffed(words.astype(">u2").tobytes())]
    return b"".join(out)


def _refinement(name: int, rows: np.ndarray) -> bytes:
    bits = (rows & 1).astype(np.uint8)
    bits[:, 0] = 0  # the code of an end of band, before the bits of the 63 others
    return _scan_head([(name, _FULL)], 1, 63, 1, 0) + _stuffed(np.packbits(bits, axis=1).tobytes())


def padded(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (-len(payload) % UNIT or (0 if payload else UNIT))


def pack_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG with the payload, a positive multiple of ``UNIT`` bytes, in its coefficients."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    needed = -(-len(payload) // 64)
    mcus = -(-needed // 6)
    across = max(1, int(np.ceil(np.sqrt(mcus))))
    down = -(-mcus // across)
    mcus = across * down
    if across > 4095 or down > 4095:
        raise ValueError("the payload is too long for one image")
    raw = np.frombuffer(payload.ljust(mcus * 6 * 64, b"\xff"), np.uint8).astype(np.int32)
    values = (256 + ((raw + 2) & 255)).reshape(-1, 64)
    luma, cb, cr = values[: 4 * mcus].reshape(2 * down, 2 * across, 64), values[4 * mcus : 5 * mcus], values[5 * mcus :]
    by_mcu = luma.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(mcus, 4, 64)
    dc = np.column_stack([by_mcu[:, :, 0], cb[:, 0], cr[:, 0]])
    sign = np.ones((mcus, 6), np.int32)
    sign[:, 1:4:2] = -1
    sign[1::2, 4:] = -1
    dc = dc * sign
    steps = dc >> 1
    steps = np.column_stack([np.diff(steps[:, :4].ravel(), prepend=0).reshape(-1, 4), np.diff(steps[:, 4], prepend=0), np.diff(steps[:, 5], prepend=0)]).ravel()
    size = np.where(np.abs(steps) >= 256, 9, 8)
    magnitude = np.where(steps < 0, steps + (1 << size) - 1, steps)
    words = np.where(size == 9, (_DC9[0] << 9) | magnitude, (_DC8[0] << 8) | magnitude)
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    planes = ((1, luma.reshape(-1, 64)), (2, cb), (3, cr))
    together = [(1, _FULL), (2, _FULL), (3, _FULL)]
    refined = np.packbits((dc & 1).astype(np.uint8).ravel()).tobytes()
    return b"".join(
        (
            b"\xff\xd8", _segment(0xFE, _NOTE + len(payload).to_bytes(8, "big")), _QUANTISER, _segment(0xC2, frame), _TABLES,
            _scan_head(together, 0, 0, 0, 1), _stuffed(words.astype(">u2").tobytes()),
            _bands(1, planes[0][1], [(1, 5), (6, 63)]), _bands(2, cb, [(1, 63)]), _bands(3, cr, [(1, 63)]),
            _scan_head(together, 0, 0, 1, 0), _stuffed(refined),
            *(_refinement(name, rows) for name, rows in planes), b"\xff\xd9",
        )
    )


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes (null: none), padded, as a progressive JPEG.

    documents: ``doc_id`` and ``text``; further columns are ignored, repeated rows are stored each.
    """
    bounded_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 4 << 20):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([pack_payload(padded(x)) for x in raw], pa.binary())], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encode), "doc_id long, n_bytes long, media binary")


def _portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of its last column, one row at least."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def decode(media: DataFrame) -> DataFrame:
    """Images decoded: the other columns, then scans, height, width, rgb (height x width x 3 bytes), payload (null if none was stored) and error.

    media: a binary column ``media``; null media has null results, and media that can't be decoded, be it cut, damaged
    or of another format, has null results and an error that says why.  Columns named like a result are replaced.
    """
    bounded_batches(media.sparkSession)
    results = [("scans", T.IntegerType(), pa.int32()), ("height", T.IntegerType(), pa.int32()), ("width", T.IntegerType(), pa.int32()), ("rgb", T.BinaryType(), pa.binary()), ("payload", T.BinaryType(), pa.binary()), ("error", T.StringType(), pa.string())]
    names = {n for n, _, _ in results}
    rows = media.select(*(F.col(f"`{c}`") for c in media.columns if c not in names and c != "media"), "media")
    out = T.StructType([*rows.schema.fields, *(T.StructField(n, kind) for n, kind, _ in results)])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 4 << 20):
                found = []
                for raw in part.column("media").to_pylist():
                    if raw is None:
                        found.append((None,) * 6)
                        continue
                    try:
                        image = Decoder(raw)
                        stored = any(c.startswith(_NOTE) for c in image.comments)
                        found.append((image.scans, image.height, image.width, image.rgb().tobytes(), image.payload() if stored else None, None))
                    except (ValueError, LookupError, StopIteration, ArithmeticError, struct.error) as problem:
                        found.append((None,) * 5 + (str(problem) or type(problem).__name__,))
                columns = [pa.array([f[k] for f in found], kind) for k, (_, _, kind) in enumerate(results)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(n for n, _, _ in results)])

    return rows.mapInArrow(lean(decoded), out)


def store_tensors(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shape, tensor): the full-resolution pixels of decoded images as a table in the shared folder, rows of images without pixels left out.

    images: what :func:`decode` gives.  A tensor is shape[0] x shape[1] x shape[2] unsigned bytes, row by row.
    """
    rows = images.where("rgb IS NOT NULL").select(key, F.array("height", "width", F.lit(3)).alias("shape"), F.col("rgb").alias("tensor"))
    return written(rows, "tensors")
