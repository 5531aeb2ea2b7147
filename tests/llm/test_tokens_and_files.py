"""Tokenisation, Re-Pair shards, packing and media against plain versions."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spanloom.llm import jpeg, packing, repair, tokens
from spanloom.llm.tokens import TextEncoder, encoder
from tokenizers import Tokenizer

ODD = ["", None, "  a", "a  b", "a   b c", "a\n b", "a\n\nb ", "a\n\nb", "\n\nb", "\na\n", "a\n\n\nb", "a\n\n", "a ", " a", " ", "\n", "don't you'll we've", "naïve café é", "1234 12a34 ---- foo--bar", "<|endoftext|> hi", "a\x1cb c", "Ünï ÇA ßTest", "$$$ ###", "it's O'Neil 's", "日本語 テスト", "\ta\tb", "ǅ İstanbul", "a　b", "_foo_bar __", "end.\nThe next", "ªº µ", "word''s x'", "Ġab c", "plain words, again. Plain words!"]
ADDED = ["<|endoftext|>", "x <|endoftext|> y", "in<|endoftext|>side", "<|startoftext|> a", "ab<|startoftext|>cd <|ENDOFTEXT|> <|endoftext |>", "  <|endoftext|>\n<|endoftext|><|startoftext|>"]
ODD += ADDED
WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
DOCS = "doc_id long, text string, source string, part string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "s", "clash") for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_the_library(path):
    own, library = encoder(path), Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = ODD * 2 + [s.format(t) for t in added for s in ("{}", "a{}b", "a {} b", "some{0}{0} words")]
    for begin, ids, offsets in own.encode_batch(pa.array(texts)):
        for k in range(len(offsets) - 1):
            text = texts[begin + k]
            assert ids[offsets[k] : offsets[k + 1]].tolist() == (library.encode(text, add_special_tokens=False).ids if text else []), text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ascii_words_are_not_spelled_by_byte(path, monkeypatch):
    """Most new pieces are plain words, whose letters stand for themselves; others keep the byte alphabet."""
    own, library, spelled = TextEncoder(path), Tokenizer.from_file(path), []
    alphabet = tokens._ALPHABET
    monkeypatch.setattr(tokens, "_ALPHABET", type("Alphabet", (), {"__getitem__": lambda _, b: spelled.append(b) or alphabet[b]})())
    for text, odd in (("plain words again plainest", False), ("plain naïve words", True), ("plain words plain", False)):
        spelled.clear()
        ((_, ids, _),) = own.encode_batch(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and bool(spelled) == odd


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_gathered_in_little_room(path):
    """What a step of texts takes on top of its ids and their places stays a small part of an index for every unit and id."""
    own, texts = TextEncoder(path), pa.array(["some plain words, again and again. " * 1000] * 110)
    list(own.encode_batch(texts[:1]))
    tracemalloc.start()
    ((_, ids, offsets),) = own.encode_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 700_000 and len(offsets) == 111 and peak < 40 * len(ids)
    assert own.known or own.fresh
    own.forget()
    assert not own.known and not own.fresh and all(x.tolist() == ids[: offsets[1]].tolist() for _, x, _ in own.encode_batch(texts[:1]))


def test_packing_keeps_no_words(spark):
    """A Python worker that has packed lives on; it holds no words for the stages that follow."""

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [len(encoder(BYTE).known) + len(encoder(BYTE).fresh)]}, schema=pa.schema([("n", pa.int64())]))

    packing.local_bins(documents(spark, ["plain words and more"] * 8).repartition(8), BYTE, 0, 64).collect()
    left = spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()
    assert {r["n"] for r in left} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 400, 40)
    ids = rng.integers(0, (3, 20, 40_000, 70_000, 1, 5)[seed], counts.sum()).astype(np.uint32)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    blob = repair.compress(ids, offsets)
    shard = repair.Shard(blob)
    assert (shard.all_ids() == ids).all() and (shard.offsets == offsets).all()
    for k in range(len(counts)):
        own = ids[offsets[k] : offsets[k + 1]]
        a, b = sorted(rng.integers(0, len(own) + 3, 2))
        assert (shard.document(k, int(a), int(b)) == own[a:b]).all()
    keys = [tuple(p) for k in range(len(counts)) for s in [shard.symbols[shard.begins[k] : shard.begins[k + 1]].tolist()] for p in zip(s, s[1:], strict=False)]
    assert all(keys.count(p) < 2 * repair.MIN_COUNT for p in set(keys) if p[0] != p[1])  # no pair worth a rule is left; a a a counts twice
    if seed < 2:
        assert len(shard.left) and len(blob) < 4 * len(ids)
        assert shard.lengths[0] == 2
    with pytest.raises(ValueError):
        repair.Shard(b"XXXX" + blob[4:])


def test_shards_of_documents(spark, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 50)
    texts = [*ODD, "same words here " * 40, "same words here " * 40]
    rows = documents(spark, texts, [*range(len(texts) - 1, 0, -1), None])
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in repair.read_documents(repair.write_token_shards(rows, WORD, 2, 3)).collect() if r["doc_id"] is not None or r["start"] == 0)
    at, own = 0, Tokenizer.from_file(WORD)
    for (start, doc_id, n, crc, ids), (want_id, text) in zip(got, [(None, texts[-1]), *((len(texts) - 1 - k, texts[k]) for k in range(len(texts) - 2, -1, -1))], strict=True):
        want = [*(own.encode(text, add_special_tokens=False).ids if text else []), 2]
        assert (start, doc_id, n, ids) == (at, want_id, len(want), want)
        assert crc == zlib.crc32(np.array(want, "<u4").tobytes())
        at += n
    assert repair.read_documents(repair.write_token_shards(rows.limit(0), WORD, 2, 3)).count() == 0


def test_best_fit():
    rng = random.Random(2)
    sizes = np.array([rng.randint(1, 100) for _ in range(400)])
    bins, places, fills = packing.best_fit(sizes, 100)
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        ordered = own[np.argsort(places[own])]
        assert places[ordered].tolist() == (np.cumsum(sizes[ordered]) - sizes[ordered]).tolist() and fills[b] == sizes[own].sum() <= 100
    assert len(fills) <= 11 / 9 * -(-sizes.sum() // 100) + 1  # best fit decreasing's guarantee
    assert packing.piece_lengths(5000, 2048) == [904, 2048, 2048] and packing.piece_lengths(4096, 2048) == [2048, 2048] and packing.piece_lengths(1, 2048) == [1]


@pytest.mark.parametrize("settings", [{}, {"BINS_PER_TASK": 3, "FAN_IN": 2}, {"BINS_PER_TASK": 1, "FAN_IN": 3}])
def test_packing(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(packing, name, value)
    texts = [*ODD, *("w " * n for n in (5, 70, 200, 3, 64, 63, 127)), "w " * 70]
    rounds = []
    merge = packing._merge_round
    monkeypatch.setattr(packing, "_merge_round", lambda bins, tasks, *rest: rounds.append((bins.count(), tasks)) or merge(bins, tasks, *rest))
    packed = packing.pack(documents(spark, [*texts, "no id"], [*range(len(texts)), None]).repartition(5), BYTE, 0, 64, with_ids=True)
    rows = packed.collect()
    own = Tokenizer.from_file(BYTE)
    for k, text in enumerate(texts):
        want = [*(own.encode(text, add_special_tokens=False).ids if text else []), 0]
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows if r["doc_id"] == k)
        assert [x for p in pieces for x in p[4]] == want
        assert all(p[2] == 64 for p in pieces[1:]) and all(p[3] == zlib.crc32(np.array(p[4], "<u4").tobytes()) for p in pieces)
    seqs = packing.sequences(packed).collect()
    assert all(len(s["ids"]) <= 64 for s in seqs)
    total = sum(r["length"] for r in rows)
    assert sum(len(s["ids"]) for s in seqs) == total and len(seqs) <= -(-total // 64) + (12 if settings else 3)
    assert all(tasks >= -(-n // packing.BINS_PER_TASK) for n, tasks in rounds) and (not settings or len(rounds) > 1)
    assert [(r["length"], r["piece"]) for r in rows if r["doc_id"] is None] == [(3, 0)]
    for s in seqs:
        own_rows = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s["sequence_id"])
        assert [o for o, _ in own_rows] == [sum(n for _, n in own_rows[:k]) for k in range(len(own_rows))]
    assert packing.pack(documents(spark, []), BYTE, 0).count() == 0


# -- a slow encoder of any coefficients, written apart from the module's ------------------------------------------


class Bits:
    def __init__(self):
        self.s = []

    def put(self, value, n):
        self.s.append(format(value, f"0{n}b") if n else "")

    def bytes(self):
        s = "".join(self.s)
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def progressive(planes, sampling, width, height, restart=0):
    """A progressive image from coefficient blocks: every symbol has an eight- or nine-bit code."""
    spec = bytes([0] * 7 + [255, 1] + [0] * 7 + list(range(256)))
    code = {s: (s, 8) if s < 255 else (510, 9) for s in range(256)}
    seg = lambda m, b: bytes((255, m)) + (len(b) + 2).to_bytes(2, "big") + b
    out = [b"\xff\xd8", seg(0xDB, bytes([0] + [2] * 64)), seg(0xC2, bytes((8,)) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes((len(planes), *(x for k, (h, v) in enumerate(sampling) for x in (k + 1, h << 4 | v, 0))))), seg(0xC4, b"\0" + spec + b"\x10" + spec)]
    if restart:
        out.append(seg(0xDD, restart.to_bytes(2, "big")))
    H, V = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * H)), -(-height // (8 * V))
    mcus = [[(k, my * v + y, mx * h + x) for k, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for my in range(down) for mx in range(across)]
    if len(planes) == 1:
        mcus = [[(0, r, c)] for r in range(-(-height // 8)) for c in range(-(-width // 8))]

    def scan(comps, a, b, hi, lo, units, write):
        parts, bits, state = [], Bits(), {}
        for n, unit in enumerate(units):
            if restart and n and n % restart == 0:
                write(bits, None, state)
                parts += [bits.bytes(), bytes((255, 0xD0 + (n // restart - 1) % 8))]
                bits, state = Bits(), {}
            for block in unit:
                write(bits, block, state)
        write(bits, None, state)
        out.extend([seg(0xDA, bytes((len(comps), *(x for k in comps for x in (k + 1, 0)), a, b, hi << 4 | lo))), *parts, bits.bytes()])

    def dc(bits, block, state):
        if block is None:
            return
        k, r, c = block
        v = int(planes[k][r, c, 0]) >> 1
        n, m = magnitude(v - state.get(k, 0))
        state[k] = v
        bits.put(*code[n])
        bits.put(m, n)

    def dc_fine(bits, block, state):
        if block is not None:
            bits.put(int(planes[block[0]][block[1], block[2], 0]) & 1, 1)

    def flush(bits, state):
        n = state.get("eob", 0)
        if n:
            size = n.bit_length() - 1
            bits.put(*code[size << 4])
            bits.put(n - (1 << size), size)
            for b in state.get("fix", []):
                bits.put(b, 1)
        state["eob"], state["fix"] = 0, []

    def ac(a, b):
        def write(bits, block, state):
            if block is None:
                return flush(bits, state)
            row = [int(abs(x)) >> 1 if x >= 0 else -(int(abs(x)) >> 1) for x in planes[block[0]][block[1], block[2], a : b + 1]]
            last = max((i for i, x in enumerate(row) if x), default=-1)
            run = 0
            if last >= 0:
                flush(bits, state)
            for x in row[: last + 1]:
                if not x:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*code[0xF0])
                    run -= 16
                n, m = magnitude(x)
                bits.put(*code[run << 4 | n])
                bits.put(m, n)
                run = 0
            if last + 1 < len(row):
                state["eob"] = state.get("eob", 0) + 1
                if state["eob"] == 0x7FFF:
                    flush(bits, state)

        return write

    def ac_fine(a, b):
        def write(bits, block, state):
            if block is None:
                return flush(bits, state)
            row = [int(x) for x in planes[block[0]][block[1], block[2], a : b + 1]]
            last = max((i for i, x in enumerate(row) if abs(x) == 1), default=-1)
            run, fix = 0, []
            for i, x in enumerate(row):
                if abs(x) > 1:
                    fix.append(abs(x) & 1)
                elif x == 0 or i > last:
                    if i <= last:
                        if run == 15 and any(abs(y) == 1 for y in row[i:]):
                            flush(bits, state)
                            bits.put(*code[0xF0])
                            for f in fix:
                                bits.put(f, 1)
                            run, fix = 0, []
                        else:
                            run += 1
                else:
                    flush(bits, state)
                    bits.put(*code[run << 4 | 1])
                    bits.put(int(x > 0), 1)
                    for f in fix:
                        bits.put(f, 1)
                    run, fix = 0, []
            if last + 1 < len(row):
                state["eob"] = state.get("eob", 0) + 1
                state.setdefault("fix", []).extend(fix)

        return write

    every = list(range(len(planes)))
    scan(every, 0, 0, 0, 1, mcus, dc)
    for k, (h, v) in enumerate(sampling):
        own = [[(k, r, c)] for r in range(-(-height * v // (8 * V))) for c in range(-(-width * h // (8 * H)))]
        for a, b in ((1, 5), (6, 63)):
            scan([k], a, b, 0, 1, own, ac(a, b))
        scan([k], 1, 63, 1, 0, own, ac_fine(1, 63))
    scan(every, 0, 0, 1, 0, mcus, dc_fine)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1), (1, 1), (1, 1)], 3), ([(3, 1), (2, 1), (1, 1)], 0)])
def test_decoder_reads_any_progressive_image(sampling, restart):
    rng = np.random.default_rng(len(sampling) + restart)
    width, height = 40, 24
    H, V = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for h, v in sampling:
        rows, columns = -(-height // (8 * V)) * v, -(-width // (8 * H)) * h
        block = np.where(rng.random((rows, columns, 64)) < 0.3, rng.integers(-40, 40, (rows, columns, 64)), 0)
        block[:, :, 0] = rng.integers(-200, 200, (rows, columns))
        block[rng.random((rows, columns)) < 0.3, 1:] = 0
        block[-(-height * v // (8 * V)) :, :, 1:] = 0
        block[:, -(-width * h // (8 * H)) :, 1:] = 0
        planes.append(block)
    image = jpeg.Decoder(progressive(planes, sampling, width, height, restart))
    for c, want in zip(image.components, planes, strict=True):
        assert (c.blocks == want).all()
    assert image.rgb().shape == (height, width, 3)


def test_transform_is_a_cosine_transform():
    block = np.zeros(64, np.float32)
    block[0] = 80
    assert np.allclose(block @ jpeg._TO_PIXELS, 10)
    assert np.allclose(jpeg._TO_PIXELS @ jpeg._TO_PIXELS.T, np.eye(64), atol=1e-5)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_payload_round_trip(n):
    rng = np.random.default_rng(n)
    for raw in (rng.integers(0, 256, 576 * n).astype(np.uint8).tobytes(), b"\xff" * 576 * n, b"\xfc\xfd" * 288 * n, bytes(576 * n)):
        assert jpeg.Decoder(jpeg.pack_payload(raw)).payload() == raw
    with pytest.raises(ValueError):
        jpeg.pack_payload(b"x")


def test_media_table(spark):
    texts = ["", None, "abc", "abc", "é😀" * 500, "x" * 576]
    rows = {r["doc_id"]: r for r in jpeg.decode(jpeg.store(documents(spark, texts))).collect()}
    for k, text in enumerate(texts):
        assert bytes(rows[k]["payload"]) == jpeg.padded((text or "").encode()) and len(rows[k]["rgb"]) == rows[k]["height"] * rows[k]["width"] * 3
    assert rows[2]["media"] == rows[3]["media"] and rows[2]["rgb"] == rows[3]["rgb"]
    tensors = {r["doc_id"]: r for r in jpeg.store_tensors(jpeg.decode(jpeg.store(documents(spark, texts)))).collect()}
    assert all(np.frombuffer(tensors[k]["tensor"], np.uint8).reshape(tensors[k]["shape"]).tobytes() == rows[k]["rgb"] for k in rows) and len(tensors) == len(texts)
    long = "é text of many bytes " * 9000
    assert bytes(jpeg.decode(jpeg.store(documents(spark, [long]))).first()["payload"]) == jpeg.padded(long.encode())
    assert jpeg.decode(jpeg.store(documents(spark, []))).count() == 0
    assert jpeg.decode(spark.createDataFrame([(1, None, "p")], "id int, media binary, payload string")).first()["payload"] is None


def test_damaged_media(spark):
    """Cut or damaged media gives null results with an error, and never ends the job."""
    raw, gen = jpeg.pack_payload(jpeg.padded(b"some words " * 200)), np.random.default_rng(3)
    bad = [raw[:300], raw[:-2], b"", b"GIF89a", raw[:2], b"\xff\xd8\xff", b"\xff\xd8\xff\xd9", raw[:20] + raw[40:]]
    spoilt = []
    for _ in range(40):
        own = bytearray(raw)
        for at in gen.integers(2, len(raw), 3):
            own[at] = int(gen.integers(0, 256))
        spoilt.append(bytes(own))
    media = spark.createDataFrame([(k, m) for k, m in enumerate([raw, *bad, *spoilt])], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in jpeg.decode(media).collect()}
    assert len(rows) == 1 + len(bad) + len(spoilt) and rows[0]["error"] is None
    for k in range(1, len(bad) + 1):
        assert rows[k]["error"] and rows[k]["payload"] is None and rows[k]["rgb"] is None, k
    assert all((r["error"] is None) == (r["rgb"] is not None) for r in rows.values())
