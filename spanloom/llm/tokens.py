"""Whole-text tokenisation with public vocabularies, by distinct word.

Both kinds of vocabulary cut a text at white space, and a word from the signs after it, before any merge
happens, so the ids of a text are the ids of its pieces in a row.  A batch of texts is cut with Arrow's
string kernels, its distinct pieces are looked up in a bounded per-process cache, new ones are spelled by
the ``tokenizers`` library's model, and the ids of the batch are gathered in one step.  Pieces other than
plain words and signs, and texts with unusual blanks or marks or a vocabulary's added tokens, go through the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 250_000  #: words met again, and half as many met once, kept by one Python worker; a full half starts anew
SLICE_BYTES = 4 << 20  #: text handled in one step; a longer text is a step of its own
GATHERED = 1 << 16  #: units whose ids are gathered at once, as their indices take several times the room of the ids

_BLANK = "Ġ"  # how byte-level vocabularies spell the blank before a word
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-/:-@\[-`{-~"
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{130}\x{300}-\x{36f}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}Ġ]"
_ODD_KEPT = _ODD + r"|  | \n|\n |\n\n\n|\n\n\z"


def _byte_alphabet() -> list[str]:
    """Byte-level BPE spells each byte as a printable character: itself where printable, else 256 + its rank."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_ALPHABET = _byte_alphabet()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _gathered(flat: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in a row, and where each unit's begin and the last one's end; flat, lengths: ids of the distinct units."""
    starts, offsets = np.cumsum(lengths) - lengths, np.zeros(len(units) + 1, np.int64)
    np.cumsum(lengths[units], out=offsets[1:])
    ids = np.empty(int(offsets[-1]), flat.dtype)
    for at in range(0, len(units), GATHERED):
        own = units[at : at + GATHERED]
        ids[offsets[at] : offsets[at + len(own)]] = flat[ragged(starts[own], lengths[own])]
    return ids, offsets


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


class TextEncoder:
    """ids of whole texts; null and empty texts have none."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_blanks = self.tokenizer.normalizer is None
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = (_ODD_KEPT if self.keeps_blanks else _ODD) + (rf"|(?i:{added})" if added else "")
        self.plain = rf"^(?P<word>{_BLANK if self.keeps_blanks else '_'}?[{_LETTERS}]+)(?P<signs>[{_SIGNS}]*)$".replace("_?", "")
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the words met so far: workers live on, and later stages need the room."""
        self.known, self.fresh = {}, {}

    def whole(self, text: str) -> bytes:
        """One text by the library alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        blank = piece[0] == _BLANK
        bare = piece[1:] if blank else piece
        spelled = bare if bare.isascii() and bare.isalpha() else "".join([_ALPHABET[b] for b in bare.encode()])  # ASCII letters stand for themselves
        return array("I", [t.id for t in self.model.tokenize(_BLANK + spelled if blank else spelled)]).tobytes()

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        known, fresh = self.known, self.fresh
        if len(known) > CACHE_PIECES:
            known.clear()
        if len(fresh) > CACHE_PIECES // 2:
            fresh.clear()
        out = list(map(known.get, pieces))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            piece = pieces[k]
            ids = fresh.get(piece)
            if ids is None:
                ids = fresh[piece] = self._piece(piece)
            else:
                known[piece] = ids
            out[k] = ids
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and for each text the number of its first unit."""
        if self.keeps_blanks:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", " " + _BLANK), "\n", " \n ")
        else:
            texts = pc.replace_substring(pc.utf8_lower(texts), "\n", " ")
        units = pc.split_pattern(texts, " ")
        return units.flatten(), units.offsets.to_numpy(zero_copy_only=False).astype(np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        wholes = {i: np.frombuffer(self.whole(texts[i].as_py()), np.uint32) for i in np.flatnonzero(odd).tolist()}
        if wholes:
            texts = pc.if_else(pa.array(odd), "", texts)
        units, first = self._cut(texts)
        coded = units.dictionary_encode()
        del texts, units  # several times the text's room together
        parts = pc.extract_regex(coded.dictionary, self.plain)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(plain))
        words, signs = (parts.field(k).dictionary_encode() for k in ("word", "signs"))
        others = _strings(coded.dictionary.filter(pa.array(~plain)))
        table = self._looked_up([*_strings(words.dictionary), *(s for s in signs.dictionary.to_pylist() if s)])
        table += [self.whole(x.replace(_BLANK, " ")) if x else b"" for x in others] + [b""]
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table), np.uint32)
        n_words, nothing = len(words.dictionary), len(table) - 1
        at_sign = np.full(len(signs.dictionary) + 1, nothing)
        at_sign[[i for i, s in enumerate(signs.dictionary.to_pylist()) if s]] = n_words + np.arange(nothing - n_words - len(others))
        pieces = np.full((len(plain), 2), nothing)
        pieces[~plain, 0] = nothing - len(others) + np.arange(len(others))
        pieces[plain, 0] = words.indices.to_numpy()
        pieces[plain, 1] = at_sign[signs.indices.to_numpy()]
        flat, lengths = flat[ragged(starts[pieces.ravel()], lengths[pieces.ravel()])], lengths[pieces].sum(1)  # by distinct unit from here
        ids, offsets = _gathered(flat, lengths, coded.indices.to_numpy())
        offsets = offsets[first]
        if not wholes:
            return ids, offsets
        return self._with_wholes(ids, offsets, wholes)

    @staticmethod
    def _with_wholes(ids, offsets, wholes):
        runs, counts, at = [], np.diff(offsets), 0
        for i, own in sorted(wholes.items()):
            runs += [ids[at : offsets[i]], own]
            at, counts[i] = offsets[i], len(own)
        return np.concatenate([*runs, ids[at:]]), np.concatenate(([0], np.cumsum(counts)))

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, offsets of each text's ids) for slices of the batch."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > SLICE_BYTES:
                yield begin, *self._slice(texts[begin:i])
                begin, held = i, 0
            held += n
        if begin < len(texts):
            yield begin, *self._slice(texts[begin:])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder, with its cache, for each vocabulary and Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
