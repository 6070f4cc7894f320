"""Whole texts to token ids with a tokenizers file, a batch of texts at a time.

The texts of a batch are cut into pieces at places where the tokenizer's splitting rules end a token whatever stands around:
before white space that follows a visible sign, before the last of several white spaces, after a line end or tab, and between
a letter and a mark. Each distinct piece of a batch is looked up once, new ones are given to the library together, and the
ids of all pieces are gathered by their places. Pieces of letters alone go to the library's model directly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docengine.llm.common import frugal

#: Bounds of what a worker remembers: pieces, and bytes of pieces and ids together. Beyond, it starts anew.
KNOWN_PIECES = 500_000
KNOWN_BYTES = 48 << 20
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: Pieces of one call of the library.
CALL_PIECES = 1000

BLANK, VISIBLE, SPACE, LETTER, MARK = 1, 2, 4, 8, 16
#: What a byte is for sure. Bytes above 126 and control characters are nothing for sure.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = VISIBLE
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[32] |= BLANK
_KIND[[*range(65, 91), *range(97, 123)]] |= LETTER
_KIND[list(b".,!?;:%&$#*")] |= MARK

#: The printable characters that stand for bytes in a byte-level vocabulary: the printable bytes themselves, then from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}
LED = chr(BYTE_CHARS[32])
_SPELLING = BYTE_CHARS | {10: 10}


def cuts(data: np.ndarray, ends: np.ndarray, byte_level: bool) -> np.ndarray:
    """Places in data (bytes of texts, each of which ends before its place in ends) where a piece begins.

    Where white space is dropped (not byte_level) anything begins a piece after it. Else a blank belongs to what follows.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = _KIND[data]
    before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    visible_next = np.append(kind[1:] & VISIBLE, 0) > 0
    visible_next[ends[ends > 0] - 1] = False
    space, after_space = (kind & SPACE) > 0, (before & SPACE) > 0
    at = space & (((before & VISIBLE) > 0) | visible_next)
    at |= after_space & ((kind & VISIBLE) > 0) & ((before & BLANK) == 0) if byte_level else after_space & ~space
    # letters of two bytes: 0xC3, then neither the multiplication nor the division sign
    latin = np.zeros(n + 1, bool)
    latin[2:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at |= ((kind & MARK) > 0) & (((before & LETTER) > 0) | latin[:n])
    at[0] = True
    at[ends[ends < n]] = True
    return np.flatnonzero(at)


class Encoder:
    """Texts to ids, for byte-pair vocabularies over bytes; end is the id after each text.

    byte_level: white space is part of the ids; else it only separates words, which are lower-cased. Strings of special
    tokens inside a text are ordinary text, as the description of the tokenizer files has it.
    """

    def __init__(self, path: str, byte_level: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.byte_level, self.end = byte_level, end
        self.forget()

    def forget(self) -> None:
        """Slot 0 is the end id."""
        self.slots: dict[bytes, int] = {}
        self.sizes, self.ids, self.held, self.bytes = np.ones(1, np.int64), np.array([self.end], np.uint32), 1, 0
        self.starts = np.zeros(1, np.int64)

    def _letters(self, words: list[bytes]) -> list[str]:
        """Words of Latin-1 letters, perhaps after a blank, as the model spells them."""
        joined = b"\n".join(words)
        if not self.byte_level:
            joined = joined.decode().lower().encode()
        text = joined.decode("latin-1")
        text = text.replace(" ", LED) if joined.isascii() else text.translate(_SPELLING)  # ASCII letters stand for themselves
        return text.split("\n") if words else []

    def _learn(self, pieces: list[bytes]) -> None:
        data, length = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        begin = np.cumsum(length) - length
        letter = (_KIND[data] & LETTER) > 0
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        wide = np.zeros(len(data), bool)
        wide[latin], wide[latin + 1] = True, True
        letter |= wide
        if self.byte_level:
            letter[begin] |= (data[begin] == 32) & (length > 1)
        plain, ascii_only = np.logical_and.reduceat(letter, begin), ~np.logical_or.reduceat(wide, begin)
        parts = [np.flatnonzero(x) for x in (plain & ascii_only, plain & ~ascii_only, ~plain)]
        tokenize, found = self.tokenizer.model.tokenize, []
        for part in parts[:2]:
            found += [[t.id for t in tokenize(w)] for w in self._letters([pieces[i] for i in part.tolist()])]
        for s in range(0, len(parts[2]), CALL_PIECES):
            others = [pieces[i].decode() for i in parts[2][s : s + CALL_PIECES].tolist()]
            found += [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        order = np.concatenate(parts).tolist()
        self.slots.update(zip([pieces[i] for i in order], range(len(self.sizes), len(self.sizes) + len(order)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        self.bytes += len(data)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and n + 1 places where each begins. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, at, held = texts.buffers()
        bounds = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        if not self.byte_level:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        begin = cuts(data, bounds[1:], self.byte_level)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slots) > KNOWN_PIECES or self.bytes + 4 * len(self.ids) > KNOWN_BYTES:
            self.forget()
        if new := [p for p in distinct if p not in self.slots]:
            self._learn(new)
        known = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        slots = known[pieces.indices.to_numpy(zero_copy_only=False)]
        last = np.searchsorted(begin, bounds[1:])  # pieces before each text's end
        slots = np.insert(slots, last, 0)
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[slots] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends[last + np.arange(len(last))]]).astype(np.int64)


@lru_cache(2)
def encoder(path: str, byte_level: bool, end: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, byte_level, end)


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts, in column at, take about SLICE_BYTES; a longer text has a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // SLICE_BYTES
        bounds = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(bounds, [*bounds[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column of 32-bit ids."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32)))


@frugal
def _crc(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        ids = batch.column(at)
        flat, offsets = np.asarray(ids.flatten()).astype("<u4"), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if i == at else c for i, c in enumerate(batch.columns)], names=names)


def with_crc32(df, ids: str, name: str):
    """df with the list column ids replaced by the unsigned CRC-32 of its little-endian unsigned 32-bit integers."""
    names = [name if c == ids else c for c in df.columns]
    schema = ", ".join(f"`{n}` {'long' if c == ids else t}" for n, (c, t) in zip(names, df.dtypes, strict=True))
    return df.mapInArrow(partial(_crc, at=df.columns.index(ids), names=names), schema)
