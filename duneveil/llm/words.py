"""Vectorised word blocks: the words of many texts as numpy arrays, without a Python loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Words are compared by a 64-bit polynomial
hash of their UTF-8 bytes, taken from one running sum over the block: the base is odd, so it has an inverse
modulo 2**64 and a word's hash does not depend on where in the block it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.empty(size, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        _powers[key] = have if size <= 8 * BLOCK_BYTES else have[: BLOCK_BYTES + 4096]
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Block:
    """Some texts of one batch: rows first..first+n-1 of it."""

    first: int
    n: int
    data: np.ndarray  #: bytes, a space after each text
    text_start: np.ndarray  #: where each text starts in data, and where the last one ends
    start: np.ndarray  #: of each word in data
    end: np.ndarray
    word_doc: np.ndarray  #: the text of each word, 0..n-1
    doc_word: np.ndarray  #: the first word of each text, and the number of words

    def hashes(self, lower: bool = False) -> np.ndarray:
        """The 64-bit hash of each word; lower folds A-Z."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.multiply(data + np.uint64(1), powers(BASE, len(data)), out=total[1:])
            np.cumsum(total, out=total)
            return mix((total[self.end] - total[self.start]) * powers(INVERSE, len(data) + 1)[self.start])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The rolling (Rabin-Karp) hash of each run of `size` hashes: polynomial in BASE, oldest first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if size <= 16:
            for k in range(size):
                out *= BASE
                out += hashes[k : k + n]
        else:
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * powers(INVERSE, len(hashes)), out=total[1:])
            out = (total[size:] - total[:-size]) * powers(BASE, len(hashes) + 1)[size - 1 :][:n]
    return mix(out)


def window_starts(doc_word: np.ndarray, size: int) -> np.ndarray:
    """For each start of a window of `size` words in a block: does it stay inside one text?"""
    total = int(doc_word[-1])
    n = max(total - size + 1, 0)
    ok = np.ones(n, bool)
    for k in doc_word[1:-1]:
        ok[max(int(k) - size + 1, 0) : min(int(k), n)] = False
    return ok


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts of about `most` bytes each, in order; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield _block(raw, offsets[first : last + 1], first)
        first = last
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


def _block(raw: np.ndarray, offsets: np.ndarray, first: int) -> Block:
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text_start = np.zeros(n + 1, np.int64)
    np.cumsum(lengths + 1, out=text_start[1:])
    data = np.full(int(text_start[-1]), 32, np.uint8)
    keep = np.ones(len(data), bool)
    keep[text_start[1:] - 1] = False
    data[keep] = raw[offsets[0] : offsets[-1]]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[0::2], edges[1::2]
    doc_word = np.searchsorted(start, text_start)
    word_doc = np.repeat(np.arange(n), np.diff(doc_word))
    return Block(first, n, data, text_start, start, end, word_doc, doc_word)


def parts(texts: list[str | None], most: int) -> Iterator[list[tuple[int, str, bool]]]:
    """Lists of (row, part, is it the text's last), of about `most` characters each; a part ends before a blank."""
    held, size = [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while at <= len(text):
            stop = len(text)
            if stop - at > most:
                ends = [x for x in (text.find(b, at + most) for b in " \t\n\x0b\x0c\r") if x >= 0]
                stop = min(ends, default=stop)
            held.append((row, text[at:stop], stop == len(text)))
            size += stop - at
            at = stop + 1 if stop == len(text) else stop
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held
