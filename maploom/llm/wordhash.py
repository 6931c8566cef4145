"""Vectorised word spans and rolling word hashes over a batch of texts.

Everything here works on plain numpy arrays inside a Spark task.  A batch of
texts becomes one byte buffer, words become (start, end, document) arrays and
each word or run of words becomes one unsigned 64-bit hash.  Hashes are the
same in every process: no Python ``hash()``, no per-process seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text hashed at once; bounds the scratch arrays of a task.
SLICE_BYTES = 2 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def separators(pattern: str) -> np.ndarray:
    """Table of 256 flags: which bytes never belong to a word.

    ``"space"`` is ``[\\x20\\x09-\\x0D]``; ``"alnum"`` keeps digits, ``a-z`` and
    every byte of a non-ASCII character.
    """
    table = np.zeros(256, dtype=bool)
    if pattern == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif pattern == "alnum":
        table[:0x80] = True
        table[0x30:0x3A] = False
        table[0x61:0x7B] = False
    else:
        raise ValueError(f"unknown word pattern {pattern!r}")
    return table


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of one slice, in text order."""

    first_doc: int  # index in the batch of the slice's first text
    n_docs: int
    doc: np.ndarray  # int32, document of each word, relative to first_doc
    start: np.ndarray  # int64 offsets into buf
    end: np.ndarray
    buf: np.ndarray  # uint8

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def slices(texts: list[str | None], pattern: str, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Cut a batch into slices of whole texts of about ``limit`` bytes and find their words.

    A null text has no words.  A text longer than ``limit`` makes a slice of its own.
    """
    sep = separators(pattern)
    at = 0
    while at < len(texts):
        parts, total, begin = [], 0, at
        while at < len(texts) and (not parts or total < limit):
            raw = (texts[at] or "").encode("utf-8", "surrogatepass")
            parts.append(raw)
            total += len(raw) + 1
            at += 1
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        buf = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        inside = ~sep[buf]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)
        doc = np.searchsorted(np.cumsum(sizes), start, side="right").astype(np.int32)
        yield Words(begin, at - begin, doc, start, end, buf)


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """One uint64 per word; a different ``seed`` gives an independent hash."""
    if not len(words.start):
        return np.zeros(0, dtype=np.uint64)
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    base = np.uint64(rng.integers(1, 1 << 62) * 2 + 1)
    first, last = words.start[0], words.end[-1]
    buf = words.buf[first:last]
    starts = words.start - first
    lengths = words.end - words.start
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[starts] = 1
    inside[words.end - first] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    spans = np.diff(starts, append=len(buf))
    offset = np.arange(len(buf), dtype=np.int64) - np.repeat(starts, spans)
    powers = np.full(int(lengths.max()), base, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = table[buf]
    terms[~inside] = 0
    np.minimum(offset, len(powers) - 1, out=offset)
    terms *= powers[offset]
    return mix64(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def window_hashes(words: Words, hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words within one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    base = np.uint64(np.random.default_rng(seed).integers(1, 1 << 62) * 2 + 1)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= base
        out += hashes[j : j + n]
    first = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return first, mix64(out[first])
