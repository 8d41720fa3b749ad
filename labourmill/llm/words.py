"""Words and hashes of many texts at once, in numpy, for use inside tasks.

Texts come as Arrow string arrays. Words are found in their UTF-8 bytes: the six separators are
single bytes that no other character contains. A word has two hashes of 64 bits. Each is the value
of a polynomial, with the word's bytes as coefficients, at a point that the run draws (modulo
2 ** 61 - 1): two different words meet in one for at most ten of all points, whatever the words
are, and no text can be written with a meeting in mind, since the points aren't known to it.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0xD6E8FEB86659FD93)
#: A prime, and the bits of parts of products modulo it.
_PRIME, _LOW29, _LOW32 = U((1 << 61) - 1), U((1 << 29) - 1), U((1 << 32) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word that one step takes, and masks of the first 0 to 7 bytes of a little-endian number.
_BYTES = 7
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(_BYTES + 1)], U)
#: Words of more bytes are hashed one by one, with a keyed BLAKE2.
LONG = 63
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 4_000_000
#: Words that are hashed at once.
PIECE = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass(frozen=True)
class Key:
    """What a run draws: a point and a mask for each of the two hashes, and a key for long words."""

    points: tuple[int, int]
    masks: tuple[int, int]
    long: bytes

    @staticmethod
    def draw() -> Key:
        """A new key; the driver draws it and tasks get it with their code, so a task that runs again has the same."""
        prime = int(_PRIME)
        return Key((2 + secrets.randbelow(prime - 2), 2 + secrets.randbelow(prime - 2)), (secrets.randbits(64), secrets.randbits(64)), secrets.token_bytes(32))


def _times(x: np.ndarray, point: int) -> np.ndarray:
    """x * point modulo the prime, plus the prime at most; x is below 2 ** 62."""
    high, low = U(point >> 32), U(point & 0xFFFFFFFF)
    x1, x0 = x >> U(32), x & _LOW32
    middle = x1 * low + x0 * high
    small = x0 * low
    total = (x1 * high << U(3)) + (middle >> U(29)) + ((middle & _LOW29) << U(32)) + (small >> U(61)) + (small & _PRIME)
    return (total & _PRIME) + (total >> U(61))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: Key) -> np.ndarray:
    """Two hashes (rows) of the bytes data[start:end] of each word: its length, then seven bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    short = np.minimum(size, LONG)
    part = eight[start] & _FIRST[np.minimum(size, _BYTES)]
    out = np.empty((2, len(size)), U)
    for lane, point in zip(out, key.points, strict=True):
        # The first step multiplies a length: a table of few products.
        np.add(np.array([n * point % int(_PRIME) for n in range(LONG + 1)], U)[short], part, out=lane)
    some = np.arange(len(size))
    for at in range(_BYTES, LONG, _BYTES):
        some = some[short[some] > at]
        if not len(some):
            break
        part = eight[start[some] + at] & _FIRST[np.minimum(short[some] - at, _BYTES)]
        for lane, point in zip(out, key.points, strict=True):
            lane[some] = _times(lane[some], point) + part
    for lane, mask in zip(out, key.masks, strict=True):
        lane[:] = (lane & _PRIME) + (lane >> U(61))
        lane -= np.where(lane >= _PRIME, _PRIME, U(0))
        lane[:] = mix(lane ^ U(mask))
    for i in np.flatnonzero(size > LONG).tolist():
        out[:, i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), key=key.long, digest_size=16).digest(), "<u8")
    return out


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values, from runs of powers of two, doubled."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    power, width, done, out = values, 1, 0, None
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else mix(out * _STEP + part)
            done += width
        if done == size:
            return out
        power = mix(power[:-width] * _STEP + power[width:])
        width *= 2


@dataclass
class Words:
    """Words of some texts: text i has the words first[i]:first[i + 1]."""

    data: np.ndarray  #: all texts' bytes
    first: np.ndarray
    start: np.ndarray  #: of each word in data
    end: np.ndarray
    hash: np.ndarray
    other: np.ndarray  #: the second hash of each word

    def __len__(self) -> int:
        return len(self.first) - 1

    def text_of(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def begins(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words of one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.flatnonzero(np.arange(len(self.start)) + size <= last)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words of one text, and their hashes."""
        at = self.begins(size)
        return at, runs(self.hash, size)[at]

    def whole(self, texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Hash of all words of each of some texts, which have some, from the words' hashes; apart from those of windows."""
        n = np.diff(self.first)[texts]
        out = np.zeros(len(texts), U)
        for size in np.unique(n).tolist():
            out[n == size] = mix(runs(hashes, size)[self.first[texts[n == size]]] ^ U(size))
        return out


def split(texts: pa.Array, key: Key, lower: bool = False) -> Words:
    """Words of an Arrow array of texts; nulls are empty. ``lower`` lowers A to Z."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    begin = np.zeros(len(data) + 1, bool)  # a text begins here
    begin[offsets] = True
    before = np.ones(len(data), bool)  # a separator or another text stands before
    before[1:] = space[:-1]
    before |= begin[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after |= begin[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    values = np.empty((2, len(start)), U)
    for i in range(0, len(start), PIECE):
        some = slice(i, i + PIECE)
        a, b = start[i], end[some][-1]
        values[:, some] = _word_hashes(data[a:b], start[some] - a, end[some] - a, key)
    return Words(data, np.searchsorted(start, offsets), start, end, *values)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
