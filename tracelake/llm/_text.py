"""Numpy kernels over Arrow string columns, shared by the operators of this subpackage.

Spark partitions and shuffles the work; inside a task these functions look at a whole Arrow column as
one byte buffer with offsets, so that no Python object is made per token unless a library needs it.
A null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

#: Word separators: bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = True  # not |, which special tokens hold

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text that one kernel call looks at (one longer text is looked at alone).
CHUNK = 2 << 20

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept while it is not larger than a chunk needs."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= CHUNK + 1:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all their bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, after which a worker gives the memory it no longer needs back to the system: it may be kept, idle, beside
    tasks that need none of Python."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another system's library
            pass

    return whole


def slices(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) that together hold every row, each of at most ``limit`` bytes or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``, or of what other ``gap`` bytes part; words never cross rows."""
    space = gap[buf]
    before = np.ones(len(buf) + 1, dtype=bool)
    before[1:] = space
    before[off[:-1]] = True
    after = np.ones(len(buf) + 1, dtype=bool)
    after[:-1] = space
    after[off] = True
    start = np.flatnonzero(~space & before[:-1])
    end = np.flatnonzero(~space & after[1:]) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each part [start, end) of the buffer, eight bytes at a time over all parts at once."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) * BASE)
    live, at, left = np.arange(len(start)), start, left
    while len(live):
        word = eight[at]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix(h[live] ^ word) * BASE
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return hashes(buf, start, end)


def number(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index at which each distinct value first stands, each value's number in that order)."""
    which = pd.factorize(values)[0]
    if not len(which):
        return np.zeros(0, np.int64), which
    top = np.maximum.accumulate(which)
    return np.flatnonzero(np.concatenate(([True], top[1:] > top[:-1]))), which


class Prefix:
    """Prefix polynomial hashes of a sequence: the hash of any run of it in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(n + 1, _BASE_INVERSE)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(n), out=self.sums[1:])

    @classmethod
    def of_bytes(cls, buf: np.ndarray) -> Prefix:
        return cls(_VALUE[buf])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def pack(**arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed value; arrays whose name ends in _d are kept as differences."""
    parts, head = [], []
    for name, a in arrays.items():
        if name.endswith("_d"):
            a = np.diff(a.astype(np.int64), prepend=0)
            a = a.astype(next(t for t in (np.int16, np.int32, np.int64) if not len(a) or (np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max)))
        head.append(f"{name}:{a.dtype.str}:{len(a)}")
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    top = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"%d;" % len(top) + top + b"".join(parts))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, rest = raw.split(b";", 1)
    at, out = len(raw) - len(rest) + int(size), {}
    for field in rest[: int(size)].decode().split(","):
        name, kind, n = field.split(":")
        dtype, n = np.dtype(kind), int(n)
        a = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n).T
        a = np.ascontiguousarray(a).reshape(-1).view(dtype)
        at += n * dtype.itemsize
        out[name] = np.cumsum(a, dtype=np.int64) if name.endswith("_d") else a
    return out


def pre_chunks(buf: np.ndarray, off: np.ndarray, only_spaces: bool = False) -> np.ndarray:
    """Starts of the units (white space, then other characters) that tokenizers treat one by one.

    A unit starts with each row, at white space that follows another character, and at an ASCII mark (but for |)
    that follows an ASCII letter: no pre-token of the byte-level tokenizers holds either pair. After a byte that may end a multi-byte space no cut is made,
    which only makes a unit longer. only_spaces: cut at 0x20 alone, after anything but 0x20 and U+2581.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(buf), dtype=bool)
    if only_spaces:
        is_space = buf == 0x20
        cut[1:] = is_space[1:] & ~is_space[:-1]
        cut[3:] &= ~((buf[:-3] == 0xE2) & (buf[1:-2] == 0x96) & (buf[2:-1] == 0x81))
    else:
        space = SPACE[buf]
        wide = space | ((buf >= 0x1C) & (buf <= 0x1F))
        cut[1:] = space[1:] & ~wide[:-1]
        cut[2:] &= ~((buf[:-2] == 0xC2) & ((buf[1:-1] == 0x85) | (buf[1:-1] == 0xA0)))
        cut[3:] &= ~((buf[:-3] >= 0xE1) & (buf[:-3] <= 0xE3) & (buf[2:-1] >= 0x80))
        cut[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
    cut[off[:-1][off[:-1] < len(buf)]] = True
    return np.flatnonzero(cut)
