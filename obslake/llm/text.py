"""Whole-column text work on UTF-8 bytes, used inside Spark tasks.

Texts arrive as Arrow columns and are handled as one byte buffer with document
offsets, so that splitting and hashing run as array operations.  Work goes over
runs of whole documents of about 256 KB, which bounds temporary memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
#: ASCII white space: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
#: digits, lower-case letters and everything beyond ASCII (after lower-casing)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_M = (1 << 64) - 1
_R, _Q = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95
_R = _R & ~7 | 5
_Q = _Q & ~7 | 5


def _mix_int(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


#: one fixed 64-bit value for each byte, and the same with A-Z as a-z
BYTE = np.array([_mix_int(0x1234567 + 0x9E3779B97F4A7C15 * (b + 1) & _M) for b in range(256)], np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[0x41:0x5B] = BYTE[0x61:0x7B]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Runs [a, b) of whole documents of about `size` bytes (a longer document is a run of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a run of documents: byte ranges, 64-bit hashes, and the n+1 word offsets of the documents."""

    def __init__(self, buf, offsets, kind=WORD, values=BYTE, hashed=True):
        starts, ends, hashes, counts = [], [], [], [np.zeros(1, np.int64)]
        for a, b in chunks(offsets):
            s, e, h, c = _words(buf, offsets[a : b + 1], kind, values, hashed)
            starts.append(s), ends.append(e), hashes.append(h), counts.append(c)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends, self.hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.offsets = np.cumsum(np.concatenate(counts))

    def __len__(self):
        return len(self.starts)

    @property
    def counts(self):
        return np.diff(self.offsets)


def _words(buf, offsets, kind, values, hashed):
    lo, hi = offsets[0], offsets[-1]
    if hi == lo:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    b, at = buf[lo:hi], offsets - lo
    inside = np.zeros(hi - lo + 1, bool)
    np.take(kind, b, out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cut = at[(at > 0) & (at < hi - lo)]
    first[cut] = inside[cut]
    last = inside[:-1] & ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hash(b, s, e, values) if hashed else np.zeros(len(s), np.uint64)
    return s + lo, e + lo, h, np.diff(np.searchsorted(s, at))


def span_hash(b, starts, ends, values=BYTE):
    """Hashes of the byte ranges, equal for equal contents wherever they stand."""
    total = np.zeros(len(b) + 1, np.uint64)
    up, down = powers(_R, len(b) + 1)
    np.cumsum(values[b] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hash(hashes, n, seed=0, at=None):
    """Hash of each n consecutive values (there are max(0, len-n+1)), or of those that start `at` some positions."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    x = hashes if not seed else mix(hashes + np.uint64(seed))
    up, down = powers(_Q, len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    if at is not None:
        return mix((total[at + n] - total[at]) * down[at])
    return mix((total[n:] - total[:-n]) * down[: len(x) - n + 1])


def inside_document(offsets, n):
    """For each position of a document of offsets: whether n values from there lie in the same document."""
    counts = np.diff(offsets)
    left = np.repeat(offsets[1:], counts) - np.arange(offsets[-1])
    return left >= n


def covered(flags, n):
    """Marks every position within n of a flagged start (itself included)."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    low = np.maximum(np.arange(len(flags)) - (n - 1), 0)
    return total[1:] > total[low]
