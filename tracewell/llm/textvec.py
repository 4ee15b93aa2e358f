"""Word hashing over whole Arrow batches with numpy, without a Python object per word.

A word is a maximal run of letters, digits and combining marks of any script, folded to lower case; all else, Unicode
punctuation and symbols included, separates words. Scripts that are written without blanks (Han, kana, bopomofo, Thai,
Lao, Khmer, Myanmar, Tibetan) have a word for each such character.
"""

from __future__ import annotations

import ctypes
import unicodedata

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Code points from here on are ideographs of the supplementary planes, or nothing.
_PLANES = 0x20000
#: Blocks where each letter, digit or mark is a word of its own.
ALONE = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its class (0 separates, 1 is part of a word, 2 is a word), its lower case, and that one's random value."""
    kind, low = np.zeros(_PLANES + 1, np.uint8), np.arange(_PLANES + 1, dtype=np.uint32)
    for cp in range(_PLANES):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LNM":
            kind[cp] = 1
            if len(c.lower()) == 1:
                low[cp] = ord(c.lower())
    for first, last in ALONE:
        kind[first : last + 1] *= 2
    kind[_PLANES] = 2
    value = _rng.integers(1, 2**63, _PLANES + 1, dtype=np.uint64) | np.uint64(1)
    return kind, low, value[low]


_KIND, _LOW, _VALUE = _tables()

#: Bytes hashed at once; bounds the memory of the numpy temporaries.
BLOCK = 1 << 17


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def raw(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes. Offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buffers = arr.buffers()
    if not len(arr) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(arr: pa.Array, most_bytes: int = 1 << 19):
    """Consecutive (start, slice) of the array, each of about ``most_bytes`` at most; one long text is a slice of its own."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    sizes = np.diff(raw(arr)[1])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(arr):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        yield at, arr.slice(at, to - at)
        at = to
    _relax()


def _relax() -> None:
    """Give memory that a batch needed back to the system: idle workers would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points, first byte of each character, or None where every byte is one)."""
    if not (data >= 0x80).any():
        return data, None
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    lead, where = points[wide], at[wide]
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    cp = lead & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
    for k in (1, 2, 3):
        more = size > k
        cp[more] = (cp[more] << 6) | (data[where[more] + k] & 0x3F)
    points[wide] = cp
    return points, at


def _spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte start, byte end) of each word; ``cuts`` are bytes where a text begins."""
    points, at = _points(data)
    n = len(points)
    if at is not None:
        cuts = np.searchsorted(at, cuts)
    cuts = cuts[(cuts > 0) & (cuts < n)]
    known = points if at is None else np.minimum(points, _PLANES)
    kind = np.zeros(n + 2, np.uint8)
    body = kind[1:-1]
    body[:] = _KIND[known]
    inside, alone = body > 0, body == 2
    begins = inside & ((kind[:-2] != 1) | alone)
    begins[cuts] = inside[cuts]
    stops = inside & ((kind[2:] != 1) | alone)
    stops[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    out = np.empty(len(start), np.uint64)
    length = end - start
    total = np.cumsum(length)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, "right")))
        ln = length[lo:hi]
        rel = np.cumsum(ln) - ln
        place = np.arange(int(ln.sum())) - np.repeat(rel, ln)
        char = place + np.repeat(start[lo:hi], ln)
        value = _VALUE[known[char]]
        if at is not None and (far := points[char] >= _PLANES).any():
            value[far] = mix(points[char[far]].astype(np.uint64)) | np.uint64(1)
        out[lo:hi] = np.add.reduceat(value * _PLACE[place & 4095] + (place >> 12).astype(np.uint64), rel) + ln.astype(np.uint64)
        lo = hi
    if at is not None:
        at = np.append(at, len(data))
        start, end = at[start], at[end]
    return mix(out), start, end


def _parts(data: np.ndarray, most: int):
    """Ends of parts of about ``most`` bytes, each where a word can't go on: after an ASCII mark or blank, or before an ideograph."""
    at, look = 0, 1 << 16
    while len(data) - at > most:
        to = at + most
        while to < len(data):
            near = data[to - min(look, most // 2) : to]
            mark = np.flatnonzero(~_ASCII_WORD[near])
            if len(mark):
                at = to - len(near) + int(mark[-1]) + 1
                break
            han = np.flatnonzero((near >= 0xE4) & (near <= 0xE9))
            if len(han):
                at = to - len(near) + int(han[-1])
                break
            to += look
        else:
            break
        yield at
    yield len(data)


_ASCII_WORD = np.ones(256, bool)
_ASCII_WORD[:128] = _KIND[:128] > 0
#: Bytes split into words at once: code points and positions of a very long text aren't held all together.
MOST = 1 << 22


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, byte start and end of each word)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z
    found, lo = [], 0
    for hi in _parts(data, MOST):
        if hi > lo:
            h, start, end = _spans(data[lo:hi], off[(off > lo) & (off < hi)] - lo)
            found.append((h, start + lo, end + lo))
            lo = hi
    h, start, end = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
    return h, np.searchsorted(start, off), start, end


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Running Karp-Rabin hashes of every n words in a row: (hash, whether the n words lie in one text), by first word.

    The window moves on by one word with an addition of the entering and a subtraction of the leaving term,
    here for all windows at once through prefix sums modulo 2**64.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    base = np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * base + h[k : len(h) - n + 1 + k]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(total), text[: len(total)] == text[n - 1 :]
