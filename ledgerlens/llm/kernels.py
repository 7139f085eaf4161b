"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

Texts are never turned into Python strings here: a batch is one byte array
plus offsets, and everything below is a handful of vectorised passes over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_byte = np.arange(256)
#: A word byte is a digit, an ASCII letter or any byte of a non-ASCII character.
IS_WORD = (_byte >= 0x80) | ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A))
#: Lower-cases A-Z and nothing else.
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n, CHUNK) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty row."""
    column = column.cast(pa.large_utf8()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each, and one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of consecutive rows, and where each row's words begin.

    ``at`` has absolute offsets into ``raw``. Memory is about 40 bytes per
    byte of text for the length of the call.
    """
    base = int(at[0])
    buf = LOWER[raw[base : int(at[-1])]]
    rel = at - base
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    is_word = IS_WORD[buf]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    inner = rel[(rel > 0) & (rel < n)]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[buf] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, rel).astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words of one text; a shorter, non-empty text is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i : len(words) - k + 1 + i]
    return mix(out + np.uint64(k))


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit code for each character of consecutive rows, and where each row's characters begin.

    The code packs the character's UTF-8 bytes, so equal codes are equal characters.
    """
    base = int(at[0])
    buf = raw[base : int(at[-1])]
    rel = at - base
    if not len(buf):
        return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
    if buf.max() < 0x80:
        return buf.astype(np.uint32), rel
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    code, goes_on = padded[lead].astype(np.uint32), np.ones(len(lead), bool)
    for k in (1, 2, 3):
        following = padded[lead + k]
        goes_on &= (following & 0xC0) == 0x80
        code = np.where(goes_on, code * np.uint32(256) + following, code)
    return code, np.searchsorted(lead, rel).astype(np.int64)


def gram_buckets(code: np.ndarray, sizes: tuple[int, ...], bits: int) -> dict[int, np.ndarray]:
    """For each n, the bucket (of 2**bits) of the n-gram that starts at each place."""
    out, h = {}, np.zeros(len(code), np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] + np.uint32(0x85EBCA6B)) * np.uint32(0x9E3779B1) ^ (code[n - 1 :] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        if n in sizes:
            out[n] = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32)
    return out


def once(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The distinct ids, without sorting; ``place`` is scratch space as long as the id space."""
    order = np.arange(len(ids), dtype=place.dtype)
    place[ids] = order
    return ids[place[ids] == order]
