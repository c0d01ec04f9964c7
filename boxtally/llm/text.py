"""Words and word shingles of many texts at once, as numpy arrays of hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEXT_WORD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Scripts without spaces, whose letters are words of their own (Thai, Lao, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Bopomofo, Han, Yi, Tangut).
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007),
    (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9D), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
_APART, _SPACED, _ALONE, _MARK = range(4)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept between calls while they are of usual size."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= 2 * CHUNK_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` characters; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) + 1 if text else 1
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of a column of texts; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 1)
    start = 0
    while start < len(size):
        end = max(int(np.searchsorted(size, (size[start - 1] if start else 0) + limit, side="right")), start + 1)
        yield start, end
        start = end


@cache
def _kinds() -> np.ndarray:
    """What each code point is to a word: apart from it, part of it, a word alone, or a mark on what stands before."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in [*range(0x40000), *range(0xE0000, 0xE0200)]:  # the planes between are unassigned or private
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = _MARK if kind == "M" else _SPACED if kind in "LN" else _APART
    for low, high in UNSPACED:
        part = kinds[low : high + 1]
        letter = np.array([unicodedata.category(chr(c)) in ("Lo", "Lm", "Nl") for c in range(low, high + 1)])
        part[letter] = _ALONE
    return kinds


@cache
def _values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 0x110001, dtype=np.uint64) * _BASE)


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-case code points, which end with a line break, begin and end."""
    kind = _kinds()[data]
    if not len(kind) or kind.max() <= _SPACED:
        edge = np.flatnonzero(np.diff(kind.astype(np.int8), prepend=np.int8(0)))
        return edge[0::2], edge[1::2]
    base = kind[np.maximum.accumulate(np.where(kind == _MARK, 0, np.arange(len(kind))))]
    base[base == _MARK] = _APART  # marks on nothing, at the very beginning
    before = np.concatenate([np.zeros(1, dtype=base.dtype), base[:-1]])
    begins = (kind == _ALONE) | ((kind == _SPACED) & (before != _SPACED))
    return np.flatnonzero(begins), np.flatnonzero((before != _APART) & ((base == _APART) | begins))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def spelt_words(text: str | None) -> list[str]:
    """The words of one text as they are spelt, in lower case."""
    low = (text or "").lower() + "\n"
    return [low[a:b] for a, b in zip(*(x.tolist() for x in _spans(_code_points(low))))]


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offsets of each text's words.

    A word is a run of letters, marks and digits in the lower-cased text, by Unicode class; a letter of a script
    without spaces is a word of its own, with the marks behind it. Null counts as empty.
    """
    raw = [(t or "").lower() for t in texts]
    data = _code_points("\n".join(raw) + "\n")
    start, end = _spans(data)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_values()[data] * powers(_BASE, len(data)), out=prefix[1:])
        value = (prefix[end] - prefix[start]) * powers(_BASE_INVERSE, len(data))[start]
        value = mix(value + (end - start).astype(np.uint64))
    bound = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    offsets[1:] = np.searchsorted(start, bound)
    return value, offsets


def shingles(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order and the offsets of each text's runs.

    A text of fewer words but at least one has a single run of all its words.
    """
    return runs_of(*words(texts), size)


def runs_of(value: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of texts whose ``words`` are at hand."""
    count = np.diff(offsets)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(runs, out=out[1:])
    first = np.repeat(offsets[:-1] - out[:-1], runs) + np.arange(out[-1])
    width = np.repeat(np.minimum(count, size), runs)
    with np.errstate(over="ignore"):
        total = width.astype(np.uint64)
        factor = np.uint64(1)
        for k in range(size):
            at = np.minimum(first + k, max(len(value) - 1, 0))
            total = total + np.where(k < width, value[at] if len(value) else np.uint64(0), np.uint64(0)) * factor
            factor = np.uint64(int(factor) * int(_NEXT_WORD) % (1 << 64))
        return mix(total), out


def by_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of every text in ascending order: (text number, hash, count)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], h[at], np.diff(np.append(at, len(h)))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return x.astype(np.uint64, copy=False).view(np.int64)
