"""Words of many texts at once, in numpy: where they are, 64-bit hashes, and hashes of n-gram windows."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [int(x) | 1 for x in _rng.integers(1, 2**63, 64, dtype=_U)]
_tables: dict[str, np.ndarray] = {}

#: Bytes that word hashes treat at once.
SEGMENT = 1 << 19
#: Bytes that part words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part words: all of ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(base: int, n: int, name: str) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.full(size, base, _U)
            have[0] = 1
            have = np.cumprod(have, dtype=_U)
        _tables[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def words(buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words up to each text) of the words of texts that lie end to end in buf."""
    return words_in(~parts[buf], offsets)


def words_in(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), from whether each byte is in a word. cuts: bytes before which a word ends as well."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    inner = offsets[1:-1] if cuts is None else np.concatenate([offsets[1:-1], cuts])
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[inside[inner] & inside[inner - 1]]
    first[both] = True
    last[both - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, from prefix sums of byte hashes times powers.

    A hash doesn't depend on the word's place, so that long buffers are treated in segments of SEGMENT bytes
    (or one longer word) each, which bounds the sums' memory.
    """
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + SEGMENT, "right")))
        part = buf[first : int(ends[j - 1])]
        n = len(part)
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[part] * _powers(_BASE, n, "base"), dtype=_U, out=sums[1:])
            out[i:j] = mix((sums[ends[i:j] - first] - sums[starts[i:j] - first]) * _powers(_INVERSE, n, "inverse")[starts[i:j] - first])
        i = j
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, over the ends of texts too; window i starts at word i."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = h[:m] * _U(_STEP[0])
        for k in range(1, n):
            out += h[k : k + m] * _U(_STEP[k])
        return mix(out + _U(n))


def within_texts(firsts: np.ndarray, n: int, m: int) -> np.ndarray:
    """For m windows of n words: whether each lies within one text. firsts: word counts up to each text."""
    ok = np.ones(m, bool)
    for edge in range(1, n):
        at = firsts[1:-1] - edge
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        out[:] = member(keys, np.unique(twice))
    return out


def member(keys: np.ndarray, known: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Whether each key is in known, which is sorted and unique. marks: mark_table(known)."""
    if not len(known):
        return np.zeros(len(keys), bool)
    marks = mark_table(known) if marks is None else marks
    out = marks[(keys & _U(len(marks) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    k = keys[at]
    where = np.minimum(np.searchsorted(known, k), len(known) - 1)
    out[at] = known[where] == k
    return out


def mark_table(known: np.ndarray) -> np.ndarray:
    """Marks for the low bits of the known keys, which rule most other keys out at once."""
    size = 1 << max(12, int(len(known) * 16).bit_length())
    marks = np.zeros(size, bool)
    marks[(known & _U(size - 1)).astype(np.int64)] = True
    return marks


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of values (one a word) in each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
