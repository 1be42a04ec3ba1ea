"""Word-shingle sets of whole texts, computed on Arrow buffers with numpy.

A word's hash is a difference of prefix sums of its bytes times powers of an odd number, mixed; a
shingle's hash combines its words'. Two texts are compared by 64-bit hashes of at most some thousand
shingles each, so that a collision within a pair is out of the question; nothing is compared
across the whole corpus by hash alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; the arrays in flight take some fifty times as much.
CHUNK_BYTES = 1 << 17

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers.clear()
        for base in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(size, base, _U)
            t[0] = 1
            _powers.append(np.multiply.accumulate(t))
    return _powers[0], _powers[1]


def _hash_docs(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the documents data[offs[i]:offs[i+1]], sorted and distinct in each, and the count of each."""
    docs, size = len(offs) - 1, len(data)
    if not size:
        return np.zeros(0, _U), np.zeros(docs, np.int64)
    ink = ~_SPACE[data]
    bound = np.zeros(size + 1, bool)
    bound[offs] = True
    bound[size] = True
    gap = np.empty(size + 1, bool)  # whether no word goes over from byte i-1 to i
    gap[0] = gap[size] = True
    gap[1:size] = ~(ink[1:] & ink[:-1]) | bound[1:size]
    s, e = np.flatnonzero(ink & gap[:-1]), np.flatnonzero(ink & gap[1:]) + 1
    power, inverse = _power_tables(size)
    sums = np.zeros(size + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[:size], out=sums[1:])
    w = mix((sums[e] - sums[s]) * inverse[s])
    words = np.diff(np.searchsorted(s, offs))  # of each document
    last = np.cumsum(words)
    doc = np.repeat(np.arange(docs), words)
    m = len(w) - k + 1
    if m > 0:
        h = w[:m].copy()
        for i in range(1, k):
            h = h * _U(0xD1342543DE82EF95) + w[i : i + m]
        whole = doc[:m] == doc[k - 1 :]
        h = mix(h[whole])
    else:
        h = np.zeros(0, _U)
    each = np.maximum(words - k + 1, 0)
    ends = np.cumsum(each)
    short = np.flatnonzero((words > 0) & (words < k))
    out, counts, at = [], np.zeros(docs, np.int64), 0
    lone = {}
    for d in short:
        x = _U(words[d])
        for y in w[last[d] - words[d] : last[d]]:
            x = mix(np.array([x * _U(0xD1342543DE82EF95) + y], _U))[0]
        lone[int(d)] = np.array([x], _U)
    for d in range(docs):
        t = lone.get(d)
        if t is None:
            t = h[at : ends[d]]
            t.sort()
            if len(t) > 1:
                t = t[np.concatenate(([True], t[1:] != t[:-1]))]
        at = ends[d]
        counts[d] = len(t)
        out.append(t)
    return np.concatenate(out) if out else np.zeros(0, _U), counts


def sets_of(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, counts) of chunks of documents: hashes sorted and distinct within each."""
    text = text.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK_BYTES, side="right")) - 1)
            b = min(b, len(text))
            yield a, b, *_hash_docs(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k)
            a = b


def set_digests(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order, as two signed words; 0 for an empty one."""
    ends = np.cumsum(counts)
    both = []
    with np.errstate(over="ignore"):
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(salt)))))
            both.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return both[0], both[1]
