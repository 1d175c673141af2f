"""Hashes of words and word shingles of many texts at once, as arrays.

Words are parted by space and U+0009 to U+000D and compared with A-Z in lower case. A word's hash is a
polynomial in random values of its bytes, from prefix sums over the whole buffer, then mixed.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once; longer texts go in parts cut at white space.
BLOCK = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 2**64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def _hash_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    blank = np.concatenate([[True], _BLANK[b], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[: len(b)])])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts, in order: the text's index, the hash, the length in bytes."""
    docs, hashes, widths = [], [], []
    pending: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal size
        if pending:
            starts, ends, h = _hash_block(b"\n".join(pending))
            at = np.cumsum([0] + [len(p) + 1 for p in pending])
            docs.append(first + np.searchsorted(at, starts, side="right") - 1)
            hashes.append(h)
            widths.append(ends - starts)
            pending.clear()
            size = 0

    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if len(raw) > BLOCK:
            flush(i)
            start = 0
            while start < len(raw):
                end = min(len(raw), start + BLOCK)
                while end < len(raw) and not _BLANK[raw[end]]:  # up to the end of the word
                    end += 1
                starts, ends, h = _hash_block(raw[start:end])
                docs.append(np.full(len(h), i))
                hashes.append(h)
                widths.append(ends - starts)
                start = end
            first = i + 1
            continue
        if size + len(raw) > BLOCK:
            flush(i)
            first = i
        if not pending:
            first = i
        pending.append(raw)
        size += len(raw) + 1
    flush(len(texts))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(widths)


def shingle_hashes(docs: np.ndarray, words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of all k-word shingles; a text of 1 to k - 1 words has one of all its words."""
    n = len(words)
    out_d, out_h = [], []
    if n >= k:
        whole = docs[: n - k + 1] == docs[k - 1 :]
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += words[j : n - k + 1 + j] * _STEP[j]
        out_d.append(docs[: n - k + 1][whole])
        out_h.append(mix(h[whole]))
    if n:
        ids, first, counts = np.unique(docs, return_index=True, return_counts=True)
        for d, at, c in zip(ids[counts < k], first[counts < k], counts[counts < k], strict=True):
            out_d.append(np.array([d]))
            out_h.append(mix((words[at : at + c] * _STEP[:c]).sum(dtype=np.uint64).reshape(1) + np.uint64(c)))
    if not out_d:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    d, h = np.concatenate(out_d), np.concatenate(out_h)
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


def counted(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with how often, ordered by both."""
    if not len(d):
        return d, h, np.empty(0, np.int64)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.concatenate([at, [len(d)]]))
