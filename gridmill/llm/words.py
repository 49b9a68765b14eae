"""Words and shingles as 64-bit hashes, shared by the operators on words.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; ``bytes.lower``
sees ASCII only, which is that rule. A word's hash is a polynomial in its bytes modulo
2^64, taken for all words of a text at once from prefix sums.
"""

from __future__ import annotations

import numpy as np

_P = 0xD1342543DE82EF95
_INVERSE = pow(_P, -1, 2**64)
_BLANKS = frozenset((32, *range(9, 14)))
_PIECE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64; kept while the worker lives."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BACK = [np.uint64(pow(m, -1, 2**64)) for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix(x: np.ndarray) -> np.ndarray:
    """The value that ``mix`` made x of."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _BACK[0]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _pieces(raw: bytes):
    """Parts of a long text, cut at blanks."""
    at = 0
    while len(raw) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(raw) and raw[cut] not in _BLANKS:
            cut += 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(text: str | None) -> np.ndarray:
    out = []
    for raw in _pieces((text or "").encode().lower()):
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            continue
        blank = np.ones(len(b) + 2, np.int8)
        blank[1:-1] = (b == 32) | ((b - np.uint8(9)) < 5)
        turn = blank[1:] - blank[:-1]
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_P, len(b)), out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * _power(_INVERSE, len(b))[start]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long, aligned hash arrays, in order."""
    h = np.full(parts[0].shape, len(parts), np.uint64)
    for p in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + p
    return mix(h)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words the whole sequence is one."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(size, len(w))
    return np.unique(joined([w[i : len(w) - size + i + 1] for i in range(size)]))
