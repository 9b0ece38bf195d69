"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time.
CHUNK = 1 << 22
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
        if n > CHUNK:  # a single word longer than a chunk: do not keep
            del _powers[base]
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _powers_of(_BASE, len(b))[: len(b)])])
    return mixed((total[ends] - total[starts]) * _powers_of(_UNBASE, len(b))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+``, in order; ``lower``: A-Z are lower-cased."""
    data = text.encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(_LOWER)
    if len(data) <= CHUNK:
        return _chunk_words(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * _PLACE[i]
    return mixed(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words: one shingle of all; no word: none."""
    words = word_hashes(text or "")
    if 0 < len(words) < n:
        return gram_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(gram_hashes(words, n))


def minhashes(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` independent minwise tokens of a set that is not empty, as signed 32-bit integers."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] * a[:, None]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
