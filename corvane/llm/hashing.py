"""Words of Arrow text columns as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .base import SPACES

_BASE = np.uint64(0x9E3779B97F4A7C15)
_space = np.zeros(256, bool)
_space[list(SPACES.encode())] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end, and where each text begins (one more entry than texts); null is empty."""
    texts = texts.cast(pa.string()).fill_null("") if texts.null_count or texts.type != pa.string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and for each text the number of its first word (one more entry than texts)."""
    solid = np.zeros(len(data) + 1, bool)
    np.logical_not(_space[data], out=solid[:-1])
    begins, ends = solid[:-1].copy(), solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    ends &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and for each text the number of its first word."""
    data, offsets = text_bytes(texts)
    first, end, at = word_places(data, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), at
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[first]) * down[first]
    return mix64(raw + (end - first).astype(np.uint64) * _BASE), at


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none. Windows may cross texts: callers skip those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out *= step
        out += words[j : j + n]
    return mix64(out)
