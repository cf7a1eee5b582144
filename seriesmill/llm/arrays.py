"""Small array helpers: the bytes of many texts at once, and hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10  # bytes whose arrays are in memory together; one longer text is a slice of its own
_BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a string array with about ``limit`` bytes each."""
    if len(texts) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row and the ends of the texts (first entry 0); a null text has none."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if raw.offset:
        raw = pa.concat_arrays([raw])
    ends = np.frombuffer(raw.buffers()[1], np.int64)[: len(raw) + 1]
    data = raw.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64))))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 2**64), np.uint64))))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, (n - 1).bit_length()) if n else 1 << 16)
    return up[:n], down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(body: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``range_hash`` reads any range off it."""
    up, _ = powers(len(body) + 1)
    with np.errstate(over="ignore"):
        values = mix_byte()[body] * up[:-1]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))


@cache
def mix_byte() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in [start, end), the same wherever they lie."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of non-space bytes; words end with their text."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[body]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(body))]
    head[inner] |= solid[inner]
    tail[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def lowered(body: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
