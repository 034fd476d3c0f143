"""Cutting texts into runs of windows that share an anchor.

A window of ``width`` bytes has an anchor: the leftmost of its ``gram``-byte
strings with the smallest hash.  Which one that is depends on the window's bytes
alone, so equal windows have equal anchors in the same place.  Neighbouring
windows mostly share theirs; they are one run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text looked at in one step.
STEP = 1 << 20
#: Bits for a place in a step; the hash is compared by the others, in every text alike.
PLACE_BITS = 21
#: Multiplier of the rolling hash, odd, so that it has an inverse modulo 2 to the 64.
BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2 to the 64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random number for each byte."""
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every string of ``gram`` bytes, in uint64."""
    up, down = _powers(STEP + 4096)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_letters()[raw] * up[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` neighbouring values, the place of the leftmost smallest by its upper bits.

    The place goes into the lower bits, so one minimum a step finds both.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    key, n = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= span:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < span:
        d = span - n
        key = np.minimum(key[:-d], key[d:])
    return (key & low).astype(np.int32)


def runs(text: bytes, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows in ``text``, step by step: first window, windows, anchor's place, anchor's hash."""
    n = len(text) - width + 1
    for at in range(0, max(0, n), STEP):
        raw = np.frombuffer(text, np.uint8)[at : at + STEP + width - 1]
        h = gram_hashes(raw, gram)
        place = leftmost_least(h, width - gram + 1)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        count = np.diff(np.concatenate([first, [len(place)]]))
        anchor = place[first]
        yield first + at, count, anchor.astype(np.int64) + at, h[anchor].view(np.int64)


def content_hash(data: bytes) -> int:
    """64 bits, signed."""
    x = xxhash.xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def content_names(pieces: list[bytes]) -> np.ndarray:
    """Two signed 64-bit numbers for each piece, a hash of 128 bits."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in pieces]), "<i8").reshape(len(pieces), 2)
