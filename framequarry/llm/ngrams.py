"""Hashed character n-grams of many texts at once, in numpy and in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters that one block of segments holds, and that a longer text is cut into.
BLOCK = 1 << 19


@cache
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def segments(texts: list[str], reach: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of segments of about size characters: lower-cased letters, other characters as spaces; where each segment begins and ends; its text's place.

    A space precedes each text.  After a segment stand reach more characters, of its text or
    spaces, so that what begins in a segment is the same wherever the text stands and is cut.
    """
    held, owner, total = [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = _letters()[np.frombuffer(b"".join(held), np.uint32)]
        ends = np.cumsum([len(x) // 4 for x in held])
        return flat, np.append(0, ends[:-1]), ends - reach, np.array(owner)

    for i, text in enumerate(texts):
        own = " " + text.lower()
        for at in range(0, len(own), size):
            part = own[at : at + size + reach]
            n = min(size, len(own) - at)
            held.append((part + " " * (n + reach - len(part))).encode("utf-32-le", "surrogatepass"))
            owner.append(i)
            total += n
            if total >= size:
                yield block()
                held, owner, total = [], [], 0
    if held:
        yield block()


def sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the values (rows) of each segment; none is empty."""
    return np.add.reduceat(values[: ends[-1]], np.column_stack((begins, ends)).ravel()[:-1], axis=0, dtype=np.float64)[::2]


def grams(flat: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, of 2**bits, of the n-gram that begins at each character (the last n - 1 are no n-grams)."""
    h = flat * np.uint32(0x9E3779B1)
    for k in range(1, n):
        h[:-k] ^= (flat[k:] + np.uint32(k)) * np.uint32(0x85EBCA77 + 0x1B873593 * k & 0xFFFFFFFF | 1)
        h *= np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - bits)
