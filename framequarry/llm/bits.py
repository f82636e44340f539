"""Fixed-size bit tables as constant arrays, for membership tests inside expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: log2 of the slots of a table: 16384 longs, whatever the data.
BITS = 20
SLOTS = 1 << BITS


def longs(values: Iterable[int]) -> Column:
    """A constant array<bigint>; written as text, as one literal a value would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bit_table(slots: Iterable[int]) -> Column:
    words = [0] * (SLOTS >> 6)
    for s in slots:
        words[s >> 6] |= 1 << (s & 63)
    return longs(w - (1 << 64) if w >> 63 else w for w in words)


def slot(value: Column) -> Column:
    """The slot of a string or a 64-bit hash of one."""
    return value.bitwiseAND(F.lit(SLOTS - 1))


def has(bits: Column, at: Column) -> Column:
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
