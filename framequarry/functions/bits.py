"""64-bit signatures as columns: bit patterns in signed longs, only ever combined bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(values: Column) -> Column:
    """Floats of [-1, 1] as whole numbers of 0 to 255, so that all sums are exact."""
    return F.transform(values, lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


def average_hash(cells: Column) -> Column:
    """Bit k is set if cell k lies above the floored mean of all 64; bit 0 is the least."""
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + c)
    mean = F.floor(total / F.size(cells))

    def bits(m: Column) -> Column:
        flags = F.transform(cells, lambda c, k: F.when(c > m, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.element_at(F.transform(F.array(mean), bits), 1)


def as_hex(value: Column) -> Column:
    """16 hexadecimal digits of the unsigned number."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def array_sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, d: s + d)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Weights 77, 150 and 29 of 256."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)
