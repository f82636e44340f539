"""I-Match document fingerprints with randomised lexicons (built-in functions only).

A term counts if its inverse document frequency lies in a band.  Document frequencies are counted
over all documents for SLOTS hashed terms, so the lexicon is a bit table of fixed size.  A
fingerprint is a row of hashes: of the sorted distinct lexicon terms, and of those in random
subsets of the lexicon, SUBSETS of each of several rates; sparse subsets keep their hash when a
part of a long text changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import let
from .decontaminate import tokens
from .neighbours import with_next

#: The band: terms in at most this share of documents, and in at least that.
MOST_SHARE, LEAST_SHARE = 0.2, 0.002
#: A subset of a rate holds one term in so many.
RATES = (4, 16, 64, 256)
SUBSETS = 12
_SHIFT = 3


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text") -> Column:
    """The bit table of hashed terms within the band over all rows of docs.

    Slots in the band: each is in LEAST_SHARE of the documents, so at most SLOTS and in fact the
    mean number of distinct terms of a document over LEAST_SHARE.
    """
    n = docs.count()
    slots = F.array_distinct(F.transform(_terms(F.col(text)), lambda h: bits.slot(h)))
    df = docs.select(F.explode(slots).alias("slot")).groupBy("slot").count()
    band = df.where(F.col("count").between(LEAST_SHARE * n, max(1, math.floor(MOST_SHARE * n)))).agg(F.collect_list("slot")).first()[0]
    return bits.bit_table(band)


def _hash(terms: Column) -> Column:
    """A hash of 32 bits that is not 0, or 0 of no terms."""
    return F.when(F.size(terms) == 0, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(terms), 32).bitwiseOR(F.lit(1).cast("long")))


def fingerprint(text: Column, table: Column) -> Column:
    """array<bigint> of 32-bit hashes, 0 where a subset holds no term of the text: of the lexicon, then of each subset at each rate.

    A subset at a sparser rate is part of the one before, so each is filtered from the last.
    """
    kept = F.sort_array(F.filter(_terms(text), lambda h: bits.has(table, bits.slot(h))))

    def thinned(terms: Column, shift: int, rates: tuple[int, ...]) -> Column:
        if not rates:
            return F.array().cast("array<bigint>")
        mask = (rates[0] - 1) << shift
        return let(F.filter(terms, lambda h: h.bitwiseAND(F.lit(mask).cast("long")) == 0), lambda part: F.concat(F.array(_hash(part)), thinned(part, shift, rates[1:])))

    return let(kept, lambda terms: F.concat(F.array(_hash(terms)), *(thinned(terms, bits.BITS + _SHIFT * j, RATES) for j in range(SUBSETS))))


def as_text(sigs: Column) -> Column:
    """Eight hexadecimal digits a hash."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: at the rate where they agree best, the share of the subsets with a term of either text whose hashes agree.

    A rate counts if half of its subsets or more hold a term of either; if none does, all rates
    are taken together.  Texts without any lexicon term are alike if both have none.
    """
    used = lambda x, y: ((x != 0) | (y != 0)).cast("int")
    same = F.zip_with(a, b, lambda x, y: F.struct(used(x, y).alias("n"), F.when(x == y, used(x, y)).otherwise(0).alias("m")))

    def total(rows: Column, key: str) -> Column:
        return F.aggregate(rows, F.lit(0), lambda s, x: s + x[key])

    def both(rows: Column) -> Column:
        return F.struct(total(rows, "n").alias("n"), total(rows, "m").alias("m"))

    def of_rate(rows: Column, i: int) -> Column:
        return F.filter(rows, lambda x, k: (k > 0) & (F.pmod(k - 1, F.lit(len(RATES))) == i))

    def share(t: Column) -> Column:
        return F.when(t["n"] * 2 >= SUBSETS, t["m"] / t["n"])

    def judged(rows: Column) -> Column:
        best = F.array_max(F.transform(F.array(*(both(of_rate(rows, i)) for i in range(len(RATES)))), share))
        whole = let(both(rows), lambda t: F.when(t["n"] == 0, F.lit(1.0)).otherwise(F.try_divide(t["m"], t["n"])))
        return F.coalesce(best, whole)

    return let(same, judged)


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited, sigs, edited_sigs, next_sigs for each row: a drill of the fingerprints on edited texts.

    edited: the last quarter of the code points (rounded down) replaced by the first as many of
    the next document in the order of doc_id.  Null texts are empty, null ids come first, equal
    ids follow a hash of the text, an only document follows itself; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = lexicon(own)
    rows = with_next(own, {"sigs": fingerprint(F.col("text"), table)})
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)))
    return rows.select("doc_id", "text", "edited", "sigs", fingerprint(F.col("edited"), table).alias("edited_sigs"), "next_sigs")
