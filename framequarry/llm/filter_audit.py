"""Filter interaction audit: what each filter of a chain removes, by order of the chain, and its Shapley share.

Each document has a mask of the filters that it fails; all that the audit needs are counts of masks
within a part, which are summed before they are shuffled.  A part's counts give its removal
polynomial, the multilinear extension of "documents removed by a set of filters": at a corner it
counts what a set removes, and the integral of a partial derivative along the diagonal, in exact
rationals, is a filter's Shapley value.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, cut, let

#: The limits of the filters A to D.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, MARKS = 200, 50, 3, "#$%&*|"
FILTERS = "ABCDE"
#: What is counted of each mask: all documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """A to D of a text that is not null: too few words, too few distinct ones, too many capitals, a mark."""
    words = F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": counted["all"] < LEAST_WORDS,
        "B": counted["distinct"] * 100 < counted["all"] * LEAST_DISTINCT_PERCENT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITAL_PERCENT,
        "D": text.rlike(f"[{MARKS}]"),
    }


def failures(docs: DataFrame, part: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, A to E (booleans) of each row of docs.

    E: equal to the text of a smaller doc_id, of any part.  Null texts are empty, null parts are
    the empty string, and null ids are neither smaller nor larger than others.  Texts are equal
    if their SHA-256 is; hashes of one document need no partner, and the others are joined by a
    shuffle on both sides, so copies of one text may be any share of the rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    own = cut(own.select("doc_id", "part", F.struct(*(c.alias(k) for k, c in text_failures(F.col("text")).items())).alias("f"), F.unhex(F.sha2("text", 256)).alias("same")))
    # Written, so that the join shuffles both sides and can split a hot one.
    first = cut(own.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("same").alias("_same"), "first"))
    copies = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return own.join(first, F.col("same") == F.col("_same"), "left").select("doc_id", "part", "f.*", copies.alias("E"))


def masks(failed: DataFrame, labels: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part, mask (bit i: filter i is failed), n, good, toxic: a row for each mask that occurs in a part.

    labels: doc_id, quality, toxic.  A document is good (toxic) if a label of its id says so with 1.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    bits = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = failed.select("doc_id", "part", bits.alias("mask")).join(marked, F.col("doc_id") == F.col("_labelled"), "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"))


class Removal:
    """The multilinear extension of the documents that a set of filters removes: sum of c[T] * prod of x_i for i in T."""

    def __init__(self, counts: dict[int, int], n_filters: int):
        """A mask m takes part with n * (1 - prod of (1 - x_i) for i in m)."""
        self.c = [0] * (1 << n_filters)
        for mask, n in counts.items():
            sub = mask
            while sub:
                self.c[sub] += n if sub.bit_count() % 2 else -n
                sub = (sub - 1) & mask

    def corner(self, chosen: int) -> int:
        """What the filters of a set remove together."""
        return sum(c for t, c in enumerate(self.c) if t & ~chosen == 0)

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t)."""
        return sum((Fraction(c, t.bit_count()) for t, c in enumerate(self.c) if t >> i & 1), Fraction(0))


def _part(filters: Sequence[str]):
    scale, whole = factorial(len(filters)), (1 << len(filters)) - 1
    at = {f: i for i, f in enumerate(filters)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows["part"].iloc[0]
        of = {k: Removal(dict(zip(rows["mask"].tolist(), rows[k].tolist(), strict=True)), len(filters)) for k in COUNTS}
        total = int(rows["n"].sum())
        gone = {k: [p.corner(s) for s in range(whole + 1)] for k, p in of.items()}
        shares = [of["n"].shapley(i) * scale for i in range(len(filters))]
        assert all(s.denominator == 1 for s in shares)
        out = []
        for order in permutations(filters):
            before = 0
            for step, f in enumerate(order, 1):
                bit, after = 1 << at[f], before | 1 << at[f]
                took = {k: g[after] - g[before] for k, g in gone.items()}
                out.append((part, "".join(order), step, total - gone["n"][after], took["n"], gone["n"][bit] - took["n"], gone["n"][whole] - gone["n"][whole ^ bit], took["good"], took["toxic"], int(shares[at[f]])))
                before = after
        return pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return run


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each step of each order of the filters in each part.

    counts: masks(); a part has 2 ** len(filters) rows at most, and gives all its rows, zeros
    included.  shapley: what the filter removes, summed over all orders.  No parts, no rows.
    """
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counts.groupBy("part").applyInPandas(_part(filters), schema)
