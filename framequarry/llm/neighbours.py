"""Each document beside the one with the next id, with one shuffle of the texts."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import longs

#: Characters of a bucket of consecutive ids, on average, and buckets at most.
BUCKET_CHARS = 1 << 22
#: What a row counts for beside the characters of its text.
ROW_CHARS = 32
MOST_BUCKETS = 1 << 16


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most value: a binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    table = longs(bounds)

    def step(at: Column, by: Column) -> Column:
        return F.when(F.get(table, at + by - 1) <= value, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _share(tx: Column, parts: Column | int) -> Column:
    """Which of so many equal ranges of 64-bit hashes holds tx, in the order of signed numbers."""
    high = F.shiftrightunsigned(tx.bitwiseXOR(F.lit(-(1 << 63))), 33)
    return F.shiftright(high * parts, 31).cast("int")


def with_next(docs: DataFrame, carried: dict[str, Column], bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id and text of docs with the columns `carried`, and next_<column> for text and each of those, of the row with the next doc_id.

    Null ids come first, equal ids are in the order of a hash of the text, and the first row
    follows the last.  Ids are cut into buckets at quantiles; null ids, and an id that fills several
    buckets, are cut at ranges of that hash, so that rows stay in one task only if id and
    text are equal.  The first rows of each bucket also go to the bucket before.  The driver sees a few numbers a bucket.
    """
    size = F.coalesce(F.length("text"), F.lit(0)) + ROW_CHARS
    nulls, chars = docs.agg(F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), size)), F.lit(0))).first()
    of_nulls, buckets = (max(1, min(MOST_BUCKETS, math.ceil(x / bucket_chars))) for x in (nulls, chars))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * MOST_BUCKETS)).first()[0] if buckets > 1 else None
    # Of each bound the first of its buckets, and how many of them are the bound's alone: as often as the quantiles name it, if more than once.
    bounds, firsts, alone, total = [], [of_nulls], [0], of_nulls + 1
    for bound, times in sorted(Counter(cuts or []).items()):
        bounds.append(bound)
        firsts.append(total)
        alone.append(times if times > 1 else 0)
        total += times + 1 if times > 1 else 1
    place = _place(bounds, F.col("doc_id"))
    at_home = [F.get(longs(x), place) for x in ([0, *bounds], firsts, alone)]
    hot = any(alone)
    in_hot = (at_home[2] > 0) & (F.col("doc_id") == at_home[0]) if hot else F.lit(False)
    tx = F.xxhash64("text")
    bucket = at_home[1]
    if hot:
        bucket = F.when(in_hot, bucket + _share(tx, at_home[2])).otherwise(bucket + at_home[2])
    bucket = bucket.cast("int")
    cut = in_hot
    if nulls:
        bucket = F.when(F.col("doc_id").isNull(), _share(tx, of_nulls)).otherwise(bucket)
        cut = F.col("doc_id").isNull() | in_hot
    least = {r["b"]: r["least"] for r in docs.groupBy(bucket.alias("b")).agg(F.min("doc_id").alias("least")).collect()}
    # Of buckets within an id the least hash, too.
    least_tx = {r["b"]: r["tx"] for r in docs.where(cut).groupBy(bucket.alias("b")).agg(F.min(tx).alias("tx")).collect()} if nulls or hot else {}
    there = sorted(least)
    earlier = {b: there[i - 1] for i, b in enumerate(there)}
    is_head = F.col("doc_id") == F.get(longs(least.get(b) or 0 for b in range(total)), F.col("bucket"))
    if least_tx:
        is_head = F.when(cut, F.col("tx") == F.get(longs(least_tx.get(b, 0) for b in range(total)), F.col("bucket"))).otherwise(is_head)
    before = F.get(longs(earlier.get(b, 0) for b in range(total)), F.col("bucket")).cast("int")
    own = docs.select("doc_id", tx.alias("tx"), "text", *(c.alias(k) for k, c in carried.items()), bucket.alias("bucket"))
    seats = F.array(F.struct(F.lit(0).alias("after"), F.col("bucket").alias("in")))
    seats = F.when(is_head, F.concat(seats, F.array(F.struct(F.lit(1).alias("after"), before.alias("in"))))).otherwise(seats)
    rows = own.withColumn("seat", F.explode(seats)).select("doc_id", "tx", "text", *carried, F.col("seat.after").alias("after"), F.col("seat.in").alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("after", F.asc_nulls_first("doc_id"), "tx")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *carried)})
    return rows.where("after = 0").select("doc_id", "text", *carried, "next_text", *(f"next_{c}" for c in carried))
