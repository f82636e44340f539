"""Mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

Slots 0, 1, 2, ... are mapped through the golden-ratio sequence and the cumulative target shares
to sources, so every stretch of the schedule is close to the target mix.  Slots are ranked within
their source; the r-th takes the r-th block of equally many words of that source's shuffled
documents, beginning anew at the end of the source.  Each source ends at its rounded target: its
last block is cut there, later slots take nothing, and slots that it lacks follow the schedule.
Sources, slots and documents all stay in
tables: prefix sums run within bounded segments, and intervals meet by equal joins on cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, cut

#: Weights by the order of sources, repeating, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Words in a block, and slots that a schedule of shorter blocks has.
BLOCK_WORDS = 4096
SLOTS = 1 << 16
#: Rows of one segment of a prefix sum, on average.
SEGMENT = 1 << 14
GOLDEN = (math.sqrt(5) - 1) / 2


def sizes(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, tx (hash of the text), source, size (words) and at (place in the shuffled order of its source)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tx"), F.col(source).alias("source"),
        F.regexp_count(body, F.lit(f"[^{BLANK}]+")).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(body)).alias("at"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """src (0, 1, ... by code point, null last), source, source_size, target, lo, hi (its part of the unit interval).

    The targets share all words by weight; those above MOST times their source's words stop
    there and the excess is shared among the rest: with sources in the order of cap by weight, a
    prefix of them is capped, and the first level that does not exceed its own ratio holds.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    by = by.withColumn("src", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("double")
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "src")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_words = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    by = by.withColumn("level", level).withColumn("place", F.row_number().over(order))
    held = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(Window.partitionBy())
    by = by.withColumn("level", held).withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(Window.partitionBy())
    by = by.withColumn("hi", F.try_divide(F.sum("target").over(upto), total)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0)))
    return by.select("src", "source", "source_size", "target", "lo", F.when(F.col("src") == F.max("src").over(Window.partitionBy()), 2.0).otherwise(F.col("hi")).alias("hi"))


def _running(rows: DataFrame, key: str, segment: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows before in its key; segments are consecutive in the order."""
    spot = Window.partitionBy(key, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, segment).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__own", F.coalesce(F.sum(value).over(spot), F.lit(0)))
    return rows.join(sums.drop("__sum"), [key, segment]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before")


def _cells(rows: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    """rows, once for each cell of so many words that [begin, end) meets."""
    return rows.withColumn("cell", F.explode(F.sequence(F.expr(f"{begin} div {width}"), F.expr(f"({end} - 1) div {width}"))))


def schedule(sized: DataFrame, block_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and pieces of the mix that sized (see sizes) gives.

    Documents: doc_id, tx, size, src, begin (words before it in its source), source_size, target.
    Pieces: slot, src, doc_id, tx, begin, size, from_word, n_words: what a slot takes, by document.
    A slot's block holds block_words words (BLOCK_WORDS, or fewer so that there are SLOTS slots),
    the last block of a source what is left up to its target, rounded to whole words (1 at least).
    Documents without words are in the first table alone.
    """
    spark = sized.sparkSession
    sized = cut(sized)
    count, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Words that a source gives.
    goal = F.when(F.col("target") > 0, F.greatest(F.round("target"), F.lit(1.0))).otherwise(0).cast("long")
    source = cut(targets(sized).withColumn("goal", goal))
    width = block_words or max(1, min(BLOCK_WORDS, words // SLOTS))
    bits = max(1, math.ceil(math.log2(max(2, count / SEGMENT))))
    docs = sized.join(source.drop("lo", "hi", "goal"), sized["source"].eqNullSafe(source["source"])).drop("source")
    docs = docs.withColumn("segment", F.shiftright(F.col("at"), 64 - bits))
    docs = cut(_running(docs, "src", "segment", ["at", "doc_id", "tx"], F.col("size"), "begin").drop("segment", "at"))

    # Slots: each point of the golden-ratio sequence finds its source through cells of the unit interval.
    cells = 4096
    n_slots = math.ceil(words / width)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot")
    step = 1 << 20
    point = F.pmod(F.pmod(F.expr(f"slot div {step}") * (step * GOLDEN % 1), F.lit(1.0)) + F.col("slot") % step * GOLDEN, F.lit(1.0))
    slots = slots.withColumn("u", point).withColumn("cell", F.floor(F.col("u") * cells))
    spread = source.where("target > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    slots = slots.join(spread, "cell").where("u >= lo and u < hi").select("slot", "src", "source_size", "goal")
    slots = cut(_running(slots.withColumn("segment", F.expr(f"slot div {SEGMENT}")), "src", "segment", ["slot"], F.lit(1), "rank").drop("segment"))
    # Blocks that a source lacks; few beside its own, as the points are spread evenly.
    given = slots.groupBy("src").agg(F.count("*").alias("given"))
    short = source.join(given, "src", "left").withColumns({"given": F.coalesce("given", F.lit(0).cast("long")), "wanted": F.expr(f"(goal + {width - 1}) div {width}")}).where("given < wanted")
    short = short.select("src", "source_size", "goal", F.explode(F.sequence("given", F.col("wanted") - 1)).alias("rank"))
    more = short.withColumn("slot", F.row_number().over(Window.orderBy("rank", "src")) + F.lit(n_slots - 1).cast("long"))
    slots = slots.unionByName(more)

    # The rank's block in the source, up to the goal; a block over the source's end makes two pieces.
    runs = slots.withColumn("x", F.col("rank") * width).withColumn("y", F.least(F.col("x") + width, F.col("goal"))).where("x < y")
    runs = runs.withColumn("lap", F.explode(F.sequence(F.expr("x div source_size"), F.expr("(y - 1) div source_size"))))
    runs = runs.withColumn("s", F.greatest(F.col("x") - F.col("lap") * F.col("source_size"), F.lit(0))).withColumn("e", F.least(F.col("y") - F.col("lap") * F.col("source_size"), F.col("source_size")))
    runs = _cells(runs.select("slot", "src", "lap", "s", "e"), "s", "e", width)
    at = docs.where("size > 0").withColumn("end", F.col("begin") + F.col("size")).select("src", "doc_id", "tx", "size", "begin", "end")
    both = runs.join(_cells(at, "begin", "end", width), ["src", "cell"])
    both = both.withColumn("a", F.greatest("s", "begin", F.col("cell") * width)).withColumn("b", F.least("e", "end", (F.col("cell") + 1) * width)).where("a < b")
    pieces = both.select("slot", "src", "doc_id", "tx", "begin", "size", (F.col("a") - F.col("begin")).alias("from_word"), (F.col("b") - F.col("a")).alias("n_words"))
    return docs, pieces


def taken(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, tx, size, source_size, target, taken (words, repeats counted) of each document of the mix."""
    # Where it begins in its source tells a document with words from any other, equal rows too.
    sums = pieces.groupBy("src", "begin").agg(F.sum("n_words").alias("taken"))
    some = docs.where("size > 0").join(sums, ["src", "begin"], "left").select("doc_id", "tx", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    none = docs.where("size = 0").select("doc_id", "tx", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.union(none)


def mix(docs: DataFrame, seed: int = 0, block_words: int | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """taken() of the schedule of docs.

    Null texts have no words, null sources are one source, an empty table gives no rows, and
    equal rows are separate documents.  Each source gives its target, rounded to whole words.
    """
    return taken(*schedule(sizes(docs, seed, doc_id, source, text), block_words))
