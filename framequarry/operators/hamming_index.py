"""Nearest signatures by substring tables, with a radius that grows until the nearest are proven.

A signature's four 16-bit substrings each have a row in the tables.  If two signatures differ in
fewer than 4 * (r + 1) bits, one of their substrings differs in r bits at most (pigeonhole).  So round r
looks up, for each query and substring, the values at r bits from its own; after it, all rows nearer
than 4 * (r + 1) are known, and a query whose topk rows are nearer is done.  Queries that no affordable
radius proves are compared with all signatures, in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming
from ..session import cut
from . import search

#: Bits of a substring, and substrings of a signature.
BITS, PARTS = 16, 4
#: The largest radius that is looked up: 560 values a substring, 2,788 in all rounds for a query.
MOST = 3


def _substring(signature: Column, part: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", signature, F.lit(BITS * part) if isinstance(part, int) else part * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def tables(rows: DataFrame, topk: int, idx: str = "idx") -> DataFrame:
    """part, value, hash, ids: a row a substring of each distinct signature, with the topk + 1 least of its rows; no more of equal signatures can be among topk others.

    To be written once and kept for many searches of up to topk.
    """
    # The least of a task's rows, then of all: a signature on any share of the rows is a few numbers.
    order = Window.partitionBy("hash").orderBy(idx)
    few = rows.select("hash", F.col(idx).cast("long").alias("idx")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= topk + 1)
    own = few.groupBy("hash").agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    parts = F.array(*(F.struct(F.lit(p).alias("part"), _substring(F.col("hash"), p).alias("value")) for p in range(PARTS)))
    return own.select("hash", "ids", F.explode(parts).alias("p")).select("p.part", "p.value", "hash", "ids")


def probed(index: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """q_hash, hash, ids, dist: distinct signatures whose nearest substring to that of a query (asked: distinct q_hash) is at the radius, once each."""
    masks = F.lit([m for m in range(1 << BITS) if m.bit_count() == radius])
    probes = asked.select("q_hash", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("q_part"))
    probes = probes.withColumn("mask", F.explode(masks)).select("q_hash", "q_part", _substring(F.col("q_hash"), F.col("q_part")).bitwiseXOR(F.col("mask")).alias("q_value"))
    met = probes.join(index, (F.col("part") == F.col("q_part")) & (F.col("value") == F.col("q_value")))
    # Of several substrings at the radius the first counts; with one below it, an earlier round has found the pair.
    apart = [F.bit_count(_substring(F.col("hash").bitwiseXOR(F.col("q_hash")), p)) for p in range(PARTS)]
    first = F.array_position(F.array(*(a.cast("int") for a in apart)), F.lit(radius)) == F.col("part") + 1
    return met.where((F.least(*apart) == radius) & first).select("q_hash", "hash", "ids", hamming(F.col("hash"), F.col("q_hash")).alias("dist"))


def _top(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("q_hash").orderBy("dist", "idx")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def nearest(index: DataFrame, asked: DataFrame, topk: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """q_hash, idx, dist: the topk + 1 nearest rows (by dist, then idx) of each distinct q_hash that is proven; and the hashes of the others."""
    spark, done = index.sparkSession, []
    open_ = cut(asked.select("q_hash").distinct())
    best = spark.createDataFrame([], "q_hash long, idx long, dist int")
    for radius in range(most + 1):
        met = probed(index, open_, radius).select("q_hash", F.explode("ids").alias("idx"), "dist")
        best = cut(_top(best.join(open_, "q_hash", "left_semi").unionByName(met), topk + 1))
        proven = best.groupBy("q_hash").agg(F.count("*").alias("n"), F.max("dist").alias("far")).where((F.col("n") > topk) & (F.col("far") < PARTS * (radius + 1)))
        proven = cut(proven.select("q_hash"))
        done.append(best.join(proven, "q_hash", "left_semi"))
        open_ = cut(open_.join(proven, "q_hash", "left_anti"))
        if open_.isEmpty():
            break
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole, open_


def search_many(table: DataFrame, queries: DataFrame, topk: int, sad: Column, idx: str = "idx", index: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """The rows of operators.search.search_many (same tables and columns), by substring tables: those given, or made here.

    Queries that repeat a signature are looked up once.  Queries of no other row, and empty tables,
    give no row.
    """
    index = cut(tables(table, topk, idx)) if index is None else index
    asked = queries.select(F.col("q_idx").cast("long").alias("q_idx"), "q_hash")
    found, rest = nearest(index, asked, topk, most)
    order = Window.partitionBy("q_idx").orderBy("dist", "idx")
    own = asked.join(found, "q_hash").where("idx <> q_idx").withColumn("place", F.row_number().over(order)).where(F.col("place") <= topk).select("q_idx", "idx", "dist")
    near = search.reranked(own, table, queries, sad, idx)
    if rest.isEmpty():
        return near
    return near.unionByName(search.search_many(table, queries.join(rest, "q_hash", "left_semi"), topk, sad, idx))
