"""Search by signature: Hamming histogram, cutoff, candidates, exact re-rank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import hamming

#: Fixed value: distances of 64-bit signatures go up to this.
FARTHEST = 64
#: Rows, and queries, that a task of a search for many queries compares at once on average.
BLOCK = 1 << 14


def distances(table: DataFrame, query: int | Column, signature: str = "hash") -> DataFrame:
    """table plus dist to a query signature (a signed 64-bit pattern)."""
    q = F.lit(query).cast("long") if isinstance(query, int) else query
    return table.withColumn("dist", hamming(F.col(signature), q))


def histogram(near: DataFrame, dense: bool = False) -> DataFrame:
    """dist, n: rows at each distance; dense: all 65, with zeros."""
    sparse = near.groupBy("dist").agg(F.count("*").alias("n"))
    if not dense:
        return sparse
    bins = near.sparkSession.range(FARTHEST + 1).select(F.col("id").cast("int").alias("dist"))
    return bins.join(F.broadcast(sparse), "dist", "left").select("dist", F.coalesce("n", F.lit(0)).alias("n"))


def cumulated(hist: DataFrame) -> DataFrame:
    """The histogram (65 rows at most) with cum, the rows up to each distance."""
    return hist.withColumn("cum", F.sum("n").over(Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def cutoff(hist: DataFrame, topk: int) -> DataFrame:
    """One row: the least distance up to which topk rows lie, or 64."""
    return cumulated(hist).agg(F.coalesce(F.min(F.when(F.col("cum") >= topk, F.col("dist"))), F.lit(FARTHEST)).cast("int").alias("cutoff"))


def report(hist: DataFrame, topk: int) -> DataFrame:
    """dist, n, cum of the bins up to the cutoff."""
    rows = cumulated(hist)
    return rows.where(F.col("cum") - F.col("n") < topk)


def within(near: DataFrame, limit: int) -> DataFrame:
    """The rows at a distance of limit or less; with the cutoff of a search, its candidates and all others that are as near as the last."""
    return near.where(F.col("dist") <= limit)


def candidates(near: DataFrame, topk: int, idx: str = "idx") -> DataFrame:
    """The topk rows nearest by (dist, idx): a heap a task, merged.  All lie within the cutoff."""
    return near.orderBy("dist", idx).limit(topk)


def rerank(found: DataFrame, sad: Column, idx: str = "idx") -> DataFrame:
    """found plus sad, in the order that the search prefers."""
    return found.withColumn("sad", sad).orderBy("sad", "dist", idx)


def best(ranked: DataFrame, idx: str = "idx") -> DataFrame:
    """One row: found and the least row by (sad, dist, idx); nulls with found false if there is none."""
    kept = F.min(F.struct("sad", "dist", F.col(idx).alias("idx")))
    return ranked.agg(kept.alias("b")).select(F.col("b").isNotNull().alias("found"), F.coalesce("b.idx", F.lit(-1)).alias(idx), F.coalesce("b.dist", F.lit(-1)).alias("dist"), F.coalesce("b.sad", F.lit(-1)).alias("sad"), F.coalesce(F.col("b.sad").cast("float"), F.lit(0.0).cast("float")).alias("score"))


def _nearest(topk: int):
    """Of the rows of a block the topk nearest to each query of a block, but for the query itself."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx, out = rows["idx"].to_numpy(np.int64), []
        hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
        for q, h in zip(queries["q_idx"], queries["q_hash"].to_numpy(np.int64).view(np.uint64), strict=True):
            dist = np.bitwise_count(hashes ^ h).astype(np.int32)
            # One more than topk, as the query may be among them; rows are in the order of idx.
            best = np.argsort(dist, kind="stable")[: topk + 1]
            best = best[idx[best] != q][:topk]
            out.append(pd.DataFrame({"q_idx": np.full(len(best), q, np.int64), "idx": idx[best], "dist": dist[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q_idx": [], "idx": [], "dist": []})

    return run


def search_many(table: DataFrame, queries: DataFrame, topk: int, sad: Column, idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """q_idx, idx, dist, sad: for each of a stated set of queries its best row among its topk nearest other rows.

    table: idx (unique), hash, payload; queries: q_idx, q_hash, q_payload.  Rows and queries are dealt into
    blocks, and a task compares one of each: only numbers and signatures are copied to blocks, and
    payloads are joined to the topk rows of a query alone.  sad: a column over payload and q_payload.
    Queries of no other row, and empty tables, give no row.
    """
    rows, asked = table.select(F.col(idx).cast("long").alias("idx"), "hash"), queries.select(F.col("q_idx").cast("long").alias("q_idx"), "q_hash")
    n_rows, n_asked = max(1, math.ceil(rows.count() / block)), max(1, math.ceil(asked.count() / block))

    def dealt(of: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return of.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    keys = ["row_block", "query_block"]
    left = dealt(rows, "idx", "row_block", n_rows, "query_block", n_asked).groupBy(*keys)
    right = dealt(asked, "q_idx", "query_block", n_asked, "row_block", n_rows).groupBy(*keys)
    near = left.cogroup(right).applyInPandas(_nearest(topk), "q_idx long, idx long, dist int")
    # topk rows a block of rows at most.
    top = near.groupBy("q_idx").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "idx"))), 1, topk).alias("top"))
    top = top.select("q_idx", F.explode("top").alias("t")).select("q_idx", "t.idx", "t.dist")
    return reranked(top, table, queries, sad, idx)


def reranked(top: DataFrame, table: DataFrame, queries: DataFrame, sad: Column, idx: str = "idx") -> DataFrame:
    """q_idx, idx, dist, sad of the best of each query's candidates (q_idx, idx, dist), whose payloads are joined to them alone."""
    both = top.join(table.select(F.col(idx).cast("long").alias("idx"), "payload"), "idx").join(queries.select(F.col("q_idx").cast("long").alias("q_idx"), "q_payload"), "q_idx")
    best = both.withColumn("sad", sad).groupBy("q_idx").agg(F.min(F.struct("sad", "dist", "idx")).alias("b"))
    return best.select("q_idx", F.col("b.idx").alias(idx), "b.dist", "b.sad")
