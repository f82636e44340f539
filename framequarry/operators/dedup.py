"""Dropping frames that hardly differ from the one before, and numbering what stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_dedup(frames: DataFrame, signature: str, threshold: float, distance: Callable[[Column, Column], Column], chunk: str = "chunk_id", order: str = "seq", reset: str | None = None) -> DataFrame:
    """frames plus sad (null for a chunk's first) and keep.

    A frame is kept if it is its chunk's first, if it is over threshold from the frame directly
    before it, kept or not, or if `reset` differs from that frame's.  A chunk is one window; null
    signatures are kept, and the frame after one too.
    """
    before = Window.partitionBy(chunk).orderBy(order)
    rows = frames.withColumn("__before", F.lag(F.struct(F.col(signature).alias("s"), *([F.col(reset).alias("r")] if reset else []), F.lit(True).alias("there"))).over(before))
    sad = distance(F.col(signature), F.col("__before.s"))
    keep = F.col("__before.there").isNull() | F.coalesce(sad > threshold, F.lit(True))
    if reset:
        keep = keep | ~F.col(reset).eqNullSafe(F.col("__before.r"))
    return rows.withColumns({"sad": F.when(F.col("__before.there").isNotNull(), sad), "keep": keep}).drop("__before")


def temporal_dedup_joined(frames: DataFrame, signature: str, threshold: float, distance: Callable[[Column, Column], Column], chunk: str = "chunk_id", order: str = "seq", reset: str | None = None) -> DataFrame:
    """The same for dense order numbers by an equal join of neighbours, for chunks beyond one task."""
    prior = frames.select((F.col(order) + 1).alias(order), F.col(chunk).alias("__chunk"), F.col(signature).alias("__s"), *([F.col(reset).alias("__r")] if reset else []), F.lit(True).alias("__there"))
    rows = frames.join(prior.withColumnRenamed("__chunk", chunk), [chunk, order], "left")
    sad = distance(F.col(signature), F.col("__s"))
    keep = F.col("__there").isNull() | F.coalesce(sad > threshold, F.lit(True))
    if reset:
        keep = keep | ~F.col(reset).eqNullSafe(F.col("__r"))
    return rows.withColumns({"sad": F.when(F.col("__there").isNotNull(), sad), "keep": keep}).select(*frames.columns, "sad", "keep")


def keep_all(frames: DataFrame) -> DataFrame:
    """No deduplication."""
    return frames.withColumns({"sad": F.lit(None).cast("long"), "keep": F.lit(True)})


def compact(flagged: DataFrame, chunk: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Kept rows with idx, 0 onwards in order; chunks are numbered apart and shifted by the counts of those before."""
    kept = flagged.where("keep")
    counts = kept.groupBy(chunk).agg(F.count("*").alias("__n"))
    # One row a chunk.
    counts = counts.select(chunk, F.coalesce(F.sum("__n").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    local = F.row_number().over(Window.partitionBy(chunk).orderBy(order)) - 1
    return kept.withColumn("__own", local).join(counts, chunk).withColumn("idx", F.col("__first") + F.col("__own")).drop("__first", "__own", "keep")
