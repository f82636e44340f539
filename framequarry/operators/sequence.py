"""Stable numbers of videos, frames and chunks from names alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_LOCAL = (1 << 33) - 1  # the row's place in its partition, within monotonically_increasing_id


def positions(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """rows plus their place (0 onwards) in the order, nulls first; rows that are equal in it take any of their places.

    Rows are dealt by ranges of the order and numbered where they lie; what a partition begins
    with is a sum over one row a partition.  The dealt rows are checkpointed, as ranges are drawn
    anew whenever they are computed.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row a partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = dealt.withColumn("__part", part).join(F.broadcast(counts), "__part")
    return placed.withColumn(name, F.col("__first") + F.col("__id").bitwiseAND(F.lit(_LOCAL))).drop("__part", "__first", "__id")


def chunked(rows: DataFrame, chunk: int, order: str = "seq") -> DataFrame:
    """rows plus chunk_id."""
    return rows.withColumn("chunk_id", F.expr(f"{order} div {int(chunk)}"))


def number(items: DataFrame, group: str, order: list[str], chunk: int, groups: DataFrame | None = None) -> DataFrame:
    """items plus video_id, frame_id, seq and chunk_id.

    video_id: place of the group's name by bytes among `groups` (those of items if not given, so
    that empty groups can count); frame_id: place in its group; seq: place over all, group after
    group; chunk_id: seq by chunk, so that chunks span groups.  A group of any size is spread over
    tasks; a row a group is joined back.
    """
    placed = positions(items, [group, *order])
    firsts = placed.groupBy(group).agg(F.min("seq").alias("__first"))
    names = positions((groups if groups is not None else items).select(group).distinct(), [group], "video_id")
    known = names.withColumnRenamed(group, "__name").join(firsts, F.col("__name").eqNullSafe(F.col(group))).select("__name", F.col("video_id").cast("int").alias("video_id"), "__first")
    numbered = placed.join(known, F.col(group).eqNullSafe(F.col("__name"))).withColumn("frame_id", (F.col("seq") - F.col("__first")).cast("int"))
    return chunked(numbered, chunk).select(*items.columns, "video_id", "frame_id", "seq", "chunk_id")
