"""What a build reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_stats(flagged: DataFrame) -> DataFrame:
    """One row: frames_total, frames_after_dedup, signatures_written."""
    kept = F.count_if("keep")
    return flagged.agg(F.count("*").alias("frames_total"), kept.alias("frames_after_dedup"), kept.alias("signatures_written"))


def chunk_stats(flagged: DataFrame, video: str = "video_id", chunk: str = "chunk_id") -> DataFrame:
    """chunk_id, frames, kept, videos (their sorted distinct ids, joined by commas)."""
    ids = F.array_join(F.sort_array(F.collect_set(F.col(video))).cast("array<string>"), ",")
    return flagged.groupBy(chunk).agg(F.count("*").alias("frames"), F.count_if("keep").alias("kept"), ids.alias("videos"))
