"""Searching the database for a query frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, QueryResult
from ..functions.pixels import byte_sad, cell_means, luma_plane
from ..operators import search
from ..sources import database, frames


def query_hash(content: bytes, cfg: Config) -> int:
    """The signed signature of a query frame."""
    cells = cell_means(luma_plane(content, cfg.geometry), cfg.query_edge)
    bits = np.packbits(cells > cells.sum() // 64, bitorder="little")
    return int(bits.view("<i8")[0])


def ranked(spark: SparkSession, path: str, content: bytes, cfg: Config) -> DataFrame:
    """idx, video_id, frame_id, dist, sad of the candidates, best first.

    Signatures alone are scanned for the topk candidates; their ids, topk numbers, go to the
    driver, which finds the files that hold one in the layout and opens no other.
    """
    near = search.distances(database.signatures(spark, path), query_hash(content, cfg))
    top = search.candidates(near, cfg.topk).select("idx", "video_id", "frame_id", "dist").collect()
    rows = spark.createDataFrame(top, "idx long, video_id int, frame_id int, dist int")
    pixels = database.payload(spark, path, [r["idx"] for r in top])
    return search.rerank(pixels.select("idx", "content").join(F.broadcast(rows), "idx"), byte_sad(F.col("content"), content)).select("idx", "video_id", "frame_id", "dist", "sad")


def find(spark: SparkSession, path: str, query: str, cfg: Config = Config()) -> QueryResult:
    """The best frame for a query file; found is False in an empty database, ValueError in one that lacks rows."""
    content = frames.read_query(spark, query, cfg.geometry)
    database.validate(spark, path)
    row = ranked(spark, path, content, cfg).first()
    if row is None:
        return QueryResult()
    return QueryResult(True, row["video_id"], row["frame_id"], row["idx"], row["dist"], row["sad"], float(np.float32(row["sad"])))


def histogram_report(spark: SparkSession, path: str, query: str, cfg: Config = Config()) -> DataFrame:
    """dist, n, cum of the distances up to the cutoff."""
    content = frames.read_query(spark, query, cfg.geometry)
    return search.report(search.histogram(search.distances(database.signatures(spark, path), query_hash(content, cfg))), cfg.topk)


def candidate_report(spark: SparkSession, path: str, query: str, cfg: Config = Config(), most: int = 10) -> DataFrame:
    """idx, dist, video_id, frame_id of the first candidates by distance."""
    content = frames.read_query(spark, query, cfg.geometry)
    near = search.distances(database.signatures(spark, path), query_hash(content, cfg))
    return search.candidates(near, min(most, cfg.topk)).select("idx", "dist", "video_id", "frame_id")
