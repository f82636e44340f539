"""One frame as a portable pixmap."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import Geometry, QueryResult
from ..sources.database import payload


def encode_ppm(content: bytes, geometry: Geometry) -> bytes:
    if geometry.channels != 3:
        raise ValueError("a pixmap has 3 channels")
    if len(content) != geometry.nbytes:
        raise ValueError(f"the frame has {len(content)} bytes of {geometry.nbytes}")
    return b"P6\n%d %d\n255\n" % (geometry.width, geometry.height) + content


def dump_winner(spark: SparkSession, database: str, geometry: Geometry, result: QueryResult, to: str) -> bool:
    """Write the frame that a search found; False, and no file, if it found none."""
    if not result.found:
        return False
    row = payload(spark, database, [result.best_db_index]).first()
    if row is None:
        raise ValueError(f"{database} lacks the pixels of frame {result.best_db_index}")
    with open(to, "wb") as out:
        out.write(encode_ppm(bytes(row["content"]), geometry))
    return True
