"""Features of new frames as they arrive; decisions are made when a chunk's neighbours are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BuildStats, Config
from ..functions.pixels import small_batches, with_features
from ..plans.build import flag, update
from ..sources import frames

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, root: str, to: str, cfg: Config, checkpoint: str) -> StreamingQuery:
    """Append path, sig and cells of frames that are new under root to the table `to`/incoming, once each; ends when all are read."""
    arrived = spark.readStream.format("binaryFile").schema(SCHEMA).load(f"{root}/*/*")
    read = arrived.select("path", frames.exact(F.col("content"), F.col("length"), cfg.geometry).alias("content"))

    def add(batch: DataFrame, number: int) -> None:
        # A folder a batch: a batch that is run again replaces itself.
        batch.write.mode("overwrite").parquet(f"{to}/incoming/batch={number}")

    with small_batches(spark):
        return with_features(read, cfg.geometry, cfg.index_edge).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(spark: SparkSession, root: str, to: str, cfg: Config) -> DataFrame:
    """All frames read so far with sad and keep, as a build over them would decide."""
    known = spark.read.parquet(f"{to}/incoming").select("path", "sig", "cells")
    return flag(known.join(frames.manifest(spark, root, cfg.chunk_frames), "path"), cfg)


def commit(spark: SparkSession, root: str, to: str, cfg: Config) -> BuildStats:
    """Bring the database under `to` up to the frames under root: features of frames that were read are not computed again, and only what is new since the last commit is decided and copied."""
    return update(spark, root, to, cfg, spark.read.parquet(f"{to}/incoming").select("path", "sig", "cells").dropDuplicates(["path"]))
