"""Sessions: a local one with this engine's defaults, and Python workers that find this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def findable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on clusters that lack that folder, ship it with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])
    return spark


def session(cores: str = "*", **conf: str) -> SparkSession:
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for k, v in conf.items():
        build = build.config(k, v)
    return findable(build.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local master may do with a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="framequarry-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    return spark.sparkContext.getCheckpointDir() or told


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and carry on from there (a reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
