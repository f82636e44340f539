"""Exact dedup by distributed MSD radix partitioning (DataFrame operations; no digest decides equality).

A document's key is its length followed by its UTF-8 bytes, so no key is a prefix of another.  Each
round splits every open group by its next digit, a run of bytes that grows from round to round:
counts of (group, digit) are summed before they are shuffled, digits of one document end there, and
rows meet the counts of the others by a join that is shuffled on both sides, so Spark splits a hot
group.  A group is done when its documents are; only documents of open groups carry bytes on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Bytes of the first digit, and how much longer each following digit is.
DIGIT = 64
GROWTH = 32

_DONE = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def _split(rows: DataFrame, keys: list[str], digit: int) -> tuple[DataFrame, int]:
    """Rows with group, n and best of their subgroups; null where a row is alone.  Also the number of subgroups of several rows.

    best: doc_id and row of the subgroup's largest doc_id, null ids least.
    """
    rows = rows.withColumn("digit", F.substring("rest", 1, digit))
    sums = rows.groupBy(*keys, "digit").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best"))
    # Numbers of subgroups are drawn once and written, so that every reader sees the same.
    subgroups = cut(sums.where("n > 1").withColumn("subgroup", F.monotonically_increasing_id()))
    there = subgroups.toDF(*(f"_{c}" if c in keys or c == "digit" else c for c in subgroups.columns))
    same: Column = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in [*keys, "digit"]))
    met = rows.join(there, same, "left")
    rest = F.when(F.col("n").isNotNull(), F.expr(f"substring(rest, {digit + 1})"))
    return met.select("doc_id", "row", "sha", F.col("subgroup").alias("group"), "n", "best", rest.alias("rest")), subgroups.count()


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digit: int = DIGIT, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs.

    Texts are equal if all their bytes are; a null text is an empty one.  Of equal texts the row
    with the largest doc_id stays (null ids are least); of rows that repeat both, one stays.
    text_sha256 is for the reader: no comparison uses it.  An empty table gives no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/radix-{uuid.uuid4().hex}"
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), body.alias("rest")).withColumns({"sha": F.sha2("rest", 256), "bytes": F.octet_length("rest")})
    keys, done, at = ["bytes"], [], 0
    while True:
        split, n = _split(rows, keys, digit)
        split.write.parquet(f"{folder}/round={at}")
        rows = spark.read.schema("doc_id long, row long, sha string, group long, n long, best struct<doc_id: long, row: long>, rest binary").parquet(f"{folder}/round={at}")
        # Alone since this round, or, by rows that were written before, ended in it.
        if at == 0:
            alone, ended = F.col("n").isNull(), F.lit(False)
        else:
            alone, ended = F.col("n").isNull(), F.coalesce(F.octet_length("rest") == 0, F.lit(False))
        best = F.when(alone, F.struct("doc_id", "row")).otherwise(F.col("best"))
        kept = F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("row") == best["row"])
        done.append(rows.where(alone | ended).select("doc_id", best["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")))
        rows = rows.where(~(alone | ended)).select("doc_id", "row", "sha", "group", "rest")
        if not n or (at and rows.isEmpty()):
            return reduce(DataFrame.unionByName, done)
        keys, at, digit = ["group"], at + 1, digit * growth
