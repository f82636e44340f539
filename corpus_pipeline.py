"""A corpus pipeline from operators of framequarry.llm; each stage works on all that the one before kept.

All stages but the last return the columns of documents.  Rows that share doc_id and text count as
one document for removal and mixing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import decontaminate, language_id, mixing, near_copies, token_output
from framequarry.llm.common import BLANK, shared_dir, table
from framequarry.llm.queries import END_ID, tokenizer_file

#: No SQL expresses the classifier, the coder and the 64-bit hashes; tests hold the stages against brute force.
ORACLE_SQL = None

#: Names of columns that find a row again by equal joins, null ids and repeated ids too.
_ID, _NULL, _TEXT = "_key_id", "_key_null", "_key_text"
_KEYS = [_ID, _NULL, _TEXT]


def _at(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... in place of its own names, so that no column of a stage meets one of them."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The numbered columns of rows under the names that docs has."""
    return rows.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))


def _keyed(rows: DataFrame, doc_id: str, text: Column, *more: Column) -> DataFrame:
    """The keys of rows from an id and the hash of a text, with more columns."""
    return rows.select(F.coalesce(F.col(doc_id), F.lit(0).cast("long")).alias(_ID), F.col(doc_id).isNull().alias(_NULL), text.alias(_TEXT), *more)


def _with_keys(docs: DataFrame) -> DataFrame:
    """Numbered columns of docs and its keys."""
    rows = _numbered(docs)
    return _keyed(rows, _at(docs, "doc_id"), F.xxhash64(F.coalesce(F.col(_at(docs, "text")), F.lit(""))), *rows.columns)


def _one_each(rows: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """Of rows with equal keys the least by lang, source and the other columns that have an order; columns of `more` are equal among them."""
    held = [f"c{i}" for i in range(len(docs.columns))]
    order = [f"c{i}" for i, (_, kind) in enumerate(docs.dtypes) if not kind.startswith(("map", "variant", "array", "struct"))]
    return rows.groupBy(*_KEYS, *more).agg(F.min_by(F.struct(*held), F.struct(*order)).alias("r")).select("r.*", *more)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts and texts without a letter go; columns of any name stay as they are."""
    model = language_id.fit(docs)
    found = language_id.predict(_numbered(docs), model, _at(docs, "text"))
    return _named(found.where(F.col("lang_pred") != language_id.UNKNOWN), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, null last, then the smallest hash of the text.

    Near are texts that share 0.8 or more of their five-word shingles (Jaccard).  Different texts under one id, or without an id, are different documents.
    """
    near = near_copies.near_copies(docs)
    near = _keyed(near, "doc_id", F.col("tx"), "component")
    kept = near.groupBy("component").agg(F.min(F.struct(_NULL, _ID, _TEXT)).alias("least")).select("least.*")
    return _named(_one_each(_with_keys(docs).join(kept, _KEYS, "left_semi"), docs), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor 0.8 or more of one's five-word shingles; null texts and equal rows stay, an empty benchmark drops none."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark"))
    leaks = _keyed(found, "doc_id", F.col("tx")).distinct()
    return _named(_with_keys(docs).join(leaks, _KEYS, "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that each source gives its target to the word.

    A document whose words are taken in part besides comes once more, cut after the last of those
    words (n_chars, where it is a column, follows); the operator fills a source from its first word on, so
    there is one such document a source at most.  Documents without words stay once; rows with equal id and text
    are one document.
    """
    once = _named(_one_each(_with_keys(docs), docs), docs)
    mix = mixing.mix(once)
    size = F.greatest("size", F.lit(1))
    takes = _keyed(mix, "doc_id", F.col("tx"), F.when(F.col("size") > 0, F.floor(F.col("taken") / size)).otherwise(1).cast("int").alias("_whole"), F.when(F.col("size") > 0, F.col("taken") % size).otherwise(0).cast("int").alias("_rest"))
    rows = _with_keys(once).join(takes.where("_whole > 0 or _rest > 0"), _KEYS)
    # Null stands for a whole copy.
    copies = F.concat(F.array_repeat(F.lit(None).cast("int"), F.col("_whole")), F.when(F.col("_rest") > 0, F.array("_rest")).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_upto", F.explode(copies))
    text = _at(docs, "text")
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0)), F.lit(1), F.col("_upto")), "")
    rows = rows.withColumn(text, F.when(F.col("_upto").isNull(), F.col(text)).otherwise(begun))
    if "n_chars" in docs.columns:
        n = _at(docs, "n_chars")
        rows = rows.withColumn(n, F.when(F.col("_upto").isNull(), F.col(n)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return _named(rows, docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the coded frames; null texts are the end id alone, equal rows are all written, no documents give no rows."""
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(docs, to, tokenizer_file(), END_ID)
    return token_output.read_tokens(spark, to)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
