"""Ranked lexical search by block-max pruning (built-in functions only).

The forward index holds of each document the terms that some query asks for, with their counts;
its rows lie in blocks of BLOCK documents as the table has them.  A block keeps of each term the
largest part of a score that a document of it gets.  Summed over a query's terms that bounds every
score in the block.  Each query's blocks are taken in the order of their bounds: the best first, which
give the query a threshold, then all others up to it.  Blocks below are never scored, and no
document that ranks lies in one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import positions
from . import bits
from .common import ascii_lower, cut, let, shared_dir

#: What parts terms, and the constants of the score.
PARTING = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
LENGTH_PERCENT, UNIT = 75, 1000
#: Documents in a block, and blocks that a query's threshold is taken from.
BLOCK = 16
FIRST_BLOCKS = 16
#: Queries that are searched together, and (query, term) rows that are sent to all tasks.
SLICE = 2048
HELD_ROWS = 1 << 17
TOP = 10


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included; of null none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[^{PARTING}]+"), F.lit(0))


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words: runs of the sorted words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda p: F.transform(p, lambda a, i: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(p, i + 1), F.size(s)) - a).alias("tf"))))

    return let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)))


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (0, 1, ...), item_id, term, qtf: a row for each distinct term of each query; rows with the same id and text are one query."""
    own = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    rows = positions(own, ["item_id", "text"], "item").select("item", "item_id", F.explode(counted(terms(F.col("text")))).alias("t"))
    return rows.select("item", "item_id", "t.term", F.col("t.tf").cast("long").alias("qtf"))


def forward_index(docs: DataFrame, asked: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """block, row, doc_id, n (terms), terms (those that asked has, with tf) of each document, written to the folder.

    Terms pass a bit table of fixed size first; the few that share a slot with one that is asked
    for stay in and meet no query.
    """
    slots = [r[0] for r in asked.select(bits.slot(F.xxhash64("term"))).distinct().collect()]  # bits.SLOTS at most
    known = bits.bit_table(slots)
    found = let(terms(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), counted(F.filter(w, lambda x: bits.has(known, bits.slot(F.xxhash64(x))))).alias("terms")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), found.alias("f"))
    rows.select((F.expr(f"row div {BLOCK}")).alias("block"), "row", "doc_id", "f.n", "f.terms").write.parquet(folder)
    return docs.sparkSession.read.schema("block long, row long, doc_id long, n long, terms array<struct<term: string, tf: int>>").parquet(folder)


def weighted(index: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """asked plus weight: a term's weight by the documents that hold it, times its repeats in the query; terms that no document holds are left out."""
    df = index.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(F.lit(float(UNIT)) * F.ln(F.lit(2.0 * n_docs + 2) / (F.col("df") * 2 + 1).cast("double")))
    return asked.join(df, "term").select("item", "item_id", "term", (w * F.col("qtf")).alias("weight"))


def _impacts(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """index with impact, the part of a score that a weight is multiplied by, in place of tf; rows of a block lie in one task."""
    length = F.lit(100 - LENGTH_PERCENT) + F.expr(f"({LENGTH_PERCENT} * n * {n_docs}L) div {n_terms}L")
    impact = lambda x: F.call_function("div", x["tf"].cast("long") * 1_000_000_000, x["tf"].cast("long") * 1000 + F.col("m") * 8)
    rows = index.where("terms is not null").withColumn("m", length).repartition("block")
    return rows.select("block", "row", "doc_id", F.explode("terms").alias("t"), "m").select("block", "row", "doc_id", F.col("t.term").alias("term"), impact(F.col("t")).alias("impact"))


def _bounds(impacts: DataFrame, asked: DataFrame) -> DataFrame:
    """block, item, bound: no document of the block has a higher score."""
    best = impacts.groupBy("block", "term").agg(F.max("impact").alias("impact"))
    return best.join(asked, "term").groupBy("block", "item").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound")).where("bound > 0")


def _scored(impacts: DataFrame, asked: DataFrame, chosen: DataFrame, n_items: int, top: int) -> DataFrame:
    """item, doc_id, row, score: the best of each query among the blocks chosen (block, item) for it.

    A block's queries are a bit mask, so that a row a term and document is enough for all of them.
    """
    words = chosen.groupBy("block", F.shiftright("item", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("item").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    mask = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by"))
    whole = F.transform(F.sequence(F.lit(0), F.lit((n_items - 1) >> 6)), lambda k: F.coalesce(F.try_element_at(F.col("by"), k), F.lit(0).cast("long")))
    mask = mask.select(F.col("block").alias("_block"), whole.alias("mask"))
    rows = impacts.join(mask, F.col("block") == F.col("_block")).join(asked, "term").where(bits.has(F.col("mask"), F.col("item")))
    sums = rows.groupBy("block", "row", "doc_id", "item").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
    return _best(sums.select("item", "doc_id", "row", "score"), top)


def _best(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's best documents with a score above 0; equal scores by doc_id, null first.

    Null texts have no terms.  Rows of docs are documents of their own, also where they repeat id
    and text; items that repeat both are one item.  Empty tables give no rows.  Scores are whole
    numbers and the ranking is exact: pruned blocks hold no document that would rank.
    """
    spark = docs.sparkSession
    asked = cut(query_terms(items, item_id, text))
    none = spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long")
    last = asked.agg(F.max("item")).first()[0]
    if last is None:
        return none
    folder = f"{shared_dir(spark)}/forward-index-{uuid.uuid4().hex}"
    index = forward_index(docs, asked, folder, doc_id, text)
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return none
    asked = cut(weighted(index, asked, n_docs))
    impacts = _impacts(index, n_docs, n_terms)
    out = none
    for at in range(0, last + 1, SLICE):
        mine = asked.where(F.col("item").between(at, at + SLICE - 1)).withColumn("item", F.col("item") - at)
        n_items = min(SLICE, last + 1 - at)
        names = mine.select("item", "item_id").distinct()
        few = mine.select("item", "term", "weight")
        held = F.broadcast(few) if few.count() <= HELD_ROWS else few
        found = _pruned(impacts, held, n_items, top, f"{folder}-bounds-{at}")
        out = out.unionByName(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def _pruned(impacts: DataFrame, asked: DataFrame, n_items: int, top: int, folder: str) -> DataFrame:
    """item, doc_id, row, score, rank: the best blocks of each query first, then those whose bounds reach what the query has by then."""
    _bounds(impacts, asked).write.parquet(folder)
    bounds = impacts.sparkSession.read.schema("block long, item long, bound long").parquet(folder)
    # A heap a task and query before rows are gathered.
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = cut(bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_BLOCKS).select("block", "item"))
    best = cut(_scored(impacts, asked, first, n_items, top))
    # 0 where a query has fewer documents yet than it may name.
    least = best.groupBy("item").agg(F.when(F.count("*") >= top, F.min("score")).otherwise(0).alias("least"))
    rest = bounds.join(least, "item", "left").where("bound >= coalesce(least, 0)").select("block", "item").join(first, ["block", "item"], "left_anti")
    more = _scored(impacts, asked, rest, n_items, top)
    return _best(best.drop("rank").unionByName(more.drop("rank")), top)
