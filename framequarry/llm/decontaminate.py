"""Benchmark decontamination: containment of short test items in long documents.

Items are partitioned by size.  An item's MinHash sketch is its bottom-k shingles by hash, where k
follows from the upper size of its partition so that a document with the wanted containment must
hold one of them at least (a document's own sketch would say nothing of a short part of it; see
Koslicki and Zabeti, 2019).  Documents are tested against the sketches, inside the scan or, for an
index that a task should not hold, by a join of sketched hashes; what remains is verified by exact
counts of the item's shingles.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import cut, let

WORDS = 5
THRESHOLD = 0.8
#: An index of more shingles or characters is not held in each task: hashes are joined by shuffling.
INDEX_SHINGLES = 1 << 17
INDEX_CHARS = 1 << 24


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, width: int) -> Column:
    """All runs of width words, joined by spaces."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))


def all_shingles(text: Column, widths) -> Column:
    """The shingles of a text at all widths, repeats included."""
    return let(tokens(text), lambda w: F.flatten(F.array(*(_shingles(w, k) for k in widths))))


def index(items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, ix (hash of the text), width, n_shingles, needed, shingle, sketched: a row for each distinct shingle of each item.

    width is words, or the item's length if it is shorter; items without a word have no row.
    needed: sketched shingles that a document with the threshold's containment has at least.
    """
    own = items.select(F.col(item_id).alias("item_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("ix"), tokens(F.col(text)).alias("w")).where("size(w) > 0").dropDuplicates(["item_id", "ix"])
    own = own.withColumn("width", F.least(F.size("w"), F.lit(words)))
    by_width = let(F.col("w"), lambda w: F.coalesce(*(F.when(F.least(F.size(w), F.lit(words)) == k, F.array_distinct(_shingles(w, k))) for k in range(1, words + 1))))
    own = cut(own.select("item_id", "ix", "width", by_width.alias("s"))).withColumn("n_shingles", F.size("s"))
    # The size partition [2^c, 2^(c+1)) of an item: misses allowed at its upper end, and one more.
    top = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    slack = 1e-9
    own = own.withColumn("k", F.least(F.col("n_shingles"), (F.floor((1 - threshold) * top + slack) + 1).cast("int")))
    own = own.withColumn("needed", F.greatest(F.lit(1), F.col("k") - F.floor((1 - threshold) * F.col("n_shingles") + slack)).cast("int"))
    ranked = F.array_sort(F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("shingle"))))
    rows = own.select("item_id", "ix", "width", "n_shingles", "needed", "k", F.posexplode(ranked).alias("i", "r"))
    return rows.select("item_id", "ix", "width", "n_shingles", "needed", F.col("r.shingle").alias("shingle"), (F.col("i") < F.col("k")).alias("sketched"))


def sketched_pairs(docs: DataFrame, rows: DataFrame, shingles: Column) -> DataFrame:
    """doc_id, tx, item_id, ix: the pairs whose document holds as many of the item's sketched shingles as it needs, by their 64-bit hashes.

    docs: doc_id, tx and what the column of all its shingles needs; rows: an index.  Only hashes
    are shuffled, and no pair at the threshold is lost.
    """
    sketches = rows.where("sketched").select("item_id", "ix", "needed", F.xxhash64("shingle").alias("h")).distinct()
    hashes = docs.select("doc_id", "tx", F.explode(F.array_distinct(F.transform(shingles, lambda s: F.xxhash64(s)))).alias("h")).distinct()
    met = hashes.join(sketches, "h").groupBy("doc_id", "tx", "item_id", "ix", "needed").agg(F.count("*").alias("n"))
    return met.where("n >= needed").select("doc_id", "tx", "item_id", "ix")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, tx (hash of the text), item_id, n_shingles, n_shared, containment: the pairs at threshold or above.

    Containment is the share of the item's distinct word shingles that the document has, words
    being lower-cased runs of letters and digits; every pair at the threshold is found.  Items of
    fewer words count as one shingle; null or wordless items and texts are in no pair.  Rows with
    the same id and text are one document or item.  Empty tables give no rows.
    """
    rows = cut(index(items, threshold, words, item_id, text))
    size = rows.agg(F.count_distinct("shingle").alias("n"), F.coalesce(F.sum(F.length("shingle")), F.lit(0)).alias("chars"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tx"), F.col(text).alias("text"))
    held = size["n"] <= INDEX_SHINGLES and size["chars"] <= INDEX_CHARS
    widths = size["widths"] or [words]
    every = all_shingles(F.col("text"), widths)
    if held:
        slots = rows.select(bits.slot(F.xxhash64("shingle")).alias("slot"), "sketched").groupBy("slot").agg(F.max("sketched").alias("sketched")).collect()  # INDEX_SHINGLES rows at most
        known, sketch = bits.bit_table(r["slot"] for r in slots), bits.bit_table(r["slot"] for r in slots if r["sketched"])
        hashed = F.transform(every, lambda s: F.struct(s.alias("s"), bits.slot(F.xxhash64(s)).alias("at")))
        # The hits of a text without a sketched shingle are left out, and the explode sees none.
        hits = let(F.filter(hashed, lambda x: bits.has(known, x["at"])), lambda h: F.when(F.exists(h, lambda x: bits.has(sketch, x["at"])), F.array_distinct(F.transform(h, lambda x: x["s"]))))
        own = own.select("doc_id", "tx", F.explode(hits).alias("shingle"))
        rows = F.broadcast(rows)
    else:
        leads = cut(sketched_pairs(own, rows, every).select("doc_id", "tx").distinct().toDF("led_id", "led_tx"))
        own = own.join(leads, F.col("doc_id").eqNullSafe(F.col("led_id")) & (F.col("tx") == F.col("led_tx")), "left_semi")
        own = own.select("doc_id", "tx", F.explode(F.array_distinct(every)).alias("shingle"))
    pairs = own.distinct().join(rows, "shingle").groupBy("doc_id", "tx", "item_id", "ix", "n_shingles", "needed").agg(F.count("*").alias("n_shared"), F.count_if("sketched").alias("n_sketched"))
    found = pairs.where((F.col("n_sketched") >= F.col("needed")) & (F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)))
    return found.select("doc_id", "tx", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
