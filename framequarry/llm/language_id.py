"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark over a bounded, hashed sample of the labelled rows; the matrix of log
probabilities (2**BITS buckets a language) is broadcast, and numpy gathers its rows for every n-gram
of a batch of whole texts.  Languages are learned and scored in blocks of at most MAX_LANGS, a
matrix and a pass over the texts each, with the best so far and the sum of likelihoods carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released
from .ngrams import BLOCK, grams, segments, sums

BITS = 15
ORDERS = (1, 2, 3)
REACH = max(ORDERS) - 1
#: Languages of a block, and numbers that are gathered for a block of characters at once.
MAX_LANGS = 64
GATHER = 1 << 22
#: Labelled rows that a language is learned from, as an expected number.
SAMPLE_PER_LANG = 1500
UNKNOWN = "und"


@dataclass(frozen=True)
class Block:
    langs: tuple[str, ...]
    log_prior: np.ndarray
    #: one row a bucket and order, one column a language
    log_prob: np.ndarray


@dataclass(frozen=True)
class Model:
    #: of a Block each, in the order of the languages
    blocks: tuple[Broadcast, ...]


def _count(langs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(ORDERS) << BITS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for b in batches:
            texts, names = b.column(1).to_pylist(), b.column(0).to_pylist()
            for flat, begins, ends, owner in segments(texts, REACH):
                for k, n in enumerate(ORDERS):
                    g = grams(flat, n, BITS) + np.uint32(k << BITS)
                    for s, e, i in zip(begins, ends, owner, strict=True):
                        np.add.at(total[place[names[i]]], g[s:e], 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model | None:
    """Learn from rows with a lang and a text; None if there is none.

    Of each language a share of rows is taken that gives SAMPLE_PER_LANG on average, chosen by a
    hash of key and text; every value of lang is learned, with a pass over the rows a block.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("at")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    every, seen = sorted(counts), sum(counts.values())
    spark = labelled.sparkSession
    return Model(tuple(spark.sparkContext.broadcast(_fit_block(rows, {x: counts[x] for x in every[i : i + MAX_LANGS]}, seen)) for i in range(0, len(every), MAX_LANGS)))


def _fit_block(rows: DataFrame, counts: dict[str, int], seen: int) -> Block:
    langs = tuple(counts)
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, SAMPLE_PER_LANG / n))))
    # Languages of other blocks have no share.
    rows = rows.where(F.pmod("at", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    sums = rows.mapInArrow(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(ORDERS) << BITS, len(langs)))
    n[sums["bucket"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    n += 0.5
    by_order = n.reshape(len(ORDERS), 1 << BITS, len(langs))
    log_prob = np.log(by_order / by_order.sum(1, keepdims=True)).reshape(n.shape).astype(np.float32)
    return Block(langs, np.log(np.array(list(counts.values()), float) / seen), log_prob)


def _predict(texts: list[str], block: Block, names: list[str], top: np.ndarray, mass: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The best language so far, its log-likelihood, and the sum of all likelihoods over that one (infinite for a text without a letter), with those of a block added."""
    if not texts:
        return names, top, mass
    total, letters = np.tile(block.log_prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    for flat, begins, ends, owner in segments(texts, REACH, max(1, min(BLOCK, GATHER // len(block.langs)))):
        for k, n in enumerate(ORDERS):
            np.add.at(total, owner, sums(block.log_prob[grams(flat, n, BITS) + np.uint32(k << BITS)], begins, ends))
        np.add.at(letters, owner, sums(flat != 32, begins, ends).astype(np.int64))
    some = letters > 0
    high = total.max(1)
    now = np.maximum(high, top)
    own = np.exp(total - high[:, None]).sum(1) * np.exp(high - now)
    found = [(block.langs[j] if new else old) if ok else UNKNOWN for j, new, old, ok in zip(total.argmax(1), high > top, names, some, strict=True)]
    return found, np.where(some, now, 0), np.where(some, own + mass * np.exp(top - now), np.inf)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with columns lang_pred and lang_score (the posterior, 0 to 1) added.

    Null texts, and texts without a letter, are `und` with score 0; so is every text if model is
    None.  Equal texts get equal results.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    docs = docs.select(*kept)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "lang_score": F.lit(0.0)})
    at = kept.index(text)
    carried = ["lang_pred", "__top", "__mass"]

    def scored(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, top, mass = (b.column(len(kept) + i) for i in range(3))
                found = _predict([x or "" for x in b.column(at).to_pylist()], shared.value, names.to_pylist(), top.to_numpy(), mass.to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2])], [*kept, *carried])

        return run

    docs = docs.withColumns({"lang_pred": F.lit(UNKNOWN), "__top": F.lit(float("-inf")), "__mass": F.lit(0.0)})
    for i, shared in enumerate(model.blocks):
        # One matrix at a time in a worker.
        docs = (cut(docs) if i else docs).mapInArrow(released(scored(shared)), docs.schema)
    return docs.select(*kept, "lang_pred", (1 / F.col("__mass")).alias("lang_score"))
