"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence counts of hashed n-grams in a bounded sample of labelled texts give the log-count ratio
of each; the SELECT n-grams whose ratio is best supported are kept, and a logistic regression on
the scaled presences is fitted on the driver.  Scoring gathers weights in numpy; an n-gram counts
once a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import grams, segments

BITS = 20
ORDERS = (4, 5)
REACH = max(ORDERS) - 1
#: Labelled rows of a class that are learned from, as an expected number.
SAMPLE_PER_CLASS = 4000
SELECT = 1024
RIDGE = 0.02


@dataclass(frozen=True)
class Model:
    bias: float
    #: one a bucket and order
    weight: np.ndarray


def _present(texts: list[str], wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct (text, bucket) of texts, as text << 32 | bucket, in blocks of whole texts; of wanted buckets only."""
    open_ = np.zeros(0, np.int64)  # of the text that the last block ended in
    for flat, begins, ends, owner in segments(texts, REACH):
        of, found = np.repeat(owner.astype(np.int64), ends - begins), [open_]
        inside = np.concatenate([np.arange(s, e) for s, e in zip(begins, ends, strict=True)])
        for k, n in enumerate(ORDERS):
            g = grams(flat, n, BITS)[inside] + np.uint32(k << BITS)
            at = slice(None) if wanted is None else np.flatnonzero(wanted[g])
            found.append(of[at] << 32 | g[at].astype(np.int64))
        every = np.unique(np.concatenate(found))
        cut = np.searchsorted(every, int(owner[-1]) << 32)
        open_ = every[cut:]
        yield every[:cut]
    yield open_


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(ORDERS) << BITS), np.int32)
    for b in batches:
        toxic, texts = b.column(0).to_numpy(False), b.column(1).to_pylist()
        for found in _present(texts):
            of = toxic[found >> 32]
            for y in (0, 1):
                np.add.at(total[y], found[of == y] & 0xFFFFFFFF, 1)
    # An n-gram in under two toxic texts of a task's share says little; the sums below need it all the same.
    y, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[y, bucket].astype(np.int64))], ["toxic", "bucket", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Weights and bias of the least penalised logistic loss, by accelerated gradient steps."""
    w = v = np.zeros(x.shape[1] + 1)
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    u = np.random.default_rng(0).normal(size=x1.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        u = x1.T @ (x1 @ u)
        u /= np.linalg.norm(u)
    step = 1 / (0.25 * np.linalg.norm(x1.T @ (x1 @ u)) / len(x) + ridge)
    pen = np.append(np.full(x.shape[1], ridge), 0)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -40, 40)))
        new = v - step * (x1.T @ (p - y) / len(x) + pen * v)
        v = new + i / (i + 3) * (new - w)
        w = new
    return float(w[-1]), w[:-1]


def fit(labelled: DataFrame, toxic: str = "toxic", text: str = "text", key: str = "doc_id") -> Model | None:
    """Learn from rows with toxic 0 or 1 and a text; None unless both classes have a row.

    Of each class a share of rows is taken that gives SAMPLE_PER_CLASS on average, by a hash of key.
    """
    rows = labelled.select(F.col(toxic).cast("int").alias("toxic"), F.col(text).alias("text"))
    found = rows.mapInArrow(_count, "toxic int, bucket int, n long").groupBy("bucket").agg(F.sum(F.col("n") * F.col("toxic")).alias("p"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("q"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return None
    ratio = F.log(((F.col("p") + 1) / (pos + 2)) / ((F.col("q") + 1) / (neg + 2)))
    # How far the two shares lie apart, in standard errors: rare n-grams have wild ratios.
    apart = F.abs(F.col("p") / pos - F.col("q") / neg) / F.sqrt((F.col("p") + F.col("q") + 1.0) / (pos + neg))
    best = found.select("bucket", ratio.alias("r"), apart.alias("apart")).orderBy(F.desc("apart"), "bucket").limit(SELECT).collect()
    buckets = np.array(sorted(b["bucket"] for b in best))
    r = np.array([x["r"] for x in sorted(best, key=lambda x: x["bucket"])])
    column = np.zeros(len(ORDERS) << BITS, np.int32)
    column[buckets] = np.arange(1, len(buckets) + 1)
    wanted = labelled.sparkSession.sparkContext.broadcast(column)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in range(len(b))]
            for pairs in _present(b.column(1).to_pylist(), wanted.value > 0):
                for i, g in zip((pairs >> 32).tolist(), (wanted.value[pairs & 0xFFFFFFFF] - 1).tolist(), strict=True):
                    out[i].append(g)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["toxic", "has"])

    seen = rows.mapInArrow(features, "toxic int, has array<int>").toArrow()  # a bounded sample
    y = seen["toxic"].to_numpy().astype(float)
    x = np.zeros((len(y), len(buckets)), np.float32)
    for i, has in enumerate(seen["has"].to_pylist()):
        x[i, has] = r[has]
    bias, w = _logistic(x, y, RIDGE / max(1, len(y)) * 10)
    weight = np.zeros(len(ORDERS) << BITS, np.float32)
    weight[buckets] = w * r
    return Model(bias, weight)


def sample(docs: DataFrame, labels: DataFrame, allowed, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, toxic, text of a bounded sample of the labelled rows for which the condition on doc_id holds: about SAMPLE_PER_CLASS of a class.

    Rows with one id and text are one.  A document with several labels is toxic if one says so; null ids and labels are left out.
    """
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    marks = marks.where(allowed(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_CLASS / max(1, sizes.get(1, 0)))).otherwise(min(1.0, SAMPLE_PER_CLASS / max(1, sizes.get(0, 0))))
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    # About twice SAMPLE_PER_CLASS rows of two numbers: broadcast whatever the corpus.
    held = texts.join(F.broadcast(marks), texts["doc_id"] == marks["id"]).select("doc_id", "toxic", "text", F.xxhash64("doc_id", "text").alias("row"))
    # An id may be on any number of texts: of each class a share of the rows is left that gives SAMPLE_PER_CLASS on average.
    rows = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count_distinct("row").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_CLASS / max(1, rows.get(1, 0)))).otherwise(min(1.0, SAMPLE_PER_CLASS / max(1, rows.get(0, 0))))
    return held.where(F.pmod(F.shiftrightunsigned("row", 20), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["row"]).drop("row")


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with column toxic_score (0 to 1) added; null texts score as empty ones, and 0 without a model."""
    kept = [c for c in docs.columns if c != "toxic_score"]
    docs = docs.select(*kept)
    if model is None:
        return docs.withColumn("toxic_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        used = m.weight != 0
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            z = np.full(len(texts), m.bias)
            for pairs in _present(texts, used):
                np.add.at(z, pairs >> 32, m.weight[pairs & 0xFFFFFFFF])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], [*kept, "toxic_score"])

    return docs.mapInArrow(run, docs.withColumn("toxic_score", F.lit(0.0)).schema)
