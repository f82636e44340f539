import random
import re

import pytest

from framequarry.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, k):
    return {" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items, t=0.8):
    out = set()
    for i, text in items:
        ws = words(text)
        if not ws:
            continue
        s = shingles(ws, min(5, len(ws)))
        for d, body in docs:
            n = len(s & shingles(words(body), min(5, len(ws))))
            if n / len(s) >= t - 1e-12:
                out.add((d, i, len(s), n))
    return out


def case():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "naïve"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(rnd.choice([1, 3, 5, 8, 20, 40, 59]))) for i in range(30)]
    docs = []
    for i in range(120):
        body = text(rnd.choice([0, 3, 30, 300]))
        if i % 2:
            part = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 2)):
                part[rnd.randrange(len(part))] = "edited"
            part = part[: rnd.randint(max(1, len(part) * 3 // 4), len(part))]
            at = rnd.randint(0, len(body))
            body[at:at] = part
        docs.append((i, ", ".join(body).upper() if i % 3 else "\n".join(body)))
    items = [(i, " ".join(w)) for i, w in items]
    items += [(100, None), (101, "!?"), (102, items[0][1]), items[0], (None, "alone word")]
    docs += [(500, None), (501, ""), docs[1], (None, "such an alone word"), (777, "word " * 50000 + items[3][1])]
    return docs, items


@pytest.mark.parametrize("held", [True, False])
def test_against_brute_force(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 0)
    docs, items = case()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, shingle string, w int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, width string")
    got = decontaminate.contained(d, i)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    rows = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()]
    assert set(rows) == brute(docs, items) and len(rows) == len(set(rows)) and len(rows) > 20


def test_sketches_prune_pairs_and_lose_none(spark):
    from pyspark.sql import functions as F

    docs, items = case()
    own = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tx", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = decontaminate.index(spark.createDataFrame(items, "item_id long, text string"))
    every = decontaminate.all_shingles(F.col("text"), range(1, 6))
    led = {(r.doc_id, r.item_id) for r in decontaminate.sketched_pairs(own, rows, every).collect()}
    whole = {(d, i) for d, i, _, _ in brute(docs, items)}
    touching = {(d, i) for d, i, _, _ in brute(docs, items, 1e-9)}
    assert whole <= led
    assert led < touching
    assert len(led) - len(whole) < len(touching) - len(whole), (len(whole), len(led), len(touching))


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.contained(d, i).count() == decontaminate.contained(some, i).count() == 0
    assert decontaminate.contained(d, some.toDF("item_id", "text")).count() == 0
