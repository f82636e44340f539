import hashlib
import random
from collections import defaultdict

import pytest

from framequarry.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[t or ""].append((d is not None, d or 0, i))
    out = []
    for t, ids in groups.items():
        stays = max(ids)
        for x in ids:
            out.append((rows[x[2]][0], stays[1] if stays[0] else None, len(ids), x == stays, hashlib.sha256(t.encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


@pytest.mark.parametrize("digit,growth", [(1, 1), (3, 2), (64, 32)])
def test_against_brute_force(spark, digit, growth):
    rnd = random.Random(digit)
    texts = ["", "a", "ab", "abc", "é" * 9, "x" * 63, "x" * 64, "x" * 65, "x" * 63 + "y", "same start " + "z" * (8 if growth == 1 else 3000), "same start " + "z" * (8 if growth == 1 else 2999) + "y", "\0", "\0\0"]
    rows = [(i, rnd.choice(texts)) for i in range(200)] + [(500, None), (None, None), (None, "ab"), (501, "ab"), (501, "ab"), (501, "x"), (502, "alone")]
    docs = spark.createDataFrame([(*r, 7, "a") for r in rows], "doc_id long, text string, row int, digit string").repartition(5)
    assert sorted(found(exact_dedup(docs, digit=digit, growth=growth)), key=str) == sorted(brute(rows), key=str)


def test_a_third_of_all_rows_is_one_text_and_texts_are_long(spark):
    hot, long = "w " * 40, "v " * 1_500_000
    rows = [(i, hot if i % 3 == 0 else f"{hot}{i}") for i in range(6000)] + [(7000, long), (7001, long), (7002, long[:-2] + "u ")]
    got = found(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert sorted(got) == sorted(brute(rows))


def test_empty_table_and_all_alone(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.kept for r in exact_dedup(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [True]


def test_copies_meet_by_joins_that_spark_can_split(spark):
    """No window or one-task step gathers a group; no digest is a key."""
    rows = spark.range(100).selectExpr("id as doc_id", "'t' as text")
    plan = exact_dedup(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
