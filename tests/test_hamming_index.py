"""Substring tables against a comparison of all signatures."""

import random

import pytest
from pyspark.sql import functions as F

from framequarry.functions.bits import array_sad
from framequarry.operators import hamming_index, search

SCHEMA = "idx long, hash long, payload array<int>"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def clusters(seed, n, each, flips):
    """Signatures in groups: a centre, and others at few bits from it."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        centre = rnd.getrandbits(64)
        for _ in range(each):
            h = centre
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                h ^= 1 << b
            rows.append((len(rows), signed(h), [rnd.randrange(256) for _ in range(4)]))
    return rows


def both(spark, rows, step, topk, most=hamming_index.MOST):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = table.where(F.col("idx") % step == 0).selectExpr("idx as q_idx", "hash as q_hash", "payload as q_payload")
    sad = array_sad(F.col("payload"), F.col("q_payload"))
    run = lambda how, **k: sorted(tuple(r) for r in how(table, asked, topk, sad, **k).collect())
    return run(hamming_index.search_many, most=most), run(search.search_many)


def test_clustered_rows_are_proven_by_a_small_part_of_all_pairs(spark, monkeypatch):
    rows, pairs = clusters(1, 200, 20, 3), []
    whole = hamming_index.probed
    monkeypatch.setattr(hamming_index, "probed", lambda *a: pairs.append((m := whole(*a)).count()) or m)
    got, want = both(spark, rows, 50, 9)
    assert got == want and len(got) == 80
    assert sum(pairs) < 80 * 4000 / 20, pairs  # a twentieth of all pairs


@pytest.mark.parametrize("most", [0, 1, 3])
def test_what_is_not_proven_is_compared_with_all(spark, most):
    rnd = random.Random(most)
    far = [(10_000 + i, signed(rnd.getrandbits(64)), [i % 256] * 4) for i in range(60)]
    got, want = both(spark, clusters(2, 10, 12, 9) + far, 10, 9, most)
    assert got == want


def test_equal_signatures_on_a_third_of_all_rows(spark):
    """A signature keeps topk + 1 of its rows, and they are the ones that count."""
    rows = [(i, 7 if i % 3 == 0 else signed(7 ^ (1 << i % 64)) if i % 3 == 1 else signed(0x9E3779B97F4A7C15 * i % (1 << 64)), [i % 256, i % 7]) for i in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA)
    index = hamming_index.tables(table, 5)
    assert index.agg(F.max(F.size("ids"))).first()[0] == 6
    got, want = both(spark, rows, 100, 5)
    assert got == want and len(got) == 30


def test_stored_tables_and_empty_ones(spark, tmp_path):
    rows = clusters(3, 5, 8, 2)
    table = spark.createDataFrame(rows, SCHEMA)
    hamming_index.tables(table, 5).write.partitionBy("part").parquet(f"{tmp_path}/index")
    asked = table.where("idx % 8 = 0").selectExpr("idx as q_idx", "hash as q_hash", "payload as q_payload")
    sad = array_sad(F.col("payload"), F.col("q_payload"))
    kept = hamming_index.search_many(table, asked, 5, sad, index=spark.read.parquet(f"{tmp_path}/index"))
    assert sorted(kept.collect()) == sorted(search.search_many(table, asked, 5, sad).collect())
    assert hamming_index.search_many(table.limit(0), asked.limit(0), 5, sad).count() == 0
    one = table.where("idx = 0")
    assert hamming_index.search_many(one, asked.where("q_idx = 0"), 5, sad).count() == 0
