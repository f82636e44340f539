"""Each named query against its SQL."""

import os

import pytest

from framequarry.operators import dedup, search, sequence
from framequarry.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got, want = df.collect(), duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def test_golden_hashes(spark):
    got = {r.vec_id: r.hash for r in catalog.ahash64(spark, "/root/testdata/sf0.01").where("vec_id < 2").collect()} if os.path.isdir("/root/testdata/sf0.01") else None
    if got is None:
        pytest.skip("no test tables")
    assert got == {0: "63dd71e4f64e0713", 1: "2dfc1d48a3775a8e"}
    best = catalog.sad_rerank(spark, "/root/testdata/sf0.01").limit(3).collect()
    assert [tuple(r) for r in best] == [(7, 0, 0), (340, 23, 817), (425, 21, 878)]


def test_dedup_with_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 0, 5.0, "a"), (0, 1, None, "a"), (0, 2, 5.0, None), (0, 3, 5.0, None), (0, 4, 5.0, "b"), (1, 5, 5.0, "b")], "chunk_id long, seq long, v double, t string")
    distance = lambda a, b: F.abs(a - b)
    for how in (dedup.temporal_dedup, dedup.temporal_dedup_joined):
        keep = lambda **k: [r.keep for r in how(rows, "v", 1.0, distance, **k).orderBy("seq").collect()]  # noqa: B023, E731
        assert keep() == [True, True, True, False, False, True]
        assert keep(reset="t") == [True, True, True, False, True, True]
        assert how(rows.limit(0), "v", 1.0, distance).count() == 0
    assert [r.idx for r in dedup.compact(dedup.keep_all(rows)).orderBy("seq").collect()] == list(range(6))


def test_search_of_an_empty_table(spark):
    none = spark.createDataFrame([], "idx long, hash long, payload array<int>")
    near = search.distances(none, 1)
    assert search.cutoff(search.histogram(near), 5).first()[0] == 64
    assert search.histogram(near, dense=True).count() == 65
    from pyspark.sql import functions as F

    assert tuple(search.best(search.rerank(search.candidates(near, 5), F.lit(0)))[["found", "idx"]].first()) == (False, -1)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_every_query_of_empty_tables(spark, tmp_path):
    for t in ("events", "documents", "embeddings"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    one_row = {"topk_cutoff": [(64,)], "search_best": [(False, -1, -1, -1, 0.0)], "build_stats": [(0, 0, 0)]}
    for name, query in catalog.QUERIES.items():
        got = [tuple(r) for r in query(spark, str(tmp_path)).collect()]
        want = [(k, 0) for k in range(65)] if name == "hamming_histogram_dense" else one_row.get(name, [])
        assert got == want, name


def test_numbers_of_any_group_are_spread_over_tasks(spark):
    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'b', if(id % 7 = 0, null, 'a')) as g", "id * 7919 % 1009 as k", "id as extra")
    got = sequence.number(rows, "g", ["k"], 100, spark.createDataFrame([(x,) for x in (None, "a", "aa", "b")], "g string")).collect()
    want = sorted(((r.g or "", r.k, r.extra) for r in rows.collect()))
    videos, seen = {"": 0, "a": 1, "b": 3}, {}
    for seq, (g, k, extra) in enumerate(want):
        frame = seen[g] = seen.get(g, -1) + 1
        want[seq] = (extra, videos[g], frame, seq, seq // 100)
    assert sorted((r.extra, r.video_id, r.frame_id, r.seq, r.chunk_id) for r in got) == sorted(want)
    assert sequence.number(rows.limit(0), "g", ["k"], 5).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["temporal_dedup", "temporal_dedup_reset", "temporal_dedup_joined", "dedup_compaction", "build_stats", "chunk_stats", "sequence_ids", "search_many"])
def test_no_plan_gathers_or_multiplies_rows(spark, name):
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # What meets in one task is a row a partition or chunk, or a part of a total.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert any("HashAggregate" in x for x in lines[i + 1 : i + 3]), "\n".join(lines[i : i + 3])


def test_search_many_by_blocks(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, rnd.getrandbits(64) - (1 << 63), [rnd.randrange(256) for _ in range(4)]) for i in range(120)] + [(500, 7, [1, 2, 3, 4]), (501, 7, [1, 2, 3, 5])]
    table = spark.createDataFrame(rows, "idx long, hash long, payload array<int>")
    asked = table.where("idx % 10 = 0").selectExpr("idx as q_idx", "hash as q_hash", "payload as q_payload")
    from pyspark.sql import functions as F

    from framequarry.functions.bits import array_sad

    got = search.search_many(table, asked, 9, array_sad(F.col("payload"), F.col("q_payload")), block=16)
    want = []
    for q, h, p in rows:
        if q % 10 == 0:
            near = sorted((bin((h ^ o) & (1 << 64) - 1).count("1"), i, x) for i, o, x in rows if i != q)[:9]
            sad, dist, i = min((sum(abs(a - b) for a, b in zip(p, x, strict=True)), d, i) for d, i, x in near)
            want.append((q, i, dist, sad))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert search.search_many(table.where("idx = 500"), asked.where("q_idx = 500"), 9, F.lit(0).cast("long")).count() == 0
    assert search.search_many(table.limit(0), asked.limit(0), 9, F.lit(0).cast("long")).count() == 0


def test_rows_within_a_distance(spark):
    near = spark.createDataFrame([(0, 3), (1, 5), (2, 4), (3, None)], "idx long, dist int")
    assert [r.idx for r in search.within(near, 4).orderBy("idx").collect()] == [0, 2]
