import random
import zlib

import numpy as np

import corpus_pipeline as p

VOCAB = {"en": "the of and ing tion er on".split(), "de": "der die und ung keit ein ver".split()}


def corpus():
    rnd = random.Random(8)
    text = lambda n, lang: " ".join("".join(rnd.choice(VOCAB[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    items = [(i, text(30, "en")) for i in range(5)]
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "de"])
        rows.append((i, text(rnd.randint(60, 200), lang), lang, rnd.choice(["s1", "s2", None]), 0))
    rows += [(200 + i, rows[i % 10][1], "en", "s3", 0) for i in range(30)]
    leaks = [(300 + i, text(50, "en") + " " + items[i % 5][1].upper() + " " + text(50, "en"), "en", "s1", 0) for i in range(10)]
    odd = [(400, None, "en", "s1", 0), (401, "123 ---", "de", "s1", 0), (402, "", None, None, 0), (None, text(80, "de"), None, "s2", 0)]
    return rows + leaks + odd, items


def write(spark, tmp_path, rows, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_in_turn(spark, tmp_path):
    rows, items = corpus()
    docs, d = write(spark, tmp_path, rows, items), str(tmp_path)
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())
    of = lambda keep: sorted((r[0] is not None, r[0] or 0) for r in rows if keep(r[0]))
    steps = []
    for name, stage in p.STAGES[:4]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(docs)
    assert ids(steps[0]) == of(lambda i: i not in (400, 401, 402))
    assert ids(steps[1]) == of(lambda i: i is None or i < 200 or 300 <= i < 400)
    assert ids(steps[2]) == of(lambda i: i is None or i < 200)
    words = {None: 0, "s1": 0, "s2": 0}
    for r in steps[2].collect():
        words[r.source] += len(r.text.split())
    taken = dict.fromkeys(words, 0)
    for r in steps[3].collect():
        taken[r.source] += len(r.text.split())
    want = {"s1": 1 / 6, "s2": 2 / 6, None: 3 / 6}
    for s, share in want.items():
        assert abs(taken[s] - share * sum(words.values())) <= 1
    out = p.STAGES[4][1](spark, steps[3], d).collect()
    assert len(out) == steps[3].count()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(p.tokenizer_file())
    sums = sorted(zlib.crc32(np.array([*whole.encode(r.text, add_special_tokens=False).ids, p.END_ID], "<u4").tobytes()) for r in steps[3].collect())
    assert sorted(r.ids_crc32 for r in out) == sums
    assert max(r.start + r.n_tokens for r in out) == sum(r.n_tokens for r in out)


def test_run_and_empty_table(spark, tmp_path):
    write(spark, tmp_path / "a", *corpus())
    assert p.run(spark, f"{tmp_path}/a").count() > 50
    write(spark, tmp_path / "b", [], [])
    assert p.run(spark, f"{tmp_path}/b").count() == 0


def test_stages_are_registered():
    import __spark_entry__ as e

    assert 4 <= len(p.STAGES) <= 5 and e.queries()["pipeline"].__wrapped__ is p.run
    for n in range(1, 14):
        assert [k for k in e.queries() if k.startswith(f"op{n}_")], n


def mixed(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return p.mix_sources(spark, spark.createDataFrame(rows, schema).repartition(5), "").collect()


def test_mixing_keeps_every_source(spark):
    """A source of one long document gives its target, cut from that document; all sources end at their targets."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, long, "en", "a", len(long))] + [(i, f"x\ty {i}\n z", "en", s, 9) for s, at in (("b", 1000), ("c", 2000)) for i in range(at, at + 100)]
    want = {"a": 30_800 - 1200 - 1200, "b": 1200, "c": 1200}  # b and c stop at three times their words
    got = mixed(spark, rows)
    taken = dict.fromkeys(want, 0)
    for r in got:
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) or r.source != "a"
    assert taken == want
    assert all(long.startswith(r.text) for r in got if r.source == "a") and sum(r.source == "a" for r in got) == 1


def test_mixing_repeated_rows_and_no_words(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "de", "s", 5), (2, None, None, None, 0), (3, " ", "en", "t", 1), (None, "d e f", "en", "t", 5), (None, "d e f", "en", "u", 5)]
    got = mixed(spark, rows)
    assert sorted(str(r.doc_id) for r in got if not (r.text or "").strip()) == ["2", "3"]
    assert {(r.doc_id, r.lang, r.source) for r in got if (r.text or "").strip()} == {(1, "de", "s"), (None, "en", "t")}


def test_columns_that_clash_come_back_unchanged(spark, tmp_path):
    rows, items = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "lang_score", "_key_id", "_key_text", "_copy", "tx", "component", "size", "taken", "c0", "c1", "r"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:])
    spark.createDataFrame([(*r[:4], len(r[1] or ""), *(f"{n} {r[0]}" for n in names[5:])) for r in rows], schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(p.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = docs.collect()
        assert len(got) > 50 and all(r[n] == f"{n} {r.doc_id}" for r in got for n in names[5:]), name
    assert p.write_token_ids(spark, docs, str(tmp_path)).count() == len(got)
