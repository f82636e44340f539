import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from framequarry.llm import token_codec, token_output
from framequarry.llm.queries import END_ID, op7_token_output, tokenizer_file
from framequarry.llm.tokenise import Encoder

POOL = "aàéßÇŒſ'  .,!?'s't'll 1²½ªº\n\t \u0085́ΣİŸ<|endoftext|>€中 \x1c\x07-_—'RE"


def texts():
    rnd = random.Random(6)
    out = [None, "", "<|endoftext|>", "a<|startoftext|>b", "' s 'S it's", "long words " * 20000]
    return out + ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40))) for _ in range(300)]


def test_encoder_equals_library():
    whole = Tokenizer.from_file(tokenizer_file())
    mine = Encoder(tokenizer_file())
    assert mine.short_cut
    rows = [t or "" for t in texts()] * 2
    assert [x.tolist() for x in mine(rows)] == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    mine.forget()
    assert mine(["again"])[0].tolist() == whole.encode("again", add_special_tokens=False).ids


@pytest.mark.parametrize("lanes", [1, 7, 2048])
def test_codec_round_trip(monkeypatch, lanes):
    monkeypatch.setattr(token_codec, "LANES", lanes)
    monkeypatch.setattr(token_codec, "LEAST_BLOCK", 100)
    rng = np.random.default_rng(lanes)
    for ids in ([], [0], [5] * 3000, np.arange(5000), rng.integers(0, 1 << 16, 9000), rng.zipf(1.2, 9000) % 5000, np.tile([1, 2, 3], 2000)):
        blocks = token_codec.encode(np.array(ids, int), 1 << 16)
        assert (token_codec.decode(blocks) == np.array(ids)).all()


def test_codec_cuts_long_runs(monkeypatch):
    monkeypatch.setattr(token_codec, "RUN", 1000)
    monkeypatch.setattr(token_codec, "BLOCK", 300)
    monkeypatch.setattr(token_codec, "LEAST_BLOCK", 300)
    ids = np.random.default_rng(0).integers(0, 50, 4567)
    blocks = token_codec.encode(ids, 50)
    assert len(blocks) == 18 and (token_codec.decode(blocks) == ids).all()


def test_codec_reads_each_block_alone(monkeypatch):
    monkeypatch.setattr(token_codec, "LEAST_BLOCK", 500)
    ids = np.random.default_rng(3).zipf(1.3, 20_003) % 300
    blocks = token_codec.encode(ids, 300)
    assert len(blocks) == 40
    each = [token_codec.decode([b]) for b in blocks]
    assert (np.concatenate(each) == ids).all()
    assert (token_codec.decode(blocks[::-7]) == np.concatenate(each[::-7])).all()


def test_codec_adapts(monkeypatch):
    """Close to the entropy of the ids that are drawn, and far fewer bits where contexts tell."""
    monkeypatch.setattr(token_codec, "LEAST_BLOCK", token_codec.BLOCK)
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 301)
    ids = rng.choice(np.arange(40_000, 40_300), 60_000, p=p / p.sum())
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum()
    bits = lambda x: sum(map(len, token_codec.encode(x, 49_408))) * 8 / len(x)
    assert bits(ids) < entropy * 1.15  # each block learns the ids for itself
    phrases = np.concatenate([ids[k : k + 12] for k in rng.integers(0, 600, 5000)])
    assert bits(phrases) < 0.6 * entropy
    assert bits(np.full(60_000, 7)) < 0.3


def test_codec_steps_take_an_id_of_each_strand(monkeypatch):
    """A step is dear whatever it holds, so a block of some 5,000 ids takes far fewer steps than ids, to write and to read."""
    steps, update = [], token_codec._Models.update
    monkeypatch.setattr(token_codec._Models, "update", lambda *a: (steps.append(1), update(*a)))
    monkeypatch.setattr(token_codec, "LEAST_BLOCK", 5000)
    ids = np.random.default_rng(7).zipf(1.2, 40_001) % 3000
    blocks = token_codec.encode(ids, 3000)
    assert len(blocks) == 8 and 0 < len(steps) < 5001 / 7
    steps.clear()
    assert (token_codec.decode(blocks) == ids).all() and 0 < len(steps) < 5001 / 7


def test_codec_strands_of_short_and_uneven_blocks():
    """Blocks that end within a strand, or have fewer ids than strands; neighbours of other lengths."""
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 90, n) for n in (*range(1, 40), *range(3999, 4011), 4000)]
    blocks = [token_codec.encode(x, 90) for x in rows]
    assert (token_codec.decode([b for x in blocks for b in x]) == np.concatenate(rows)).all()
    assert (token_codec.decode([b for x in blocks[::-1] for b in x]) == np.concatenate(rows[::-1])).all()


def test_codec_refuses_damage_anywhere():
    block = token_codec.encode(np.random.default_rng(9).zipf(1.3, 3000) % 500, 500)[0]
    for at in range(0, len(block), 37):
        harmed = bytearray(block)
        harmed[at] ^= 0x41
        with pytest.raises(ValueError):
            token_codec.decode([bytes(harmed)])


def test_codec_refuses_damage_and_foreign_ids():
    blocks = token_codec.encode(np.random.default_rng(1).integers(0, 100, 9000), 100)
    for at in (2, 9, 12, len(blocks[1]) // 2):
        harmed = bytearray(blocks[1])
        harmed[at] ^= 1
        with pytest.raises(ValueError):
            token_codec.decode([blocks[0], bytes(harmed), blocks[2]])
    for ids, vocab in (([100], 100), ([-1], 100), ([1], 0), ([1], (1 << 16) + 1)):
        with pytest.raises(ValueError):
            token_codec.encode(np.array(ids), vocab)


def test_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FRAME_IDS", 500)
    monkeypatch.setattr(token_output, "BATCH_CHARS", 300)
    rows = [(7 * i % 1009 - 300, t, "x", 1) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, start string, part int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    whole, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for d, t, _, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, END_ID]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op7_token_output(spark, str(tmp_path)).collect()) == want


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (1, "b b"), (1, "b b"), (None, None)], "doc_id long, text string")
    token_output.write_tokens(docs, f"{tmp_path}/a", tokenizer_file(), END_ID)
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_output.read_tokens(spark, f"{tmp_path}/a").collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [None, None, 1, 1] and sum(r[2] for r in got) == got[-1][0] + 3 == 9
    assert {len(r.ids) for r in token_output.decoded_ids(spark, f"{tmp_path}/a").collect()} == {1, 2, 3}
    token_output.write_tokens(docs.limit(0), f"{tmp_path}/b", tokenizer_file(), END_ID)
    assert token_output.read_tokens(spark, f"{tmp_path}/b").count() == 0


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_task_gives_its_memory_back():
    """A worker that is used again holds what it needs, and not the most that a task took."""
    from framequarry.llm.common import released

    kept = []

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        kept.extend(held[:: 5000] + [bytes(2000)])  # freed memory lies below blocks in use
        held.clear()
        yield from batches

    before = resident()
    assert list(released(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60_000_000


def test_short_words_are_numbers_of_their_own():
    """Words of one to some eight bytes, at any place of the text and to its very end, two-byte letters too."""
    from framequarry.llm import tokenise

    words = sorted({w[:n] for w in (b"abcdefgh", b"bbbbbbbb", "éèabcdé".encode(), b"x1y2z3w4") for n in range(1, 9)})
    letters = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    begin = (np.cumsum(size) - size).astype(np.int32)
    assert tokenise._numbers(letters, begin, size).astype("<u8").view("S8").tolist() == words
    mine = tokenise.Encoder(tokenizer_file())
    texts = ["abcdefgh abcdefghi abcdefg é éé ééééé abcdefgh", "internationalisation it 's a7b ABCDEFGH", "abcdefghi abcdefgh"]
    for _ in range(2):
        assert [x.tolist() for x in mine(texts)] == [e.ids for e in mine.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(mine.ends) - 1 == len(mine.words[0]) + len(mine.words[1]) and len(mine.words[1]) >= 2


def test_words_reach_the_model_in_the_alphabet_of_bytes():
    """Each character of the short cut as a word, against the library; bytes that no such character has are refused."""
    from framequarry.llm import tokenise

    mine = tokenise.Encoder(tokenizer_file())
    words = [chr(i) * n for i in range(0x21, tokenise._END) if not 0x7F <= i <= 0xA0 for n in (1, 3)]
    mine._learn([w.encode() for w in words])
    lower = [w for w in words if w == w.lower() and mine.plain.fullmatch(w) and w.isalpha()]
    at = {w: i for i, w in enumerate(words)}
    assert len(lower) > 300
    assert [mine.ids[mine.ends[at[w]] : mine.ends[at[w] + 1]].tolist() for w in lower] == [mine.whole.encode(w, add_special_tokens=False).ids for w in lower]
    with pytest.raises(UnicodeDecodeError):
        mine._learn([b"\xff"])
