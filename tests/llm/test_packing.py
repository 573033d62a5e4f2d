import collections
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import packing as pk
from clickloom.llm.common import prepare

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def check(rows, texts, length=pk.LENGTH):
    """Every piece of every document once, with the tokenizer's ids; sequences without gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = collections.Counter()
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), length)):
            part = ids[s:s + length]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_documents(spark):
    df = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pk.pack(df).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert n <= -(-sum(r["length"] for r in rows) // pk.LENGTH) + 1


def test_odd_texts(spark):
    texts = [
        (1, None), (2, ""), (2, ""), (None, "null id"), (3, "word " * 9000), (4, "a " * 4095), (5, "a " * 4096),
        (6, "<|endoftext|> x<|startoftext|>y"), (7, "don't we'll 12345 É é ñ z\x1cq\x85r"), (8, "北京😀 ΣΑΣ İ"), (9, "é ́x"),
    ]
    df = prepare(spark).createDataFrame([(*t, 1, "k") for t in texts], "doc_id long, text string, length int, key string")
    check(pk.pack(df).collect(), texts)
    assert pk.pack(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_word_ids_are_text_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    text = text.encode("utf-8", "replace").decode()
    assert pk.WordEncoder(path).encode(text.encode()).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_many_groups_exchange_their_rest(spark, monkeypatch):
    monkeypatch.setattr(pk, "GROUP_ROWS", 40)
    rng = random.Random(2)
    texts = [(i, "a " * rng.randrange(0, 60)) for i in range(600)]
    df = prepare(spark).createDataFrame(texts, "doc_id long, text string")
    rows = pk.pack(df, length=64).collect()
    n = check(rows, texts, 64)
    alone = len(pk.best_fit_decreasing(np.array([r["length"] for r in rows], np.int64), 64)[2])
    assert n <= 1.03 * alone


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_bounds_and_bins(lengths):
    x = np.array(lengths, np.int64)
    bins, offsets, room = pk.best_fit_decreasing(x, 100)
    values, counts = np.unique(x, return_counts=True)
    bound = pk.lower_bound(values, counts, 100)
    assert bound <= len(room) <= max(bound + 1, 1.5 * bound + 1)
    for b in range(len(room)):
        spans = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert sum(n for _, n in spans) + room[b] == 100
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans))


@pytest.mark.parametrize(("lengths", "want"), [([51] * 5, 5), ([34] * 5, 3), ([26] * 7, 3), ([60, 40], 1), ([], 0)])
def test_bounds_beat_the_sum(lengths, want):
    values, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    assert pk.lower_bound(values, counts, 100) == want


def test_words_are_looked_up_once_a_batch():
    """Words that texts of a column share are looked up once; odd white space, null and empty texts keep their places."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the cat the cat", None, "", " \t\x0bcat\x0c\r\nthe\x1cé ", "don't <|endoftext|> 北京 the"] * 40
    encoder, asked = pk.WordEncoder(path), collections.Counter()

    class Counted(dict):
        def __missing__(self, word):
            self[word] = value = encoder._learn(word)
            return value

        def __getitem__(self, word):
            asked[word] += 1
            return super().__getitem__(word)

    encoder.place = Counted()
    got = [x.tolist() for x in encoder.encode_all(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))]
    tokenizer = Tokenizer.from_file(path)
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert set(asked.values()) == {1} and asked[b"cat"] == 1


def test_batches_meet_and_keep_their_rows():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([f"{i}" * n])], ["text"]) for i, n in enumerate([5, 5, 400, 5, 5, 5])]
    got = list(pk.together(iter(batches), 100))
    assert pa.Table.from_batches(got).column("text").to_pylist() == [b.column("text")[0].as_py() for b in batches]
    assert [b.num_rows for b in got] == [2, 1, 3] and not list(pk.together(iter([])))
