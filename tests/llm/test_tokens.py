import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from clickloom.llm import tokens as t
from clickloom.llm.common import prepare

RANKS = t.read_ranks(P.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, "a", "é", " ", "\n\n  x", "it's we'LL they'd", "<|endoftext|> <|im_start|>", "日本語のテキスト", "👩‍👩‍👧 🇩🇪", "  　 ok",
       "٣٤ ½ Ⅷ 12345678901234567890", "à‍﻿", "x" * 5000, "=" * 3001, "ab" * 700 + " " * 900, "\x00\x1f\x7f\t\r\n", "ᏣᎳᎩ 𝔘𝔫𝔦 \U0001e900\U00031350"]


def run(spark, rows, **more):
    docs = prepare(spark).createDataFrame([(i, x, "n", b"w") for i, x in rows], "doc_id long, text string, ids string, words binary")
    out = t.decode(t.encode(docs, **more))
    assert out.columns == ["doc_id", "ids", "decoded"]
    return sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect()), key=repr)


def brute(rows):
    out = []
    for i, text in rows:
        ids = ENCODING.encode_ordinary(text or "")
        out.append((i, np.array(ids, "<u4").tobytes(), ENCODING.decode_bytes(ids)))
    assert all(d == (x or "").encode() for (_, _, d), (_, x) in zip(out, rows, strict=True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 19, 40, 0])
def test_equals_the_library(spark, most):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdluüß'-1 ", k=rng.randint(1, 12))) for _ in range(500)]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=60))) for i in range(50)]
    rows += [rows[-1], (None, "null id"), (None, None)]
    assert run(spark, rows, most=most) == brute(rows)


def test_fold_equals_the_library(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("aabcehillnrst 'ü", k=rng.randint(1, 20))) for _ in range(2000)} | {"aaa", "aaaaaaa", "ababab"}
    words |= {p.decode() for p in list(RANKS)[::37] if p.isascii()}
    df = prepare(spark).createDataFrame([(w,) for w in words], "w string").repartition(8)
    out = df.select("w", F.encode("w", "utf-8").alias("b")).select("w", t.fold_merges(F.col("b"), t.rank_map(RANKS)).alias("ids"))
    for r in out.collect():
        word = r["w"].encode()
        assert list(r["ids"]) == t.merge(word, RANKS) == ENCODING._core_bpe.encode_single_piece(word)


def test_ranks_allow_merging_all_at_once():
    assert t.check_ranks(RANKS)
    assert not t.check_ranks({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4})


def test_dictionary_keeps_its_bound(spark):
    docs = prepare(spark).createDataFrame([(" ".join(f"w{j}" for j in range(i)),) for i in range(1, 40)], "text string")
    assert t.dictionary(docs, P.PATTERN, RANKS, 10).num_rows <= 10
    words = t.Words(t.dictionary(docs, P.PATTERN, RANKS), RANKS).known()
    assert words and all(np.frombuffer(ids, "<u4").tolist() == ENCODING.encode_ordinary(w) for w, ids in words.items())
    assert t.dictionary(docs.select(F.lit("w" * 100).alias("text")), P.PATTERN, RANKS).num_rows == 0


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = t.op11(prepare(spark), sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = ENCODING.encode_ordinary(docs[r["doc_id"]])
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), want)
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
