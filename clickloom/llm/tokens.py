"""Byte-level BPE: a fold of ranked merges over the distinct words, and decoding by joining pieces.

Texts are cut into words by the tokenizer's pattern. The distinct words of all documents are counted, and the frequent
ones (``DICTIONARY_WORDS`` at most, by the number of documents that hold them) are encoded by higher-order functions: an
array of a word's bytes is folded, and each step merges every occurrence of the adjacent pair of least rank, looked up in
a literal map of ranks. The dictionary is bounded, so it may go to every task, where texts become ids word by word. A word
that the dictionary lacks (beyond the bound, or longer than ``WORD_BYTES``) is merged in its task by the same rule.

Merging all occurrences of a pair at once equals merging the leftmost first as long as every token arises from merges of
lower rank than its own; ``check_ranks`` proves that for a rank file.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, parts_for, query, table, tidy

#: Words of the dictionary at most, and bytes of each: about 25 MB travel to a worker.
DICTIONARY_WORDS, WORD_BYTES = 1 << 19, 64
#: Words outside the dictionary that a task remembers before it starts anew.
CACHE_WORDS = 200_000
#: Slots of the literal rank map.
SLOTS = 1 << 16
#: Counts are compared by steps of 1/64 of a doubling when the dictionary is cut to its bound.
STEPS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost adjacent pair of least rank merges until none has a rank (a heap over linked pieces)."""
    n = len(word)
    if n == 1 or word in ranks and n < 3:
        return [ranks[word]]
    start, end, alive = list(range(n)), list(range(1, n + 1)), [True] * n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has merged meanwhile
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] < n:
            before[after[j]] = i
            k = after[j]
            if (r := ranks.get(word[i:end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[start[i]:end[i]]] for i in range(n) if alive[i]]


def check_ranks(ranks: dict[bytes, int]) -> bool:
    """Whether each token is its own encoding, by merges of lower rank only."""
    for token, rank in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
            if least > rank:
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return True


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: an array of small maps from pieces in hex, a piece's slot being its crc32."""
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<map<string,int>>")


def _let(x: Column, kind: str, f) -> Column:
    """``f`` of ``x`` under a name, so that ``x`` is computed once; ``kind`` is the result's type."""
    return F.aggregate(F.array(x), F.lit(None).cast(kind), lambda _, v: f(v))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Ids (array of int) of a non-empty binary word."""

    def fold(ranks: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.get(ranks, (F.crc32(piece.cast("binary")) % SLOTS).cast("int"))[piece]

        def step(pieces: Column, _: Column) -> Column:
            def joined(pair_ranks: Column, least: Column) -> Column:
                # A pair merges unless the one before it does: of three equal pieces in a row the first two.
                here = lambda i: (F.get(pair_ranks, i) == least) & ~F.get(pair_ranks, i - 1).eqNullSafe(least)
                moved = F.transform(pieces, lambda x, i: F.when(here(i), F.concat(x, F.get(pieces, i + 1))).when(
                    ~F.coalesce(here(i - 1), F.lit(False)), x))
                return F.filter(moved, lambda x: x.isNotNull())

            pairs = F.transform(pieces, lambda x, i: rank(F.concat(x, F.get(pieces, i + 1))))
            return _let(pairs, "array<string>", lambda p: _let(
                F.array_min(p), "array<string>", lambda least: F.when(least.isNull(), pieces).otherwise(joined(p, least))
            ))

        single = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.hex(F.substring(word, i, F.lit(1))))
        return F.aggregate(single, single, step, lambda pieces: F.transform(pieces, rank))

    return _let(ranks, "array<int>", fold)


def frequent_words(docs: DataFrame, pattern: str, scratch: Scratch, most: int) -> DataFrame:
    """The distinct words that most documents hold, ``most`` at most: all words above a cut of their counts."""
    counts = scratch.write(
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
        .where((F.octet_length("word") <= WORD_BYTES) & (F.octet_length("word") > 0))
        .withColumn("step", F.floor(F.log2("n") * STEPS).cast("int"))
    )
    total, cut = 0, 1 << 30
    for step, n in sorted(counts.groupBy("step").count().collect(), reverse=True):  # 64 x 64 rows at most
        if total + n > most:
            break
        total, cut = total + n, step
    return counts.where(F.col("step") >= cut).select("word")


def dictionary(docs: DataFrame, pattern: str, ranks: dict[bytes, int], most: int = DICTIONARY_WORDS) -> pa.Table:
    """(word, ids) of the frequent words: ``most`` rows at most, kept as Arrow columns on the driver."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    words = frequent_words(docs, pattern, scratch, most).repartition(parts_for(spark))
    ids = fold_merges(F.col("bytes"), rank_map(ranks))
    coded = scratch.write(words.select("word", F.encode("word", "utf-8").alias("bytes")).select("word", ids.alias("ids")))
    return coded.toArrow()


class Words:
    """The dictionary in a worker: made from the columns when the worker first needs it, and kept for its later tasks."""

    def __init__(self, coded: pa.Table, ranks: dict[bytes, int]):
        self.coded, self.ranks, self.ready = coded, ranks, None

    def known(self) -> dict[str, bytes]:
        if self.ready is None:
            self.ready = {}
            for batch in self.coded.to_batches(max_chunksize=1 << 14):
                ids = batch.column("ids")
                ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
                data = ids.flatten().to_numpy().astype("<u4").tobytes()
                for word, a, b in zip(batch.column("word").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    self.ready[word] = data[4 * a:4 * b]
            self.coded = None
        return self.ready


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, ids) for each row of ``docs(doc_id, text)``; ids is binary, little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Null ids stay null, repeated rows are encoded each, other columns are ignored. No
    special tokens: their strings are ordinary text. An empty table gives no rows.
    """
    import public_tokenizers

    ranks = read_ranks(path or str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pattern = pattern or public_tokenizers.PATTERN
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(Words(dictionary(texts, pattern, ranks, most), ranks))

    def run(batches):
        import regex

        words, ranks = known.value.known(), known.value.ranks
        find, cache = regex.compile(pattern).findall, {}

        def new(word: str) -> bytes:
            if word not in cache:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[word] = np.array(merge(word.encode(), ranks), "<u4").tobytes()
            return cache[word]

        for batch in batches:
            out = []
            for text in batch.column("text"):
                found = find(text.as_py() or "")
                out.append(b"".join([words.get(w) or new(w) for w in found]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return texts.mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encoded(doc_id, ids)`` with ``decoded``: the ids' binary pieces, joined. Null ids decode to nothing."""
    import public_tokenizers

    ranks = read_ranks(path or str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = encoded.sparkSession.sparkContext.broadcast({r: p for p, r in ranks.items()})

    def run(batches):
        piece = pieces.value.__getitem__
        for batch in batches:
            out = [b"".join(map(piece, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids binary, decoded binary")


@query("op11_tokens")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
