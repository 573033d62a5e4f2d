"""Best-fit packing of tokenised documents into sequences, with bounds that certify the number of sequences.

Whole pieces of the full length are sequences of their own. The others are dealt to groups by a hash and packed
best-fit decreasing in each. A group whose sequence count equals its lower bound (dual feasible functions) cannot do
better alone; what is left are sequences with room. If the sum is above the bound of all pieces together, the pieces of
sequences with room leave their groups, meet in fewer groups and are packed again, until the bound is met, one group
is left, or a round gains nothing. Full sequences never move again.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, query, table, tidy

LENGTH, END_ID = 4096, 1
#: Pieces of one group, on average.
GROUP_ROWS = 20_000
#: Words whose ids a task remembers before it starts anew.
CACHE_WORDS = 600_000
#: Bytes of texts whose words are looked up together, each distinct one once.
HELD_BYTES = 12 << 20


#: Words of Latin letters, digits and signs without an apostrophe or ``<``. No rule of the tokenizer reaches across their
#: runs of letters, single digits and runs of signs, so its model may be asked for each of these by itself.
_PLAIN = re.compile("[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f!-&(-/:;=-@\\[-`{-~]+")
_PIECES = re.compile("[a-z\u00df-\u017f]+|[0-9]|[^a-z0-9\u00df-\u017f]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level models write a byte as itself if it is a visible character, else as the next one from U+0100 on.
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class _Learned(dict):
    """A dictionary that asks ``learn`` for what it does not hold yet."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, key):
        self[key] = value = self.learn(key)
        return value


class WordEncoder:
    """Ids of whole texts from remembered ids of their words.

    The tokenizer never joins what white space parts, so a text's ids are its words' ids in a row; each new word is
    encoded by the tokenizer itself (plain words by its model, which spares the work around it, and a piece that many
    words share is asked for once). Words are cut at ASCII white space only and keep everything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _piece_ids(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([_BYTES[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word_ids(self, word: str) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if not _PLAIN.fullmatch(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def _clear(self) -> None:
        self.pieces, self.place = _Learned(self._piece_ids), _Learned(self._learn)
        self.flat, self.first = array("I"), array("q", [0])

    def _learn(self, word: bytes) -> int:
        """The place of a new word, whose ids are ``flat`` from ``first`` of it to that of the next."""
        self.flat.frombytes(self.word_ids(word.decode()))
        self.first.append(len(self.flat))
        return len(self.first) - 2

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a binary column; a null text has none. A word that the column repeats is looked up once."""
        if len(self.place) > CACHE_WORDS:
            self._clear()
        words = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        coded = words.flatten().dictionary_encode()
        place = np.fromiter(map(self.place.__getitem__, coded.dictionary.view(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
        flat, first = np.array(self.flat), np.array(self.first)
        start = first[place].astype(np.int64)
        count = first[place + 1] - start
        at, bounds = coded.indices.to_numpy(), words.offsets.to_numpy()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            some = at[low:high]
            n = count[some]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield flat[np.repeat(start[some] - (ends - n), n) + np.arange(total)]

    def encode(self, text: bytes) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.binary())))


def together(batches: Iterator[pa.RecordBatch], limit: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in fewer batches: neighbours of at most ``limit`` bytes together become one."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and the end id, cut at ``length``."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(tokenizer)
        for batch in together(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start:start + length]
                    for column, x in zip(rows, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def lower_bound(lengths: np.ndarray, counts: np.ndarray, size: int = LENGTH) -> int:
    """The most that the dual feasible functions u(k) and U(e) prove for a histogram of lengths: bins that any packing needs."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if not counts.sum():
        return 0
    best = -(-int((lengths * counts).sum()) // size)
    for k in range(1, 41):  # u(k): x if (k+1)x is whole, else floor((k+1)x)/k
        whole = (k + 1) * lengths % size == 0
        value = np.where(whole, lengths * k, (k + 1) * lengths // size * size)
        best = max(best, -(-int((value * counts).sum()) // (size * k)))
    order = np.argsort(lengths)
    ls, cs = lengths[order], counts[order]
    sums, many = np.concatenate([[0], np.cumsum(ls * cs)]), np.concatenate([[0], np.cumsum(cs)])
    e = np.unique(ls[ls <= size // 2])  # U(e): 1 above size - e, nothing below e, the length between
    low, high = np.searchsorted(ls, e, "left"), np.searchsorted(ls, size - e, "right")
    if len(e):
        best = max(best, int((many[-1] - many[high] + -(-(sums[high] - sums[low]) // size)).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's room: the longest first, into the fullest bin that can hold it.

    Bins with the same room are a stack; a bit per room value finds the smallest one that is large enough.
    """
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        above = rooms >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << free)
        else:
            b, free = len(room), size
            room.append(size)
        bins[i], offsets[i] = b, size - free
        left = free - need
        room[b] = left
        stacks.setdefault(left, []).append(b)
        rooms |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def _pack(size: int):
    def run(key, t):
        keys = t.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        lengths = t.column("length").to_numpy()[order]
        bins, offsets, room = best_fit_decreasing(lengths, size)
        values, counts = np.unique(lengths, return_counts=True)
        n = len(keys)
        return pa.table({
            "key": pa.array(keys[order], pa.int64()), "length": pa.array(lengths, pa.int64()),
            "group": pa.array(np.full(n, key[0].as_py()), pa.int64()), "bin": pa.array(bins, pa.int64()),
            "offset": pa.array(offsets, pa.int64()), "room": pa.array(room[bins], pa.int64()),
            "bound": pa.array(np.full(n, lower_bound(values, counts, size)), pa.int64()),
        })

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs(doc_id, text)``.

    A null or empty text is one piece of the end id alone. Repeated rows are packed each. An empty table gives no rows.
    Lengths alone decide; the histogram that the driver sees has at most ``length`` rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(
        token_pieces(docs, tokenizer, length).withColumn("key", F.monotonically_increasing_id())
    )
    parts = pieces.where(F.col("length") < length).select("key", "length")
    histogram = parts.groupBy("length").count().collect()
    bound = lower_bound(
        np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), length
    )
    rows = sum(r["count"] for r in histogram)
    schema = "key long, length long, group long, bin long, offset long, room long, bound long"
    placed, done, step, before = [], 0, 0, None
    while rows:
        groups = -(-rows // GROUP_ROWS)
        group = F.pmod(F.xxhash64("key", F.lit(step)), F.lit(groups))
        packed = scratch.write(
            parts.groupBy(group.alias("group")).applyInArrow(_pack(length), schema).withColumn("step", F.lit(step))
        )
        per = packed.groupBy("group").agg(F.max("bin").alias("last"), F.max("bound").alias("bound"))
        used = per.agg(F.sum(F.col("last") + 1)).first()[0]
        if before is not None and used >= before[1]:  # the round gained nothing: its input stays as it was
            placed.append(before[0])
            break
        full = packed.where("room = 0")
        closed = full.select("group", "bin").distinct().count()
        if groups == 1 or done + used == bound:
            placed.append(packed)
            break
        placed.append(full)
        done += closed
        before = (packed.where("room > 0"), used - closed)
        parts, rows = before[0].select("key", "length"), before[0].count()
        if rows > 0.9 * groups * GROUP_ROWS and step:
            placed.append(before[0])
            break
        step += 1
    place = pieces.where(F.col("length") >= length).select(
        "key", (F.col("key") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    for p in placed:
        one = F.shiftleft(F.col("step").cast("long"), 56) + F.shiftleft(F.col("group"), 28) + F.col("bin")
        place = place.union(p.select("key", one.alias("sequence_id"), "offset"))
    return pieces.join(place, "key").drop("key")


@query("op7_pack")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
