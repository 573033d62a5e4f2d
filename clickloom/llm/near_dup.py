"""Near-duplicate groups by HyperMinHash: compressed registers, banding, corrected estimates, then exact checks.

A document's set holds its distinct five-word shingles (the whole word sequence if it is shorter), each as a 64-bit
hash of lower-cased words. Each of ``REGISTERS`` hash functions keeps the leading-zero count (6 bits) and the next 10
mantissa bits of its smallest value, as HyperMinHash does. Equal sets collapse first. Bands of five registers bring
candidates together; two sets as similar as the limit miss all 32 bands with a chance of about 1e-8.

- Buckets of up to ``PAIR_BUCKET`` sets give candidate pairs. The share of equal registers, corrected for chance
  collisions of compressed registers, must reach the limit less five standard errors; full sets then decide.
- Larger buckets join into clusters (components over buckets). Each set of a cluster is first held, whole, against the
  bucket leader it shares most bands with; the largest group linked that way is the cluster's trunk, whose members need
  no comparison with each other. The rest are compared with the rest and with the trunk, block against block, on full
  sets. A block task returns a spanning forest of its links. So a group of copies costs about one comparison per copy,
  and never becomes a table of all pairs.

Both ways are exact on the candidates; the bucket size only chooses between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, mix64, query, table, text_slices, tidy, word_hashes
from clickloom.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
PAIR_BUCKET = 40
#: Documents, and shingles, of a block of a large cluster.
BLOCK_DOCS, BLOCK_SHINGLES = 400, 250_000

_A = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix64(_A ^ np.uint64(0x5851F42D4C957F2D))
_C = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for first, end, data, offsets in text_slices(texts):
        words, rows = word_hashes(data, offsets)
        bounds = np.searchsorted(rows, np.arange(end - first + 1))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            w = words[lo:hi]
            if len(w) == 0:
                yield w
            elif len(w) < size:
                h = np.uint64(len(w))
                for x in w:
                    h = mix64(np.array([h ^ x]) * _C[0])[0]
                yield np.array([h])
            else:
                h = w[: len(w) - size + 1] * _C[0]
                for k in range(1, size):
                    h = h + w[k: len(w) - size + 1 + k] * _C[k]
                h = np.sort(mix64(h))
                yield h[np.concatenate([[True], h[1:] != h[:-1]])]


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa bits of the smallest value under each hash function, 16 bits each."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at:at + 512, None]
        low = np.minimum(low, (x * _A + _B).min(axis=0))
    return compress(low)


def compress(low: np.ndarray) -> np.ndarray:
    # The exponent of a float is exact up to rounding at 2**53, so the bits are taken by integer steps.
    zeros, x = np.zeros(low.shape, np.uint64), low.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < (np.uint64(1) << np.uint64(64 - step))
        zeros += np.where(small, np.uint64(step), np.uint64(0))
        x = np.where(small, x << np.uint64(step), x)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that the registers of two disjoint sets of these sizes agree.

    A smallest value has density n(1-x)^(n-1). In octave l all mantissa cells are d_l wide, and the chance of a common
    cell is d_l times the integral of the product of both densities.
    """
    n_a, n_b = np.maximum(n_a, 1).astype(float)[:, None], np.maximum(n_b, 1).astype(float)[:, None]
    octave = np.arange(54, dtype=float)
    high, low = 0.5 ** octave, 0.5 ** (octave + 1)
    width = low / (1 << MANTISSA)
    power = n_a + n_b - 1
    upper = np.where(high < 1, np.exp(power * np.log1p(-np.minimum(high, 1 - 1e-12))), 0.0)
    mass = np.exp(power * np.log1p(-low)) - upper
    return np.clip((width * n_a * n_b / power * mass).sum(axis=1), 0, 0.5)


def estimate(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    equal = (reg_a == reg_b).mean(axis=1)
    chance = collision_rate(n_a, n_b)
    return (equal - chance) / (1 - chance)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp, registers) of every row; fp is equal for equal sets, null without words."""

    def run(batches):
        for batch in batches:
            n, fp, regs = [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                if len(s):
                    fp.append(np.array([mix64(s ^ k).sum(dtype=np.uint64) for k in (_A[0], _A[1])]).tobytes())
                    regs.append(registers(s).tobytes())
                else:
                    fp.append(None)
                    regs.append(None)
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()),
            ], ["doc_id", "n_shingles", "fp", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, n_shingles long, fp binary, registers binary"
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, n, shingles): the sets themselves, six bytes of each hash."""

    def run(batches):
        for batch in batches:
            sets = [s >> np.uint64(16) for s in shingle_sets(batch.column("text"))]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_pack(s) for s in sets], pa.binary()),
            ], ["id", "n", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "id long, n long, shingles binary")


def _pack(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view(np.uint64)


def _linked(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over the shingles both lists have."""
    values = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    shared = np.intersect1d(values[0], values[1])
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    cols, sides = [], []
    for v, o in zip(values, owners, strict=True):
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        order = np.argsort(at[hit], kind="stable")
        cols.append(at[hit][order])
        sides.append(o[hit][order])
    for lo in range(0, len(shared), 4096):
        m = []
        for c, o, x in zip(cols, sides, (a, b), strict=True):
            i, j = np.searchsorted(c, (lo, lo + 4096))
            dense = np.zeros((len(x), min(4096, len(shared) - lo)), np.float32)
            dense[o[i:j], c[i:j] - lo] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out


def _forest(pairs, size: int) -> list[tuple[int, int]]:
    root, kept = list(range(size)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept.append((x, y))
    return kept


def _block_links(percent: int):
    def run(key, t):
        left, right = key[1].as_py(), key[2].as_py()
        own, ids, n = (t.column(c).to_numpy() for c in ("block", "id", "n"))
        sets = [_unpack(b.as_py()) for b in t.column("shingles")]
        a = np.flatnonzero(own == left)
        b = a if left == right else np.flatnonzero(own == right)
        inter = _intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.int64)
        hit = _linked(inter, n[a][:, None], n[b][None, :], percent)
        pairs = ((a[x], b[y]) for x, y in zip(*np.nonzero(hit), strict=True) if a[x] != b[y])
        kept = _forest(pairs, len(ids))
        return pa.table({
            "a": pa.array([ids[x] for x, _ in kept], pa.int64()), "b": pa.array([ids[y] for _, y in kept], pa.int64()),
        })

    return run


def _pairs_of(ids: str) -> str:
    return f"""flatten(transform({ids}, (x, i) -> transform(slice({ids}, i + 2, size({ids})),
               y -> named_struct('a', x, 'b', y))))"""


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    Sets whose intersection is at least ``percent`` of their union are linked; component_id is the smallest doc_id
    reachable. Null or wordless texts: empty set, linked with nothing. Rows that repeat a doc_id are one node. A null
    doc_id gets a null component_id and is kept. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    docs = docs.select("doc_id", "text")
    rows = scratch.write(sketch(docs))
    known = rows.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.write(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = scratch.write(
        known.select("doc_id", "n_shingles", "fp").join(classes, "fp").select("doc_id", "rep", "n_shingles")
    )
    reps = scratch.write(
        known.join(classes, "fp").where("doc_id = rep")
        .groupBy("doc_id", "fp").agg(F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
        .select(F.col("doc_id").alias("id"), "n", "registers")
    )
    width = 2 * ROWS
    keys = F.array(*[
        F.xxhash64(F.lit(i), F.substring("registers", 1 + i * width, width)) for i in range(BANDS)
    ])
    banded = reps.select("id", F.explode(keys).alias("key"))
    crowded = scratch.write(banded.groupBy("key").count().where("count > 1"))
    shared = scratch.write(banded.join(crowded, "key"))

    # Large buckets: clusters over buckets, compared whole.
    hot = shared.where(F.col("count") > PAIR_BUCKET)
    pivots = scratch.write(hot.groupBy("key").agg(F.min("id").alias("b")))
    led = hot.join(pivots, "key").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("bands"))
    led = scratch.write(led)
    cluster = scratch.write(components(led.select("a", "b"), scratch))
    star = scratch.write(
        led.where("a <> b").groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    )

    # Small buckets: pairs, estimated from registers.
    small = (
        shared.where(F.col("count") <= PAIR_BUCKET)
        .join(cluster, F.col("id") == F.col("node"), "left")
        .groupBy("key").agg(
            F.array_sort(F.collect_set("id")).alias("ids"), F.min("label").alias("lo"), F.max("label").alias("hi"),
            F.count("label").alias("in_cluster"), F.count("*").alias("n"),
        )
        .where("size(ids) > 1 AND NOT (lo <=> hi AND in_cluster = n)")  # a cluster is compared whole
        .select("ids").distinct()
    )
    pairs = small.select(F.explode(F.expr(_pairs_of("ids"))).alias("p")).select("p.a", "p.b").distinct()
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    limit = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def likely(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("r_a", "r_b"))
            near = estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= limit
            yield batch.select(["a", "b"]).filter(pa.array(near))

    sized = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    probable = scratch.write(
        pairs.join(side("a"), "a").join(side("b"), "b").where(sized)
        .mapInArrow(tidy(likely), "a long, b long")
    )
    scratch.drop(shared, crowded, pivots, led)

    # Full sets of the documents that something asks for.
    asked = scratch.write(
        probable.select(F.col("a").alias("doc_id")).union(probable.select("b")).union(cluster.select("node")).distinct()
    )
    sets = scratch.write(full_sets(docs.join(asked, "doc_id", "left_semi")).distinct())

    def confirm(batches):
        for batch in batches:
            s_a, s_b = batch.column("s_a"), batch.column("s_b")
            keep = []
            for x, y in zip(s_a, s_b, strict=True):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                keep.append(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = (
        probable.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")
        .select("a", "b", "s_a", "s_b").mapInArrow(tidy(confirm), "a long, b long")
    )
    # Clusters: every set against its leader, then what is not in the trunk against all.
    leaders = scratch.write(sets.join(star.select(F.col("b").alias("id")).distinct(), "id", "left_semi"))
    attached = scratch.write(
        star.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(leaders.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")
        .select("a", "b", "s_a", "s_b").mapInArrow(tidy(confirm), "a long, b long")
    )
    parts = components(attached, scratch)
    members = scratch.write(
        cluster.join(sets.select("id", "n"), F.col("node") == F.col("id"))
        .join(parts.select(F.col("node").alias("id"), F.col("label").alias("part")), "id", "left")
        .select("label", "id", "n", F.coalesce("part", "id").alias("part"))
    )
    part_size = scratch.write(
        members.groupBy("label", "part").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    )
    trunk = part_size.groupBy("label").agg(F.max_by("part", F.struct("docs", -F.col("part"))).alias("trunk"))

    def blocks(side: str):
        total = lambda c: F.sum(F.when(F.expr(side), F.col(c)).otherwise(0))
        return F.ceil(total("docs") / BLOCK_DOCS + total("n") / BLOCK_SHINGLES).cast("int")

    size = scratch.write(
        part_size.join(trunk, "label").groupBy("label", "trunk")
        .agg(blocks("part <> trunk").alias("rest"), blocks("part = trunk").alias("own")).where("rest > 0")
    )
    dealt = (
        members.join(size, "label").join(sets.select("id", "shingles"), "id")
        .withColumn("block", F.expr(
            "cast(if(part = trunk, rest + pmod(xxhash64(id), own), pmod(xxhash64(id), rest)) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, if(part = trunk, rest, rest + own) - 1)")))
        .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "n",
                "shingles", "block")
    )
    within = dealt.groupBy("label", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = scratch.write(near.union(within).union(several).union(attached))
    found = scratch.write(components(links, scratch))
    scratch.drop(sets, asked, size, reps, cluster, probable, links, star, leaders, attached, members, part_size)
    part = named.select("doc_id", "n_shingles", "rep").join(
        found.select(F.col("node").alias("rep"), "label"), "rep", "left"
    ).select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    rest = rows.where("fp IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return part.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query("op1_near_dup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
