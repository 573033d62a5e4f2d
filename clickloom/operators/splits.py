"""Splits and samples by group (display), never by row.

A split is a cut in a fixed total order of the group ids, so rows are assigned by comparing their
own id with a few cut points: the rows themselves are not shuffled or joined.

A null group is a group like any other: it has its place in the hash order, and it comes first in the id order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.operators.ranks import global_position
from clickloom.session import materialise

_PREFIX_DIGITS = 3  # 4096 buckets of the hash order


def hash_key(group: str | Column, seed: int) -> Column:
    """md5 of seed and id; the null group hashes the seed alone."""
    group = F.col(group) if isinstance(group, str) else group
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), F.md5(F.lit(f"{seed}")))


def _distinct_ids(df: DataFrame, group: str) -> DataFrame:
    return df.select(F.col(group).alias("id")).distinct()


def hash_cuts(df: DataFrame, group: str, seed: int, ranks) -> tuple[int, list[tuple[int, str | None, object]]]:
    """Ids at the given ranks of the order (md5(seed:id), id).

    ``ranks`` maps the number of ids to the wanted ranks. Returns that number and a
    (rank, hash, id) triple per wanted rank; rank 0 has no id. The driver sees 4096 bucket counts
    and the cut points; only the buckets with a cut are sorted.
    """
    ids = _distinct_ids(df, group).withColumn("h", hash_key("id", seed))
    bucket = F.substring("h", 1, _PREFIX_DIGITS)
    counts = sorted((r["b"], r["n"]) for r in ids.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    ends, total = [], 0
    for _, n in counts:
        total += n
        ends.append(total)
    wanted = list(ranks(total))
    places = {}
    for rank in {min(r, total) for r in wanted if r > 0 and total > 0}:
        i = bisect_left(ends, rank)
        places[rank] = (counts[i][0], rank - (ends[i] - counts[i][1]))
    found = {}
    if places:
        local = ids.withColumn("b", bucket).where(F.col("b").isin(sorted({b for b, _ in places.values()})))
        local = local.withColumn("rn", F.row_number().over(W.partitionBy("b").orderBy("h", "id")))
        hit = F.lit(False)
        for b, rn in set(places.values()):
            hit = hit | ((F.col("b") == b) & (F.col("rn") == rn))
        found = {(r["b"], r["rn"]): (r["h"], r["id"]) for r in local.where(hit).collect()}
    cuts = []
    for rank in wanted:
        h, i = found[places[min(rank, total)]] if rank > 0 and total > 0 else (None, None)
        cuts.append((rank, h, i))
    return total, cuts


_H = "_hash"


def _with_hash(df: DataFrame, group: str, seed: int) -> DataFrame:
    """The hash as a column, so that it is computed once however many cuts look at it."""
    return df.withColumn(_H, hash_key(group, seed))


def _up_to(group: str, cut: tuple[int, str | None, object]) -> Column:
    """Whether a row of ``_with_hash`` lies at or before the cut."""
    _, h, i = cut
    if h is None:
        return F.lit(False)
    tie = F.col(group).isNull() if i is None else F.coalesce(F.col(group) <= F.lit(i), F.lit(True))
    return (F.col(_H) < h) | ((F.col(_H) == h) & tie)


def sample_groups(df: DataFrame, group: str, fraction: float, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """All rows of exactly trunc(fraction * n) groups.

    ``ids``, here and below, is a cheaper table with the same groups to take the cuts from.
    """
    _, (cut,) = hash_cuts(df if ids is None else ids, group, seed, lambda n: [math.trunc(fraction * n)])
    return _with_hash(df, group, seed).where(_up_to(group, cut)).drop(_H)


def train_valid(df: DataFrame, group: str, fraction: float = 0.8, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Adds ``part``: train for trunc(fraction * n) groups, valid for the rest."""
    _, (cut,) = hash_cuts(df if ids is None else ids, group, seed, lambda n: [math.trunc(fraction * n)])
    part = F.when(_up_to(group, cut), "train").otherwise("valid")
    return _with_hash(df, group, seed).withColumn("part", part).drop(_H)


def random_blocks(
    df: DataFrame, group: str, blocks: int, seed: int = 1, name: str = "block", ids: DataFrame | None = None
) -> DataFrame:
    """Adds a block number 1..blocks; groups are dealt out in hash order into equal blocks."""
    _, cuts = hash_cuts(df if ids is None else ids, group, seed, lambda n: [math.ceil(b * n / blocks) for b in range(1, blocks)])
    number = F.lit(1)
    for cut in cuts:
        number = number + (~_up_to(group, cut)).cast("int")
    return _with_hash(df, group, seed).withColumn(name, number).drop(_H)


def tail_validation(df: DataFrame, group: str, fraction: float, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Adds ``part``: the last ``fraction`` of the groups in hash order is valid.

    A group is valid iff its rank exceeds (1 - fraction) * n.
    """
    _, (cut,) = hash_cuts(df if ids is None else ids, group, seed, lambda n: [math.floor((1 - fraction) * n)])
    part = F.when(_up_to(group, cut), "train").otherwise("valid")
    return _with_hash(df, group, seed).withColumn("part", part).drop(_H)


def first_groups(df: DataFrame, group: str, stratum: str, rows: int, seed: int = 1) -> DataFrame:
    """Of every stratum, the rows of its first groups in hash order: as many whole groups as have at most ``rows`` rows.

    One aggregate counts all strata's rows in 4096 buckets of the hash order. Buckets below a stratum's cut are taken by
    comparing the hash; only the bucket of the cut, 1/4096 of the stratum, is put in order. A null group or stratum is
    one like any other.
    """
    spread = df.withColumns({_H: hash_key(group, seed), "_b": F.substring(hash_key(group, seed), 1, _PREFIX_DIGITS)})
    counts = spread.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_cut")).agg(F.count("*").alias("_n"))
    # At most 4096 rows of counts for a stratum.
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_s").orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).where(F.col("_before") < rows)
    cuts = last.groupBy("_s").agg(F.max_by(F.struct("_cut", "_before"), "_cut").alias("c")).select("_s", "c.*")
    cuts = materialise(cuts)  # one row for a stratum, used twice
    near = spread.join(cuts, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_b") <= F.col("_cut"))
    sizes = near.where(F.col("_b") == F.col("_cut")).groupBy("_s", "_before", _H, F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    order = W.partitionBy("_s").orderBy(_H, "_g").rowsBetween(W.unboundedPreceding, 0)
    fits = sizes.withColumn("_end", F.col("_before") + F.sum("_n").over(order)).where(F.col("_end") <= rows)
    known = fits.select(F.col("_s").alias("_fs"), F.col("_g").alias("_fg"))
    same = F.col(stratum).eqNullSafe(F.col("_fs")) & F.col(group).eqNullSafe(F.col("_fg"))
    edge = near.where(F.col("_b") == F.col("_cut")).join(known, same, "left_semi")
    return near.where(F.col("_b") < F.col("_cut")).select(df.columns).unionByName(edge.select(df.columns))


def ordered_cuts(df: DataFrame, group: str, ranks) -> list:
    """Ids at the given ranks of the id order, nulls left out.

    The ids get their positions from range partitions, so no task holds more than its range, however
    many ids there are and however unevenly they lie.
    """
    ids = _distinct_ids(df, group).where("id IS NOT NULL")
    placed = global_position(ids, [F.asc("id")], "rank")
    total = placed.count()
    if not total:
        return []
    wanted = [min(max(r, 1), total) for r in ranks(total)]
    found = {r["rank"]: r["id"] for r in placed.where(F.col("rank").isin(sorted(set(wanted)))).collect()}
    return [found[r] for r in wanted]


def ordered_blocks(df: DataFrame, group: str, blocks: int, name: str = "block") -> DataFrame:
    """Adds a block number 1..blocks in id order, equal in groups."""
    cuts = ordered_cuts(df, group, lambda n: [math.ceil(b * n / blocks) for b in range(1, blocks)])
    number = F.lit(1)
    for cut in cuts:
        number = number + F.coalesce(F.col(group) > F.lit(cut), F.lit(False)).cast("int")
    return df.withColumn(name, number)


def ordered_sub_blocks(df: DataFrame, group: str, blocks: int, sub_blocks: int) -> DataFrame:
    """Blocks in id order and, inside each, sub-blocks in id order.

    With m groups in a block, sub-block s ends at its local rank ceil(s * m / sub_blocks).
    """

    def ranks(n: int) -> list[int]:
        out = []
        for b in range(1, blocks + 1):
            start, end = math.ceil((b - 1) * n / blocks), math.ceil(b * n / blocks)
            out += [start + math.ceil(s * (end - start) / sub_blocks) for s in range(1, sub_blocks + 1)]
        return out

    cuts = ordered_cuts(df, group, ranks)
    step = F.lit(0)
    for cut in cuts[:-1]:
        step = step + F.coalesce(F.col(group) > F.lit(cut), F.lit(False)).cast("int")
    df = df.withColumn("_step", step)
    return df.select(
        *[c for c in df.columns if c != "_step"],
        (F.call_function("div", F.col("_step"), F.lit(sub_blocks)) + 1).cast("int").alias("block"),
        (F.col("_step") % sub_blocks + 1).cast("int").alias("sub_block"),
    )


def hash_ranks(df: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, rank) of every distinct group in hash order.

    A hash prefix splits the order into 4096 even buckets: a window inside each, plus the bucket's
    offset from a 4096-row table.
    """
    ids = df.select(group).distinct().withColumn("_h", hash_key(group, seed))
    ids = ids.withColumn("_b", F.substring("_h", 1, _PREFIX_DIGITS))
    counts = ids.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_b", before.alias("_before"))
    local = F.row_number().over(W.partitionBy("_b").orderBy("_h", group))
    return (
        ids.withColumn("_rn", local)
        .join(F.broadcast(offsets), "_b")
        .select(group, (F.col("_before") + F.col("_rn")).alias("rank"))
    )


def kfold(df: DataFrame, group: str, folds: int, seed: int = 1) -> DataFrame:
    """Adds ``fold`` 0..folds-1: rank in hash order modulo folds, so fold sizes differ by one at most."""
    ranks = hash_ranks(df, group, seed).select(F.col(group).alias("_g"), (F.col("rank") % folds).cast("int").alias("fold"))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def day_balanced(
    df: DataFrame, group: str, day: str, split_day: int = 12, fraction: float = 0.8, seed: int = 1
) -> DataFrame:
    """Early groups cut to the number of late groups, then split into train and valid.

    Only rows of the kept groups come back; ``part`` tells the side. ``df`` is computed once, and the cuts are looked for in
    a table of its groups.
    """
    df = materialise(df)
    days = df.groupBy(group).agg(F.max((F.col(day) >= split_day).cast("int")).alias("_late"),
                                 F.max((F.col(day) < split_day).cast("int")).alias("_early"))
    days = materialise(days)
    n_late = days.where("_late = 1").count()
    early = days.where("_early = 1")
    _, (cut,) = hash_cuts(early, group, seed, lambda n: [min(n, n_late)])
    kept = _with_hash(days, group, seed).where((F.col("_late") == 1) | ((F.col("_early") == 1) & _up_to(group, cut)))
    kept = kept.select(group)
    return train_valid(df.join(kept, group, "left_semi"), group, fraction, seed, ids=kept)


def row_capped(df: DataFrame, group: str, cap: int, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Groups sampled so that about ``cap`` rows remain; the table itself when it is smaller."""
    rows = df.count()
    return df if rows <= cap else sample_groups(df, group, cap / rows, seed, ids)


def accumulate_to_cap(batch_sizes: DataFrame, batch: str, rows: str, cap: int) -> DataFrame:
    """The shortest run of leading batches whose row count exceeds the cap (one row per batch in, so small)."""
    w = W.orderBy(batch)
    before = F.coalesce(F.sum(rows).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        batch_sizes.withColumn("before", before)
        .where(F.col("before") <= cap)
        .select(batch, rows, (F.col("before") + F.col(rows)).alias("running"))
    )


def take_batches(df: DataFrame, batch: str, keep: Sequence[int]) -> DataFrame:
    return df.where(F.col(batch).isin(list(keep)))
