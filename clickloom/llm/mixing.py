"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its weighted share of the mix, at most twice its size, and every document of the source is wanted
``target / source_size`` times. The whole part is sure. The fraction is a chance, and chances are rounded in pairs:
mass (chance times words) moves from one document to the other, in a random direction that keeps both chances fair,
until one of the two is decided. The undecided one meets the next. Blocks of documents are rounded at once; their
residuals meet in blocks of blocks, and so on, as a reduction tree. Moving mass keeps the words of a source exactly,
so a source misses its target by at most half of its last undecided document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, n_words, query, table

#: Documents, or residuals, that are rounded in one block of the tree.
FAN_IN = 48


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, place, source_size, docs, target) for each source of ``sizes(source, size)``.

    Sources in code-point order, null last, get the weights in turn and share ``share`` times all words. A target above
    ``most`` times the source's size is cut to that, and the excess goes to the others by weight until none is above.
    In order of ``most * size / weight``, the sources that reach their limit come first, so running sums find the level.
    The source table has one row per source, so its unpartitioned windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("place", F.row_number().over(in_order)).withColumn(
        "weight", F.get(cycle, (F.col("place") - 1) % len(weights))
    ).withColumn("limit", most * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("limit") / F.col("weight")), "place")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    free = F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    first = F.min(F.when(free.isNotNull(), F.struct((F.col("limit") / F.col("weight")).alias("r"), "place", "level"))).over(whole)
    return per.withColumn("first", first).select(
        "source", "place", "source_size", "docs",
        F.least("limit", F.coalesce(F.col("first.level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _chance(*of: Column) -> Column:
    """A number in [0, 1) from a hash of its arguments."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / float(1 << 52)


def _meet(seed: int):
    """The pivotal step: ``state(key, draw, size, mass, taken)`` meets the next ``item(key, draw, size, mass)``."""

    def step(state: Column, item: Column) -> Column:
        up, down = F.least(state.size - state.mass, item.mass), F.least(state.mass, item.size - item.mass)
        rise = _chance(F.lit(seed), state.draw, item.draw) * (up + down) < down

        def result(goes_on: Column, mass: Column, won: Column | None) -> Column:
            taken = state.taken if won is None else F.concat(state.taken, F.array(won))
            return F.struct(
                goes_on.key.alias("key"), goes_on.draw.alias("draw"), goes_on.size.alias("size"), mass.alias("mass"), taken.alias("taken")
            )

        return (
            F.when(rise & (state.size - state.mass <= item.mass), result(item, item.mass - (state.size - state.mass), state.key))
            .when(rise, result(state, state.mass + item.mass, None))
            .when(state.mass <= item.size - item.mass, result(item, item.mass + state.mass, None))
            .otherwise(result(state, state.mass - (item.size - item.mass), item.key))
        )

    return step


def pivotal_rounding(items: DataFrame, scratch: Scratch, seed: int = 7) -> DataFrame:
    """Keys taken up, from ``items(stratum, key, spread, size, mass, members)``, 0 <= mass <= size, size > 0.

    ``spread`` orders and deals out the items of a stratum (a hash, so that a hot stratum becomes many even blocks) and
    makes the draws, so that the outcome does not depend on how rows lie in files; ``key`` only names rows;
    ``members`` is the stratum's row count. Each block leaves its undecided item, and the tree ends with one per
    stratum, which has no partner left and goes to the nearer end.
    """
    # One tree level takes items to blocks; each next level takes blocks to blocks of blocks.
    level = items.withColumn("blocks", F.ceil(F.col("members") / FAN_IN).cast("long"))
    level = level.withColumn("block", F.pmod("spread", F.col("blocks"))).withColumn("draw", F.col("spread"))
    taken = []
    while True:
        line = F.sort_array(F.collect_list(F.struct("spread", "key", "draw", "size", "mass")))
        head = F.get(F.col("line"), 0)
        start = F.struct(
            head.key.alias("key"), head.draw.alias("draw"), head["size"].alias("size"), head.mass.alias("mass"),
            F.array().cast("array<bigint>").alias("taken"),
        )
        folded = level.groupBy("stratum", "block", "blocks").agg(line.alias("line")).select(
            "stratum", "block", "blocks",
            F.aggregate(F.slice("line", 2, F.size("line")), start, lambda s, x: _meet(seed)(_fields(s), _fields(x))).alias("s"),
        )
        folded = scratch.write(folded.select("stratum", "block", "blocks", "s.*"))
        taken.append(folded.select(F.explode("taken").alias("key")))
        if not folded.where("blocks > 1").limit(1).count():
            taken.append(folded.where("2 * mass >= size").select("key"))
            break
        level = folded.select(
            "stratum", F.floor(F.col("block") / FAN_IN).alias("block"),
            F.ceil(F.col("blocks") / FAN_IN).cast("long").alias("blocks"), F.col("block").alias("spread"), "key", "draw", "size", "mass",
        )
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out


class _fields:
    """Struct fields as attributes (``size`` and others are also Column methods)."""

    def __init__(self, column: Column):
        self.key, self.draw, self.size, self.mass = (column.getField(x) for x in ("key", "draw", "size", "mass"))
        self.column = column

    @property
    def taken(self) -> Column:
        return self.column.getField("taken")


def mix(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, key: str | None = None
) -> DataFrame:
    """doc_id, size, source_size, target, copies (0 to ``most``, whole) and key of each row of ``docs(doc_id, text, source)``.

    ``key`` names a stored column of unique longs; without it the rows get numbers of their own.

    Null text or a text without words has size 0 and its sure copies only; a null source is a source of its own, last.
    Repeated rows are rounded one by one. The draws are hashes of doc_id and size, so reruns agree. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.write(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"),
        (F.col(key) if key else F.monotonically_increasing_id()).alias("key"),
    ))
    targets = scratch.write(source_targets(sizes, weights, share, most))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = targets.withColumnRenamed("source", "of")
    rows = scratch.write(
        sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("wanted", wanted).withColumn("copies", F.floor("wanted").cast("int"))
    )
    open_rows = rows.where("size > 0 AND wanted > copies").select(
        F.col("place").alias("stratum"), "key", F.xxhash64(F.lit(seed), "doc_id", "size").alias("spread"),
        F.col("size").cast("double").alias("size"), ((F.col("wanted") - F.col("copies")) * F.col("size")).alias("mass"),
        F.col("docs").alias("members"),
    )
    up = pivotal_rounding(open_rows, scratch, seed).withColumn("up", F.lit(1))
    return rows.join(up, "key", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") + F.coalesce("up", F.lit(0))).alias("copies"), "key",
    )


@query("op8_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
