"""The feature matrix: profiles, document scores and leader values joined onto impressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators.profiles import CLICK_STATS, VIEW_STATS
from clickloom.operators.ranks import global_position
from clickloom.plans.wide import AD_KEYS, PAGE_KEYS

#: The columns that name a row of the wide table.
ROW = ("display_id", "ad_id")
#: Profile rows that one insertion broadcasts at most, all its keys together: some 50 MB of 25 statistics and a key each.
SMALL_PROFILES = 200_000
#: Large keys that are joined directly: a row moves once for each, with what was found before.
FEW_KEYS = 2
VIEW_AD_KEYS = tuple(f"ad_{k}" for k in PAGE_KEYS if k != "uuid")
DOC_KINDS = {"topic": ("topics", 8), "entity": ("entities", 8), "category": ("categories", 2)}


def lookup(
    df: DataFrame, profiles: DataFrame, keys: Mapping[str, str], stats: Sequence[str], infix: str = "", row: Sequence[str] = ROW
) -> DataFrame:
    """(row key, ``<column><infix>_<stat>`` ...): the long-form profile of every key of every row, null where it has none.

    ``keys`` maps a column of ``df`` to the ``key_name`` it is looked up under; null keys match the null profile. The keys
    are stacked, so there is one join however many they are, and what it moves is a row key and one value at a time, never
    the wide row; a hot key value meets one profile row, so adaptive execution can split it. The values found are gathered
    by row key, at most ``len(keys)`` of them. Rows that repeat whole share a result; two rows with one row key and
    different values of a key are an error.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(name).alias("name"), F.col(c).cast("string").alias("value"))
        for i, (c, name) in enumerate(keys.items())
    ])
    long = df.select(*row, F.explode(cells).alias("_c"))
    table = profiles.select(F.col("key_name").alias("_name"), F.col("key_value").alias("_value"), F.struct(*stats).alias("_found"))
    found = long.join(table, (F.col("_c.name") == F.col("_name")) & F.col("_c.value").eqNullSafe(F.col("_value")), "left")
    entry = F.struct(F.col("_c.slot").alias("slot"), F.col("_found").alias("found"))
    by_slot = found.groupBy(*row).agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("_m"))
    return by_slot.select(*row, *[F.col("_m")[i][s].alias(f"{c}{infix}_{s}") for i, c in enumerate(keys) for s in stats])


def attach(df: DataFrame, found: DataFrame, row: Sequence[str] = ROW) -> DataFrame:
    """The columns of ``found`` put onto the rows with its row key; null ids match each other."""
    named = found.withColumnsRenamed({c: f"_row_{c}" for c in row})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_row_{c}")) for c in row])
    return df.join(named, same, "left").drop(*[f"_row_{c}" for c in row])


def insert_profiles(
    df: DataFrame, profiles: DataFrame, keys: Mapping[str, str], stats: Sequence[str], infix: str = "", row: Sequence[str] = ROW,
    small: int = SMALL_PROFILES,
) -> DataFrame:
    """Join the long-form profile of each key onto the rows as ``<column><infix>_<stat>``, 0 where missing.

    ``keys`` maps a column of ``df`` to the ``key_name`` it is looked up under. Null keys match the null profile. The
    profiles are counted first: the smallest, of at most ``small`` rows together, are broadcast, so the rows do not move;
    one or two other keys are joined one after the other, which moves less than their values by row key would; more go
    through one ``lookup``, after which the rows move once. ``row`` need name a row only for those.
    """
    counts = {r["key_name"]: r["count"] for r in profiles.groupBy("key_name").count().collect()}  # a handful of key names
    left, sent, added = small, [], []
    for column in sorted(keys, key=lambda c: counts.get(keys[c], 0)):
        left -= counts.get(keys[column], 0)
        if left >= 0:
            sent.append(column)
    rest = {c: n for c, n in keys.items() if c not in sent}
    if len(rest) > FEW_KEYS:
        found = lookup(df, profiles, rest, stats, infix, row)
        df = attach(df, found, row)
        added += [c for c in found.columns if c not in row]
        rest = {}
    found, have = [], df.columns
    for i, column in enumerate([*rest, *sent]):
        # What is found travels as one field through the joins that follow, which copy a row field by field.
        one = profiles.where(F.col("key_name") == keys[column]).select(F.col("key_value").alias("_key"), F.struct(*stats).alias(f"_found_{i}"))
        one = one if column in rest else F.broadcast(one)
        df = df.join(one, F.col(column).cast("string").eqNullSafe(F.col("_key")), "left").drop("_key")
        found += [F.col(f"_found_{i}")[s].alias(f"{column}{infix}_{s}") for s in stats]
        added += [f"{column}{infix}_{s}" for s in stats]
    return df.select(*have, *found).fillna(0, subset=added)  # one projection for all joins


CLICK_KEYS = {k: k for k in (*PAGE_KEYS, *AD_KEYS)}


def insert_click_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """11 statistics of each of the 10 keys."""
    return insert_profiles(df, profiles, CLICK_KEYS, CLICK_STATS)


def insert_view_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """25 page-view statistics of 5 page keys, and the same tables again for 4 ad keys."""
    keys = {k: k for k in PAGE_KEYS} | {k: k.removeprefix("ad_") for k in VIEW_AD_KEYS}
    return insert_profiles(df, profiles, keys, VIEW_STATS, infix="_pgvw")


def leader_columns(df: DataFrame, group: str, score: str, item: str, columns: Sequence[str], prefix: str = "clk1_") -> DataFrame:
    """Columns of the group's best item (highest score, lowest id) repeated on all rows of the group.

    The best item's columns come out of the aggregate itself, combined map-side, and are joined back once. A null group
    has no leader and its rows go.
    """
    order = F.struct(F.col(score), (-F.col(item)).alias("n"))
    best = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(F.struct(*columns), order).alias("_best"))
    return df.join(best.select(group, *[F.col(f"_best.{c}").alias(prefix + c) for c in columns]), group)


def document_numerics() -> list[str]:
    """Weighted scores (both roles) and the first page-role type rates of each document table."""
    out = []
    for kind, (plural, k) in DOC_KINDS.items():
        out += [f"{plural}_prob", f"ad_{plural}_prob", *[f"{kind}_prob_{i}" for i in range(1, k + 1)]]
    return out


def key_numerics() -> list[str]:
    """Profile statistics used as features: no clicks, and no smallest gap for page keys."""
    kept = [s for s in CLICK_STATS if s != "clicks"]
    page = [f"{k}_{s}" for k in PAGE_KEYS for s in kept if s != "gap_min"]
    return page + [f"{k}_{s}" for k in AD_KEYS for s in kept]


def view_numerics() -> list[str]:
    return [f"{k}_pgvw_{s}" for k in (*PAGE_KEYS, *VIEW_AD_KEYS) for s in VIEW_STATS]


def tree_numerics() -> list[str]:
    return ["day", "hour", "publish_ts", "ad_publish_ts", *document_numerics(), *key_numerics(), *view_numerics()]


def leader_numerics() -> list[str]:
    return [c for c in tree_numerics() if c.startswith("ad_")]


DUMMIES = ("platform1", "platform2", "platform3", "countryUS", "countryCA", "countryGB", "countryRest")


def tree_features() -> list[str]:
    return [*tree_numerics(), *[f"clk1_{c}" for c in leader_numerics()], *DUMMIES, "num_ads"]


def tree_matrix(df: DataFrame, label: str = "clicked", only: Sequence[str] | None = None) -> DataFrame:
    """Label, then every feature as double, then the keys.

    ``df`` holds the inserted profiles; ``only`` keeps the named features (a model's own list).
    The leader is the ad with the highest ``ad_id_prob``.
    """
    wanted = [c for c in tree_features() if only is None or c in set(only)]
    lead = [c for c in leader_numerics() if f"clk1_{c}" in wanted]
    if lead:
        df = leader_columns(df, "display_id", "ad_id_prob", "ad_id", lead)
    dummies = dict(zip(DUMMIES, [*S.platform_dummies(), *S.country_dummies()], strict=True))
    label_col = F.coalesce(F.col(label), F.lit(0)) if label in df.columns else F.lit(0)
    cols = [(dummies[c] if c in dummies else F.col(c)).cast("double").alias(c) for c in wanted]
    return df.select(label_col.cast("double").alias(label), *cols, "display_id", "ad_id")


# --- scaling ---------------------------------------------------------------------------------


def scaling_statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    """Min, max, mean and sample deviation of every column from one aggregate; one small row reaches the driver."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"), F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|sd")]
    row = df.agg(*aggs).first()
    return {c: {s: row[f"{c}|{s}"] for s in ("min", "max", "mean", "sd")} for c in columns}


def _scaled(c: str, shift: float | None, width: float | None):
    """(x - shift) / width, null when the column is constant."""
    if shift is None or not width:
        return F.lit(None).cast("double")
    return (F.col(c).cast("double") - F.lit(shift)) / F.lit(width)


def minmax(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    st = scaling_statistics(df, columns)
    width = {c: None if st[c]["max"] is None else st[c]["max"] - st[c]["min"] for c in columns}
    return df.select(*keep, *[_scaled(c, st[c]["min"], width[c]).alias(c) for c in columns])


def zscore(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    st = scaling_statistics(df, columns)
    return df.select(*keep, *[_scaled(c, st[c]["mean"], st[c]["sd"]).alias(c) for c in columns])


def category_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): codes 1.. in value order per column (numbers by size, texts by text).

    Levels are numbered by range partitions, so a column with billions of levels stays off the driver.
    """
    kinds = dict(df.dtypes)
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.lit(None).cast("double") if kinds[c] == "string" else F.col(c).cast("double")).alias("num"),
            F.col(c).cast("string").alias("value"),
        )
        for c in columns
    ])
    levels = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    placed = global_position(levels, [F.col("column"), F.col("num"), F.col("value")], "pos")
    starts = placed.groupBy("column").agg((F.min("pos") - 1).alias("start"), F.count("*").alias("levels"))
    return placed.join(F.broadcast(starts), "column").select(  # one row per column
        "column", "value", (F.col("pos") - F.col("start")).alias("code"), "levels"
    )


def category_codes(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str], row: Sequence[str] | None = None, small: int = SMALL_PROFILES
) -> DataFrame:
    """Columns replaced by their level codes; null gets a level of its own after the others.

    ``row`` names the row key, all kept columns unless given. Rows that keep more than that meet the levels as
    ``insert_profiles`` says, so a row moves for a column of many levels only; of the others ``lookup`` says what ``row`` has to
    tell apart.
    """
    row = list(keep if row is None else row)
    levels = category_levels(df, columns)
    counts = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.max("levels").alias("n")).collect()}
    named = levels.withColumnsRenamed({"column": "key_name", "value": "key_value"})
    if set(keep) <= set(row):
        found = lookup(df, named, {c: c for c in columns}, ["code"], row=row)
    else:
        found = insert_profiles(df.select(*keep, *columns), named, {c: c for c in columns}, ["code"], row=row, small=small)
    # Codes begin at 1: one that was not found is null or 0.
    codes = [F.coalesce(F.nullif(f"{c}_code", F.lit(0)), F.lit(counts.get(c, 0) + 1)).alias(c) for c in columns]
    return found.select(*keep, *codes)


def bayes_matrix(
    df: DataFrame, categories: Sequence[str], numerics: Sequence[str], label: str = "clicked",
    insert: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Label, z-scored numerics and category codes, with the keys.

    ``insert`` puts those numerics onto rows that ``df`` does not have; it may not need the categories. It gets the rows when they
    have their codes, so that the rows are narrow when they move for these.
    """
    keys, insert = ["display_id", "ad_id"], insert or (lambda rows: rows)
    st = scaling_statistics(insert(df), numerics)
    coded = insert(category_codes(df, categories, [c for c in df.columns if c not in categories], keys))
    scaled = [_scaled(c, st[c]["mean"], st[c]["sd"]).alias(c) for c in numerics]
    return coded.select(*keys, label, *scaled, *categories)


def sequence_matrix(
    df: DataFrame, numerics: Sequence[str], label: str = "clicked", insert: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Rows numbered by time with min-max numerics and dummies.

    ``insert`` puts those numerics onto rows that ``df`` does not have, once they are numbered, so that they do not move.
    """
    insert = insert or (lambda rows: rows)
    df = df.fillna(0, subset=[c for c in ("publish_ts", "ad_publish_ts") if c in df.columns])
    st = scaling_statistics(insert(df), numerics)
    scaled = [_scaled(c, st[c]["min"], st[c]["max"] - st[c]["min"]).alias(c) for c in numerics]
    placed = insert(global_position(df, [F.asc_nulls_last("ts"), F.asc("display_id"), F.asc("ad_id")]))
    return placed.select("display_id", "ad_id", "ts", label, *scaled, *S.platform_dummies(), *S.country_dummies(), "position")


# --- sequences --------------------------------------------------------------------------------


def to_sequences(df: DataFrame, group: str, order_by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per group: its length and the array of its rows' feature arrays, in order."""
    row = F.struct(*order_by, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    rows = F.array_sort(F.collect_list(row))
    return df.groupBy(group).agg(rows.alias("rows")).select(
        group, F.size("rows").alias("seq_len"), F.transform("rows", lambda r: r["x"]).alias("x")
    )


def flatten_sequences(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Inverse: one row per step with its 0-based position."""
    steps = df.select(group, F.posexplode("x").alias("step", "v"))
    return steps.select(group, "step", *[F.element_at("v", i + 1).alias(c) for i, c in enumerate(features)])


def to_categorical(label: str):
    return F.array(1 - F.col(label), F.col(label))


def feature_summary(df: DataFrame, columns: Sequence[str], scale: Mapping[str, float] | None = None) -> DataFrame:
    """Per feature: rows, non-zero rows, extremes, mean, and a mean weighted by the row's keys.

    Columns are stacked and aggregated map-side, which stays in generated code for hundreds of columns.
    """
    scale = scale or {}
    cells = F.array(*[F.col(c).cast("double") / F.lit(float(scale.get(c, 1))) for c in columns])
    w = ((F.col("display_id") + F.col("ad_id")) % 7).alias("w")
    long = df.select(w, F.posexplode(cells).alias("i", "v"))
    sums = long.groupBy("i").agg(
        F.count("v").alias("n"), F.count_if(F.col("v") != 0).alias("nonzero"), F.min("v").alias("low"),
        F.max("v").alias("high"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("w")).alias("mix"),
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return sums.select(name.alias("feature"), "n", "nonzero", "low", "high", "mean", "mix")
