"""Topics, entities and categories of documents rolled up into click scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clickloom.operators.joins import keep_known
from clickloom.session import materialise


def document_click_rates(wide: DataFrame, label: str = "clicked") -> DataFrame:
    """Click rate of each document in its page role and in its ad role, 0 where it has none.

    Both roles are stacked and grouped once, which equals the full outer join of two rate tables.
    """
    roles = F.array(
        F.struct(F.col("document_id").alias("document_id"), F.col(label).alias("page"), F.lit(None).cast("int").alias("ad")),
        F.struct(F.col("ad_document_id").alias("document_id"), F.lit(None).cast("int").alias("page"), F.col(label).alias("ad")),
    )
    rows = wide.select(F.explode(roles).alias("r")).select("r.*")
    zero = F.lit(0.0)
    return rows.groupBy("document_id").agg(
        F.coalesce(F.avg("page"), zero).alias("docprob"), F.coalesce(F.avg("ad"), zero).alias("ad_docprob")
    )


def with_document_rates(types: DataFrame, rates: DataFrame) -> DataFrame:
    return types.join(rates, "document_id", "left").fillna(0, subset=["docprob", "ad_docprob"])


def type_rates(typed: DataFrame) -> DataFrame:
    """Per type: sum(document rate * confidence) / number of rows, for both roles."""
    def rate(c: str):
        return F.sum(F.col(c) * F.col("confidence_level")) / F.count("*")

    return typed.groupBy("type_id").agg(rate("docprob").alias("type_prob"), rate("ad_docprob").alias("ad_type_prob"))


def rated_types(typed: DataFrame) -> DataFrame:
    """Every (document, type) row with the rates of its type."""
    return typed.join(type_rates(typed), "type_id")


def document_scores(rated: DataFrame) -> DataFrame:
    """Per document: sum(type rate * confidence), for both roles."""
    def score(c: str):
        return F.sum(F.col(c) * F.col("confidence_level"))

    return rated.groupBy("document_id").agg(
        score("type_prob").alias("types_prob"), score("ad_type_prob").alias("ad_types_prob")
    )


def top_type_pivot(rated: DataFrame, k: int, name: str) -> DataFrame:
    """Rates of the k most confident types of each document as columns ``name_prob_1`` .. k and ``ad_name_prob_1`` .. k.

    The rank filter lets Spark cut every map task's output to k rows per document before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("confidence_level"), "type_id"))
    top = rated.select("document_id", "type_prob", "ad_type_prob", rank.alias("rn")).where(F.col("rn") <= k)
    cells = []
    for source, prefix in (("type_prob", ""), ("ad_type_prob", "ad_")):
        cells += [
            F.coalesce(F.max(F.when(F.col("rn") == i, F.col(source))), F.lit(0.0)).alias(f"{prefix}{name}_prob_{i}")
            for i in range(1, k + 1)
        ]
    return top.groupBy("document_id").agg(*cells)


def types_per_document(types: DataFrame, wide: DataFrame) -> DataFrame:
    """Most, fewest and mean number of types per document: all, page and ad documents."""
    sizes = types.groupBy("document_id").agg(F.count("*").alias("n"))
    ads = wide.select(F.col("ad_document_id").alias("document_id"))
    roles = {"all": sizes, "page": keep_known(sizes, wide, "document_id"), "ad": keep_known(sizes, ads, "document_id")}
    parts = [
        df.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean")).select(F.lit(role).alias("role"), "*")
        for role, df in roles.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def document_features(types: DataFrame, rates: DataFrame, name: str, plural: str, k: int) -> DataFrame:
    """One row per document: weighted scores and top-k type rates, page columns and ``ad_`` columns."""
    # The rated rows feed two plans, so they are written once; inside, Spark reuses the shuffle of ``types``.
    rated = materialise(rated_types(with_document_rates(types, rates)))
    scores = document_scores(rated).withColumnsRenamed(
        {"types_prob": f"{plural}_prob", "ad_types_prob": f"ad_{plural}_prob"}
    )
    return scores.join(top_type_pivot(rated, k, name), "document_id")


def combine_features(tables: Sequence[DataFrame]) -> DataFrame:
    """One row per document of any of the tables, 0 where a table does not have it."""
    out = reduce(lambda a, b: a.join(b, "document_id", "full"), tables)
    return out.fillna(0, subset=[c for c in out.columns if c != "document_id"])


#: Documents whose features are sent to every task: some 40 MB of 44 rates and an id each.
SMALL_DOCUMENTS = 100_000


def insert_document_features(wide: DataFrame, features: DataFrame, small: int = SMALL_DOCUMENTS) -> DataFrame:
    """Page columns joined on document_id, ``ad_`` columns on ad_document_id; 0 where a document has no types.

    The documents are counted first: at most ``small`` of them are broadcast, so the rows do not move.
    """
    page: Sequence[str] = [c for c in features.columns if c != "document_id" and not c.startswith("ad_")]
    ad = [c for c in features.columns if c.startswith("ad_")]
    sent = F.broadcast if features.count() <= small else (lambda df: df)
    as_ad = sent(features.select(F.col("document_id").alias("ad_document_id"), F.struct(*ad).alias("_ad")))
    as_page = sent(features.select("document_id", F.struct(*page).alias("_page")))
    out = wide.join(as_page, "document_id", "left").join(as_ad, "ad_document_id", "left")
    first = [c for c in ("ad_document_id", "document_id") if c in out.columns]
    return out.select(
        *first, *[c for c in wide.columns if c not in first],
        *[F.col(f"_page.{c}").alias(c) for c in page], *[F.col(f"_ad.{c}").alias(c) for c in ad],
    ).fillna(0, subset=[*page, *ad])
