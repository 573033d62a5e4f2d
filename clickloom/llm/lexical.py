"""Ranked lexical search, term at a time with a limit on accumulators.

Statistics cover all documents. The postings of the terms that are asked for are dealt to shards of documents by a hash,
so a frequent term is spread evenly. A shard's task takes each query's terms rarest first. A term opens an accumulator
for each of its documents until the bounds of the terms still to come add up to less than the k-th partial score: from
there on no new document can reach the k best, and further terms only update the accumulators that are open. The k best
of each shard have exact scores, and a last ranking keeps the k best of all shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, query, table, tidy

#: A term: letters and digits of ASCII, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard and queries of a block, on average: a task holds the postings of one and the terms of the other.
SHARD_DOCS, BLOCK_QUERIES = 4096, 256
#: Length normalisation in hundredths, and the scale of scores.
SLOPE, SCALE = 25, 1_000_000_000
#: Stands in the postings for the document itself, with its number of terms; no term is empty.
DOCUMENT = ""


def terms(text: Column) -> Column:
    """All terms of a text in order, as written; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def lower(term: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(F.octet_length(term) == F.length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def query_terms(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, item_id, term, qtf): the distinct terms of each row of ``items(item_id, text)``, with their repeats."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    each = numbered.select("item", "item_id", F.explode(terms(F.col("text"))).alias("term"))
    return scratch.write(each.groupBy("item", "item_id", lower(F.col("term")).alias("term")).agg(F.count("*").alias("qtf")))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, doc_id, n, term_no, tf) for the terms of ``vocabulary(term, term_no)``; n counts all terms of the document.

    One pass over the texts. Occurrences are counted inside each task before they move.
    """
    found = docs.select(
        F.monotonically_increasing_id().alias("doc"), "doc_id", terms(F.col("text").cast("string")).alias("terms")
    ).select("doc", "doc_id", F.size("terms").cast("long").alias("n"), F.explode(F.array_append("terms", F.lit(DOCUMENT))).alias("term"))
    return (
        found.withColumn("term", lower(F.col("term"))).join(vocabulary, "term")
        .groupBy("doc", "doc_id", "n", "term_no").agg(F.count("*").alias("tf"))
    )


def accumulate(parts: list[tuple[np.ndarray, np.ndarray]], k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the documents 0 to ``size`` and which have an accumulator, from (documents, gains) of each term.

    Terms come rarest first. Scores of documents with an accumulator are complete; no other document can be among the k best.
    """
    score, held = np.zeros(size, np.int64), np.zeros(size, bool)
    bound = [int(gain.max(initial=0)) for _, gain in parts]
    rest, creating = sum(bound), True  # rest: what a document without an accumulator can still reach
    for (docs, gain), most in zip(parts, bound, strict=True):
        if creating:
            partial = score[held]
            creating = len(partial) < k or rest >= np.partition(partial, len(partial) - k)[len(partial) - k]
        if creating:
            held[docs] = True
        else:
            docs, gain = docs[held[docs]], gain[held[docs]]
        score[docs] += gain
        rest -= most
    return score, held


def _search(k: int):
    def run(key, posts, asked):
        term_no = posts.column("term_no").to_numpy()
        order = np.argsort(term_no, kind="stable")
        docs, at = np.unique(posts.column("doc").to_numpy(), return_inverse=True)
        ids, null = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
        ids[at] = posts.column("doc_id").fill_null(0).to_numpy()
        null[at] = posts.column("doc_id").is_null().to_numpy()
        term_no, at, impact = term_no[order], at[order], posts.column("impact").to_numpy()[order]
        items, wanted, w, df = (asked.column(c).to_numpy() for c in ("item", "term_no", "weight", "df"))
        first, last = np.searchsorted(term_no, wanted, "left"), np.searchsorted(term_no, wanted, "right")
        by_item = np.lexsort((wanted, df, items))  # rarest first
        cuts = np.flatnonzero(np.diff(items[by_item], prepend=-1, append=-1))
        out: list[list] = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            parts = [(at[first[r]:last[r]], w[r] * impact[first[r]:last[r]]) for r in by_item[a:b]]
            score, held = accumulate(parts, k, len(docs))
            found = np.flatnonzero(held & (score > 0))
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
            best = found[np.lexsort((docs[found], ids[found], null[found], -score[found]))[:k]]
            for column, x in zip(out, (np.full(len(best), items[by_item[a]]), best, score[best]), strict=True):
                column.append(x)
        item, best, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
        return pa.table({
            "item": pa.array(item, pa.int64()), "doc": pa.array(docs[best], pa.int64()),
            "doc_id": pa.array(ids[best], pa.int64(), mask=null[best]), "score": pa.array(score, pa.int64()),
        })

    def one(key, posts, asked):
        (out,) = tidy(lambda x: iter([run(key, *x)]))((posts, asked))
        return out

    return one


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of ``items(item_id, text)``.

    Equal scores go by ascending doc_id, null ids last. Repeated rows of ``docs(doc_id, text)`` are documents of their
    own and repeated items are ranked each. Null and empty texts have no terms: such documents are never found, such
    items find nothing. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = query_terms(items, scratch)
    vocabulary = asked.select("term").distinct().union(spark.range(1).select(F.lit(DOCUMENT)))
    vocabulary = scratch.write(vocabulary.withColumn("term_no", F.monotonically_increasing_id()))
    posts = scratch.write(postings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary))
    no_term = vocabulary.where(F.col("term") == DOCUMENT).first()["term_no"]
    whole = posts.where((F.col("term_no") == no_term) & (F.col("n") > 0))
    n_docs, n_terms = whole.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    real = posts.where(F.col("term_no") != no_term)
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = scratch.write(real.groupBy("term_no").agg(F.count("*").alias("df")).withColumn("weight", weight))

    shards, blocks = -(-n_docs // SHARD_DOCS), -(-asked.select("item").distinct().count() // BLOCK_QUERIES)
    if not shards or not blocks:
        return asked.where("false").select("item_id", *(F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("doc_id", "long"), ("score", "long"))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    long = lambda e: F.expr(e).cast("long")
    dealt = real.select(
        F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"), "doc", "doc_id", "term_no",
        (long(f"{100 - SLOPE} + (({SLOPE} * n * {n_docs}L) div {max(1, n_terms)}L)")).alias("m"), "tf",
    ).withColumn("impact", long(f"({SCALE}L * tf) div (1000 * tf + 12 * m)")).drop("m", "tf")
    wanted = asked.join(vocabulary, "term").join(weights, "term_no").select(
        each(shards).alias("shard"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "item", "term_no",
        (F.col("weight") * F.col("qtf")).alias("weight"), "df",
    )
    best = dealt.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(
        _search(k), "item long, doc long, doc_id long, score long"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark
), s AS (
  SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n, coalesce(sum(len(t)), 0)::BIGINT AS l FROM d
), asked AS (
  SELECT item, item_id, term, count(*) AS qtf FROM (SELECT item, item_id, unnest(t) AS term FROM q) GROUP BY ALL
), p AS (
  SELECT doc, doc_id, m, term, count(*)::BIGINT AS tf FROM (
    SELECT doc, doc_id, 75 + (25 * len(t)::BIGINT * s.n) // s.l AS m, unnest(t) AS term FROM d, s WHERE len(t) > 0
  ) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, s.n
), scored AS (
  SELECT item, item_id, doc, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN p USING (term) JOIN w USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
